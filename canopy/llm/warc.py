"""WARC archives of web pages and their merged capture index.

**Archives.** Each page becomes one WARC 1.1 record whose block is an HTTP response with the HTML in UTF-8. Of records with
equal payloads of at least ``LEAST_BYTES`` bytes the one with the largest id is a ``response``; the others are ``revisit`` records
(HTTP head only) that refer to it. Records are text, so Spark's text writer writes them, with the two line feeds that end a WARC
record as its line end and gzip as its codec: any Hadoop file system, committed task by task, safe
when executors are lost. Files hold at most ``FILE_RECORDS`` records.

**Index.** Each archive is read back whole by one task, by its records' content lengths, and every payload's digest is verified.
Its captures, sorted by URL key and timestamp, are one locally sorted run, written to the shared folder.

**External merge.** The runs are cut at sampled (URL key, timestamp, id) bounds, so a URL with any share of the captures is spread
over tasks; Spark's external sort keeps each run's part in its own order, and each task merges its k
run parts with a loser tree (one comparison per level and capture). ``merge_part``, then ``merge_pos``, is the global order
of the capture histories. A task holds one range of captures, about ``RANGE_ROWS`` rows without payloads.

Defined cases: a null page counts as empty (0 bytes, response); of repeated rows with the largest id of their payload all are
responses; a null id is a response unless an id with its payload exists; a null URL gives the key ''; an empty table
gives an empty result. Other input columns are ignored, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, written

LEAST_BYTES = 1000
FILE_RECORDS, RANGE_ROWS = 2000, 10_000
EOL, END = "\r\n", "\r\n\r\n"
FIRST_CAPTURE = 1_700_000_000
INDEX = ("url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, "
         "refers_to long, run string, seq long")
KEY = ["url_key", "captured", "page_id"]


def _lines(*lines: Column) -> Column:
    """Header lines that are not null, each ended."""
    return F.concat(F.concat_ws(EOL, *lines), F.lit(END))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            captured: Column | None = None) -> DataFrame:
    """One column ``record``: the WARC record of each page.

    ``captured`` is the capture's time in seconds; by default the table's rule, one page a second in id order.
    """
    captured = captured if captured is not None else F.coalesce(F.col(id_col), F.lit(0)) + FIRST_CAPTURE
    page = pages.select(
        F.col(id_col).cast("long").alias("id"), F.regexp_replace(url_col, "[\r\n]", "").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
        F.date_format(F.to_utc_timestamp(F.timestamp_seconds(captured), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
    ).withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    # payloads that occur more than once, and who answers for them: counted before the shuffle, one row a payload
    held = (page.where(F.col("bytes") >= LEAST_BYTES).groupBy("digest")
            .agg(F.max("id").alias("holder"), F.count("*").alias("n")).where("n > 1").select("digest", "holder"))
    typed = page.join(held, "digest", "left").withColumn("revisit", F.expr("holder IS NOT NULL AND NOT (id <=> holder)"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    head = _lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"),
                  F.concat(F.lit("Content-Length: "), F.col("bytes")))
    block = F.when(F.col("revisit"), head).otherwise(F.concat(head, F.col("html")))
    typed = typed.withColumn("block", block)
    warc = _lines(
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("id"))), F.concat(F.lit("WARC-Date: "), F.col("date")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), urn(F.col("holder")))),
        F.when(F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length("block")))
    return typed.select(F.concat(warc, F.col("block")).alias("record"))


def write_archives(pages: DataFrame, path: str, **columns) -> None:
    """Write ``pages`` as gzipped WARC files under ``path``."""
    (records(pages, **columns).write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", FILE_RECORDS).text(path))


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed archive, by content length."""
    at = 0
    while at < len(archive):
        stop = archive.index(b"\r\n\r\n", at)
        lines = archive[at:stop].decode("utf-8").split(EOL)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        begin = stop + 4
        at = begin + int(headers["Content-Length"])
        yield headers, archive[begin:at]
        if archive[at:at + 4] != b"\r\n\r\n":
            raise ValueError(f"a WARC record does not end at byte {at}")
        at += 4


def url_key(url: str) -> str:
    """The sort key of a URL: host labels reversed, no scheme, user, leading www, default port or fragment, lower case."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url.strip().lower()
    labels = host.split(".")
    labels = labels[1:] if labels[0] == "www" and len(labels) > 2 else labels
    path = (parts.path or "/") + (f"?{'&'.join(sorted(parts.query.split('&')))}" if parts.query else "")
    return f"{','.join(reversed(labels))}{f':{port}' if port and port not in (80, 443) else ''}){path}".lower() if host else url.strip().lower()


def _page(urn: str) -> int | None:
    name = urn[len("<urn:page:"):-1]
    return None if name == "none" else int(name)


def captures(archive: bytes, run: str) -> list[tuple]:
    """The index entries of one archive, verified, in order: a locally sorted run."""
    out = []
    for h, block in parse(archive):
        stop = block.index(b"\r\n\r\n")
        http = dict(x.split(": ", 1) for x in block[:stop].decode("utf-8").split(EOL)[1:])
        payload, digest = block[stop + 4:], h["WARC-Payload-Digest"].removeprefix("sha1:")
        if h["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(http["Content-Length"])):
            raise ValueError(f"the payload of {h['WARC-Record-ID']} is damaged")
        refers = _page(h["WARC-Refers-To"]) if h["WARC-Type"] == "revisit" else None
        url = h.get("WARC-Target-URI", "")
        out.append((url_key(url) if url else "", h["WARC-Date"], _page(h["WARC-Record-ID"]), int(http["Content-Length"]), digest, h["WARC-Type"], refers))
    out.sort(key=lambda e: (e[0], e[1], e[2] is not None, e[2]))
    return [(*e, run, i) for i, e in enumerate(out)]


def index_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under ``path``: one sorted run per file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                rows = captures(gzip.decompress(b.column(1)[k].as_py()), b.column(0)[k].as_py())
                yield pa.RecordBatch.from_pydict(dict(zip(out.names, zip(*rows) if rows else [[]] * len(out))), schema=out)

    out = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (f.split(" ") for f in INDEX.split(", "))])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(run, INDEX)


def loser_tree(runs: list[Iterator], key) -> Iterator:
    """Merge sorted iterators: each inner node keeps the loser of its match, the winner goes on up."""
    k = len(runs)
    done = object()
    heads = [next(r, done) for r in runs]
    keys = [None if h is done else key(h) for h in heads]

    def beats(a: int, b: int) -> bool:
        """Whether run ``a``'s head comes before run ``b``'s; an ended run loses, equals go by run."""
        if keys[a] is None or keys[b] is None:
            return keys[b] is None and (keys[a] is not None or a < b)
        return (keys[a], a) < (keys[b], b)

    # leaf i stands at place k + i of a heap; tree[1:] are the losers, tree[0] the winner
    tree, won = [0] * max(k, 1), [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = won[2 * node], won[2 * node + 1]
        won[node], tree[node] = (a, b) if beats(a, b) else (b, a)
    winner = won[1] if k > 1 else 0
    while k and keys[winner] is not None:
        yield heads[winner]
        heads[winner] = h = next(runs[winner], done)
        keys[winner] = None if h is done else key(h)
        node = (k + winner) // 2
        while node:
            if beats(tree[node], winner):
                tree[node], winner = winner, tree[node]
            node //= 2


def merge_index(runs: DataFrame, rows: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The runs' captures with ``merge_part`` and ``merge_pos``, their global order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts: list[list[tuple]] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if not parts or parts[-1][-1][7] != row[7]:
                    parts.append([])
                parts[-1].append(row)
        part, pos, batch = TaskContext.get().partitionId(), 0, []
        for row in loser_tree([iter(p) for p in parts], lambda e: (e[0], e[1], e[2] is not None, e[2] or 0)):
            batch.append((*row, part, pos))
            pos += 1
            if len(batch) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*batch), out.types)], schema=out)
                batch = []
        if batch:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*batch), out.types)], schema=out)

    schema = f"{INDEX}, merge_part int, merge_pos long"
    out = pa.schema([(n, {"string": pa.string(), "int": pa.int32()}.get(t, pa.int64())) for n, t in (f.split(" ") for f in schema.split(", "))])
    ranges = max(1, -(-rows // range_rows))
    return runs.repartitionByRange(ranges, *KEY).sortWithinPartitions("run", "seq").mapInArrow(run, schema)


def archive_and_index(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` as WARC archives in the shared folder, read them back and merge their index."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, id_col=id_col, url_col=url_col, html_col=html_col)
    runs = written(index_runs(spark, path), "runs")
    return merge_index(runs, runs.count()).select(
        F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to",
        "url_key", "captured", "merge_part", "merge_pos")
