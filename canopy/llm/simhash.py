"""SimHash near-duplicates by multi-index hashing.

**Fingerprint.** A text is lower-cased (A-Z only), split at the six ASCII
white-space bytes, and read as shingles of ``words`` words joined by one
space, repeats included; a text of fewer words gives its whole sequence, a
text without words no shingle and fingerprint 0. Each shingle is hashed with
XXH64 (UTF-8, seed 42); a bit of the fingerprint is 1 if it is set in more
than half of the hashes.

**Links.** Two fingerprints link at ``max_bits`` = 2 or fewer differing bits.
The 64 bits are cut into two segments of 32, one hash table each. If two
fingerprints differ in at most 2 bits, then either their first segments
differ in at most 1 bit or their second segments are equal; so the first
table is asked for the Hamming ball of radius 1 round a fingerprint's first
segment, the second for its own second segment. Of a pair that differs in
one bit of the first segment only the side whose bit is 0 asks, so a pair is
fetched once from that table. Every fetched pair's full distance is verified.

**Hot segments.** Thousands of near copies can share one segment, and
fetching all their pairs would grow with the square of the group. Where a
table holds more than ``HOT`` fingerprints under one value, the fingerprints
that fetch it and those it holds are linked by shared neighbours instead:
each names the 65 values of its own radius-1 ball over both segments.
Two fingerprints name a common value exactly if they differ in
at most 2 bits, so linking each one to the smallest that names the value
gives the same components, whatever the group's size, with 65 rows each.

Defined cases: a null text counts as empty (fingerprint 0, linked like any
other); repeated rows each get their own output row; rows with a null doc_id
are kept and take part, and a component of null doc_ids only has a null
component_id; an empty table gives an empty result. Input columns other than
the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_place, slices, written
from .components import connected_components

#: Fingerprints under one segment value beyond which pairs are not fetched.
HOT = 32
#: Hashes whose bits are counted at once.
HASHES_AT_ONCE = 1 << 16
SEED = 42
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit SimHash of one whole text."""
    import xxhash

    w = (text or "").encode("utf-8").translate(LOWER).split()
    if not w:
        return 0
    digest, space = xxhash.xxh64_intdigest, b" "
    if len(w) < words:
        return digest(space.join(w), SEED)
    ones, n = np.zeros(64, np.int64), len(w) - words + 1
    for at in range(0, n, HASHES_AT_ONCE):
        part = w[at:at + HASHES_AT_ONCE + words - 1]
        shingles = zip(*(part[k:len(part) - words + 1 + k] for k in range(words)))
        h = np.fromiter((digest(space.join(s), SEED) for s in shingles), dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprint(df: DataFrame, text_col: str = "text", name: str = "_fp", words: int = 3) -> DataFrame:
    """``df`` with ``name``: the fingerprint of each row's whole text as a signed long."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(b.schema.get_field_index(text_col))
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in texts), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp.view(np.int64))], names=[*b.schema.names, name])

    return df.mapInArrow(run, schema)


def _ball(fp: str, zero_only: bool, low: int, high: int) -> str:
    """SQL array of ``fp`` with each bit of [low, high) flipped (only zero bits set, if so asked)."""
    bits = f"sequence({low}, {high - 1})"
    bits = f"filter({bits}, b -> getbit({fp}, b) = 0)" if zero_only else bits
    return f"transform({bits}, b -> {fp} ^ shiftleft(1L, b))"


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (u, v) that connect all fingerprints (distinct longs in ``fp``) at 2 or fewer differing bits."""
    # segment 0: the upper 32 bits, segment 1: the lower
    table = fps.select("fp", F.posexplode(F.expr("array(shiftright(fp, 32), fp & 4294967295L)")).alias("seg", "val"))
    size = table.groupBy("seg", "val").agg(F.count("*").alias("n"))
    table = table.join(size.where("n > 1").select("seg", "val", "n"), ["seg", "val"], "left")
    table = table.select("seg", "val", F.col("fp").alias("other"), F.coalesce("n", F.lit(1)).alias("n"))
    ask = fps.select("fp", F.explode(F.expr(
        "concat(array(named_struct('seg', 0, 'val', shiftright(fp, 32)), named_struct('seg', 1, 'val', fp & 4294967295L)),"
        f" transform({_ball('fp', True, 32, 64)}, x -> named_struct('seg', 0, 'val', shiftright(x, 32))))")).alias("k"))
    ask = ask.select("fp", "k.seg", "k.val")
    fetched = written(table.where(F.col("n") <= hot).join(ask, ["seg", "val"])
                      .where("fp <> other AND bit_count(fp ^ other) <= 2")
                      .select(F.col("fp").alias("u"), F.col("other").alias("v")), "links")
    full = size.where(F.col("n") > hot).select("seg", "val")
    crowd = ask.join(full, ["seg", "val"], "left_semi").select("fp").distinct()
    named = crowd.select("fp", F.explode(F.expr(f"concat(array(fp), {_ball('fp', False, 0, 64)})")).alias("near"))
    first = named.groupBy("near").agg(F.min("fp").alias("v"), F.max("fp").alias("last")).where("v <> last")
    shared = named.join(first, "near").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return fetched.union(shared).distinct()


def components(marked: DataFrame, id_col: str = "doc_id", fp_col: str = "_fp", hot: int = HOT) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of ``marked``.

    ``root`` names the component; ``component_id`` is the smallest id of its
    rows. ``marked`` is read more than once: give a written table.
    """
    fps = written(marked.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("least")), "fps")
    roots = written(connected_components(links(fps.select("fp"), hot))
                    .select(F.col("node").alias("fp"), "root"), "roots")
    least = roots.join(fps, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    linked = roots.join(least, "root").select("fp", "root", "component_id")
    alone = fps.join(roots, "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    return linked.union(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                    hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (16 hex digits), ``component_id``."""
    marked = written(with_fingerprint(docs.select(id_col, text_col), text_col, words=words).drop(text_col), "marked")
    found = components(marked, id_col, hot=hot).withColumnRenamed("fp", "_fp")
    return marked.join(found, "_fp").select(
        id_col, F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
             hot: int = HOT) -> DataFrame:
    """The rows of ``docs`` of which each component keeps one, all columns unchanged.

    The row with the component's smallest id stays (of a component of null
    ids, one of its rows); of rows that repeat that id, one. Fingerprints and
    row numbers are written with the rows, so later reads see the same numbers.
    """
    own, text = by_place(docs), f"c{docs.columns.index(text_col)}"
    marked = written(with_fingerprint(own.withColumn("_row", F.monotonically_increasing_id()), text, words=words), "marked")
    narrow = marked.select(F.col(f"c{docs.columns.index(id_col)}").alias("id"), "_fp", "_row")
    found = components(narrow, "id", hot=hot).withColumnRenamed("fp", "_fp")
    first = (narrow.join(found, "_fp").where("id <=> component_id")
             .groupBy("root").agg(F.min("_row").alias("_row")))
    return marked.join(first.select("_row"), "_row", "left_semi").select(*own.columns).toDF(*docs.columns)
