"""WARC archives: exact round trip, record format, and the merged index."""
import gzip
import hashlib
import heapq
import random

import pytest

from canopy.llm import warc
from llm_tables import SF001

LONG = "<p>" + "é long page " * 200 + "</p>"
PAGES = [
    (1, "http://WWW.Example.com:80/b?z=1&a=2#top", LONG), (2, "https://example.com/a", LONG), (3, "http://a.example.com/", LONG),
    (4, "http://b.org/x", "short"), (5, "http://b.org/x", "short"), (6, None, None), (7, "", ""), (8, "not a url\r\nInjected: yes", "a\r\n\r\nb"),
    (9, "http://c.org", "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 60), (10, "http://[bad", "x" * 1000), (11, "http://d.org", "x" * 999),
    (12, "http://d.org", "x" * 999), (2, "https://example.com/a", LONG), (None, "http://e.org", LONG), (None, "http://f.org", "y" * 2000),
    (3, "http://a.example.com/again", LONG), (20, "http://g.org", "z" * 300_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, digest string, run int").repartition(4)


def plain(rows):
    most = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 1000 and i is not None:
            most[raw] = max(i, most.get(raw, i))
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = raw in most and i != most[raw]
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", most[raw] if revisit else None))
    return sorted(out, key=str)


COLS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_round_trip_of_awkward_pages(pages):
    got = warc.archive_and_index(pages).collect()
    assert sorted((tuple(r[c] for c in COLS) for r in got), key=str) == plain(PAGES)


def test_query_and_global_order(spark):
    import __spark_entry__ as E
    got = E.queries()["op6_warc"](spark, SF001).collect()
    table = spark.read.parquet(f"{SF001}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in table.collect()]
    assert sorted((tuple(r[c] for c in COLS) for r in got), key=str) == plain(rows)
    index = warc.archive_and_index(table).collect()
    order = [(r.url_key, r.captured, r.page_id) for r in sorted(index, key=lambda r: (r.merge_part, r.merge_pos))]
    assert order == sorted(order) and len(order) == len(rows)


def test_archives_hold_whole_records(spark, pages, tmp_path):
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path)
    payloads = []
    for f in (tmp_path / "warc").glob("*.gz"):
        for head, block in warc.parse(gzip.decompress(f.read_bytes())):
            assert int(head["Content-Length"]) == len(block) and head["WARC-Date"].endswith("Z") and "Injected" not in head
            if head["WARC-Type"] == "response":
                payloads.append(block.split(b"\r\n\r\n", 1)[1])
            else:
                assert head["WARC-Refers-To"] == "<urn:page:3>"
    want = [(h or "").encode() for i, _, h in PAGES if h != LONG or i == 3]
    assert sorted(payloads) == sorted(want)


def test_damage_is_noticed():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    assert len(list(warc.parse(record * 3))) == 3
    with pytest.raises(ValueError):
        list(warc.parse(record.replace(b"5", b"4")))
    with pytest.raises(ValueError):
        list(warc.parse(b"junk" + record))


def test_loser_tree_is_a_stable_merge():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((rng.randrange(20), i, j) for j in range(rng.choice((0, 1, 30)))) for i in range(k)]
        got = list(warc.loser_tree([iter(r) for r in runs], lambda e: e[0]))
        assert got == list(heapq.merge(*runs, key=lambda e: e[0]))


def test_one_url_with_most_captures_is_cut(spark):
    rows = [(i, "http://hot.org/" if i % 3 else f"http://h{i}.org/", "p") for i in range(600)]
    runs = warc.index_runs(spark, _written(spark, rows))
    got = warc.merge_index(runs, 600, range_rows=100).collect()
    order = [(r.url_key, r.captured, r.page_id) for r in sorted(got, key=lambda r: (r.merge_part, r.merge_pos))]
    assert order == sorted(order) and len(order) == 600
    assert len({r.merge_part for r in got if r.url_key == "org,hot)/"}) > 2


def _written(spark, rows):
    from canopy.llm.common import scratch_path
    path = scratch_path(spark, "test")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5), path)
    return path


def test_url_keys():
    for url, key in [("http://WWW.Example.com:80/b?z=1&a=2#top", "com,example)/b?a=2&z=1"), ("https://a.b.co.uk:8443", "uk,co,b,a:8443)/"),
                     ("http://[bad", "http://[bad"), ("Plain text", "plain text")]:
        assert warc.url_key(url) == key


def test_empty_table(pages):
    assert warc.archive_and_index(pages.limit(0)).count() == 0
