"""SimHash near-duplicates against a plain bit-by-bit version and all pairs."""
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from canopy.llm import simhash
from canopy.llm.components import connected_components
from llm_tables import SF001, documents, no_documents  # noqa: F401


def plain_fingerprint(text):
    words, word = [], b""
    for c in (text or "").encode() + b" ":
        if c == 0x20 or 9 <= c <= 13:
            words, word = words + [word] if word else words, b""
        else:
            word += bytes([c + 32 if 65 <= c <= 90 else c])
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks):
    """index -> smallest index of its component, at 2 or fewer differing bits."""
    root = list(range(len(marks)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(marks)):
        for b in range(a):
            if (marks[a] ^ marks[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(marks))]


def test_fingerprints_of_awkward_texts(documents):
    for _, text in documents[1]:
        if len(text or "") < 5000:
            assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_counts_in_parts(monkeypatch):
    text = " ".join(str(random.Random(0).random()) for _ in range(500))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "HASHES_AT_ONCE", 7)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


def test_awkward_rows_one_output_row_each(documents):
    docs, rows = documents
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.component_id for r in zero} == {0}  # null, empty and blank texts link
    by = {r.doc_id: r for r in got}
    assert by[10].component_id == by[11].component_id == 10
    assert len({r.component_id for r in got if r.doc_id == 20}) == 1


def test_empty_table(no_documents):
    assert simhash.near_duplicates(no_documents).count() == 0
    assert simhash.keep_one(no_documents).count() == 0


def test_query_matches_all_pairs(spark):
    import __spark_entry__ as E
    got = E.queries()["op1_simhash_dedup"](spark, SF001).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    ids = sorted(docs)
    marks = [simhash.fingerprint(docs[i]) for i in ids]
    roots = plain_components(marks)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == [
        (i, f"{m:016x}", ids[r]) for i, m, r in zip(ids, marks, roots)]


@pytest.mark.parametrize("hot", [1, 4, 10_000])
def test_crowded_segments_give_the_same_components(spark, hot):
    """Clusters round shared centres: every segment is crowded, links of 1 and 2 bits in all places."""
    rng = random.Random(hot)
    marks = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(25):
            marks.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    marks = sorted(marks)
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    table = spark.createDataFrame([(i, m) for i, m in enumerate(signed)], "doc_id long, _fp long")
    got = {r.fp: r.component_id for r in simhash.components(table, hot=hot).collect()}
    assert [got[m] for m in signed] == plain_components(marks)


def test_keep_one_keeps_all_columns_and_the_smallest_id(documents):
    docs, _ = documents
    groups = simhash.near_duplicates(docs)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    want = groups.where("doc_id IS NOT NULL").select("component_id").distinct().collect()
    assert sorted(i for i in ids if i is not None) == sorted(r.component_id for r in want)
    assert ids.count(20) == 1


def test_components_of_chains_cycles_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 4), (4, 5), (7, 7), (5, 3), (900, 2), (2, 901)]
    table = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in connected_components(table).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 4: 3, 5: 3, 2: 2, 900: 2, 901: 2}
    assert connected_components(table.where(F.lit(False))).count() == 0
