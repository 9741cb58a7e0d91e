"""op11, op12 and op13 against brute force: awkward rows, ties, copies, blocks and shards of every size."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.llm import balltree, intvec, lexical, negatives
from llm_tables import AWKWARD, documents, no_documents, prose  # noqa: F401

NAN, INF = float("nan"), float("inf")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# --- op11 ---------------------------------------------------------------------------------------

def plain_terms(text):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain_search(docs, items, k):
    bags = [(i, Counter(w), len(w)) for i, t in docs if (w := plain_terms(t))]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scored = []
        for i, bag, n in bags:
            m = 25 + (75 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m))
                    for t in plain_terms(text) if t in bag)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def searched(found):
    return sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_terms_are_the_patterns():
    rng = random.Random(1)
    texts = [*AWKWARD, "".join(chr(rng.choice([rng.randint(0, 127), rng.randint(128, 2000), rng.randint(0x1F600, 0x1F640)])) for _ in range(5000)), "İSS ß ÀB c"]
    for t in texts:
        assert [w.decode() for w in lexical.terms((t or "").encode())] == plain_terms(t)


@pytest.mark.parametrize("item_bytes", [lexical.ITEM_BYTES, 60])
def test_search_matches_brute_force(spark, documents, item_bytes):  # noqa: F811
    docs, rows = documents
    items = [(1, "the river, the STONE!"), (2, None), (3, ""), (4, "nothing-here qqq"), (None, "water light"), (1, "the river, the STONE!"),
             (5, prose(2)), (6, "x" * 30_000 + " naïve 漢字"), (7, "house " * 50)]
    table = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, score string")
    got = searched(lexical.search(docs, table, k=4, item_bytes=item_bytes))
    assert got == plain_search(rows, items, 4) and len(got) > 15


def test_search_copies_and_ties(spark):
    """Classes of many copies, bags that differ only outside an item's terms, and equal scores over classes: smallest ids first."""
    rng = random.Random(2)
    rows = [(i, "red fox" if i % 3 else f"red fox {rng.choice(['a', 'b', 'c', 'd'])}") for i in rng.sample(range(1000), 300)]
    rows += [(rng.randint(0, 50), "fox red red")] * 30 + [(i, "blue") for i in range(20)]
    items = [(1, "fox"), (2, "fox a b c d"), (3, "red"), (4, "blue a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = searched(lexical.search(docs, spark.createDataFrame(items, "item_id long, text string")))
    assert got == plain_search(rows, items, 10)


def test_search_of_empty_tables(spark, no_documents):  # noqa: F811
    items = spark.createDataFrame([(1, "fox")], "item_id long, text string")
    assert lexical.search(no_documents, items).isEmpty()
    assert lexical.search(no_documents, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


# --- op12 and op13 ------------------------------------------------------------------------------

ODD = [(900, None, 1), (950, [], 1), (1000, [0.0] * 8, 1), (903, [None] + [1.0] * 7, 1), (904, [NAN] + [1.0] * 7, 1), (905, [INF] + [1.0] * 7, 1),
       (906, [1.0, 2.0], 1), (1050, [2.0, 1.0], 1), (None, [0.3] * 8, 1), (1100, [1e30, -1e30] * 4, 2), (907, [1e30] * 8, 2), (1150, [0.1] * 8, None),
       (50, [0.2] * 8, 1), (100, [0.25] * 8, 0), (1200, [3e5] * 8, 3), (908, [2e5, 3e5] * 4, 1)]


def vectors(seed, n=500, dim=8, hot=100):
    """Clustered vectors with a group of copies, components often equal after rounding so that scores tie."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.2, (6, dim))
    x = centres[rng.integers(0, 6, n)] + rng.normal(0, 0.05, (n, dim))
    x[rng.choice(n, hot, replace=False)] = centres[0]
    return [(i, np.round(v, 2).tolist(), int(i) % 4) for i, v in enumerate(x)]


def whole(v):
    if not v or None in v or not np.isfinite(np.array(v, float)).all():
        return None
    return [math.floor(256 * float(np.float32(c))) for c in v]


def dot(a, b):
    return max(intvec.LEAST, min(intvec.MOST, sum(x * y for x, y in zip(a, b))))


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], lab, "x", "y", "z") for i, v, lab in rows],
                                 "vec_id long, embedding array<float>, label int, id string, row string, vec string").repartition(4)


def plain_exact(rows, step, k):
    ok = [(i, w) for i, v, _ in rows if (w := whole(v)) is not None]
    queries = {}
    for i, w in ok:
        if i is not None and i % step == 0:
            packed = (np.array(w, np.float32 if max(map(abs, w)) < 1 << 24 else np.float64).tobytes(), w)
            queries[i] = min(queries.get(i, packed), packed)
    out = []
    for q, (_, w) in queries.items():
        near = sorted((-dot(w, x), j is None, j or 0) for j, x in ok if len(x) == len(w) and j != q)
        out += [(q, r + 1, None if null else j, -s) for r, (s, null, j) in enumerate(near[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("bounds", [{}, {"shard_bytes": 600, "pivots": 5, "query_bytes": 200}])
def test_exact_search_matches_brute_force(spark, bounds):
    rows = vectors(1) + ODD
    got = sorted((tuple(r) for r in balltree.search(table(spark, rows), F.col("id") % 50 == 0, 4, **bounds).collect()), key=repr)
    assert got == plain_exact(rows, 50, 4)


def test_exact_search_of_no_vectors(spark):
    none = table(spark, ODD).limit(0)
    assert balltree.search(none, F.col("id") % 50 == 0).isEmpty()
    assert balltree.search(table(spark, ODD[:2]), F.col("id") % 50 == 0).columns == ["query_id", "rank", "vec_id", "score"]


def test_ball_tree_bounds_and_visits():
    """Balls hold their rows, leaves part the rows, and on clustered rows most leaves are never visited."""
    rng = np.random.default_rng(3)
    x = np.floor(256 * (np.repeat(rng.normal(0, 1, (16, 12)), 200, axis=0) + rng.normal(0, 0.02, (3200, 12))))
    tree = balltree.BallTree(x, 50)
    assert sorted(tree.order.tolist()) == list(range(len(x)))
    for lo, hi, c, r in zip(tree.lo, tree.hi, tree.centre, tree.radius):
        assert np.sqrt(((x[tree.order[lo:hi]] - c) ** 2).sum(axis=1)).max() <= r
    packed = balltree.packed_tree(np.arange(len(x)), np.zeros(len(x), bool), [v.astype(np.float32).tobytes() for v in x], 12)
    best = balltree.Best(np.full(40, -1), x[::80], np.full(40, intvec.LEAST - 1), 5)
    seen, add = [], best.add
    best.add = lambda rows, leaf, ids, null: (seen.append(len(rows) * len(leaf)), add(rows, leaf, ids, null))
    balltree.descend(balltree.unpacked_tree(packed), best)
    assert sum(seen) < 0.3 * 40 * len(x)
    assert (best.score == np.sort((x[::80] @ x.T).astype(np.int64), axis=1)[:, :-6:-1]).all()


def plain_negatives(rows, step, positives, k):
    ok = [(i, w, lab) for i, v, lab in rows if lab is not None and (w := whole(v)) is not None]
    anchors = {}
    for i, w, lab in ok:
        if i is not None and i % step == 0:
            entry = (str(lab), np.array(w, np.float32 if max(map(abs, w)) < 1 << 24 else np.float64).tobytes(), w, lab)
            anchors[i] = min(anchors.get(i, entry), entry)
    out = []
    for a, (_, _, w, lab) in anchors.items():
        scored = sorted((-dot(w, x), j is None, j or 0, own) for j, x, own in ok if len(x) == len(w) and j != a)
        for s, null, j, _ in [c for c in scored if c[3] == lab][:positives]:
            hard = [c for c in scored if c[3] != lab and 80 * -s <= 100 * -c[0] <= 100 * -s][:k]
            out += [(a, None if null else j, r + 1, None if n else m, -s, -t) for r, (t, n, m, _) in enumerate(hard)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("bounds", [{}, {"block_bytes": 500, "anchor_bytes": 100}])
def test_hard_negatives_match_brute_force(spark, bounds):
    rows = vectors(2) + ODD
    found = negatives.mine(table(spark, rows), F.col("id") % 25 == 0, F.col("label"), 3, 4, **bounds).drop("positive_rank")
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    want = plain_negatives(rows, 25, 3, 4)
    assert got == want and len(got) > 80


def test_hard_negatives_of_no_vectors(spark):
    assert negatives.mine(table(spark, ODD).limit(0), F.col("id") % 25 == 0, F.col("label")).isEmpty()


def test_threshold_join_leaves_nothing_out():
    """Every pair that reaches its threshold is found, and at high thresholds most dimensions are never indexed."""
    rng = np.random.default_rng(4)
    x = np.floor(256 * rng.normal(0, 1, (400, 24)) * np.linspace(2, 0.1, 24))
    q = np.floor(256 * rng.normal(0, 1, (30, 24)))
    block = negatives.Block(x)
    ordered = q[:, block.order]
    rest = negatives._suffix_norms(ordered)
    for level in (0.9, 0.5, 0.2, 0.0, -0.5):
        t = level * rest[:, 0] * block.most
        i, j = block.join(ordered, rest, t)
        reach = set(zip(*np.nonzero(q @ x.T >= t[:, None])))
        assert reach <= set(zip(i.tolist(), j.tolist()))
        if level == 0.9:
            assert len(i) < 100
