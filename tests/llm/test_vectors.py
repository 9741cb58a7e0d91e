"""Nearest neighbours and embedding near-duplicates against brute force."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.llm import ann, itq
from llm_tables import SF01

NAN, INF = float("nan"), float("inf")


def unit(x):
    x = np.asarray(x, np.float64)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def clusters(seed=0, n=400, dim=32, groups=12):
    """Random vectors, and groups of near copies at cosines round 0.98."""
    rng = np.random.default_rng(seed)
    x = [rng.standard_normal(dim) for _ in range(n)]
    for g in range(groups):
        for _ in range(2 + 3 * g):
            x.append(unit(x[g]) + rng.standard_normal(dim) * rng.choice((0.005, 0.02, 0.035)))
    return np.array(x, np.float32)


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], lab, "x", "y") for i, v, lab in rows],
                                 "vec_id long, embedding array<float>, label int, code string, row string").repartition(3)


ODD = [(900, None, 1), (901, [], 1), (902, [0.0] * 32, 1), (903, [None] + [1.0] * 31, 1), (904, [NAN] + [1.0] * 31, 1),
       (905, [INF] + [1.0] * 31, 1), (906, [1.0, 2.0], 1), (950, [2.0, 1.0], 1), (None, [1.0] * 32, 1), (907, [1e-38] * 32, None)]


def plain_nearest(rows, is_query, k):
    ok = [(i, np.array(v, np.float64)) for i, v, _ in rows if v is not None and len(v) and None not in v
          and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = {}
    for i, v in ok:
        if i is not None and is_query(i):
            near = [(-float(unit(v) @ unit(w)), j is None, j or 0) for j, w in ok if len(w) == len(v) and j != i]
            out[i] = sorted(near)[:k]
    return out


def test_nearest_is_exact_on_clusters(spark):
    x = clusters()
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + ODD
    got = {}
    for r in ann.nearest(table(spark, rows), F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = plain_nearest(rows, lambda i: i % 50 == 0, 5)
    assert set(got) == set(want)
    hits = 0
    for q, near in want.items():
        assert [g[0] for g in got[q]] == list(range(1, len(near) + 1))
        assert np.allclose([g[2] for g in got[q]], [-s for s, _, _ in near], atol=1e-9)
        hits += len({g[1] for g in got[q]} & {None if null else j for _, null, j in near})
    assert hits >= 0.98 * sum(map(len, want.values()))
    assert len(got[950]) == 1 and got[950][0][1] == 906  # only vectors of its own length, fewer than five


def test_ties_go_to_the_smaller_id_in_every_block(spark, monkeypatch):
    same = [(i, [1.0, 2.0, 3.0], 1) for i in range(200)]
    for block in (2048, 1):
        got = ann.nearest(table(spark, same), F.col("id") % 100 == 0, query_block=block).collect()
        assert sorted((r.query_id, r.vec_id) for r in got) == [(0, i) for i in range(1, 6)] + [(100, i) for i in range(5)]
        assert {round(r.score, 12) for r in got} == {1.0}


def test_estimates_keep_their_bound():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((3000, 64)), unit(rng.standard_normal((20, 64)))
    bits, scalar = ann.encode(x)
    signs = np.unpackbits(bits, axis=1, count=64).astype(float) * 2 - 1
    estimate = signs @ (q @ ann.rotation(64)).T / (8 * scalar)[:, None]
    bound = ann.EPSILON * np.sqrt((1 - scalar**2) / scalar**2 / 63)
    off = np.abs(estimate - unit(x) @ q.T)
    assert (off <= bound[:, None]).mean() > 0.995 and off.mean() < 0.1


def test_nearest_query_recall(spark):
    import __spark_entry__ as E
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()]
    got = {(r.query_id, r.vec_id) for r in E.queries()["op3_ann"](spark, SF01).collect()}
    want = {(q, j) for q, near in plain_nearest(rows, lambda i: i % 50 == 0, 5).items() for _, _, j in near}
    assert len(got & want) >= 0.98 * len(want) and len(got) == len(want)


def test_empty_tables(spark):
    empty = table(spark, [(1, [1.0], 1)]).limit(0)
    assert ann.nearest(empty, F.col("id") % 50 == 0).count() == 0
    assert itq.near_duplicates(empty).count() == 0
    nothing = table(spark, [(1, None, 1), (2, [0.0], None)])
    assert ann.nearest(nothing, F.col("id") % 1 == 0).count() == 0
    assert sorted(map(tuple, itq.near_duplicates(nothing).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def plain_links(rows, least=0.98):
    """index -> (links, smallest id reachable)."""
    ok = [v is not None and lab is not None and len(v) > 0 and None not in v and bool(np.isfinite(np.array(v, float)).all()) and bool(np.any(v))
          for _, v, lab in rows]
    near = [{b for b, (_, w, m) in enumerate(rows) if b != a and ok[a] and ok[b] and lab == m and len(v) == len(w)
             and float(unit(v) @ unit(w)) >= least} for a, (_, v, lab) in enumerate(rows)]
    out = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        out.append((rows[a][0], len(near[a]), min(ids, default=None)))
    return out


@pytest.mark.parametrize("block", [512, 7])
def test_near_duplicates_match_all_pairs(spark, block):
    """Also with buckets cut into small blocks: no link lost or counted twice."""
    x = clusters(seed=4, n=150, groups=9)
    rows = [(i, v.tolist(), i % 2 if i >= 150 else 0) for i, v in enumerate(x)] + ODD
    rows += [(2000 + i, x[160].tolist(), 0) for i in range(40)] + [(2000, x[160].tolist(), 0)] + [(3000, x[160].tolist(), 5)]
    got = itq.near_duplicates(table(spark, rows), block=block, bits=32).collect()
    want = plain_links(rows)
    key = lambda r: tuple((v is None, v or 0) for v in r[:3])
    found, there = sum(r.n_links for r in got), sum(w[1] for w in want)
    assert found <= there and found >= 0.97 * there
    if found == there:
        assert sorted(map(key, got)) == sorted(map(key, want))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_more_copies_of_one_vector_than_the_sample_holds(spark):
    """The fitting sample takes them as one, also if their hash comes first."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 64)).astype(np.float32)
    df = table(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]).selectExpr("vec_id AS row", "vec_id AS id", "string(label)", "embedding")
    hot = x[itq._vectors(df, "id", "embedding", "label").orderBy(F.xxhash64("vec")).first().row]
    near = [unit(hot) + unit(rng.standard_normal(64)) * 0.1 for _ in range(60)]
    rows = [(i, list(map(float, v)), 0) for i, v in enumerate([*x, *near, *[hot] * 500])]
    got = itq.near_duplicates(table(spark, rows), sample=200).collect()
    found, there = sum(r.n_links for r in got), sum(w[1] for w in plain_links(rows))
    assert 0.97 * there <= found <= there
    # the copies' links with each other need no code: count those of the near copies
    assert sum(r.n_links for r in got if 300 <= r.vec_id < 360) >= 0.97 * sum(w[1] for w in plain_links(rows) if 300 <= w[0] < 360)


@pytest.mark.parametrize("others", [0, 20])
def test_nearly_all_vectors_near_one(spark, others):
    """Copies and near copies of one vector, and few others: the sample's mean is that vector."""
    rng = np.random.default_rng(7)
    hot = unit(rng.standard_normal(64))
    x = [hot] * 50 + [hot + unit(rng.standard_normal(64)) * 0.1 for _ in range(400)] + list(rng.standard_normal((others, 64)))
    rows = [(i, list(map(float, v)), 0) for i, v in enumerate(np.array(x, np.float32))]
    found, there = (sum(n) for n in ([r.n_links for r in itq.near_duplicates(table(spark, rows)).collect()], [w[1] for w in plain_links(rows)]))
    assert 0.97 * there <= found <= there


def test_near_duplicates_query_recall(spark):
    import __spark_entry__ as E
    from conftest import SF001
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    got = E.queries()["op4_embedding_dedup"](spark, SF001).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(plain_links(rows))


def test_learnt_codes_are_balanced():
    x = unit(np.random.default_rng(0).standard_normal((2000, 16)) * np.linspace(0.2, 3, 16) + 1)
    code = itq.encode(x, itq.learn(x, 16)).view(np.uint64)
    share = [((code >> np.uint64(b)) & np.uint64(1)).mean() for b in range(16)]
    assert 0.3 < min(share) and max(share) < 0.7
