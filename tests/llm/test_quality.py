"""The quality classifier: flat traversal against plain trees, held-out accuracy, awkward rows."""
import zlib

import numpy as np
from pyspark.sql import functions as F

from canopy.llm import quality
from llm_tables import SF01, documents, no_documents  # noqa: F401


def plain_score(m, row):
    total = m.base
    for root in m.roots:
        at = root
        while m.left[at] != at:
            at = m.left[at] if row[m.feature[at]] <= m.threshold[at] else m.right[at]
        total += m.value[at]
    return 1 / (1 + np.exp(-total))


def test_flat_traversal_is_the_trees():
    rng = np.random.default_rng(0)
    x = np.round(rng.standard_normal((600, 6)), 1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] * x[:, 2] > 0.2)).astype(float)
    m = quality.train(x, y, trees=30, depth=4)
    got = m.score(x)
    assert np.allclose(got, [plain_score(m, r) for r in x])
    assert ((got > 0.5) == y).mean() > 0.95 and (0 < got).all() and (got < 1).all()
    assert np.array_equal(quality.train(x, y, trees=30, depth=4).score(x), got)


def test_degenerate_training():
    none = np.zeros((0, 3))
    assert np.allclose(quality.train(none, np.zeros(0)).score(np.ones((2, 3))), 0.5)
    assert (quality.train(np.ones((9, 3)), np.ones(9)).score(np.ones((2, 3))) > 0.8).all()
    same = quality.train(np.ones((10, 3)), np.arange(10) % 2.0)
    assert np.allclose(same.score(np.ones((1, 3))), 0.5)


def test_query_on_the_held_out_fold(spark):
    import __spark_entry__ as E
    got = {r.doc_id: r for r in E.queries()["op7_quality"](spark, SF01).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(labels[i], r) for i, r in got.items() if i in labels and r.held_out]
    good = [r for q, r in held if q == 1]
    assert np.mean([r.predicted for r in good]) >= 0.98
    auc = np.mean([a.score > b.score for a in good for q, b in held if q == 0])
    assert auc > 0.95


def test_held_out_labels_are_never_learnt(spark, documents):
    """Turning every held-out label round changes no score."""
    docs = spark.read.parquet(f"{SF01}/documents.parquet").limit(200)
    rows = [(i, i % 2) for i in range(200)]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in rows]
    one, two = (quality.score_documents(docs, spark.createDataFrame(r, "doc_id long, quality int")) for r in (rows, turned))
    assert sorted(one.collect()) == sorted(two.collect())


def test_awkward_rows(documents, no_documents, spark):
    docs, rows = documents
    labels = spark.createDataFrame([(i, i % 2) for i in range(13)] + [(1, None), (None, 1), (2, 7), (3, 0), (99, 1)], "doc_id long, quality int")
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False, False]
    assert quality.keep_good(docs, labels, threshold=0.0).columns == docs.columns
    assert quality.keep_good(docs, labels, threshold=0.0).count() == len(rows)
    assert quality.keep_good(docs, labels, threshold=1.1).count() == 0
    assert quality.score_documents(no_documents, labels).count() == 0
    unlabelled = quality.score_documents(docs, labels.limit(0)).collect()
    assert {round(r.score, 9) for r in unlabelled} == {0.5}


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i} of some words") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    seen = []
    old, quality.train = quality.train, lambda x, y, **k: seen.append(len(x)) or old(x, y, **k)
    try:
        quality.score_documents(docs, labels, train_rows=50).count()
    finally:
        quality.train = old
    assert seen and max(seen) <= 50


def test_an_id_of_many_rows_counts_once(spark, monkeypatch):
    ids = spark.range(200).where(~quality.held_out("id"))
    hot = ids.orderBy(F.xxhash64("id")).first().id
    rows = [(i, f"text {i} " * (1 + i % 7)) for i in range(200)] + [(hot, f"copy {k % 5}") for k in range(400)]
    seen = []
    train = quality.train
    monkeypatch.setattr(quality, "train", lambda x, y: seen.append((x, y)) or train(x, y))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i == hot or i % 2 == 0)) for i in range(200)], "doc_id long, quality int")
    for _ in range(2):
        quality.fit(docs, labels, train_rows=60)
    x, y = seen[0]
    assert x.shape[0] == len(y) == 60 and 10 < y.sum() < 50
    assert (x == seen[1][0]).all() and (y == seen[1][1]).all()


def test_statistics_are_finite():
    for t in [None, "", " ", "\n\n", "a", "é" * 10, "word " * 5000, "|||", "A\nA\nA"]:
        assert len(quality.statistics(t)) == len(quality.FEATURES) and np.isfinite(quality.statistics(t)).all()
