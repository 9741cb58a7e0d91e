"""Document quality by histogram gradient-boosted trees over text statistics.

**Features.** ``FEATURES`` numbers describe one whole text: lengths, word and
line shapes, shares of character classes, repetition, byte entropy and
compressed size. No label, language, source or id is among them.

**Training.** At most ``train_rows`` labelled texts (a documented bound; the
ids with the smallest hash, so a fixed sample at any size, and of each id the text with the smallest hash) give a feature
matrix that the driver holds whole. Features are cut at quantiles into at
most ``bins`` bins; trees grow level by level on gradient and hessian
histograms of the logistic loss, with L2-regularised gains.

**Scoring.** All trees lie in one set of flat arrays (feature, threshold, left, right, value);
leaves point at themselves, so every (row, tree) pair descends in numpy with
``depth`` gathers. Scoring needs no shuffle: each text is read once and the
model is a bounded constant of the task.

Defined cases: a null text counts as empty; empty texts get a score like any
other; repeated rows and null ids are scored too (``held_out`` false for a
null id); labels that are null or neither 0 nor 1 are left out, several
labels of one id are averaged; without labels, or with one class only, the
score is the smoothed share of label 1 (0.5 without any label). An empty
table gives an empty result. Other input columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_place, slices

TRAIN_ROWS = 20_000
#: Tasks that take the features of the training texts.
TRAIN_TASKS = 32
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0

FEATURES = [
    "log_bytes", "log_words", "log_lines", "word_len_mean", "word_len_std", "word_len_max", "short_words",
    "long_words", "distinct_words", "top_word", "distinct_pairs", "title_words", "upper_words", "odd_words",
    "ended_words", "repeated_lines", "repeated_line_chars", "line_len_mean", "ended_lines", "letters", "upper",
    "digits", "spaces", "punctuation", "symbols", "non_ascii", "entropy", "compressed",
]
_BYTES = np.arange(256)
_CLASSES = np.stack([
    ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)),
    (_BYTES >= 65) & (_BYTES <= 90),
    (_BYTES >= 48) & (_BYTES <= 57),
    np.isin(_BYTES, [9, 10, 11, 12, 13, 32]),
    np.isin(_BYTES, list(b".,;:!?'\"()-")),
    np.isin(_BYTES, list(b"#$%&*+/<=>@[\\]^_`{|}~")),
    _BYTES >= 128,
]).astype(np.float64)
_ENDS = (".", "!", "?", ":", ";", ",")


def statistics(text: str | None) -> list[float]:
    """The ``FEATURES`` of one whole text, all finite."""
    text = text or ""
    raw, words = text.encode("utf-8", "replace"), text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, nw, nl = max(1, len(raw)), max(1, len(words)), max(1, len(lines))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = _CLASSES @ counts / n
    p = counts[counts > 0] / n
    lens = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    seen = Counter(words)
    by_line = Counter(lines)
    again = [(k, c) for k, c in by_line.items() if c > 1]
    return [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), lens.mean(), lens.std(), lens.max(),
        (lens <= 3).mean(), (lens >= 15).mean(), len(seen) / nw, max(seen.values(), default=0) / nw,
        len(set(zip(words, words[1:]))) / nw, sum(map(str.istitle, words)) / nw, sum(map(str.isupper, words)) / nw,
        sum(not w.isalpha() for w in words) / nw, sum(w.endswith(_ENDS) for w in words) / nw,
        sum(c for _, c in again) / nl, sum(len(k) * c for k, c in again) / n, len(text) / nl,
        sum(x.rstrip().endswith((".", "!", "?")) for x in lines) / nl, *shares.tolist(),
        float(-(p * np.log2(p)).sum()) if len(raw) else 0.0, len(zlib.compress(raw, 1)) / n,
    ]


def matrix(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in texts], np.float64).reshape(-1, len(FEATURES))


@dataclass
class Trees:
    """Boosted trees as flat arrays; node ``roots[t]`` starts tree t, leaves point at themselves."""

    base: float
    depth: int
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of ``x``."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def train(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64,
          l2: float = 1.0, least: float = 3.0) -> Trees:
    """Fit to the rows of ``x`` with targets ``y`` in [0, 1]; deterministic."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    cols: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []

    def node(value: float) -> int:
        at = len(cols["feature"])
        for k, v in (("feature", 0), ("threshold", np.inf), ("left", at), ("right", at), ("value", value)):
            cols[k].append(v)
        return at

    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1) if len(x) else x
    raw = np.full(len(y), base)
    for _ in range(trees if len(y) and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        leaf = lambda rows: rate * g[rows].sum() / (h[rows].sum() + l2)
        every = np.arange(len(y))
        level = [(node(leaf(every)), every)]
        roots.append(level[0][0])
        for _ in range(depth):
            below = []
            for at, rows in level:
                best, gs, hs = (1e-9, 0, 0), g[rows].sum(), h[rows].sum()
                whole = gs * gs / (hs + l2)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, f]
                    gl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                    gain = np.where((hl >= least) & (hs - hl >= least),
                                    gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - whole, -1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
                if best[0] > 1e-9:
                    _, f, k = best
                    low = binned[rows, f] <= k
                    sides = [rows[low], rows[~low]]
                    kids = [node(leaf(s)) for s in sides]
                    cols["feature"][at], cols["threshold"][at] = f, edges[f][k]
                    cols["left"][at], cols["right"][at], cols["value"][at] = kids[0], kids[1], 0.0
                    below += zip(kids, sides)
                else:
                    raw[rows] += cols["value"][at]
            level = below
        for at, rows in level:
            raw[rows] += cols["value"][at]
    if not roots:
        roots = [node(0.0)]
    return Trees(base, depth, np.array(roots), np.array(cols["feature"]), np.array(cols["threshold"], float),
                 np.array(cols["left"]), np.array(cols["right"]), np.array(cols["value"], float))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's id falls in the fold that no label is learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        train_rows: int = TRAIN_ROWS) -> Trees:
    """Train on one text each of at most ``train_rows`` labelled ids outside the held-out fold.

    The chosen labels are the broadcast side of the join with the texts, a
    table of at most ``train_rows`` rows of 16 bytes.
    """
    order = F.xxhash64("_id")
    chosen = (labels.select(F.col(id_col).alias("_id"), F.col("quality").alias("_y"))
              .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out("_id"))
              .groupBy("_id").agg(F.avg("_y").alias("_y")).orderBy(order, "_id").limit(train_rows))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    # an id with many rows counts once, by its text of the smallest hash; the few texts left are dealt out anew
    first = F.min(F.struct(F.xxhash64("_text").alias("hash"), F.col("_text"))).alias("_first")
    texts = texts.groupBy("_id", "_y").agg(first).select("_id", "_y", "_first._text").repartition(TRAIN_TASKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = matrix(b.column("_text"))
            yield pa.RecordBatch.from_pydict({"_id": b.column("_id"), "_y": b.column("_y"), "_x": list(x)}, schema=out)

    out = pa.schema([("_id", pa.int64()), ("_y", pa.float64()), ("_x", pa.list_(pa.float64()))])
    got = (texts.select(F.col("_id").cast("long"), "_y", "_text").mapInArrow(run, "_id long, _y double, _x array<double>")
           .orderBy(F.xxhash64("_id"), "_id").select("_y", "_x").toArrow())
    x = np.array(got.column("_x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return train(x, got.column("_y").to_numpy())


def with_score(df: DataFrame, model: Trees, text_col: str = "text", name: str = "score") -> DataFrame:
    """``df`` with ``name``: the model's score of each row's whole text."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = model.score(matrix(b.column(b.schema.get_field_index(text_col))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got)], names=[*b.schema.names, name])

    return df.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """id, ``held_out``, ``score``, ``predicted`` for every row of ``docs``."""
    model = fit(docs, labels, id_col, text_col, train_rows)
    got = with_score(docs.select(id_col, text_col), model, text_col, "score")
    return got.select(id_col, held_out(id_col).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns unchanged."""
    model = fit(docs, labels, id_col, text_col, train_rows)
    got = with_score(by_place(docs), model, f"c{docs.columns.index(text_col)}")
    return got.where(F.col("score") >= threshold).drop("score").toDF(*docs.columns)
