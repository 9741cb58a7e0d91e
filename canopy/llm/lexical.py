"""Ranked lexical search by bag deduplication.

**Bags.** Every whole text is cut into its terms; of these only the terms of the items' vocabulary are kept, as a *bag*: the sorted
(term, tf) pairs, next to n, the number of all terms. Documents that differ elsewhere only have the same bag.

**Classes.** Documents with equal bag and equal m (the length factor) have equal scores for every item. They are grouped by a 64-bit hash of
(bag, m) together with bag and m themselves, so that a collision of the hash parts no class and merges none. A class holds its number of documents
and its smallest doc_id; the counts give the document frequencies. Copies meet in partial aggregates before the shuffle.

**Scores.** Each class is scored once against all items, along the inverted lists term -> items. A task gives each item's ``k`` best classes
(score, then smallest doc_id). Every document among an item's first ``k`` is in one of its first ``k`` classes: each class before
its own has a document that comes before it. So at most ``k`` classes an item are expanded, to their ``k`` smallest doc_ids.

The items are the query set. They are read in blocks of at most ``ITEM_BYTES`` of text (or one item), whose vocabulary goes to all tasks; the
documents are scanned once a block.

Defined cases: null and empty texts have no terms, count in neither N nor L, and match nothing; an item without terms has no rows; every row of items is
an item of its own, repeated ids and null ids included; repeated documents are each returned; a null doc_id comes last among equal scores; very
long texts are handled like others, one at a time; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import slices, written

ITEM_BYTES = 16 << 20
#: Cells of a (classes x items) score matrix, and postings, held at once.
CELLS = 2_000_000

#: Byte by byte: A-Z to a-z, every byte that no term holds to a blank. All bytes of characters beyond ASCII are of terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Score of the length: m = M_BASE + (M_SLOPE * n * N) div L.
M_BASE, M_SLOPE = 25, 75
FOUND = "item int, score long, first long, hash long, bag binary, m long"


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_TERM_BYTES).split()


def bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, bag) of ``docs`` (id, text) with a term; ``bag`` is null if none is of the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for b in slices(batches):
            ids, counts, packed = [], [], []
            texts = b.column(1).cast(pa.binary())
            for i in range(b.num_rows):
                words = terms(texts[i].as_py() or b"")
                if words:
                    bag = Counter(map(number, words))
                    del bag[None]
                    ids.append(i)
                    counts.append(len(words))
                    packed.append(array("i", [x for pair in sorted(bag.items()) for x in pair]).tobytes() if bag else None)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(counts, pa.int64()),
                                              pa.array(packed, pa.binary())], names=["id", "n", "bag"])

    return docs.mapInArrow(run, "id long, n long, bag binary")


def unpack(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf) of every pair of the bags."""
    pairs = np.frombuffer(b"".join(packed), np.int32).reshape(-1, 2)
    sizes = np.array([len(p) // 8 for p in packed], np.int64)
    return np.repeat(np.arange(len(packed)), sizes), pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.int64)


def frequencies(classes: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary; collected, as long as the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for b in slices(batches, 4096):
            row, term, _ = unpack(b.column(0).to_pylist())
            np.add.at(held, term, b.column(1).to_numpy()[row])
        seen = np.nonzero(held)[0]
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(held[seen])], names=["term", "docs"])

    out = np.zeros(size, np.int64)
    for r in classes.select("bag", "docs").mapInArrow(run, "term int, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).collect():
        out[r.term] = r.docs
    return out


class Postings:
    """The inverted lists term -> (item, repeats) of a block of items, and the terms' weights."""

    def __init__(self, wanted: list[dict[int, int]], weight: np.ndarray) -> None:
        lists = sorted((t, i, r) for i, of in enumerate(wanted) for t, r in of.items())
        self.items, self.weight = len(wanted), weight
        term, self.item, self.repeats = (np.array(c, np.int64) for c in zip(*lists)) if lists else (np.zeros(0, np.int64),) * 3
        self.start = np.searchsorted(term, np.arange(len(weight) + 1))
        longest = max((sum(of.values()) for of in wanted), default=0)
        #: All sums stay below 2^53, so sums of doubles are exact.
        self.exact = int(weight.max(initial=0)) * 1_000_000 * longest < 1 << 53

    def scores(self, packed: list[bytes], m: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """(rows, their integer scores against all items), some rows at a time."""
        row, term, tf = unpack(packed)
        part = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
        width = self.start[term + 1] - self.start[term]
        per_row = np.bincount(row, width, len(packed)).astype(np.int64)
        first = np.searchsorted(row, np.arange(len(packed) + 1))
        at = 0
        while at < len(packed):
            most = max(1, CELLS // max(self.items, 1))
            end = at + max(1, int(np.searchsorted(np.cumsum(per_row[at:at + most]), CELLS, "right")))
            own = slice(first[at], first[end])
            n = width[own]
            where = np.repeat(self.start[term[own]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            cell = np.repeat(row[own] - at, n) * self.items + self.item[where]
            add = np.repeat(part[own], n) * self.repeats[where]
            if self.exact:
                out = np.bincount(cell, add, (end - at) * self.items).astype(np.int64)
            else:
                out = np.zeros((end - at) * self.items, np.int64)
                np.add.at(out, cell, add)
            yield slice(at, end), out.reshape(end - at, self.items)
            at = end


def best_classes(classes: DataFrame, lists: Postings, k: int) -> DataFrame:
    """Each item's ``k`` best classes (score above 0, ties to the smaller first doc_id) of every task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in range(lists.items)]  # (-score, no id, first id, hash, bag, m), best first
        least = np.ones(lists.items, np.int64)
        for b in slices(batches, 4096):
            first, bag, m, code = (b.column(b.schema.get_field_index(c)) for c in ("first", "bag", "m", "hash"))
            ids, packed, m, code = first.to_pylist(), bag.to_pylist(), m.to_numpy(), code.to_pylist()
            order = sorted(range(b.num_rows), key=lambda i: (ids[i] is None, ids[i]))
            for rows, score in lists.scores([packed[i] for i in order], m[order]):
                for j in np.nonzero((score >= least).any(axis=0))[0]:
                    top = np.argsort(-score[:, j], kind="stable")[:k]
                    new = [(-int(score[r, j]), ids[i] is None, ids[i] or 0, code[i], packed[i], int(m[i]))
                           for r, i in ((r, order[rows.start + r]) for r in top) if score[r, j] >= least[j]]
                    best[j] = sorted(best[j] + new)[:k]
                    if len(best[j]) == k:
                        least[j] = -best[j][-1][0]
        found = [(j, -s, None if null else i, c, g, m) for j, own in enumerate(best) for s, null, i, c, g, m in own]
        if found:
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)],
                                             names=["item", "score", "first", "hash", "bag", "m"])

    return classes.select("first", "bag", "m", "hash").mapInArrow(run, FOUND)


def _search_block(docs: DataFrame, items: list[tuple[int | None, bytes]], k: int) -> DataFrame | None:
    vocabulary: dict[bytes, int] = {}
    wanted = [Counter(vocabulary.setdefault(t, len(vocabulary)) for t in terms(text)) for _, text in items]
    if not vocabulary:
        return None
    spark = docs.sparkSession
    held = written(bags(docs, vocabulary), "bags")
    count, length = held.agg(F.count("*"), F.sum("n")).first()
    if not count:
        return None
    held = (held.where("bag IS NOT NULL").withColumn("m", F.expr(f"{M_BASE}L + ({M_SLOPE}L * n * {count}L) div {length}L"))
            .withColumn("hash", F.xxhash64("bag", "m")))
    classes = written(held.groupBy("hash", "bag", "m").agg(F.count("*").alias("docs"), F.min("id").alias("first")), "classes")
    df = frequencies(classes, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("first"))
    best = written(best_classes(classes, Postings(wanted, weight), k).withColumn("place", F.row_number().over(order))
                   .where(F.col("place") <= k).drop("place", "first"), "best")
    key = ["hash", "bag", "m"]
    nth = F.row_number().over(W.partitionBy(*key).orderBy(F.asc_nulls_last("id")))
    members = (held.join(best.select(*key).distinct(), key, "left_semi").select("id", *key)
               .withColumn("nth", nth).where(F.col("nth") <= k).drop("nth"))
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    ids = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(items)], "item int, item_id long")
    return (best.join(members, key).withColumn("rank", rank).where(F.col("rank") <= k)
            .join(ids, "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score"))


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` highest-scoring documents of every row of ``items``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    block, size = [], 0
    for r in [*rows.toLocalIterator(), None]:
        text = b"" if r is None else (r.text or "").encode()
        if block and (r is None or size + len(text) > item_bytes):
            found = _search_block(docs, block, k)
            out = out if found is None else out.union(written(found, "ranked"))
            block, size = [], 0
        if r is not None:
            block.append((r.item_id, text))
            size += len(text)
    return out
