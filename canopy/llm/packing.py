"""Packing of token sequences by a grouping genetic algorithm on islands.

**Pieces.** A document's token ids, closed by id 0, are one piece, or pieces
of ``cap`` tokens if there are more (only the last may be shorter).

**The problem that evolves.** Pieces of one length are interchangeable, so a
packing is a list of *bins with a multiplicity* over the histogram of piece
lengths: at most ``cap`` lengths and a few thousand kinds of bin, however
many documents there are. That bounds what the driver and an island hold.

**Grouping genetic algorithm.** A chromosome is such a list; a gene is a
whole bin. Crossover injects well-filled bins of one parent into the other,
removes the bins in which pieces would then be used twice, and best-fits the
displaced pieces, longest first, into the gaps that are left. Mutation
empties some of the worst-filled bins and best-fits their pieces in a
disturbed order. Fitness is the number of bins, then the sum of squared fills.
``islands`` Spark tasks evolve populations of their own; after each epoch
every island keeps its elite and sends it to the next one. An island that
reaches the lower bound (tokens / cap) stops, and so does the search.

**Assignment.** Pieces of a length are numbered without gaps (hot lengths by
salted parts, see ``common.ranked``); the winning bins say which range of
numbers lies in which bins at which offset, a table of a few thousand rows
that is broadcast. No piece passes through the driver.

Defined cases: a null text counts as empty and gives the one piece [0];
repeated rows and null ids are packed like any others; an empty table gives an
empty result. Other input columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import random
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, slices, written

CAP = 2048
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4, 3, 4, 6
SALTS = 32
#: Characters of words that a worker process remembers with their ids before it starts anew.
CACHE_CHARS = 8_000_000

#: Signs that the tokenizer parts from a letter before them (not from a mark); not the apostrophe, which may belong to it.
SIGNS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'

WORDS_AT_ONCE = 256
#: Bytes of texts cut into words at once (one text at least): the more, the fewer words are met again in another round.
TEXT_BYTES = 8 << 20

Bins = list[tuple[tuple[int, ...], int]]  # (piece lengths, multiplicity)


# ---- tokens ----

class WordIds:
    """Token ids of whole texts, each distinct word encoded once.

    For a tokenizer that drops white space, never lets a token cross it and
    closes each word by a token on ``</w>``, a text's ids are its words' ids in a row. ``__call__`` takes texts and gives each one's
    ids as little-endian 32-bit numbers.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.last: dict[str, bool] = {}

    def _parts(self, letter: str) -> bool:
        """Whether signs after ``letter`` are a word part of their own: not if it is normalised to a letter and marks, which join the signs."""
        if letter not in self.last:
            text = self.tokenizer.normalizer.normalize_str(letter + ".") if self.tokenizer.normalizer else letter + "."
            self.last[letter] = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)[-1][1] == (len(text) - 1, len(text))
        return self.last[letter]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.held > CACHE_CHARS:
            self.known, self.held = {}, 0
        # only these four are cut at: any other white space stays inside a word, for the tokenizer to see
        flat = pa.array([t.replace("\n", " ").replace("\t", " ").replace("\r", " ") for t in texts], pa.large_string())
        cut = pc.split_pattern(flat, " ")
        coded = cut.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        known = self.known
        new = [w for w in distinct if w not in known]
        # letters and the signs after them are split anyway: both are looked up on their own
        parted = {w: (base, w[len(base):]) for w in new
                  if (base := w.rstrip(SIGNS)) and base != w and base.isalpha() and (base[-1].isascii() or self._parts(base[-1]))}
        whole = {w for w in new if w not in parted} | {p for pair in parted.values() for p in pair if p not in known}
        self._learn_plain([w for w in whole if w.isalpha()])
        self._learn_each([w for w in whole if not w.isalpha()])
        for w, (base, signs) in parted.items():
            known[w] = known[base] + known[signs]
        self.held += sum(map(len, new))
        # the ids of the distinct words in a row, and from there those of all words of all texts
        packed = [known[w] for w in distinct]
        ids = np.frombuffer(b"".join(packed), "<u4")
        size = np.array([len(p) // 4 for p in packed], np.int64)
        begin = np.cumsum(size) - size
        word = coded.indices.to_numpy()
        width = size[word]
        past = np.cumsum(width)
        all_ids = ids[np.repeat(begin[word] - (past - width), width) + np.arange(past[-1] if len(past) else 0)]
        ends = np.concatenate([[0], past])[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        return [all_ids[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _learn_each(self, words: list[str]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            self.known[w] = array("I", e.ids).tobytes()

    def _learn_plain(self, words: list[str]) -> None:
        """Words of letters only, many to a text: each ends with its one token that closes a word."""
        groups = [words[i:i + WORDS_AT_ONCE] for i in range(0, len(words), WORDS_AT_ONCE)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(group):  # lower case may turn a letter into several signs
                self._learn_each(group)
                continue
            buf, begin = ids.tobytes(), 0
            for w, end in zip(group, ends.tolist()):
                self.known[w] = buf[4 * begin:4 * end]
                begin = end


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """A worker process keeps one tokenizer and the words it has met from task to task."""
    return WordIds(path)


def by_size(batches: Iterator[pa.RecordBatch], column: int, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches, at most ``most`` bytes of a text column (or one row) at a time."""
    for b in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, end - at)
            at = end


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           cap: int = CAP) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and a salt for ``ranked``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, n = word_ids(tokenizer_path), 0
        for b in by_size(batches, 1):
            rows: list[tuple] = []
            ids = encode([t or "" for t in b.column(1).to_pylist()])
            for doc, buf in zip(b.column(0).to_pylist(), ids):
                buf += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(buf), 4 * cap)):
                    part = buf[at:at + 4 * cap]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), n % SALTS))
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)

    doc_type = docs.schema[id_col].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type
    out = pa.schema([(id_col, to_arrow_type(docs.schema[id_col].dataType)), ("piece", pa.int32()), ("start", pa.int64()),
                     ("length", pa.int64()), ("ids_crc32", pa.int64()), ("salt", pa.int32())])
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {doc_type}, piece int, start long, length long, ids_crc32 long, salt int")


# ---- the genetic algorithm, on a histogram of lengths ----

def best_fit(bins: Bins, loose: dict[int, int], cap: int, order: list[int]) -> Bins:
    """``bins`` with the ``loose`` pieces (length -> count) added, each to the fullest bin that has room."""
    by_room: list[list] = [[] for _ in range(cap + 1)]
    mask = 0
    for items, m in bins:
        room = cap - sum(items)
        by_room[room].append((items, m))
        mask |= 1 << room

    for length in order:
        left = loose.get(length, 0)
        while left:
            if fits := mask >> length:
                room = length + (fits & -fits).bit_length() - 1
                items, m = by_room[room].pop()
                if not by_room[room]:
                    mask ^= 1 << room
            else:
                room, items, m = cap, (), left
            each = min(room // length, left)
            n = min(m, left // each)
            left -= n * each
            if items and n < m:
                by_room[room].append((items, m - n))
                mask |= 1 << room
            by_room[room - each * length].append((items + (length,) * each, n))
            mask |= 1 << (room - each * length)
    return merged(b for at in by_room for b in at)


def merged(bins) -> Bins:
    """Equal bins as one, in a fixed order."""
    total: dict[tuple[int, ...], int] = {}
    for items, m in bins:
        key = tuple(sorted(items, reverse=True))
        total[key] = total.get(key, 0) + m
    return sorted(total.items(), reverse=True)


def fitness(bins: Bins) -> tuple[int, int]:
    """Smaller is better: number of bins, then less the sum of squared fills."""
    return sum(m for _, m in bins), -sum(m * sum(items) ** 2 for items, m in bins)


def disturbed(lengths: list[int], rng: random.Random, by: float) -> list[int]:
    return sorted(lengths, key=lambda x: -x * (1 + by * rng.random()))


def crossover(a: Bins, b: Bins, counts: dict[int, int], cap: int, rng: random.Random) -> Bins:
    """A child of ``a`` with well-filled bins of ``b`` injected whole."""
    left = dict(counts)
    least = cap - rng.choice((0, 1, 4, 16, 64))
    child: Bins = []
    for source, chosen in ((b, lambda items: sum(items) >= least and rng.random() < 0.5), (a, lambda items: True)):
        for items, m in source:
            if chosen(items):
                need = {x: items.count(x) for x in items}
                if n := min(m, *(left[x] // k for x, k in need.items())):
                    child.append((items, n))
                    for x, k in need.items():
                        left[x] -= n * k
    return best_fit(child, left, cap, sorted((x for x in left if left[x]), reverse=True))


def mutated(bins: Bins, cap: int, rng: random.Random) -> Bins:
    """``bins`` with a share of the least filled ones, and a few others, emptied and packed anew."""
    worst = sorted(bins, key=lambda b: sum(b[0]))
    out, cut = worst[:max(1, len(worst) // rng.choice((4, 10, 30)))], []
    for b in worst[len(out):]:
        (out if rng.random() < 0.05 else cut).append(b)
    loose: dict[int, int] = {}
    for items, m in out:
        for x in items:
            loose[x] = loose.get(x, 0) + m
    return best_fit(cut, loose, cap, disturbed(list(loose), rng, 0.2))


def evolve(counts: dict[int, int], cap: int, elite: list[Bins], seed: int, generations: int = GENERATIONS,
           population: int = POPULATION) -> Bins:
    """The best packing of an island after some generations from ``elite``."""
    rng = random.Random(seed)
    bound = -(-sum(x * n for x, n in counts.items()) // cap)
    pool = [*elite] or [best_fit([], counts, cap, sorted(counts, reverse=True))]
    for _ in range(generations):
        if min(map(fitness, pool))[0] <= bound:
            break
        while len(pool) < population:
            pool.append(best_fit([], counts, cap, disturbed(list(counts), rng, 0.3)))
        children = [crossover(*rng.sample(pool, 2), counts, cap, rng) for _ in range(population)]
        children += [mutated(rng.choice(pool), cap, rng) for _ in range(population // 2)]
        pool = sorted([*pool, *children], key=fitness)[:population]
    return min(pool, key=fitness)


def pack_histogram(spark: SparkSession, counts: dict[int, int], cap: int = CAP, islands: int = ISLANDS,
                   epochs: int = EPOCHS) -> Bins:
    """Evolve packings of ``counts`` (length -> pieces) on ``islands`` tasks; the best one found."""
    if not counts:
        return []
    bound = -(-sum(x * n for x, n in counts.items()) // cap)
    elite: dict[int, list[Bins]] = {}
    for epoch in range(epochs):
        def run(batches, elite=elite, epoch=epoch):
            for b in batches:
                for i in b.column(0).to_pylist():
                    best = evolve(counts, cap, elite.get(i, []), 1000 * epoch + i)
                    yield pa.RecordBatch.from_pydict({"island": [i], "bins": [json.dumps(best)]})

        got = spark.range(0, islands, 1, islands).mapInArrow(run, "island long, bins string").collect()
        best = {r.island: [(tuple(items), m) for items, m in json.loads(r.bins)] for r in got}
        if min(fitness(b)[0] for b in best.values()) <= bound:
            break
        # elites stay on their island and migrate to the next
        elite = {i: [best[i], best[(i - 1) % islands]] for i in best}
    return min(best.values(), key=fitness)


def slots(spark: SparkSession, bins: Bins) -> DataFrame:
    """Where the pieces of each length go: numbers [first, end) lie ``each`` to a bin from ``base`` on, at ``place``."""
    rows, base = [], 0
    used: dict[int, int] = {}
    for items, m in bins:
        place = 0
        for x in sorted(set(items), reverse=True):
            k, first = items.count(x), used.get(x, 0)
            rows.append((x, first, first + m * k, k, base, place))
            used[x] = first + m * k
            place += k * x
        base += m
    return spark.createDataFrame(rows, "length long, first long, end long, each long, base long, place long")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         cap: int = CAP) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer_path, id_col, text_col, cap), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most cap rows
    where = F.broadcast(slots(spark, pack_histogram(spark, counts, cap)))
    numbered = ranked(cut, "length", ["start"], F.col("salt"))
    return (numbered.join(where, "length").where("rank >= first AND rank < end")
            .select(id_col, "piece", "start", "length", "ids_crc32",
                    F.expr("base + (rank - first) div each").alias("sequence_id"),
                    F.expr("place + (rank - first) % each * length").alias("offset")))
