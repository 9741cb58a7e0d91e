"""Packing: exact tokens, whole and gapless sequences, and the genetic algorithm's parts."""
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from canopy.llm import packing
from llm_tables import SF001, documents, no_documents  # noqa: F401

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_pieces(rows, cap):
    tk = Tokenizer.from_file(PATH)
    out = []
    for i, t in rows:
        ids = tk.encode(t or "", add_special_tokens=False).ids + [0]
        out += [(i, k, a, len(ids[a:a + cap]), zlib.crc32(np.array(ids[a:a + cap], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), cap))]
    return sorted(out, key=str)


def check(got, rows, cap):
    """The pieces are exact, no sequence overflows or has gaps; gives the number of sequences."""
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == plain_pieces(rows, cap)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap
    return len(by)


def test_word_ids_are_the_tokenizers(documents):
    texts = [t or "" for _, t in documents[1]] + ["<|endoftext|> a<|startoftext|>b", "é ́x ́", "I'll can't  's", " a b\x1cc\x85d\xa0e",
                                                    "ΑΣ ΣΑΣ İI", "12345 6\n7", "a ́b"]
    words, tk = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    for _ in range(2):  # anew, and from memory
        assert [list(np.frombuffer(b, "<u4")) for b in words(texts)] == [tk.encode(t, add_special_tokens=False).ids for t in texts]


def test_letters_that_become_letter_and_mark():
    """Signs after them stay with the mark; every letter that Python knows, with a sign after it."""
    texts = ["İ.", "Kİ!", "\u09b9\u09df,", "\u0915\u0958)", "İ İ. İ.. İİ a.", "\ufb1d:"]
    texts += [f"{c}. a{c}!" for c in map(chr, range(128, 0x32000)) if c.isalpha() and not "\u4e00" <= c <= "\ud7a3"]
    words, tk = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    for t, b in zip(texts, words(texts)):
        assert list(np.frombuffer(b, "<u4")) == tk.encode(t, add_special_tokens=False).ids, ascii(t)


def test_query(spark):
    import __spark_entry__ as E
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    got = E.queries()["op9_packing"](spark, SF001).collect()
    n = check(got, rows, 2048)
    bound = -(-sum(r.length for r in got) // 2048)
    assert n <= bound + 2


def test_awkward_and_empty(documents, no_documents):
    docs, rows = documents
    check(packing.pack(docs, PATH, cap=64).collect(), rows, 64)
    assert packing.pack(no_documents, PATH).count() == 0


def test_one_length_with_most_pieces(spark):
    rows = [(i, "one two three" if i % 3 else " ".join("x" * (i % 50))) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(packing.pack(df, PATH, cap=50).collect(), rows, 50)


def pieces_of(bins):
    out = {}
    for items, m in bins:
        for x in items:
            out[x] = out.get(x, 0) + m
    return out


def test_operators_keep_every_piece_once():
    rng = random.Random(2)
    for seed in range(30):
        cap = rng.choice((10, 50, 200))
        counts = {x: rng.randint(1, 40) for x in rng.sample(range(1, cap + 1), rng.randint(1, cap))}
        a = packing.best_fit([], counts, cap, sorted(counts, reverse=True))
        b = packing.best_fit([], counts, cap, packing.disturbed(list(counts), rng, 0.5))
        for bins in (a, b, packing.crossover(a, b, counts, cap, rng), packing.mutated(b, cap, rng), packing.evolve(counts, cap, [b], seed)):
            assert pieces_of(bins) == counts and all(sum(items) <= cap and m > 0 for items, m in bins)


def test_best_fit_is_that_of_single_pieces():
    """On distinct lengths the bulk version is the textbook best-fit decreasing."""
    rng = random.Random(8)
    for _ in range(20):
        lengths = rng.sample(range(1, 100), 40)
        rooms = []
        for x in sorted(lengths, reverse=True):
            fits = [r for r in rooms if r >= x]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - x)
            else:
                rooms.append(100 - x)
        got = packing.best_fit([], {x: 1 for x in lengths}, 100, sorted(lengths, reverse=True))
        assert packing.fitness(got)[0] == len(rooms)


def test_evolution_beats_best_fit_decreasing(spark):
    """Triplets: bins that three pieces fill exactly, which best-fit decreasing misses."""
    rng, counts = random.Random(0), {}
    for _ in range(40):
        a, b = rng.randint(380, 490), rng.randint(250, 300)
        for x in (a, b, 1000 - a - b):
            counts[x] = counts.get(x, 0) + 1
    start = packing.fitness(packing.best_fit([], counts, 1000, sorted(counts, reverse=True)))[0]
    got = packing.pack_histogram(spark, counts, 1000)
    assert pieces_of(got) == counts
    assert 40 <= packing.fitness(got)[0] <= start
    assert packing.fitness(packing.evolve(counts, 1000, [], 1, generations=30))[0] < start or start == 40


def test_injected_bins_survive():
    counts = {6: 4, 5: 4, 4: 4, 3: 4}
    good, bad = [((6, 4), 4), ((5, 3), 4)], [((6, 3), 4), ((5, 4), 4)]
    child = packing.crossover(bad, good, counts, 10, random.Random(0))
    assert pieces_of(child) == counts and packing.fitness(child)[0] <= 8
