"""Encoding and decoding against the tokenizers library."""
import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from canopy.llm import bpe
from llm_tables import SF001, documents, no_documents  # noqa: F401

PATH = public_tokenizers.path("byte_bpe_50k.json")
TK = Tokenizer.from_file(PATH)
OWN = bpe.ByteBpe(PATH)


def same(text):
    want = TK.encode(text, add_special_tokens=False).ids
    assert OWN.ids(text) == want if text else OWN.encode([text]) == [[]]
    assert OWN.decode(want) == TK.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", [
    "", " ", "  ", "   ", "a b", "a  b", "a   b", " a", "a ", "a  ", "\n a", "a\n b", "a \n", "a \nb", "a\n ", "a \n b", " \n a", "\n\n\na", "a\t\tb \t c",
    "a\xa0 b", "a\xa0  b", "x\x1cy \x1c z", "\x85 a", "　 a", "I'll we've can't 's 'S", "<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>  ",
    "<|endoftext", "naïve café 漢字 \U0001f600‍", "123 4567٣ ½", "!!! ??? ...", "a" * 3000, "-" * 500, "the" * 400, " " * 200 + "x", "x" + " " * 200,
    "internationalization Internationalization INTERNATIONALIZATION", "\r\n\r\n", "é́ ́",
])
def test_known_cases(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tthearndoing's0.!"), st.characters(codec="utf-8", max_codepoint=0x2fff, exclude_categories=["Cn", "Cs"])), max_size=60))
def test_any_text(text):
    same(text)


def test_long_random_words():
    rng = random.Random(0)
    for n in (1, 2, 5, 17, 80, 400):
        for _ in range(30):
            same("".join(rng.choice("aeinrstouhl ") for _ in range(n)))


def test_prefixes_are_shared_and_computed_once(monkeypatch):
    own, seen = bpe.ByteBpe(PATH), []
    adjacent = own.adjacent
    monkeypatch.setattr(own, "adjacent", lambda a, b: seen.append(1) or adjacent(a, b))
    words = [b"transportation", b"transportations", b"transportational", b"transportationally"]
    got = dict(own.encode_words(words))
    together = len(seen)
    seen.clear()
    for w in words:
        assert dict(own.encode_words([w])) == {w: got[w]}
    assert together < 0.6 * len(seen)
    assert {w: [own.token[i] for i in t] for w, t in got.items()} == {w: own.merge(w) for w in words}


def test_decoding_of_broken_utf8():
    for ids in ([OWN.id[b"\xe6"]], [OWN.id[b"\xe6"], OWN.id[b"a"]], [OWN.id[b"\xff"], OWN.id[b"\xf0"]], [50256]):
        assert OWN.decode(ids) == TK.decode(ids, skip_special_tokens=False)


def plain(text):
    ids = TK.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(TK.decode(ids, skip_special_tokens=False))


def test_query(spark):
    import __spark_entry__ as E
    got = {r.doc_id: tuple(r)[1:] for r in E.queries()["op10_bpe"](spark, SF001).collect()}
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    assert got == {d.doc_id: plain(d.text) for d in docs}


def test_awkward_and_empty(documents, no_documents):
    docs, rows = documents
    got = bpe.digests(docs, PATH)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, *plain(t)) for i, t in rows), key=str)
    whole = {r.doc_id: r for r in bpe.encoded(docs, PATH).collect()}
    for i, t in rows:
        if i is not None and len(t or "") < 1000:
            assert whole[i].ids == TK.encode(t or "", add_special_tokens=False).ids and whole[i].decoded == (t or "")
    assert bpe.digests(no_documents, PATH).count() == 0


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHARS", 50)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 5)
    own = bpe.ByteBpe(PATH)
    for k in range(20):
        text = f"some new words number {k} and {k * k}"
        assert own.ids(text) == TK.encode(text, add_special_tokens=False).ids
    assert own.held < 200 and len(own.pairs) <= 6
