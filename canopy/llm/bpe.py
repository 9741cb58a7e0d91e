"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

**Last-token states.** For a fixed list of merges, the encoding of every prefix of
a word is fixed by its last token: prefix p ends in token t exactly if t is a suffix of
p, and the encoding of the rest of p, whose last token is known by then, may be
followed by t. Two tokens may stand side by side exactly if merging their joined
bytes gives these two tokens again. So a word is encoded from left to right with one
state, the last token, for each byte, and read back from its end.

**Trie.** The distinct words of a block of texts are put in byte order, which is the depth-first
order of their trie: a word continues at the node where it leaves its
predecessor, and the states above that node, those of the shared prefix, are
on the stack already. Each trie node's state is thus computed once.

**Texts.** A text is cut before each space (where the split pattern never crosses), and each
distinct cut is split into words by the pattern and kept with its ids. Texts in which such a cut could
fall inside one match of the pattern (three or more white-space characters in a row, or rare white space)
are split by the pattern as a whole. Special tokens' strings are found first, as the tokenizers library does.
A task keeps the ids of its latest words in a table of bounded size.

**Decoding** joins the bytes of the ids; bytes that are no UTF-8 become U+FFFD.

Defined cases: a null text counts as empty and has no ids; repeated rows and
null ids get a row each; texts of any length are encoded whole; an empty table
gives an empty result. Other input columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

# Fixed value: the pattern that splits text into words before the merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space other than these four, and a space amid or at the end of other white space: no cut before spaces then.
UNCUT = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|[ \n\r\t] (?:[ \n\r\t]|\\Z)")
#: Bounds of what a task remembers: characters of cut texts, pairs of tokens.
CACHE_CHARS, CACHE_PAIRS = 8_000_000, 1_000_000
NONE = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: visible Latin-1 as itself, the rest from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """A byte-level BPE vocabulary in the tokenizers library's JSON form."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.token = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        self.id = {b: i for i, b in self.token.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        as_bytes = lambda t: bytes(letters[c] for c in t)
        self.rank = {(as_bytes(a), as_bytes(b)): r for r, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token |= {i: t.encode("utf-8") for t, i in self.special.items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.longest = max(map(len, self.id))
        self.words = regex.compile(SPLIT).findall
        #: id of every token that merging makes of its own bytes; no other occurs in an encoding
        self.usable = {t: i for t, i in self.id.items() if self.merge(t) == [t]}
        self.pairs: dict[int, bool] = {}
        self.cuts: dict[str, tuple[int, str, bytes]] = {}
        self.held = 0

    def merge(self, raw: bytes) -> list[bytes]:
        """The encoding by definition: the lowest-ranked adjacent pair is joined, again and again."""
        rank = self.rank.get
        parts = [raw[i:i + 1] for i in range(len(raw))]
        ranks = [rank(p, NONE) for p in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != NONE:
            i = ranks.index(least)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), NONE)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), NONE)
        return parts

    def adjacent(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow token ``a`` in an encoding."""
        if (known := self.pairs.get(a << 32 | b)) is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            x, y = self.token[a], self.token[b]
            known = self.pairs[a << 32 | b] = (x, y) not in self.rank and self.merge(x + y) == [x, y]
        return known

    def encode_words(self, words: list[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """(word, ids) of distinct words, depth-first through their trie.

        Only one token can end a prefix, so candidates may be tried in any
        order: first the one that continues the last byte's token, then a new
        one, then the others.
        """
        token, adjacent, longest = self.usable.get, self.adjacent, self.longest
        last: list[int] = []  # last[i]: the id of the last token of the path's first i + 1 bytes
        size: list[int] = []  # and its length
        path = b""
        for w in sorted(words):
            shared, most = 0, min(len(path), len(w))
            if path[:most] == w[:most]:
                shared = most
            else:
                while path[shared] == w[shared]:
                    shared += 1
            del last[shared:], size[shared:]
            for end in range(shared + 1, len(w) + 1):
                go_on = end - 1 - size[-1] if end > 1 else 0
                for begin in (go_on, end - 1, *range(max(0, end - longest), end - 1)):
                    t = token(w[begin:end])
                    if t is not None and (not begin or adjacent(last[begin - 1], t)):
                        last.append(t)
                        size.append(end - begin)
                        break
                else:
                    raise ValueError(f"no token for byte {w[end - 1]}")
            path = w
            out, at = [], len(w)
            while at:
                out.append(last[at - 1])
                at -= size[at - 1]
            yield w, out[::-1]

    def learn(self, cuts: set[str]) -> None:
        """Remember the ids of cut texts."""
        split = {c: [w.encode("utf-8") for w in self.words(c)] for c in cuts}
        ids = {w: t for w, t in self.encode_words(list({w for ws in split.values() for w in ws}))}
        for c, ws in split.items():
            got = [i for w in ws for i in ids[w]]
            self.cuts[c] = len(got), ",".join(map(str, got)), self.decode_bytes(got)
        self.held += sum(map(len, cuts))

    def cut(self, text: str) -> list[str]:
        """``text`` in parts that can be encoded one by one; a special token's string is a part."""
        if self.specials and (parts := self.specials.split(text)) and len(parts) > 1:
            return [c for p in parts for c in ([p] if p in self.special else self.cut(p) if p else [])]
        if not text:
            return []
        if UNCUT.search(text):
            return self.words(text)
        first, *rest = text.split(" ")
        return [c for c in (first, *(" " + r for r in rest)) if c]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.token[i] for i in ids])

    def encode(self, texts: list[str]) -> list[list[tuple[int, str, bytes]]]:
        """For each whole text its parts in order: (number of ids, the ids listed, their bytes)."""
        if self.held > CACHE_CHARS:
            self.cuts, self.held = {}, 0
        for s, i in self.special.items():
            self.cuts[s] = 1, str(i), self.decode_bytes([i])
        cut = [self.cut(t) for t in texts]
        self.learn({c for cs in cut for c in cs if c not in self.cuts})
        return [[self.cuts[c] for c in cs] for cs in cut]

    def ids(self, text: str) -> list[int]:
        return [int(i) for _, listed, _ in self.encode([text])[0] for i in listed.split(",")]

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def vocabulary(path: str) -> ByteBpe:
    """A worker process keeps one vocabulary and what it learnt from task to task."""
    return ByteBpe(path)


def encoded(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``ids`` and ``decoded`` (the ids decoded again)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(tokenizer_path)
        for b in slices(batches):
            got = [bpe.ids(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int32())), pa.array(map(bpe.decode, got))],
                                             names=[id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, SHA-256 of the listed ids and of the decoded text."""
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = vocabulary(tokenizer_path), lambda b: hashlib.sha256(b).hexdigest()
        for b in slices(batches):
            texts = bpe.encode([t or "" for t in b.column(1).to_pylist()])
            decoded = (b"".join([raw for _, _, raw in parts]).decode("utf-8", "replace") for parts in texts)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([sum([n for n, _, _ in parts]) for parts in texts], pa.int64()),
                pa.array([sha(",".join([listed for _, listed, _ in parts]).encode()) for parts in texts]),
                pa.array([sha(d.encode("utf-8")) for d in decoded])], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
