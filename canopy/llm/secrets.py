"""Secret spans: fixed patterns, and a randomness test battery with false-discovery control.

**Pattern spans.** ``assign`` (a key word, ``:`` or ``=`` and a value of 8 or
more characters), ``access`` (AKIA keys of 16 or more) and ``hex`` (runs of 32
or more), each kind's matches found left to right without overlap; a match
that fails its length is dropped after it has used up its text. Positions are
code points, the end exclusive.

**Randomness battery.** Other candidates are runs of 24 or more characters of
the base64 alphabets that overlap no pattern span. Each one's encoding is
inferred from the characters it uses (``ENCODINGS``, the first that fits). A run
that fits none (no digit, or separators beside letters of one case, or of both
base64 alphabets) is tested by its parts between separators that are long enough
to be candidates themselves, and by all its letters and digits without the separators
(the run as it is, if they are too few), each with the encoding of ``PART_ENCODINGS`` that fits; it is cleared if all of
these are. Against the hypothesis that its characters were
drawn independently and uniformly from that alphabet, three tests are made:

* chi-squared: the sum of squared character counts, standardised by its exact
  mean and variance at the run's length (short runs have few per cell);
* runs: the changes between the alphabet's halves, of mean and variance (n-1)/2, (n-1)/4;
* serial correlation of neighbouring characters, of variance 1/(n-1).

The smallest of the three two-sided p-values, times three, is the candidate's.

Against some thirty letters chi-squared has little power, and ordinary names of several words would pass for random. So the parts of runs that
fit no encoding are also tested for what words of a language show and random letters don't: more vowels (a binomial count), and more changes
between vowels and other characters within the words between separators (a runs test with vowels as the one kind). Both are one-sided, of exact mean and
variance under the same hypothesis. Their smaller p-value times two gets 0.8 of the weight, the three tests together the rest (a weighted
Bonferroni bound, so the p-value stays one).

**Length-aware false-discovery control.** "Not random" is the discovery that
clears a candidate, so a false discovery is a missed secret. Benjamini and Hochberg's
step-up is made separately for every encoding and length class (doubling),
since power grows with length: of the candidates cleared in a class, a share of at most ``q`` (``parts_q`` of parts) is expected to be
random. What is not cleared is reported as ``random``. P-values are rounded up to
a grid of 20 steps a decade, which keeps the bound and makes the step-up a
count over a table of fixed size; all candidates of the table take part.

Only DataFrame functions run. The texts are scanned once and not shuffled;
their spans are written to the shared folder, counted there and joined with nothing.

Defined cases: a null text counts as empty and has no spans; repeated rows and
null ids get a row each; an empty table gives an empty result. Other input
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import by_place, written

# The pattern kinds in their order, their expressions, the group whose length counts, and its least length.
KINDS = ["assign", "access", "hex", "random"]
PATTERNS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
    "random": (r"[A-Za-z0-9+/_-]+={0,2}", 0, 24),
}
#: What a text must hold to be scanned for a kind at all; never rarer than a span.
PROBES = {
    "assign": r"(?i:passw|secret|token|api_?key)",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
    "random": r"[A-Za-z0-9+/_-]{22}",
}
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (name, what the whole run must match, alphabet)
ENCODINGS = [
    ("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", UPPER + "234567"),
    ("base36", r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", DIGITS + LOWER),
    ("BASE36", r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$", DIGITS + UPPER),
    ("base62", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
]
#: Of the parts of runs that fit none of these; classes of their own. One fits always.
PART_ENCODINGS = [
    ("decimal", r"^[0-9]+$", DIGITS),
    *ENCODINGS[:6],
    ("lower", r"^[a-z]+$", LOWER),
    ("UPPER", r"^[A-Z]+$", UPPER),
    ("letters", r"^[A-Za-z]+$", UPPER + LOWER),
    ("lower, separators", r"^[0-9a-z+/_-]+$", DIGITS + LOWER + "+/-_"),
    ("UPPER, separators", r"^[0-9A-Z+/_-]+$", DIGITS + UPPER + "+/-_"),
    ("separators", r"^", UPPER + LOWER + DIGITS + "+/-_"),
]
SEPARATORS, VOWELS = "+/-_", "aeiouAEIOU"
#: Share of the weight that the tests for words get among the tests of a part.
WORDS_WEIGHT = 0.8
#: Share of the cleared that may be random: of whole runs, and of parts, which most ordinary names are.
Q, PARTS_Q = 0.05, 0.1
STEPS, LAST_STEP = 20, 600
MASK = "[SECRET]"
_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _matches(text: str, kind: str) -> Column:
    """Array of (start, kind, end, value) of one kind's matches of sufficient length."""
    pattern, group, least = PATTERNS[kind]
    t, p = F.col(text), F.lit(pattern)
    # between match i-1 and match i lies the i-th part of the split, so positions are sums of lengths
    zipped = F.arrays_zip(
        F.split(t, pattern, -1).alias("gap"), F.regexp_extract_all(t, p, F.lit(0)).alias("hit"),
        F.regexp_extract_all(t, p, F.lit(group)).alias("value"))
    start = F.expr(f"named_struct('at', 0L, 'out', cast(array() as array<struct<start:bigint,kind:int,end:bigint,value:string>>))")

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        found = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(s["out"], F.array(found)))
                        .otherwise(s["out"]).alias("out"))

    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint,value:string>>)")
    return F.when(t.rlike(PROBES[kind]), F.aggregate(zipped, start, step, lambda s: s["out"])).otherwise(none)


def _tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution, by a rational approximation good to 1e-7."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(F.lit(1.0), 2 * F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly)


def _tested(found: Column) -> Column:
    """Candidates (start, end, value) as (start, end, class, step), one for each part that is tested."""
    body = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"),
                                                 F.regexp_replace(x["value"], "=+$", "").alias("body")))
    known = F.array(*[F.lit(a) for _, _, a in ENCODINGS + PART_ENCODINGS])
    least = PATTERNS["random"][2]
    # of the encodings of parts: how likely a letter or digit is a vowel; 0 where words are not tested for
    plain = ["".join(c for c in a if c not in SEPARATORS) for _, _, a in PART_ENCODINGS]
    vowel_share = F.array(*[F.lit(0.0)] * len(ENCODINGS), *[F.lit(sum(c in VOWELS for c in a) / len(a)) for a in plain])

    def encoding(text: Column, encodings: list, first: int) -> Column:
        e = F.lit(None).cast("int")
        for i in reversed(range(len(encodings))):
            e = F.when(text.rlike(encodings[i][1]), first + i).otherwise(e)
        return e

    def unit(x: Column, text: Column, enc: Column, whole: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), text.alias("body"), enc.alias("enc"), whole.alias("whole"))

    def units(x: Column) -> Column:
        enc = encoding(x["body"], ENCODINGS, 0)
        joined = F.regexp_replace(x["body"], "[+/_-]", "")
        long = F.filter(F.split(x["body"], "[+/_-]", -1), lambda p: F.length(p) >= least)
        rest = F.when(F.length(joined) >= least, joined).otherwise(x["body"])
        # a part is a word of its own; what is left without separators keeps its words for the tests of words
        parts = F.array_distinct(F.concat(F.transform(F.filter(long, lambda p: p != rest), lambda p: F.struct(p.alias("text"), p.alias("whole"))),
                                          F.array(F.struct(rest.alias("text"), x["body"].alias("whole")))))
        return F.when(enc.isNotNull(), F.array(unit(x, x["body"], enc, F.lit("")))).otherwise(
            F.transform(parts, lambda p: unit(x, p["text"], encoding(p["text"], PART_ENCODINGS, len(ENCODINGS)), p["whole"])))

    def values(x: Column) -> Column:
        letters = F.filter(F.split(x["body"], "", -1), lambda c: c != "")
        alphabet = F.element_at(known, x["enc"] + 1)
        words = F.filter(F.split(x["whole"], f"[{SEPARATORS[:2]}_-]", -1), lambda w: w != "")
        runs = F.aggregate(words, F.lit(0), lambda s, w: s + F.regexp_count(w, F.lit(f"[{VOWELS}]+|[^{VOWELS}]+")) - 1)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["enc"].alias("enc"),
                        F.regexp_count(x["whole"], F.lit(f"[{VOWELS}]")).cast("double").alias("vowels"), runs.cast("double").alias("turns"),
                        F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w)).cast("double").alias("letters"),
                        F.size(words).cast("double").alias("words"), F.size(F.filter(words, lambda w: F.length(w) == 1)).cast("double").alias("ones"),
                        F.length(alphabet).cast("double").alias("a"), F.length(x["body"]).alias("n"),
                        F.transform(letters, lambda c: (F.instr(alphabet, c) - 1).cast("double")).alias("xs"))

    def scores(x: Column) -> Column:
        a, n, xs = x["a"], x["n"].cast("double"), x["xs"]
        squares = F.aggregate(F.array_distinct(xs), F.lit(0.0), lambda s, v: s + F.pow(
            F.size(F.filter(xs, lambda y: y == v)).cast("double"), F.lit(2.0)))
        chi = (squares * a / n - n - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)
        pairs = F.arrays_zip(F.slice(xs, F.lit(1), x["n"] - 1).alias("l"), F.slice(xs, F.lit(2), x["n"] - 1).alias("r"))
        changes = F.size(F.filter(pairs, lambda p: (p["l"] >= a / 2) != (p["r"] >= a / 2)))
        runs = (changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        mean = (a - 1) / 2
        cross = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["l"] - mean) * (p["r"] - mean))
        serial = cross / ((a * a - 1) / 12) / F.sqrt(n - 1)
        three = 3 * F.least(_tail(chi), _tail(runs), _tail(serial))
        v = F.element_at(vowel_share, x["enc"] + 1)
        vq, inner = v * (1 - v), x["letters"] - x["words"]
        more = (x["vowels"] - x["letters"] * v) / F.sqrt(F.greatest(x["letters"] * vq, F.lit(1e-9)))
        # changes of neighbours, and those that share a character
        spread = inner * 2 * vq * (1 - 2 * vq) + 2 * (inner - x["words"] + x["ones"]) * (vq - 4 * vq * vq)
        turns = (x["turns"] - inner * 2 * vq) / F.sqrt(F.greatest(spread, F.lit(1.0)))
        upper = (lambda z: F.when(z > 0, _tail(z) / 2).otherwise(F.lit(1.0)))
        p = F.least(F.lit(1.0), F.when(v > 0, F.least(2 * F.least(upper(more), upper(turns)) / WORDS_WEIGHT, three / (1 - WORDS_WEIGHT))).otherwise(three))
        step = F.least(F.lit(LAST_STEP), F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * STEPS).cast("int"))
        size = F.floor(F.log2(n)).cast("int")
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), (x["enc"] * 64 + size).alias("class"), step.alias("step"))

    out = F.flatten(F.transform(F.filter(body, lambda x: F.length(x["body"]) >= least), units))
    return F.transform(F.transform(out, values), scores)


def scanned(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``_base``, the pattern spans in order, and ``_tested``, the other candidates with their p-value steps."""
    got = df.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    base = F.concat(*[_matches("_text", k) for k in KINDS[:3]])
    got = got.withColumn("_base", F.array_sort(F.transform(base, lambda x: F.struct(
        x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))))
    free = F.filter(F.col("_found"), lambda x: ~F.exists(
        F.col("_base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return (got.withColumn("_found", _matches("_text", "random")).withColumn("_found", free)
            .withColumn("_tested", _tested(F.col("_found"))).drop("_text", "_found"))


def least_steps(tested: DataFrame, q: float = Q, parts_q: float = PARTS_Q) -> dict[int, int]:
    """class -> least p-value step at which a candidate is cleared (classes in which none is are absent).

    The counts have at most 21 encodings x 64 lengths x 601 steps, the result one row a class.
    """
    counts = (tested.select(F.explode("_tested").alias("x")).groupBy(F.col("x.class").alias("class"), F.col("x.step").alias("step"))
              .agg(F.count("*").alias("n")))
    per = W.partitionBy("class")
    ranks = counts.select("class", "step", F.sum("n").over(per.orderBy(F.desc("step"))).alias("rank"), F.sum("n").over(per).alias("m"))
    share = F.when(F.col("class") < len(ENCODINGS) * 64, q).otherwise(parts_q)
    cleared = ranks.where(F.pow(F.lit(10.0), -F.col("step") / STEPS) <= share * F.col("rank") / F.col("m"))
    return {r["class"]: r.least for r in cleared.groupBy("class").agg(F.min("step").alias("least")).collect()}


def _all_spans(steps: dict[int, int]) -> Column:
    """``_base`` and the candidates of which not all parts were cleared, in order."""
    bound = F.create_map(*[F.lit(v) for kv in steps.items() for v in kv]) if steps else F.expr("cast(map() as map<int,int>)")
    kept = F.filter(F.col("_tested"), lambda x: x["step"] < F.coalesce(F.element_at(bound, x["class"]), F.lit(LAST_STEP + 1)))
    extra = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), x["end"].alias("end")))
    return F.array_sort(F.concat("_base", F.array_distinct(extra))).cast(_SPAN)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = Q) -> DataFrame:
    """One row per row of ``docs``: id, counts per pattern kind, ``base`` and ``spans`` as span lists."""
    seen = written(scanned(docs.select(id_col, text_col), text_col).drop(text_col), "spans")
    return seen.select(id_col, F.col("_base").alias("base"), _all_spans(least_steps(seen, q)).alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of ``find_secrets``' result."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(id_col, *[count(k) for k in KINDS[:3]],
                        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def masked(docs: DataFrame, text_col: str = "text", q: float = Q, size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every secret span replaced by ``MASK``, all other columns unchanged.

    Overlapping spans become one mask; ``size_col``, if the table has it, is
    the new length where the text changed. A null text stays null. The table
    is scanned twice (once for the class bounds), so no text is written.
    """
    steps = least_steps(scanned(docs.select(text_col), text_col).select("_tested"), q)
    own = by_place(docs)
    place = dict(zip(docs.columns, own.columns))
    got = scanned(own, place[text_col]).withColumn("_spans", _all_spans(steps)).drop("_base", "_tested")
    t = F.col(place[text_col])

    def step(s: Column, x: Column) -> Column:
        new = x["start"] >= s["at"]
        gap = F.substring(t, s["at"].cast("int") + 1, (x["start"] - s["at"]).cast("int"))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"),
                        F.when(new, F.concat(s["out"], gap, F.lit(MASK))).otherwise(s["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    hidden = F.aggregate("_spans", start, step, lambda s: F.concat(s["out"], F.substring(t, s["at"].cast("int") + 1, F.length(t))))
    got = got.withColumn("_new", F.when(F.size("_spans") > 0, hidden).otherwise(t))
    changed = F.size("_spans") > 0
    put = {text_col: F.col("_new")}
    if size_col in place:
        put[size_col] = F.when(changed, F.length("_new").cast(docs.schema[size_col].dataType)).otherwise(F.col(place[size_col]))
    return got.select(*[put.get(c, F.col(place[c])).alias(c) for c in docs.columns])
