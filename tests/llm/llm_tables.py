"""Small tables with the awkward rows that every operator must bear."""
import random

import pytest

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORDS = "the of and river stone water light over under green house walks quietly through seven open doors until morning".split()


def prose(seed, n=60):
    rng = random.Random(seed)
    out = [rng.choice(WORDS) for _ in range(n)]
    for i in range(0, n, 9):
        out[i] = out[i].capitalize()
    return " ".join(out) + "."


AWKWARD = [None, "", "   \n\t ", "one", "two words", "Ünïcode – naïve façade ☃ 漢字 \U0001f600", "a\x00b", "x" * 30_000, prose(1, 20_000),
           "  double  spaces   and\n\n\nlines \t\r\n end ", prose(2), prose(2), prose(2) + " tail"]
#: Names that the operators use themselves, as extra columns of the input.
CLASH = ["_fp", "_row", "rank", "score", "label", "shard", "slot", "component_id", "kept", "piece", "length", "id", "vec", "c0", "_text", "key"]


@pytest.fixture(scope="session")
def documents(spark):
    """(docs, rows): awkward texts, a repeated row, null and repeated ids, and columns whose names clash."""
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(20, prose(3)), (20, prose(3)), (None, prose(4)), (None, None), (21, prose(5)), (22, prose(6))]
    full = [(i, t, "en", "s", len(t or ""), *["x"] * len(CLASH)) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame(full, schema).repartition(3), rows


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents[0].limit(0)
