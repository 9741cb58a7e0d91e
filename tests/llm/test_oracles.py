"""The SQL of the queries that have some, on the smallest tables and on secrets of every kind."""
import base64
import random

import duckdb
import pytest

import __spark_entry__ as E
from llm_tables import SF001

KEYS = ["op4_embedding_dedup", "op5_secret_scan", "op6_warc", "op11_lexical_search", "op12_hard_negatives", "op13_exact_search"]


def both(spark, con, key, folder):
    df = E.queries()[key](spark, folder)
    res = con.execute(E.oracle_sql()[key])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    return sorted(map(repr, map(tuple, df.collect()))), sorted(repr(tuple(r[i] for i in at)) for r in res.fetchall())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_its_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    got, want = both(spark, con, key, SF001)
    assert got == want


def test_secret_battery_matches_its_sql(spark, tmp_path):
    rng = random.Random(2)
    runs = [base64.b64encode(rng.randbytes(rng.randint(18, 60))).decode() for _ in range(80)]
    runs += [rng.randbytes(rng.randint(12, 15)).hex() for _ in range(40)] + [base64.b32encode(rng.randbytes(25)).decode() for _ in range(40)]
    runs += ["Some/Path3/with/Folders/and/Names", "abcabcabc123abcabcabc123abcabc", "A1" * 15, "X9y" * 12]
    texts = [None, "", "password = tooshort1 token:abc"] + [f"é {rng.choice(runs)} mid {rng.choice(runs)}, token={rng.choice(runs)}" for _ in range(250)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got, want = both(spark, con, "op5_secret_scan", str(tmp_path))
    assert got == want
    assert sum("random:" in g for g in got) > 50
