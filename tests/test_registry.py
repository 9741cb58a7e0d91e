"""Every registered query against its DuckDB oracle on the smallest tables
(the driver's gate in miniature), plus semantic traps on the reports."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from canopy.plans.oracle_sql import ORACLE
from conftest import SF001

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "events"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def v(x):
        if isinstance(x, float):
            return round(x, 6) if not math.isnan(x) else "nan"
        return x
    return sorted((tuple(repr(v(r[i])) for i in order) for r in rows))


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF001)
    got = df.collect()
    res = con.execute(E.oracle_sql()[key])
    ocols = [d[0] for d in res.description]
    want = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert _norm(got, df.columns) == _norm(want, ocols)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["desc_subclass", "area_desmatada_km2"]
    assert df.count() >= 0


def test_every_query_has_an_oracle_or_is_listed():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_shuffle_and_salted_paths_match_broadcast(spark):
    """The plan that runs at scale (shuffle join on cells, optionally with hot
    cells salted) gives the same report as the broadcast plan used locally."""
    from conftest import SF01
    import canopy.operators.spatial_join as SJ
    from canopy.plans import alerts as qa
    from canopy.plans import layers as L

    def q01(**kw):
        a, p = L.prepared(L.alerts(spark, SF01)), L.prepared(L.parcels(spark, SF01))
        pairs = SJ.spatial_join(a, p.withColumnRenamed("id", "parcel_id"), left_id="id", right_id="parcel_id",
                                left_cols=[], right_cols=["desc_subclass"], **kw)
        return sorted((r[0], r[1]) for r in pairs.groupBy("desc_subclass").sum("inter_area").collect())

    base = q01()
    old = SJ.BROADCAST_MAX_ROWS
    SJ.BROADCAST_MAX_ROWS = -1
    try:
        assert q01() == base
        assert q01(salt_buckets=4, hot_cell_rows=20) == base
    finally:
        SJ.BROADCAST_MAX_ROWS = old
