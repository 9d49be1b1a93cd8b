"""Driver contract at sf0.001: entry() runs; every query with an oracle matches DuckDB."""

import duckdb
import pytest

import __spark_entry__ as E
from scripts.check_oracle import digest, norm

SF = "/root/testdata/sf0.001"
TABLES = ["events", "conversations", "documents", "embeddings", "benchmark"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "avg_velocity" in df.columns


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    s = E.queries()[name](spark, SF).toPandas()
    o = con.execute(E.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(o.columns)
    assert len(s) == len(o)
    assert digest(norm(s)) == digest(norm(o))


def test_fixture_anchors_sf0001(spark):
    """Anchor values of FIXTURES.md section 3 (merge 6 h, idle 24 h, look-back 48 h)."""
    from pyspark.sql import functions as F

    from sessionlog.config import ADAPTER_AGG, ExecConfig
    from sessionlog.operators.blocks import activity_blocks
    from sessionlog.operators.corrections import error_corrections
    from sessionlog.operators.gaps import idle_gaps
    from sessionlog.sources.adapter import load_driver_events

    ev = load_driver_events(spark, SF)
    for exe in (ExecConfig(), ExecConfig(chunk_rows=16)):
        closed = {r.closed_by: r["count"] for r in activity_blocks(ev, ADAPTER_AGG, exe).groupBy("closed_by").count().collect()}
        assert closed == {"context_switch": 391, "session_end": 14, "timeout": 110}
        assert idle_gaps(ev, ADAPTER_AGG, exe).count() == 96
        c = error_corrections(ev, ADAPTER_AGG, exe)
        assert c.count() == 36 and c.agg(F.sum("ticks_reversed")).first()[0] == 561
