import duckdb
import pytest

import __spark_entry__
from trekframe.plans import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect(config={"memory_limit": "4GB"})
    for name in ("events", "lineitem", "orders"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def shown(values):
    return tuple(None if v != v else round(v, 9) if isinstance(v, float) else v for v in values)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_agrees(spark, con, name):
    found = con.sql(queries.ORACLE_SQL[name])
    mine = queries.QUERIES[name](spark, FOLDER)
    assert sorted(mine.columns) == sorted(found.columns)
    assert sorted(str(shown(r)) for r in mine.select(*found.columns).collect()) == sorted(str(shown(r)) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_the_others_give_rows(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0


def test_entry_point(spark):
    found = __spark_entry__.entry(spark)
    assert found.count() == 15 and "difficulty" in found.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scans_read_only_what_they_need(spark):
    plan = queries.QUERIES["track_stats"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "props" not in schema and "event_type" not in schema


def test_dominant_band_of_tracks_that_their_last_sample_decides(spark, tmp_path):
    """Two tracks of events at 60 times sf0.1, by user and shift of the keys; both were FLAT, in the SQL DESCENT."""
    con = duckdb.connect(config={"memory_limit": "4GB"})
    some = " UNION ALL ".join(
        f"SELECT * REPLACE (event_id + {shift} AS event_id, user_id + {shift} AS user_id) FROM '/root/testdata/sf0.1/events.parquet' WHERE user_id = {user}"
        for user, shift in ((149, 160_000_000_000), (1329, 34_000_000))
    )
    con.execute(f"COPY ({some}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    wanted = con.execute(queries.ORACLE_SQL["dominant_band"]).fetchall()
    assert sorted(wanted) == [("160000000149", "DESCENT"), ("34001329", "DESCENT")]
    assert sorted(tuple(r) for r in queries.QUERIES["dominant_band"](spark, str(tmp_path)).collect()) == sorted(wanted)
