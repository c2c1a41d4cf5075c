"""Every query with an oracle against DuckDB at the smallest size; the others run and keep their promises."""

import duckdb
import pytest

from textloom.registry import ORACLES, QUERIES
from textloom.streaming import jobs as J

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def canon(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    return tuple(map(canon, v)) if isinstance(v, list) else str(v)


def table(arrow):
    names = sorted(arrow.column_names)
    return names, sorted(tuple(canon(r[c]) for c in names) for r in arrow.to_pylist())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toArrow()
    if name in ORACLES:
        assert table(got) == table(duck.sql(ORACLES[name]).to_arrow_table())
    else:
        assert got.num_rows > 0


def test_rate_limits_agree(spark):
    batch = {r.event_id: r.allowed for r in QUERIES["rate_limit"](spark, SF).collect()}
    stream = {r.event_id: r.allowed for r in QUERIES["stream_rate_limit"](spark, SF).collect()}
    assert batch == stream and len(set(batch.values())) == 2


def test_rate_limit_rule(spark):
    rows = [(i, 1, f"2024-01-01 00:00:{s:02d}") for i, s in enumerate((0, 1, 2, 3, 30))] + [(9, 1, "2024-01-01 00:01:00"), (10, 2, "2024-01-01 00:00:01")]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", __import__("pyspark").sql.functions.col("ts").cast("timestamp_ntz"))
    got = {r.event_id: r.allowed for r in J.rate_limited(events, most=3, seconds=60).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False, 9: True, 10: True}
