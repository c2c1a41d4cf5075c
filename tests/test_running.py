import random
from itertools import groupby

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators.parsers import STRETCH, row_blocks
from textloom.operators.running import running_mean, running_sums

ROW = st.tuples(st.sampled_from([None, "a", "b"]), st.one_of(st.none(), st.integers(0, 20)), st.one_of(st.none(), st.integers(-5, 5)))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ROW, max_size=25), st.integers(1, 8))
def test_sums_are_those_of_one_pass(spark, rows, width):
    numbered = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(numbered, "id int, key string, at int, value int")
    got = {r.id: (r.total, r.n) for r in running_sums(df, "key", ["at", "id"], F.floor(F.col("at") / width), {"total": F.col("value"), "n": F.lit(1)}).collect()}
    expected = {}
    order = lambda r: (r[1] is not None, r[1] or "", r[2] is not None, r[2] or 0, r[0])
    for _, mine in groupby(sorted(numbered, key=order), lambda r: r[1]):
        total, n = None, 0
        for i, _, _, value in mine:
            n += 1
            total = total if value is None else (total or 0) + value
            expected[i] = (total, n)
    assert got == expected


def test_means(spark):
    rows = [(1, "a", 1, None), (2, "a", 2, 4.0), (3, "a", 9, None), (4, "a", 30, 2.0), (5, "b", 30, 7.0)]
    df = spark.createDataFrame(rows, "id int, key string, at int, value double")
    got = {r.id: r.mean for r in running_mean(df, "value", "key", ["at"], F.floor(F.col("at") / 10)).collect()}
    assert got == {1: None, 2: 4.0, 3: 4.0, 4: 3.0, 5: 7.0}
    assert running_mean(df.limit(0), "value", "key", ["at"], F.lit(0)).count() == 0


def test_a_key_with_most_rows_is_sorted_in_stretches(spark):
    """No task of the window gets more than one stretch of the hot key."""
    df = spark.range(40000).select(F.col("id"), F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("key"), F.lit(1).alias("value"))
    told = running_sums(df, "key", ["id"], F.floor(F.col("id") / 1000), {"n": F.col("value")})
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and plan.count("hashpartitioning(key") >= 2
    own = [line for line in plan.splitlines() if "Window [sum" in line and "__own" in line]
    assert own and all("__stretch" in line for line in own)
    assert {r.key: (r.n, r.least) for r in told.groupBy("key").agg(F.max("n").alias("n"), F.min("n").alias("least")).collect()} == {"hot": (36000, 1), "cold": (4000, 1)}


def test_sheets_longer_than_a_stretch(spark):
    random.seed(3)
    numbers = sorted(random.sample(range(3 * STRETCH), 3000))
    rows = spark.createDataFrame([("s", n, f"n{n}") for n in numbers], "sheet string, row int, name string")
    blocks = row_blocks(rows, ["name"], block=50).orderBy("block").collect()
    assert [(b.block, b.first_row, b.last_row) for b in blocks] == [(i, numbers[50 * i], numbers[50 * i + 49]) for i in range(60)]
