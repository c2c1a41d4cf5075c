"""sql_full_join counts what the joined pairs would, without making them."""

import duckdb

from textloom.plans import base, gateway


def test_counts_of_a_full_join_without_its_pairs(spark, tmp_path):
    customers = [(1, 1), (2, 1), (2, 1), (3, None), (4, None), (5, 7), (None, 1), (6, 9)]
    suppliers = [(1, 1), (2, 1), (3, None), (4, 8), (None, 8), (1, 9)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    db = duckdb.connect()
    for name in ("customer", "supplier"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = gateway.sql_full_join(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(db.execute(base.ORACLES["sql_full_join"]).fetchall(), key=str)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
