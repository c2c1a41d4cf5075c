"""Queries: the SQL front door over the relational tables, and catalog search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import gateway as G
from textloom.plans.base import query
from textloom.sources.tables import table

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = NAMES) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names}


def _guarded(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The statement passes the guard and runs over the tables; what it says itself limits its rows."""
    for name, df in tables(spark, sf_dir).items():
        df.createOrReplaceTempView(name)
    G.check(spark, sql)
    return spark.sql(sql)


def _passed(name: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _guarded(spark, sf_dir, sql)

    run.__name__ = name
    query(sql)(run)


_passed("sql_join", "SELECT n_name, count(*) AS n_customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
_passed("sql_aggregate", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus")
_passed("sql_window", "WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) SELECT o_custkey, o_orderkey, o_totalprice, CAST(k AS BIGINT) AS k FROM r WHERE k <= 3")
_passed("sql_semi", "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
_passed("sql_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
_passed("sql_setops", "SELECT p_partkey FROM part WHERE p_size < 10 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 2")
_passed("sql_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")


@query("SELECT coalesce(c_nationkey, s_nationkey) AS nationkey, count(DISTINCT c_custkey) AS n_customers, count(DISTINCT s_suppkey) AS n_suppliers FROM customer FULL JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1")
def sql_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the full join counts, without its pairs: each customer and each supplier is in some row of it under its own nation, so both sides are summed
    up by nation and no nation's customers meet its suppliers. Rows without a nation join nothing and share one group."""
    for name, df in tables(spark, sf_dir, ("customer", "supplier")).items():
        df.createOrReplaceTempView(name)
    apart = """SELECT nationkey, sum(customers) AS n_customers, sum(suppliers) AS n_suppliers FROM (
      SELECT c_nationkey AS nationkey, count(DISTINCT c_custkey) AS customers, 0 AS suppliers FROM customer GROUP BY c_nationkey
      UNION ALL SELECT s_nationkey, 0, count(DISTINCT s_suppkey) FROM supplier GROUP BY s_nationkey) GROUP BY nationkey"""
    G.check(spark, apart)
    return spark.sql(apart)


_CROSS = """WITH nation AS (SELECT n_nationkey AS k, n_name AS name, r_name /* FROM region */ FROM nation JOIN region ON n_regionkey = r_regionkey)
 SELECT name, r_name, 'FROM orders' AS said, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM customer JOIN nation ON c_nationkey = k JOIN orders ON o_custkey = c_custkey
 WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) GROUP BY name, r_name -- JOIN supplier"""


@query(_CROSS)
def sql_qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement without databases, over tables that only a database has: the parser's places of tables get it."""
    for name, df in tables(spark, sf_dir).items():
        df.createOrReplaceGlobalTempView(f"shop_{name}")
    places = {n: "global_temp" for n in NAMES}
    sql = G.qualified(_CROSS, places).replace("global_temp.", "global_temp.shop_")
    G.check(spark, sql)
    return spark.sql(sql)


_VIEWS = ", ".join(f"'{n}'" for n in NAMES)
_COLUMNS = f"(SELECT table_name, column_name, ordinal_position AS ordinal, data_type FROM information_schema.columns WHERE table_name IN ({_VIEWS}))"
_FIELDS = ["c_nationkey", "c_custkey", "s_nationkey", "n_nationkey", "n_regionkey", "r_regionkey"]


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in NAMES))
def table_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sizes(tables(spark, sf_dir))


_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in NAMES)


@query(f"""WITH m AS (SELECT table_name, string_agg(column_name, ',' ORDER BY column_name) AS matched, count(*) AS n_matched FROM {_COLUMNS} WHERE column_name IN ({', '.join(repr(f) for f in _FIELDS)}) GROUP BY 1)
 SELECT table_name, matched, n_matched, n_rows FROM m JOIN ({_COUNTS}) USING (table_name)""")
def field_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that have some of the fields, and how many rows each has of them."""
    held = tables(spark, sf_dir)
    return G.tables_with_fields(G.catalog_columns(held), _FIELDS).join(G.sizes(held), "table_name")


@query(f"WITH c AS ({_COUNTS}), d AS (SELECT table_name, 'table ' || table_name || ': ' || string_agg(column_name, ', ' ORDER BY ordinal) AS description FROM {_COLUMNS} GROUP BY 1) SELECT table_name, description || '; rows: ' || n_rows AS description FROM d JOIN c USING (table_name)")
def describe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as texts to search, columns in order (types differ between engines and are left out here)."""
    held = tables(spark, sf_dir)
    texts = G.described(G.catalog_columns(held).withColumn("data_type", F.lit(None).cast("string")))
    return texts.join(G.sizes(held), "table_name").select("table_name", F.concat("description", F.lit("; rows: "), "n_rows").alias("description"))
