"""A guarded SQL front door: read-only statements, capped results, and catalog search."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONGEST = 4096
MOST_ROWS = 100
#: Kinds of parsed statements that only look: everything else with "Command", "Insert" and the like in it is refused.
LOOKING = {"ShowTables", "ShowColumns", "ShowNamespaces", "ShowFunctions", "ShowTableProperties", "DescribeRelation", "DescribeColumn", "DescribeNamespace", "DescribeQueryCommand", "ExplainCommand"}
CHANGING = re.compile(
    r"Insert|Delete|Update|Merge|Drop|Create|Replace|Alter|Truncate|Rename|Set|Cache|Uncache|Refresh|Load|Analyze|Repair|Recover|Add|Call|Command|Clear|Reset|Comment|Export|Write|Overwrite"
)


class Refused(ValueError):
    """The statement is not one that only reads."""


def parsed(spark: SparkSession, sql: str):
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def check(spark: SparkSession, sql: str) -> None:
    """Raises Refused unless the statement, all that stands inside it included, only reads. It is the parsed statement that is
    judged: a column called create_time is none of its business, and two statements don't parse."""
    if len(sql) > LONGEST:
        raise Refused(f"{len(sql)} characters; {LONGEST} are allowed")
    try:
        plan = parsed(spark, sql)
    except Exception as e:
        raise Refused("no single SQL statement") from e
    stack, first = [plan], True
    while stack:
        node = stack.pop()
        kind = node.getClass().getSimpleName().rstrip("$")
        if kind not in LOOKING and CHANGING.search(kind) and not re.fullmatch(r"(Left|Right)?.*SetOperation|UnresolvedSubqueryColumnAliases", kind):
            raise Refused(f"{kind} is not allowed")
        if kind in LOOKING and not first and kind != "ExplainCommand":
            raise Refused(f"{kind} inside another statement")
        if kind == "ExplainCommand":
            stack.append(node.logicalPlan())
        first = False
        for group in (node.children(), node.innerChildren()):
            for i in range(group.size()):
                child = group.apply(i)
                if hasattr(child, "children"):
                    stack.append(child)


def run(spark: SparkSession, sql: str, most: int = MOST_ROWS) -> DataFrame:
    check(spark, sql)
    return spark.sql(sql).limit(most)


def run_repaired(spark: SparkSession, sql: str, repair, most: int = MOST_ROWS) -> DataFrame:
    """As run; if the statement can't be resolved, once more with what ``repair(sql, columns)`` makes of it, columns being
    those of the tables that it names."""
    try:
        return run(spark, sql, most)
    except Refused:
        raise
    except Exception:
        tables = [parts[-1] for _, parts in named(spark, sql)]
        columns = {t: [c.name for c in spark.catalog.listColumns(t)] for t in dict.fromkeys(tables) if spark.catalog.tableExists(t)}
        return run(spark, repair(sql, columns), most)


def _spelt(sql: str, at: int) -> str:
    """The identifier that begins at a place, as it is written."""
    found = re.compile(r"`(?:[^`]|``)*`|[\w$]+").match(sql, at)
    return found[0] if found else ""


def named(spark: SparkSession, sql: str) -> list[tuple[int, list[str]]]:
    """(place, parts of the name) of each table that a statement reads, where it is named. Names of common table expressions are no tables inside
    their statement, and those that an inner one hides are themselves again outside it."""
    found: list[tuple[int, list[str]]] = []
    scala = lambda seq: [seq.apply(i) for i in range(seq.size())]

    def visit(node, hidden: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedWith":
            for pair in scala(node.cteRelations()):
                name = pair._1().lower()
                visit(pair._2(), hidden | {name} if node.allowRecursion() else hidden)
                hidden = hidden | {name}
            visit(node.child(), hidden)
            return
        if kind == "UnresolvedRelation":
            parts = [str(p) for p in scala(node.multipartIdentifier())]
            start = node.origin().startIndex()
            if start.isDefined() and (len(parts) > 1 or parts[0].lower() not in hidden):
                found.append((start.get(), parts))
        for group in (node.children(), node.innerChildren()):
            for child in scala(group):
                if hasattr(child, "innerChildren"):
                    visit(child, hidden)

    visit(parsed(spark, sql), frozenset())
    return sorted(set((at, tuple(parts)) for at, parts in found))


def qualified(sql: str, places: dict[str, str], aliases: dict[str, str] | None = None) -> str:
    """Tables without a database get the one that ``places`` names; databases under an alias get their name. The statement is changed where the
    parser found the tables, so strings, comments, column names and the names of common table expressions stay as they are."""
    spark = SparkSession.getActiveSession()
    for at, parts in reversed(named(spark, sql)):
        first = _spelt(sql, at)
        if len(parts) == 1 and parts[0] in places:
            sql = f"{sql[:at]}{places[parts[0]]}.{sql[at:]}"
        elif len(parts) > 1 and parts[0] in (aliases or {}) and first:
            sql = sql[:at] + aliases[parts[0]] + sql[at + len(first) :]
    return sql


def catalog_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, ordinal, data_type) of some tables: as many rows as columns."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, f.name, i, f.dataType.simpleString()) for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal int, data_type string")


def tables_with_fields(columns: DataFrame, fields: list[str], least: int = 1, n: int = 30) -> DataFrame:
    """Tables that have at least ``least`` of the fields: which, and how many."""
    found = columns.where(F.col("column_name").isin(fields)).groupBy("table_name")
    got = found.agg(F.array_join(F.array_sort(F.collect_set("column_name")), ",").alias("matched"), F.count("*").alias("n_matched"))
    return got.where(F.col("n_matched") >= least).orderBy(F.col("n_matched").desc(), "table_name").limit(n)


def sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows), largest first."""
    counts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def described(columns: DataFrame) -> DataFrame:
    """One text for each table: its name and its columns in order."""
    text = F.concat_ws(" ", "column_name", "data_type")
    listed = F.array_sort(F.collect_list(F.struct("ordinal", text.alias("text"))))
    return columns.groupBy("table_name").agg(listed.alias("c")).select("table_name", F.concat(F.lit("table "), "table_name", F.lit(": "), F.array_join(F.transform("c", lambda x: x["text"]), ", ")).alias("description"))
