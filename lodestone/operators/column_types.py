"""Types of expressions, as far as the catalogue's columns prove them, and the columns that statements fill.

expressions (path, scope, id, expression, relations: array of struct<alias, table>); columns (table, column, type); variables
(path, scope, name, type). Parsing is one Arrow UDF; everything else is joins and grouped counts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.identity import type_name
from lodestone.functions.storage import settled
from lodestone.sources.sql_text import expression_key, masked

# Functions whose results have one type.
RESULTS = {"now": "timestamp with time zone", "count": "bigint", "to_date": "date"}
_NAME = r'(?:"(?:[^"]|"")+"|[^\W\d]\w*)'
_COLUMN = re.compile(rf"(?:({_NAME}(?:\.{_NAME})*)\.)?({_NAME})")
_CALL = re.compile(rf"({_NAME}(?:\.{_NAME})*)\s*\((.*)\)", re.S)
_CAST = re.compile(r"cast\s*\((.*)\s+as\s+([^()]+(?:\([\d\s,]*\))?(?:\[\])*)\)", re.S | re.I)
_SHORT_CAST = re.compile(r".*::\s*([A-Za-z][\w .]*(?:\([\d\s,]*\))?(?:\[\])*)", re.S)


def _plain(name: str) -> str:
    return name[1:-1].replace('""', '"') if name.startswith('"') else name.lower()


def shape(expression: str) -> tuple[str, str | None, str | None]:
    """(what, type or owner, name): a cast and its type, a call and its type, a column with its owner and name, or neither."""
    text = expression.strip()
    code, _, _ = masked(text, identifiers=False, literal="0")
    try:
        if m := _CAST.fullmatch(code) or _SHORT_CAST.fullmatch(code):
            whole = code.count("(", 0, m.start(m.lastindex)) == code.count(")", 0, m.start(m.lastindex)) or m.re is _CAST
            return ("cast", type_name(m[m.lastindex].strip()), None) if whole else ("other", None, None)
        if m := _CALL.fullmatch(code):
            depth = 0
            for c in m[2]:
                depth += (c == "(") - (c == ")")
                if depth < 0:
                    return "other", None, None
            return "call", RESULTS.get(m[1].lower()), None
        if m := _COLUMN.fullmatch(text):
            return "column", ".".join(_plain(x) for x in re.findall(_NAME, m[1])) if m[1] else None, _plain(m[2])
    except ValueError:
        pass
    return "other", None, None


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("what", "a", "name")]))
def _shapes(expression: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([shape(x or "") for x in expression], columns=["what", "a", "name"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def expression_tokens(expression: pd.Series) -> pd.Series:
    """Tokens by which two spellings of an expression are the same, for joins; null stays null."""
    return expression.map(lambda x: None if x is None else list(expression_key(x)))


def inferred(expressions: DataFrame, columns: DataFrame, variables: DataFrame) -> DataFrame:
    """(path, scope, id, expression, type): a cast has its type, a few calls have theirs, a bare name is a variable of its scope or
    else a column; a column has its type where all columns that it may mean, in the relations that its statement reads (or in the
    one that its owner names), agree. Anything else is null: not established."""
    by = ["path", "scope", "id"]
    rows = expressions.withColumn("_s", _shapes("expression"))
    own = variables.select("path", "scope", F.col("name").alias("_v"), F.col("type").alias("_vtype"))
    bare = (F.col("_s.what") == "column") & F.col("_s.a").isNull()
    rows = rows.withColumn("_v", F.when(bare, F.col("_s.name"))).join(own, ["path", "scope", "_v"], "left")
    seen = rows.where(F.col("_s.what") == "column").select(*by, F.col("_s.a").alias("owner"), F.col("_s.name").alias("column"), F.explode("relations").alias("r"))
    seen = seen.where(F.col("owner").isNull() | (F.col("owner") == F.col("r.alias")) | (F.col("owner") == F.col("r.table")))
    meant = seen.join(columns.select(F.col("table").alias("_t"), F.col("column").alias("_c"), F.col("type").alias("_ctype")), (F.col("r.table") == F.col("_t")) & (F.col("column") == F.col("_c")))
    one = meant.groupBy(*by).agg(F.count_distinct("_ctype").alias("_n"), F.min("_ctype").alias("_ctype")).where("_n = 1").drop("_n")
    found = F.when(F.col("_s.what").isin("cast", "call"), F.col("_s.a")).otherwise(F.coalesce("_vtype", "_ctype"))
    return rows.join(one, by, "left").select(*by, "expression", found.alias("type"))


def mapped(fills: DataFrame) -> DataFrame:
    """fills (path, scope, id, target, columns, expressions) -> (path, scope, id, target, position, column, expression): what stands at
    the same place, as far as the shorter list goes."""
    n = F.least(F.size("columns"), F.size("expressions"))
    pairs = F.slice(F.arrays_zip("columns", "expressions"), 1, F.greatest(n, F.lit(0)))
    rows = fills.where((F.size("columns") > 0) & (F.size("expressions") > 0)).select("path", "scope", "id", "target", F.posexplode(pairs).alias("position", "p"))
    return rows.select("path", "scope", "id", "target", (F.col("position") + 1).alias("position"), F.col("p.columns").alias("column"), F.col("p.expressions").alias("expression"))


def type_problems(mappings: DataFrame, types: DataFrame, columns: DataFrame) -> DataFrame:
    """(path, scope, id, target, position, column, problem): a target column that its table has not, and one whose type differs from the
    established type of what fills it. A table that no definition is known for has no problems."""
    rows = mappings.join(types.select("path", "scope", "id", F.col("position").alias("_p"), F.col("type").alias("_type")), ["path", "scope", "id"], "left").where(F.col("_p").isNull() | (F.col("_p") == F.col("position")))
    tables = columns.select(F.col("table").alias("target")).distinct()
    rows = rows.join(tables, "target", "left_semi").join(columns.select(F.col("table").alias("target"), "column", F.col("type").alias("_want")), ["target", "column"], "left")
    problem = F.when(F.col("_want").isNull(), "unknown_column").when(F.col("_type") != F.col("_want"), "type_mismatch")
    return rows.withColumn("problem", problem).where("problem is not null").select("path", "scope", "id", "target", "position", "column", "problem")


def complete(shown: DataFrame, columns: DataFrame) -> DataFrame:
    """shown (table, column) against columns: (table, missing, unknown) of tables whose sets of columns differ."""
    a = shown.groupBy("table").agg(F.collect_set("column").alias("a"))
    b = columns.groupBy("table").agg(F.collect_set("column").alias("b"))
    rows = a.join(b, "table").select("table", F.sort_array(F.array_except("b", "a")).alias("missing"), F.sort_array(F.array_except("a", "b")).alias("unknown"))
    return rows.where((F.size("missing") > 0) | (F.size("unknown") > 0))


# Columns as of a place ---------------------------------------------------------------------------------------------------


def assigned(statements: DataFrame) -> DataFrame:
    """statements (path, scope, id, at, target, columns, expressions, sets) -> (path, scope, id, at, target, position, column, expression):
    the lists of an INSERT, of an INSERT branch of a MERGE or of INTO and its select list, which meet by place as far as the shorter goes, and `sets` (column,
    expression), what an UPDATE or an UPDATE branch sets. Empty and null lists have no rows. Statements may bring the types of their expressions, null where
    not established: `types` beside the lists, and `type` in `sets`; the rows then have type."""
    out, typed = ["path", "scope", "id", "at", "target"], "types" in statements.columns
    more = [F.coalesce("types", F.array().cast("array<string>")).alias("types")] if typed else []
    pairs = F.slice(F.arrays_zip("columns", "expressions", *more), 1, F.greatest(F.least(F.size("columns"), F.size("expressions")), F.lit(0)))
    lists = statements.where((F.size("columns") > 0) & (F.size("expressions") > 0)).select(*out, F.posexplode(pairs).alias("position", "p"))
    lists = lists.select(*out, (F.col("position") + 1).alias("position"), F.col("p.columns").alias("column"), F.col("p.expressions").alias("expression"), *[F.col("p.types").alias("type")] * typed)
    sets = statements.select(*out, F.posexplode("sets").alias("position", "p")).select(*out, (F.col("position") + 1).alias("position"), "p.column", "p.expression", *["p.type"] * typed)
    return lists.unionByName(sets)


def histories(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """changes (table, column, at, type: null where the column goes) -> each column's changes in order, in runs as long as there are runs:
    (table, column, starts: the place of each run's first change) and (table, column, run, spans: from which place on there is which type). Of
    several changes at one place the type that sorts last counts, and a column is gone there only if nothing else stands there."""
    one = changes.groupBy("table", "column", "at").agg(F.max("type").alias("type"))
    own = Window.partitionBy("table", "column")
    long_ = F.ceil(F.sqrt(F.count("*").over(own)))
    one = one.withColumn("run", F.floor((F.row_number().over(own.orderBy("at")) - 1) / long_).cast("int"))
    runs = one.groupBy("table", "column", "run").agg(F.min("at").alias("start"), F.array_sort(F.collect_list(F.struct("at", "type"))).alias("spans"))
    return runs.groupBy("table", "column").agg(F.array_sort(F.collect_list("start")).alias("starts")), runs.drop("start")


def as_of(uses: DataFrame, changes: DataFrame) -> DataFrame:
    """uses (table, column, at, ...) with known (the table had columns by then), present and type: what the change before or at that
    place left. Places grow in the order in which statements and changes take effect.

    Uses meet the starts of their column's runs, and then the one run that they need, by equi-joins, whose hot keys adaptive execution splits (or
    by broadcasts, where histories are small): no range join, no sort of the uses, and of n changes a use looks at two roots of n. Histories are written first: by their true
    size the planner sees which are small, and uses are not shuffled for those."""
    spark = uses.sparkSession
    starts, runs = (settled(spark, x, "history") for x in histories(changes))
    tables = settled(spark, changes.where("type is not null").groupBy("table").agg(F.min("at").alias("_from")), "tables")
    rows = uses.join(starts, ["table", "column"], "left").join(tables, "table", "left")
    rows = rows.withColumn("run", F.size(F.filter("starts", lambda x: x <= F.col("at"))) - 1).join(runs, ["table", "column", "run"], "left")
    rows = rows.withColumn("type", F.try_element_at(F.filter("spans", lambda x: x["at"] <= F.col("at")), F.lit(-1))["type"])
    return rows.withColumns({"present": F.col("type").isNotNull(), "known": F.coalesce(F.col("_from") <= F.col("at"), F.lit(False))}).drop("starts", "run", "spans", "_from")


def problems_at(mappings: DataFrame, types: DataFrame | None, changes: DataFrame) -> DataFrame:
    """mappings of assigned(), types (path, scope, id, position, type; null: not established) of what fills them (None: mappings have
    them, as assigned() gives them), and changes -> (path, scope,
    id, at, target, position, column, problem): each statement against the columns as they were at its place. unknown_column: the
    table had no such column then (dropped_column: it had it before); type_mismatch: both types are known and differ. Statements on a table
    that nothing has defined by then have no problems."""
    by = ["path", "scope", "id", "position"]
    rows = mappings.withColumnRenamed("target", "table")
    rows = rows.withColumnRenamed("type", "_given") if types is None else rows.join(types.select(*by, F.col("type").alias("_given")), by, "left")
    rows = as_of(rows, changes).where("known")
    before = settled(rows.sparkSession, changes.where("type is not null").groupBy("table", "column").agg(F.min("at").alias("_first")), "first")
    rows = rows.join(before, ["table", "column"], "left")
    absent = F.when(F.col("_first") <= F.col("at"), "dropped_column").otherwise("unknown_column")
    problem = F.when(~F.col("present"), absent).when(F.col("_given") != F.col("type"), "type_mismatch")
    return rows.withColumn("problem", problem).where("problem is not null").select("path", "scope", "id", "at", F.col("table").alias("target"), "position", "column", "problem")
