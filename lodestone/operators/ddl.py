"""Tables rebuilt from ordered DDL, per project."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.sql_text import parts, statements
from lodestone.sources.sql_walk import constructs

NAME = r'(?:"(?:[^"]|"")+"|\w+)(?:\.(?:"(?:[^"]|"")+"|\w+))*'


COLUMN = r'("(?:[^"]|"")+"|\w+)'


def _name(x: str) -> str:
    return x[1:-1].replace('""', '"') if x.startswith('"') else x.lower()


class Unsupported(ValueError):
    """A statement whose effect is not known."""


def apply(state: dict, statement: str) -> dict:
    """The state after a statement; the one given stays as it is. state: table -> column -> [type, not null, default]."""
    state = {t: {c: list(x) for c, x in cols.items()} for t, cols in state.items()}
    text = " ".join(statement.split())
    if m := re.match(rf"create table (if not exists )?({NAME}) ?\((.*)\)$", text, re.I):
        if m[2].lower() in state:
            if m[1]:
                return state
            raise Unsupported(f"table {m[2]} stands already")
        columns, keys = {}, []
        for item in parts(m[3]):
            if k := re.match(r"(?:constraint \S+ )?primary key ?\(([^)]*)\)", item, re.I):
                keys += [_name(x.strip()) for x in k[1].split(",")]
            elif not re.match(r"(?:constraint|unique|check|foreign)\b", item, re.I):
                name, what = _column(item)
                columns[name] = what
        for k in keys:
            columns[k][1] = True
        state[m[2].lower()] = columns
    elif m := re.match(rf"alter table (?:if exists )?(?:only )?({NAME}) (.*)$", text, re.I):
        table = m[1].lower()
        if table not in state:
            raise Unsupported(f"no table {table}")
        for action in parts(m[2]):
            state = _altered(state, table, action)
    elif m := re.match(rf"drop table (if exists )?({NAME})$", text, re.I):
        if state.pop(m[2].lower(), None) is None and not m[1]:
            raise Unsupported(f"no table {m[2]}")
    elif m := re.match(rf"comment on column ({NAME})\.{COLUMN} is ", text, re.I):
        if _name(m[2]) not in state.get(m[1].lower(), {}):
            raise Unsupported(f"no column {m[1]}.{m[2]}")
    elif not re.match(r"(comment on|create schema)\b", text, re.I):  # rows that change, indexes and rights are no state of a table
        raise Unsupported(text[:60])
    return state


def _column(item: str) -> tuple[str, list]:
    m = re.match(r'("(?:[^"]|"")+"|\w+) (.+?)(?= (?:not null|null|default|primary key|unique|references|check|constraint)\b|$)(.*)$', item, re.I)
    if not m:
        raise Unsupported(item)
    rest = m[3].lower()
    default = re.search(r"default (.+?)(?= (?:not null|null|primary key|unique|references|check|constraint)\b|$)", m[3], re.I)
    return _name(m[1]), [m[2].lower(), "not null" in rest or "primary key" in rest, default[1] if default else None]


def _altered(state: dict, table: str, action: str) -> dict:
    columns = state[table]
    if m := re.match(r"add (?:column )?(?:if not exists )?(?!constraint|primary|unique|check|foreign)(.+)$", action, re.I):
        name, what = _column(m[1])
        columns[name] = what
    elif m := re.match(rf"drop (?:column )?(if exists )?{COLUMN}(?: cascade)?$", action, re.I):
        if columns.pop(_name(m[2]), None) is None and not m[1]:
            raise Unsupported(f"no column {m[2]}")
    elif m := re.match(rf"alter (?:column )?{COLUMN} (?:set data )?type (.+?)(?: using .*)?$", action, re.I):
        columns[_name(m[1])][0] = m[2].lower()
    elif m := re.match(rf"alter (?:column )?{COLUMN} (set|drop) not null$", action, re.I):
        columns[_name(m[1])][1] = m[2].lower() == "set"
    elif m := re.match(rf"alter (?:column )?{COLUMN} (?:set default (.+)|drop default)$", action, re.I):
        columns[_name(m[1])][2] = m[2]
    elif m := re.match(rf"rename to {COLUMN}$", action, re.I):
        state[table.rpartition(".")[0] + "." * ("." in table) + _name(m[1])] = state.pop(table)
    elif m := re.match(rf"rename (?:column )?{COLUMN} to {COLUMN}$", action, re.I):
        if _name(m[1]) not in columns:
            raise Unsupported(f"no column {m[1]}")
        state[table] = {_name(m[2]) if c == _name(m[1]) else c: x for c, x in columns.items()}
    elif m := re.match(r"add (?:constraint \w+ )?primary key ?\(([^)]*)\)$", action, re.I):
        for c in m[1].split(","):
            columns[_name(c.strip())][1] = True
    elif not re.match(r"add (?:constraint \w+ )?(unique|check|foreign key)\b", action, re.I):
        raise Unsupported(action)
    return state


def rebuilt(migrations: DataFrame) -> DataFrame:
    """migrations (project, position, sql) -> (project, status, reason, table, position, column, type, not_null, default), in
    the given order only; a project stops at its first unsupported statement and keeps the state before that file; one whose files
    have no order of their own (a position that is null or repeats) is ambiguous and has no tables."""
    schema = "project string, status string, reason string, table string, position int, column string, type string, not_null boolean, default string"
    rows = migrations.select("project", F.col("position").cast("int").alias("position"), "sql").repartition("project").sortWithinPartitions("project", "position")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Projects come one after another, their files in order; a task holds one project's files."""
        now, files, out = None, [], []
        table = lambda rows: pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")], dtype=object)
        for batch in batches:
            for project, position, sql in zip(batch["project"], batch["position"], batch["sql"], strict=True):
                if files and project != now:
                    out += folded(now, files)
                    files = []
                now = project
                files.append((None if pd.isna(position) else int(position), sql))
            if out:
                yield table(out)
                out = []
        if files:
            yield table(folded(now, files))

    return rows.mapInPandas(run, schema)


def folded(project: str, files: list[tuple[int | None, str | None]]) -> list[tuple]:
    """Rows of rebuilt() for one project."""
    state, status, reason = {}, "resolved", None
    places = [p for p, _ in files]
    if None in places or len(set(places)) < len(places):
        status, reason, files = "ambiguous", "the order is not established", []
    for _, sql in files:
        try:
            after = state
            for _, statement in statements(sql or ""):
                after = apply(after, statement)
            state = after
        except (Unsupported, KeyError, ValueError) as e:
            status, reason = "unsupported", str(e)
            break
    rows = [(project, status, reason, t, i, c, *x) for t, columns in sorted(state.items()) for i, (c, x) in enumerate(columns.items(), 1)]
    return rows or [(project, status, reason, None, None, None, None, None, None)]


def _dealt(files: DataFrame) -> DataFrame:
    """(path, sql), dealt to all cores: a walk takes far longer than reading its text, and a table of many files may be one small split.
    Rows of one path, or of none, are dealt by their text too."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.select("path", "sql").repartition(4 * cores, "path", "sql")


def inventoried(files: DataFrame) -> DataFrame:
    """files (path, sql) -> one row per statement: path, line, ordinal within its kind, kind, target."""
    schema = "path string, line int, kind string, ordinal int, target string"
    first = re.compile(r"(?:with\b.*?\)\s*)?(insert|update|delete|merge|select|create|alter|drop|grant|revoke|comment|truncate|call|do)\b", re.I | re.S)
    what = re.compile(rf"^(?:insert into|update|delete from|merge into|truncate(?: table)?|call|(?:create|alter|drop)\s+(?:or replace\s+)?(?:temp(?:orary)?\s+)?(?:table|view|materialized view|function|procedure|index|trigger|schema)(?:\s+if (?:not )?exists)?)\s+({NAME})", re.I)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, sql in zip(batch["path"], batch["sql"], strict=True):
                seen: dict[str, int] = {}
                for line, statement in statements(sql or ""):
                    m = first.match(statement)
                    kind = m[1].upper() if m else "UNKNOWN"
                    seen[kind] = seen.get(kind, 0) + 1
                    t = what.match(" ".join(statement.split()))
                    out.append((path, line, kind, seen[kind], t[1].lower() if t else None))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return _dealt(files).mapInPandas(run, schema)


#: A text goes through the walk in one piece: a file is one row.
CONSTRUCTS = "path string, scope string, construct string, ordinal int, start_line int, end_line int, reads array<string>, writes array<string>, calls array<string>, branch array<string>, details string"


def walked(files: DataFrame) -> DataFrame:
    """files (path, sql) -> one row per construct, with what it reads, writes and calls and the branch that it stands in."""
    dealt = _dealt(files)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *r) for p, q in zip(batch["path"], batch["sql"], strict=True) for r in constructs(q or "")[0]]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CONSTRUCTS.split(", ")])

    return dealt.mapInPandas(run, CONSTRUCTS)


# Constructs that declare a relation, and all that declare an object.
RELATIONS = ("VIEW", "MATERIALIZED_VIEW", "CREATE_TABLE", "CTAS")
DECLARATIONS = (*RELATIONS, "FUNCTION", "PROCEDURE")
#: Statements that may stand after the relation that they are about.
TRAILING = ("INDEX", "TRIGGER", "GRANT", "REVOKE", "ALTER", "COMMENT", "CONSTRAINT", "INSERT", "UPDATE", "DELETE", "TRUNCATE")


def owned(constructs: DataFrame) -> DataFrame:
    """walked() rows with owner: the declaration whose scope they stand in, or, for statements that trail, the relation of the same
    file that they are about; null where the file declares none (standalone)."""
    declared = constructs.where(F.col("construct").isin(*DECLARATIONS)).select("path", F.col("scope").alias("_scope")).distinct()
    relations = constructs.where(F.col("construct").isin(*RELATIONS)).select("path", F.col("scope").alias("_about")).distinct()
    about = F.when(F.col("construct").isin(*TRAILING), F.coalesce(F.when(~F.startswith("scope", F.lit("unresolved+")), F.col("scope")), F.get("writes", F.lit(0))))
    rows = constructs.withColumn("_scope", F.col("scope")).withColumn("_about", about)
    rows = rows.join(declared.withColumn("_own", F.col("_scope")), ["path", "_scope"], "left").join(relations.withColumn("_of", F.col("_about")), ["path", "_about"], "left")
    return rows.withColumn("owner", F.coalesce("_own", "_of")).drop("_scope", "_about", "_own", "_of")


def subjects(constructs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (path, subject) with (n, scope): how many declarations of the file a subject names, by its scope, its qualified name or its
    bare name; scope where it is just one. Overloads share a name and need their signature."""
    name = F.regexp_replace("scope", r"\(.*\)$", "")
    declared = constructs.where(F.col("construct").isin(*DECLARATIONS)).select("path", "scope").distinct()
    named = declared.select("path", "scope", F.explode(F.array_distinct(F.array(F.col("scope"), name, F.substring_index(name, ".", -1)))).alias("subject"))
    rows = wanted.join(named, ["path", "subject"], "left").groupBy("path", "subject").agg(F.count("scope").alias("n"), F.min("scope").alias("scope"))
    return rows.withColumn("scope", F.when(F.col("n") == 1, F.col("scope")))


def notes(files: DataFrame) -> DataFrame:
    """files (path, sql) -> (path, line, reason): what walked() did not understand or cannot know."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *n) for p, q in zip(batch["path"], batch["sql"], strict=True) for n in constructs(q or "")[1]]
            yield pd.DataFrame(rows, columns=["path", "line", "reason"])

    return _dealt(files).mapInPandas(run, "path string, line int, reason string")


def conflicting(columns: DataFrame) -> DataFrame:
    """columns (table, definition, column, type): tables that several definitions describe differently."""
    one = columns.groupBy("table", "definition").agg(F.sort_array(F.collect_list(F.struct("column", "type"))).alias("columns"))
    return one.groupBy("table").agg(F.count_distinct("columns").alias("variants")).where("variants > 1")


def inherited_effects(calls: DataFrame, routines: DataFrame) -> DataFrame:
    """calls (caller, callee) with what the callee reads and writes, where just one routine (name, reads, writes) has that name."""
    known = routines.groupBy(F.col("name").alias("callee")).agg(F.count("*").alias("n"), F.first("reads").alias("reads"), F.first("writes").alias("writes"))
    return calls.join(known.where("n = 1").drop("n"), "callee", "left")
