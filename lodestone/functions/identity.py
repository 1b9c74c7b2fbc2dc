"""Names of types, routines and pages. Keys are plain columns; only what has to parse a type or an argument list is Python."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.functions.text import percent_encoded, slug
from lodestone.sources.sql_text import parts

# Spellings of the types' names and what they stand for.
ALIASES = {
    "int2": "smallint",
    "int": "integer",
    "int4": "integer",
    "int8": "bigint",
    "float4": "real",
    "float8": "double precision",
    "float": "double precision",
    "bool": "boolean",
    "varchar": "character varying",
    "char": "character",
    "bpchar": "character",
    "decimal": "numeric",
    "timestamp": "timestamp without time zone",
    "timestamptz": "timestamp with time zone",
    "time": "time without time zone",
    "timetz": "time with time zone",
    "varbit": "bit varying",
}
# Names of the catalogue's types, which a quoted name or one of pg_catalog may mean.
CATALOGUE = frozenset(
    "int2 int4 int8 float4 float8 bool text bytea numeric varchar bpchar char json jsonb uuid date time timetz timestamp timestamptz interval bit varbit money inet cidr "
    "macaddr macaddr8 point line lseg box path polygon circle tsvector tsquery oid record anyelement anyarray anycompatible anycompatiblearray "
    "regclass regtype regprocedure regproc void trigger event_trigger cstring internal".split()
)
# Other names that need no schema to be known.
PLAIN = frozenset("bytea text uuid json jsonb xml interval date numeric real smallint integer bigint boolean bit".split())
# Words that say how an argument is passed.
MODES = ("in", "out", "inout", "variadic")
#: Fixed value: longest identifier, in bytes.
NAME_BYTES = 63

_QUALIFIED = re.compile(r'(?:("(?:[^"]|"")+"|\w+)\.)?("(?:[^"]|"")+"|\w+)')
_TYPE = re.compile(r'((?:(?:(?:"(?:[^"]|"")+"|\w+)\.)?(?:"(?:[^"]|"")+"|[\w.]+))(?: (?:precision|varying))?)\s*(\([^)]*\))?\s*((?:with|without) time zone)?\s*((?:\[\d*\]\s*|array\b\s*(?:\[\d*\])?)*)$', re.I)
_FIRST_NAME = re.compile(r'("(?:[^"]|"")+"|\w+)\s+(?=\S)')
_TWO_WORDS = ("double precision", "character varying", "bit varying", "timestamp with", "timestamp without", "time with", "time without")


def type_name(spelling: str, for_identity: bool = False) -> str:
    """One spelling of a type. Lengths and array bounds stay, but not for_identity, where any array is one [].

    A quoted name, and one of pg_catalog, means the catalogue's own type where there is one (so "char" is another than char); any other quoted or
    qualified name stays as it is spelt. For identity, a name without a schema that is no known type is an error: which one it means
    is for the search path to say."""
    text = " ".join(spelling.split())
    m = _TYPE.match(text)
    if not m:
        raise ValueError(f"no type: {spelling!r}")
    base, size, zone, array = m[1], m[2] or "", (m[3] or "").lower(), m[4].strip()
    if '"' in base or "." in base:
        return _named_type(base, for_identity, spelling) + ("" if for_identity else re.sub(r"\s+", "", size)) + _array(array, for_identity)
    name = base.lower()
    if name == "float" and size:
        digits = int(size.strip("() "))
        if not 1 <= digits <= 53:
            raise ValueError(f"no such precision: {spelling!r}")
        name, size = ("real" if digits <= 24 else "double precision"), ""
    if zone and name in ("timestamp", "time", "timestamptz", "timetz"):
        name = f"{name.removesuffix('tz')} {zone}"
    known = ALIASES.get(name, name)
    if for_identity:
        if name not in ALIASES and known not in ALIASES.values() and known not in CATALOGUE and known not in PLAIN and not zone:
            raise ValueError(f"no known type: {spelling!r}")
        return known + _array(array, True)
    return known + re.sub(r"\s+", "", size) + _array(array, False)


def _array(array: str, for_identity: bool) -> str:
    if for_identity or not array:
        return "[]" if array else ""
    return re.sub(r"array", "[]", array, flags=re.I).replace(" ", "").replace("[][", "[")


def _named_type(base: str, for_identity: bool, spelling: str) -> str:
    """A type whose name is quoted or has a schema."""
    named = _QUALIFIED.fullmatch(base)
    if not named:
        raise ValueError(f"no type: {spelling!r}")
    plain = [None if x is None else x[1:-1].replace('""', '"') if x.startswith('"') else x.lower() for x in named.groups()]
    if plain[0] in (None, "pg_catalog") and plain[1] in CATALOGUE:
        return "pg_catalog.char" if plain[1] == "char" else ALIASES.get(plain[1], plain[1])
    if for_identity and plain[0] is None:
        raise ValueError(f"no known type: {spelling!r}")
    return ".".join(x if re.fullmatch(r"[a-z_][a-z0-9_$]*", x) else '"' + x.replace('"', '""') + '"' for x in plain if x is not None)


def argument_types(arguments: str) -> list[str]:
    """Types that tell one routine from its namesakes: without names, defaults and arguments that only come out."""
    out = []
    for item in parts(arguments) if arguments.strip() else []:
        item = re.split(r"\s+default\b|\s*:?=", item, maxsplit=1, flags=re.I)[0].strip()
        words = item.split(None, 1)
        mode = words[0].lower() if words and words[0].lower() in MODES and len(words) > 1 else "in"
        item = words[1] if words and words[0].lower() == mode and len(words) > 1 else item
        if mode == "out":
            continue
        m = _FIRST_NAME.match(item)
        if m and not " ".join(item.lower().split()).startswith(_TWO_WORDS) and not re.match(r"\w+\s*(\[|array\b)", item, re.I):
            item = item[m.end() :]
        out.append(type_name(item, for_identity=True))
    return out


@F.pandas_udf(StringType())
def canonical_type(spelling: pd.Series) -> pd.Series:
    """type_name() as a column; null where it is no type."""

    def one(x):
        try:
            return None if x is None else type_name(x)
        except ValueError:
            return None

    return spelling.map(one)


@F.pandas_udf(StringType())
def signature(arguments: pd.Series) -> pd.Series:
    """(type1,type2) of an argument list; null where it cannot be read."""

    def one(x):
        try:
            return None if x is None else "(" + ",".join(argument_types(x)) + ")"
        except ValueError:
            return None

    return arguments.map(one)


def routine_key(kind: Column, schema: Column, name: Column, arguments: Column) -> Column:
    """kind+schema+name(types); null without a schema or a readable argument list."""
    return F.concat(kind, F.lit("+"), percent_encoded(schema), F.lit("+"), percent_encoded(name), signature(arguments))


def migration_key(path: Column, number: Column) -> Column:
    return F.concat_ws("+", F.lit("migration"), percent_encoded(path), percent_encoded(number))


def object_key(kind: Column, schema: Column, name: Column, arguments: Column, scope: Column) -> Column:
    """The key of an object that facts describe: null for one of a scope of its own, without a schema or a name, and for a routine
    whose arguments are not known."""
    routine = kind.isin("function", "procedure")
    known = scope.isNull() & schema.isNotNull() & name.isNotNull() & (schema != "") & (name != "")
    return F.when(known & routine, routine_key(kind, schema, name, arguments)).when(known & ~routine, F.concat_ws("+", kind, percent_encoded(schema), percent_encoded(name)))


def too_long(identifier: Column) -> Column:
    return F.octet_length(identifier) > NAME_BYTES


def page_names(keys: DataFrame, column: str = "key", first: int = 12) -> DataFrame:
    """keys with page_name: slug and the shortest start of the key's hash, of `first` digits at least, that no other key with
    that slug shares. Repeated keys have one name; null keys have none."""
    rows = keys.select(column).where(F.col(column).isNotNull()).distinct().select(column, slug(F.col(column)).alias("_slug"), F.sha2(column, 256).alias("_hash"))
    beside = Window.partitionBy("_slug").orderBy("_hash")
    rows = rows.withColumn("_before", F.lag("_hash").over(beside)).withColumn("_after", F.lead("_hash").over(beside))
    # of sorted hashes the neighbours share the longest start
    shared = lambda c: F.coalesce(F.length(F.regexp_extract(F.concat_ws(" ", "_hash", c), r"^([0-9a-f]*)[0-9a-f]* \1", 1)), F.lit(0))
    digits = F.greatest(F.lit(first), shared("_before") + 1, shared("_after") + 1)
    names = rows.select(column, F.concat(F.col("_slug"), F.lit("--"), F.left("_hash", digits), F.lit(".md")).alias("page_name"))
    return keys.join(names, column, "left")
