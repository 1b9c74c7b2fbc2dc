"""Text and identity functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_encoded(x: Column) -> Column:
    """Percent-encoding that leaves only letters, digits and _ . - ~ as they are."""
    out = F.url_encode(x)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def relation_key(kind: Column, schema: Column, name: Column) -> Column:
    """kind+schema+name, so that a plus inside a name cannot join two keys."""
    return F.concat_ws("+", kind, percent_encoded(schema), percent_encoded(name))


def slug(key: Column) -> Column:
    """At most 80 of a-z, 0-9 and single dashes between them: closing brackets go, all else becomes a dash; `object` if nothing is left."""
    plain = F.regexp_replace(F.replace(F.lower(key), F.lit(")"), F.lit("")), "[^a-z0-9]+", "-")
    cut = F.rtrim(F.left(F.regexp_replace(plain, "^-+|-+$", ""), F.lit(80)), F.lit("-"))
    return F.when(cut == "", "object").otherwise(cut)


def page_id(key: Column) -> Column:
    """Slug of at most 80 characters, then 12 of the key's hash."""
    return F.concat(slug(key), F.lit("--"), F.left(F.sha2(key, 256), F.lit(12)), F.lit(".md"))


def line_count(text: Column) -> Column:
    """0 for an empty text; a trailing line feed begins no line."""
    feeds = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("bigint")
    return F.when(F.length(text) == 0, F.lit(0).cast("bigint")).otherwise(feeds + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1))


def line_of(text: Column, position: Column) -> Column:
    """The 1-based line of a 0-based position."""
    head = F.left(text, position)
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def lines_between(text: Column, first: int, last: int) -> Column:
    """Lines first..last (1-based, both included), without carriage returns."""
    return F.array_join(F.slice(F.split(text, "\r?\n"), first, last - first + 1), "\n")


def has_substance(text: Column) -> Column:
    return F.rlike(text, F.lit(r"[\p{L}\p{N}]"))


def folded_identifier(x: Column) -> Column:
    """Unquoted names fold to lower case; quoted ones lose their quotes and keep their case."""
    return F.when(F.rlike(x, F.lit('^".*"$')), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(F.lower(x))


def migration_id(path: Column) -> Column:
    """Leading digits of the file's stem before _ . or -, else the stem."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    digits = F.regexp_extract(stem, r"^(\d+)[_.-]", 1)
    return F.when(digits == "", stem).otherwise(digits)


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), 1)
