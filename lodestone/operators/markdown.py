"""Markdown as rows of blocks, sections, and what they cover."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
ITEM = re.compile(r" {0,3}(?:[-*+]|\d{1,9}[.)])(?:[ \t]+|$)")
ANCHOR = re.compile(r"\s*\{#([^}\s]+)\}\s*$")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


def blocks(text: str) -> list[tuple[str, int, int, int, str, str | None]]:
    """(kind, level, first line, last line, text, own anchor), lines from 1: heading, code, table, list, comment, rule, paragraph."""
    lines, out, i = text.split("\n"), [], 0
    while i < len(lines):
        line, start = lines[i], i
        if not line.strip():
            i += 1
            continue
        level, kind = 0, "paragraph"
        if m := FENCE.match(line):
            kind, i = "code", i + 1
            while i < len(lines) and not re.match(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$", lines[i]):
                i += 1
            body, i = "\n".join(lines[start + 1 : i]), i + 1
        elif line.startswith(("    ", "\t")):
            kind = "code"
            while i < len(lines) and (lines[i].startswith(("    ", "\t")) or not lines[i].strip()):
                i += 1
            body = "\n".join(x[4:] if x.startswith("    ") else x.lstrip("\t") for x in lines[start:i]).strip("\n")
            while not lines[i - 1].strip():
                i -= 1
        elif m := ATX.match(line):
            kind, level, body, i = "heading", len(m[1]), m[2] or "", i + 1
        elif line.lstrip().startswith("<!--"):
            kind = "comment"
            while i < len(lines) and "-->" not in lines[i]:
                i += 1
            i = min(i + 1, len(lines))
            body = "\n".join(lines[start:i]).strip()
        elif RULE.match(line):
            kind, body, i = "rule", "", i + 1
        elif "|" in line and i + 1 < len(lines) and DELIMITER.match(lines[i + 1]) and "-" in lines[i + 1]:
            kind = "table"
            while i < len(lines) and lines[i].strip():
                i += 1
            body = "\n".join(lines[start:i])
        else:
            kind = "list" if ITEM.match(line) else "paragraph"
            i += 1
            while i < len(lines) and lines[i].strip() and not ATX.match(lines[i]) and not FENCE.match(lines[i]):
                if kind == "paragraph" and re.match(r" {0,3}(=+|-+)[ \t]*$", lines[i]):
                    kind, level = "heading", 1 if "=" in lines[i] else 2
                    i += 1
                    break
                if kind == "paragraph" and (ITEM.match(lines[i]) or RULE.match(lines[i])):
                    break
                i += 1
            body = "\n".join(x.strip() for x in lines[start : i - (kind == "heading")])
        anchor = None
        if kind == "heading" and (m := ANCHOR.search(body)):
            anchor, body = m[1], body[: m.start()]
        out.append((kind, level, start + 1, min(i, len(lines)), body, anchor))
    return out


BLOCKS = "doc string, kind string, level int, first int, last int, text string, anchor string"


def parsed(docs: DataFrame) -> DataFrame:
    """docs (doc, text) -> one row per block; null and empty texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *b) for d, t in zip(batch["doc"], batch["text"], strict=True) for b in blocks(t or "")]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in BLOCKS.split(", ")])

    return docs.select("doc", "text").mapInPandas(run, BLOCKS)


def sections(rows: DataFrame) -> DataFrame:
    """(doc, section, title, level, first, end): a section ends before the next heading of its level or a higher one (null: at
    the end). section is the heading's own anchor or its slug; repeated slugs count on: slug, slug-1, slug-2."""
    heads = rows.where("kind = 'heading'")
    later = Window.partitionBy("doc").orderBy("first").rangeBetween(1, Window.unboundedFollowing)
    ends = [F.min(F.when(F.col("level") <= k, F.col("first"))).over(later) for k in range(1, 7)]
    end = F.coalesce(*(F.when(F.col("level") == k, ends[k - 1]) for k in range(1, 7)))
    slug = F.regexp_replace(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\s_-]", "")), r"\s", "-")
    heads = heads.select("doc", F.coalesce("anchor", slug).alias("slug"), F.col("text").alias("title"), "level", "first", end.alias("end"))
    n = F.row_number().over(Window.partitionBy("doc", "slug").orderBy("first")) - 1
    return heads.withColumn("n", n).select("doc", F.when(F.col("n") == 0, F.col("slug")).otherwise(F.concat_ws("-", "slug", "n")).alias("section"), "title", "level", "first", "end")


def enclosing(rows: DataFrame, levels: int = 6) -> DataFrame:
    """rows of blocks (doc, kind, level, first, ...) with `within`: the first lines of the headings whose sections each block stands in, from
    the highest level down; a heading stands in its parents' sections, not in its own.

    One sweep over each document's lines in order: a heading is open until one of its level or a higher one comes, so the latest heading
    of a level counts if it came after the latest of every higher level. One exchange and one sort by document; a document
    is one sorted run of rows, which spills where it is long."""
    before = Window.partitionBy("doc").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    latest = [F.last(F.when((F.col("kind") == "heading") & (F.col("level") == k), F.col("first")), True).over(before) for k in range(1, levels + 1)]
    out = rows.withColumns({f"_at{k}": x for k, x in enumerate(latest, 1)})
    own = F.when(F.col("kind") == "heading", F.col("level")).otherwise(levels + 1)
    top = F.lit(0)
    open_ = []
    for k in range(1, levels + 1):
        at = F.col(f"_at{k}")
        open_.append(F.when((at > top) & (k < own), at))
        top = F.greatest(top, F.coalesce(at, F.lit(0)))
    return out.withColumn("within", F.array_compact(F.array(*open_))).drop(*(f"_at{k}" for k in range(1, levels + 1)))


def contents(rows: DataFrame) -> DataFrame:
    """(doc, section, n_blocks, has_text): content blocks inside each section, its subsections' too. A block meets the headings that
    enclose it, six at most, not all sections of its document."""
    own = enclosing(rows.select("doc", "kind", "level", "first", "text")).where("kind not in ('heading', 'comment', 'rule')")
    text = F.rlike(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}\p{N}]"))
    n = own.select("doc", F.explode("within").alias("first"), text.alias("t")).groupBy("doc", "first").agg(F.count("*").alias("n_blocks"), F.max("t").alias("has_text"))
    found = sections(rows).join(n, ["doc", "first"], "left")
    return found.select("doc", "section", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.coalesce("has_text", F.lit(False)).alias("has_text"))


def adjacent(lines: DataFrame) -> DataFrame:
    """lines (doc, line, blank: boolean, mark, target) -> (doc, line, mark, target_line, target) for each line with a mark: the next line
    below it that has a target, if only blank lines lie between (else nulls). A line's own target is not below it.

    One pass over each document's lines in order, without a join: the number of lines that are not blank is carried along, and at the next
    target it must be that of the mark and one more. Marks and targets are any values, null on the other lines; equal line numbers of a
    document are one line as far as order goes, and none lies between the others."""
    here = Window.partitionBy("doc").orderBy("line")
    below = here.rangeBetween(1, Window.unboundedFollowing)
    filled = F.sum(F.when(F.col("blank"), 0).otherwise(1)).over(here.rangeBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("_filled", filled)
    rows = rows.withColumn("_before", F.coalesce(F.max("_filled").over(here.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    next_ = F.first(F.when(F.col("target").isNotNull(), F.struct("line", "target", F.col("_before").alias("n"))), True).over(below)
    rows = rows.withColumn("_next", next_).where("mark is not null")
    close = F.col("_next.n") == F.col("_filled")
    return rows.select("doc", "line", "mark", F.when(close, F.col("_next.line")).alias("target_line"), F.when(close, F.col("_next.target")).alias("target"))


#: Hidden comments that name the section or the block below them, and anchors that do.
MARKER = r"^\s*<!--\s*wiki-doc:(section|fragment)\s+([\w][\w.-]*)\s*-->\s*$"
ID_ANCHOR = r"(?i)^\s*<a\s+id=[\"'](?-i:([\w][\w.-]*))[\"']\s*>\s*</a>\s*$"


def marked(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs (doc, text) and their blocks -> (doc, line, mark, id, target_line, target, problem): what hidden markers and `<a id>` name.
    A section marker and the heading right below it, an anchor and that heading or block, a fragment marker and that block; only blank lines may
    lie between. problem: no_heading or no_block where there is none, several_markers for a heading that more than one names,
    repeated_id for a name that stands more than once in its document."""
    lines = docs.select("doc", F.posexplode(F.split("text", "\r?\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    kind = F.when(F.rlike("text", F.lit(MARKER)), F.regexp_extract("text", MARKER, 1)).when(F.rlike("text", F.lit(ID_ANCHOR)), "anchor")
    name = F.when(F.rlike("text", F.lit(MARKER)), F.regexp_extract("text", MARKER, 2)).otherwise(F.regexp_extract("text", ID_ANCHOR, 1))
    mark = F.when(kind.isNotNull(), F.struct(kind.alias("mark"), name.alias("id")))
    starts = rows.where("kind not in ('comment', 'rule')").select("doc", F.col("first").alias("line"), F.when(F.col("kind") == "heading", "heading").otherwise("block").alias("target"))
    own = lines.select("doc", "line", (F.trim("text") == "").alias("blank"), mark.alias("mark")).join(starts, ["doc", "line"], "left")
    own = own.withColumn("target", F.when(F.col("mark").isNull(), F.col("target")))  # a marker is no content
    got = adjacent(own).select("doc", "line", "mark.mark", "mark.id", "target_line", "target")
    fits = (F.col("target") == "heading") | ((F.col("mark") != "section") & (F.col("target") == "block"))
    fits = fits & ~((F.col("mark") == "fragment") & (F.col("target") == "heading"))
    got = got.withColumns({"target_line": F.when(fits, F.col("target_line")), "target": F.when(fits, F.col("target"))})
    same = F.count("*").over(Window.partitionBy("doc", "target_line"))
    repeated = F.count("*").over(Window.partitionBy("doc", "id"))
    problem = (
        F.when(F.col("target").isNull(), F.when(F.col("mark") == "section", "no_heading").otherwise("no_block"))
        .when((F.col("target") == "heading") & (same > 1), "several_markers").when(repeated > 1, "repeated_id")
    )
    return got.withColumn("problem", problem)


def coverage(required: DataFrame, entries: DataFrame, filled: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """required (doc, fact) against entries (doc, fact, section) and contents: (doc, fact, problem) of facts without an entry,
    in an unknown section, or in an empty one. allowed (group, section), with a group in required: a section that is not allowed for the
    fact's group is wrong, unless it is unknown or empty."""
    joined = required.join(entries, ["doc", "fact"], "left").join(filled, ["doc", "section"], "left")
    wrong = F.lit(False)
    if allowed is not None:
        joined = joined.join(allowed.select("group", "section", F.lit(True).alias("_allowed")).distinct(), ["group", "section"], "left")
        wrong = F.col("_allowed").isNull()
    problem = F.when(F.col("section").isNull(), "not_covered").when(F.col("has_text").isNull(), "unknown_section").when(~F.col("has_text"), "empty_section").when(wrong, "wrong_section")
    return joined.withColumn("problem", problem).where("problem is not null").select("doc", "fact", "problem")
