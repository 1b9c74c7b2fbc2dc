"""Faults of a tree of pages: links, pages and metadata that do not agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import markdown

LINK = r"(?<!!)\[[^\]]*\]\(\s*<?([^)\s>]+)>?(?:\s+\"[^\"]*\")?\s*\)"


def unquoted(x: Column) -> Column:
    """Percent-decoded; a plus stays one. Null where an escape is broken."""
    return F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))


def links(blocks: DataFrame) -> DataFrame:
    """(doc, line, target, scheme, path, fragment) of the links in text; code has none. path is the one named from the root, ''
    for the page itself; null where it leads out of the root or cannot be decoded."""
    rows = blocks.where("kind not in ('code', 'comment', 'rule')").select("doc", F.col("first").alias("line"), F.explode(F.regexp_extract_all(F.regexp_replace("text", "`[^`]*`", ""), F.lit(LINK), 1)).alias("target"))
    scheme = F.lower(F.regexp_extract("target", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    path = unquoted(F.regexp_extract("target", r"^([^#?]*)", 1))
    rows = rows.withColumn("scheme", scheme).withColumn("_path", F.when(scheme == "", path)).withColumn("fragment", unquoted(F.regexp_extract("target", "#(.*)$", 1)))
    folder = F.regexp_extract("doc", r"^(.*/)?[^/]*$", 1)
    steps = F.split(F.concat(folder, "_path"), "/")
    # each .. takes the last step back; a step back from the root leaves it
    walked = F.aggregate(
        F.filter(steps, lambda s: (s != "") & (s != ".")), F.array().cast("array<string>"),
        lambda at, s: F.when(s != "..", F.concat(at, F.array(s))).when(F.size(at) > 0, F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.array(F.lit(None).cast("string"))),
    )
    whole = F.when(F.col("_path") == "", "").when(F.startswith("_path", F.lit("/")) | F.exists(walked, lambda s: s.isNull()), None).otherwise(F.array_join(walked, "/"))
    return rows.withColumn("path", whole).select("doc", "line", "target", "scheme", "path", "fragment")


def broken_links(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """(code, file, line, message) of links to no file of files (path, n_lines), to no section of a page, or beyond a file's lines
    (#L12-L20)."""
    rows = links(blocks).where("scheme = ''").withColumn("to", F.when(F.col("path") == "", F.col("doc")).otherwise(F.col("path")))
    rows = rows.join(files.select(F.col("path").alias("to"), "n_lines", F.lit(True).alias("_file")), "to", "left")
    rows = rows.join(markdown.sections(blocks).select(F.col("doc").alias("to"), F.col("section").alias("fragment"), F.lit(True).alias("_section")).distinct(), ["to", "fragment"], "left")
    first, last = (F.try_to_number(F.nullif(F.regexp_extract("fragment", r"^L(\d+)(?:-L(\d+))?$", n), F.lit("")), F.lit("999999999")) for n in (1, 2))
    code = (
        F.when(F.col("to").isNull(), "link_outside_root").when(F.col("_file").isNull(), "broken_link")
        .when(first.isNotNull() & ((first < 1) | (F.coalesce(last, first) > F.col("n_lines")) | (F.coalesce(last, first) < first)), "bad_line_anchor")
        .when(first.isNull() & (F.col("fragment") != "") & F.endswith("to", F.lit(".md")) & F.col("_section").isNull(), "broken_anchor")
    )
    return rows.withColumn("code", code).where("code is not null").select("code", F.col("doc").alias("file"), "line", F.col("target").alias("message"))


def lint(blocks: DataFrame, files: DataFrame, metadata: DataFrame, index: str = "index.md") -> DataFrame:
    """(code, file, line, message, severity): broken links; pages that index does not list; metadata (page_id, key) without its
    page; keys and page ids that stand twice."""
    pages = files.where(F.endswith("path", F.lit(".md"))).select("path")
    listed = links(blocks).where((F.col("doc") == index) & F.col("path").isNotNull()).select("path").distinct()
    issue = lambda df, code, file, message: df.select(F.lit(code).alias("code"), file.alias("file"), F.lit(None).cast("int").alias("line"), message.alias("message"))
    twice = lambda c: metadata.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"), F.min("page_id").alias("_first")).where("n > 1")
    out = [
        broken_links(blocks, files),
        issue(pages.where(F.col("path") != index).join(listed, "path", "left_anti"), "unlisted_page", F.col("path"), F.lit("not in the index")),
        issue(metadata.join(pages.withColumnRenamed("path", "page_id"), "page_id", "left_anti"), "page_missing", F.col("page_id"), F.lit("metadata without a page")),
        issue(twice("key"), "repeated_key", F.col("_first"), F.col("key")),
        issue(twice("page_id"), "repeated_page", F.col("page_id"), F.lit("several metadata")),
    ]
    return reduce(DataFrame.unionByName, out).withColumn("severity", F.when(F.col("code") == "unlisted_page", "warning").otherwise("error"))
