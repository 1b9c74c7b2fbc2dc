"""PDF files to Markdown by a back end of the caller's; what surrounds it are columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_BREAK = "<!-- PAGE_BREAK -->"
_backends: dict[str, Callable[[bytes], str]] = {}


class BackendUnavailable(RuntimeError):
    """No back end of that name is registered."""


def register(name: str, extract: Callable[[bytes], str]) -> None:
    _backends[name] = extract


def cache_key(content: Column, mode: str) -> Column:
    """Of the whole content, its size and the mode."""
    return F.left(F.sha2(F.concat_ws("|", F.octet_length(content).cast("string"), F.sha2(content, 256), F.lit(mode)), 256), F.lit(16))


def paged(markdown: Column) -> Column:
    return F.replace(markdown, F.lit("\n-----\n"), F.lit(f"\n{PAGE_BREAK}\n"))


def pages(rows: DataFrame, key: str = "path", column: str = "markdown") -> DataFrame:
    """(key, page from 1, text)."""
    return rows.select(key, F.posexplode(F.split(paged(F.col(column)), PAGE_BREAK)).alias("page", "text")).withColumn("page", F.col("page") + 1)


def image_names(markdown: Column) -> Column:
    """Distinct base names of the images that a text shows."""
    found = F.regexp_extract_all(markdown, F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.substring_index(x, "/", -1))))


IMAGE = "<!-- image -->"


def _literal(name: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(name, F.lit("\\E"), F.lit("")), F.lit("\\E"))


def relinked(markdown: Column, names: Column) -> Column:
    """Images of these names (those that exist) are shown from images/, wherever the text had them."""
    shown = lambda n: F.concat(F.lit("](images/"), F.regexp_replace(n, r"([\\$])", r"\\$1"), F.lit(")"))
    return F.aggregate(names, markdown, lambda text, n: F.regexp_replace(text, F.concat(F.lit(r"\]\((?:[^()]*/)?"), _literal(n), F.lit(r"\)")), shown(n)))


def placed(markdown: Column, names: Column) -> Column:
    """The n-th placeholder becomes the n-th image; placeholders beyond the images stay."""
    parts = F.split(markdown, IMAGE)
    last = F.size(parts) - 1
    after = lambda i: F.when(i == last, "").when(i < F.size(names), F.concat(F.lit("![](images/"), F.get(names, i), F.lit(")"))).otherwise(IMAGE)
    return F.array_join(F.transform(parts, lambda x, i: F.concat(x, after(i))), "")


def titled(markdown: Column, source: Column, n_pages: Column, mode: str) -> Column:
    """A text with a header that names its source, pages and mode."""
    return F.concat(F.lit("---\nsource: "), F.to_json(F.array(source)).substr(F.lit(2), F.length(F.to_json(F.array(source))) - 2), F.lit("\npages: "), n_pages.cast("string"), F.lit(f"\nmode: {mode}\n---\n\n"), markdown)


def image_table(images: Column) -> Column:
    """images: array of (name, bytes), as a Markdown table by name; empty without images."""
    rows = F.transform(F.array_sort(images), lambda x: F.concat(F.lit("| "), x["name"], F.lit(" | "), F.format_number(F.bround(x["bytes"] / 1024, 1), 1), F.lit(" |")))
    return F.when(F.size(images) > 0, F.concat(F.lit("| Image | KB |\n| --- | --- |\n"), F.array_join(rows, "\n"))).otherwise("")


def image_catalogue(images: DataFrame, texts: DataFrame) -> DataFrame:
    """images (path, name, bytes) that their document's text (path, markdown) shows, by path and name, each once."""
    shown = texts.select("path", F.explode(image_names(F.col("markdown"))).alias("name"))
    return images.dropDuplicates(["path", "name"]).join(shown, ["path", "name"], "left_semi").orderBy("path", "name")


def extracted(files: DataFrame, mode: str = "fast", cache: DataFrame | None = None) -> DataFrame:
    """files (path, content) -> (path, cache_key, markdown, from_cache). Only keys that the cache (cache_key, markdown) lacks
    are extracted, each once."""
    if mode not in _backends:
        raise BackendUnavailable(f"no PDF back end {mode!r}; register() one")
    extract = _backends[mode]
    keyed = files.select("path", "content", cache_key(F.col("content"), mode).alias("cache_key"))
    new = keyed if cache is None else keyed.join(cache.select("cache_key"), "cache_key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"cache_key": batch["cache_key"], "markdown": [extract(bytes(x)) for x in batch["content"]]})

    made = new.groupBy("cache_key").agg(F.first("content").alias("content")).mapInPandas(run, "cache_key string, markdown string").withColumn("from_cache", F.lit(False))
    whole = made if cache is None else made.unionByName(cache.select("cache_key", "markdown").withColumn("from_cache", F.lit(True)))
    return keyed.select("path", "cache_key").join(whole, "cache_key").select("path", "cache_key", "markdown", "from_cache")
