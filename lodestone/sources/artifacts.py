"""Artifact files as tables: strict JSON, line journals, ledgers of hashes."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.storage import settled


def strict_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, sha256, valid, value) of each file: UTF-8, a byte-order mark is skipped, repeated keys and NaN are invalid. The
    schema is given, never inferred; an invalid file has a null value."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    rows = raw.select("path", F.sha2("content", 256).alias("sha256"), text.alias("text"))
    valid = F.try_parse_json("text").isNotNull() & ~F.rlike(F.regexp_replace("text", r'"(?:[^"\\]|\\.)*"', ""), F.lit(r"NaN|Infinity"))
    return rows.withColumn("valid", valid).select("path", "sha256", "valid", F.when(F.col("valid"), F.from_json("text", schema)).alias("value"))


def journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The events of line files; lines that are no JSON object (a torn tail, bad bytes) are left out."""
    lines = spark.read.text(path).where(F.rlike("value", F.lit(r"^\s*\{")) & F.try_parse_json("value").isNotNull())
    return lines.select(F.from_json("value", schema).alias("e")).select("e.*")


def recorded(events: DataFrame, path: str) -> None:
    """Append events to a journal."""
    events.write.mode("append").json(path)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of all files below a folder, hidden ones left out. Spark's scan gives no row for an empty file; those come from
    the list of files, which the driver makes for any scan."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    plain = lambda df: df.withColumn("path", F.regexp_replace("path", "^file:/*", "file:/"))
    names = spark.createDataFrame([(unquote(x),) for x in found.inputFiles()], "path string")
    rows = plain(names).join(plain(found.select("path", "length", "content")), "path", "left")
    return rows.select("path", F.coalesce("length", F.lit(0)).cast("bigint").alias("length"), F.coalesce("content", F.lit(b"")).alias("content"))


def named(folder: str) -> Column:
    """A file's path from the folder on."""
    root = F.regexp_replace(F.lit(folder), "^file:/*|/+$", "")
    return F.replace(F.regexp_replace("path", "^file:/*", ""), F.concat(F.regexp_replace(root, "^/+", ""), F.lit("/")), F.lit(""))


def drifted(spark: SparkSession, ledger: DataFrame, folder: str) -> DataFrame:
    """ledger (name, sha256) against the files below a folder: (name, reason) of those that changed or are missing."""
    now = files(spark, folder).select(named(folder).alias("name"), F.sha2("content", 256).alias("now"))
    rows = ledger.join(now, "name", "left").where(~F.col("now").eqNullSafe(F.col("sha256")))
    return rows.select("name", F.when(F.col("now").isNull(), "source_missing").otherwise("source_changed").alias("reason"))


#: The parts of a run's artifact set.
PARTS = ("inventory", "facts", "coverage", "validation_plan", "validation", "decision", "manifest")


def artifact_set(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """(run, valid, sha256, value) of each part that a schema is given for, over all runs below a folder (one folder each)."""
    out = {}
    for name in (p for p in PARTS if p in schemas):
        rows = strict_json(spark, f"{folder}/*/{name}.json", schemas[name])
        out[name] = rows.select(F.element_at(F.split("path", "/"), -2).alias("run"), "valid", "sha256", "value")
    return out


def metadata(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(file, valid, value) of the metadata files of pages below a folder."""
    return strict_json(spark, folder, schema).select(F.element_at(F.split("path", "/"), -1).alias("file"), "valid", "value")


def archive_problems(records: DataFrame, documented: DataFrame, manifests: DataFrame, decisions: DataFrame) -> DataFrame:
    """records (run_id, page_id, key, page_sha256) against their archives: documented (run_id, page_id, key), manifests (run_id, page_id,
    sha256, draft_sha256, validation_sha256) and decisions (run_id, decision, manifest_sha256, validation_sha256): (run_id, problem)."""
    n = documented.groupBy("run_id").agg(F.count("*").alias("_n"), F.min("page_id").alias("_page"), F.min("key").alias("_key"))
    m = manifests.select("run_id", F.col("page_id").alias("_mpage"), F.col("sha256").alias("_sha"), "draft_sha256", F.col("validation_sha256").alias("_validation"))
    rows = records.join(n, "run_id", "left").join(m, "run_id", "left").join(decisions.select("run_id", "decision", "manifest_sha256", "validation_sha256"), "run_id", "left")
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    found = F.array_compact(F.array(
        F.when(F.coalesce("_n", F.lit(0)) != 1, "not_one_identity"), F.when(differs("_key", "key"), "other_key"), F.when(differs("_page", "page_id") | differs("_mpage", "page_id"), "other_page"),
        F.when(differs("draft_sha256", "page_sha256"), "other_draft"), F.when(~F.col("decision").eqNullSafe(F.lit("ready")), "not_ready"),
        F.when(differs("manifest_sha256", "_sha"), "other_manifest"), F.when(differs("validation_sha256", "_validation"), "other_validation"),
    ))
    return rows.select("run_id", F.explode(found).alias("problem"))


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """(name from the folder, sha256, bytes) of the files below it: what drifted() compares with."""
    return files(spark, folder).select(named(folder).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


#: Bytes of files that a task copies, about; and of one file that it holds at a time.
TASK_BYTES, CHUNK = 256 << 20, 8 << 20


def copied(spark: SparkSession, folder: str, destination: str) -> DataFrame:
    """Copy the files below a folder to another, in tasks of about TASK_BYTES: (name, sha256, bytes, copy_sha256) of each, from a
    written table. A file streams into a hidden one beside its place, which is read back and then gets its name: a task that breaks leaves no half
    file under a name, and may run again. Both folders must be open to executors through pyarrow.fs (local and shared disks, HDFS, S3)."""
    listed = files(spark, folder).select("path", "length")  # without contents
    total, n = listed.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    base, out = (x if "://" in x or x.startswith("file:") else f"file://{x}" for x in (folder.rstrip("/"), destination.rstrip("/")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(re.sub("^file:/*", "file:///", base))
        target, place = fs.FileSystem.from_uri(re.sub("^file:/*", "file:///", out))

        def digest(stream) -> tuple[str, int]:
            h, size = hashlib.sha256(), 0
            while block := stream.read(CHUNK):
                h.update(block)
                size += len(block)
            return h.hexdigest(), size

        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                name = re.sub("^file:/*", "/", path) if path.startswith("file:") else re.sub("^[a-z0-9]+://[^/]*", "", path)
                name = name[name.index(root) + len(root) :].lstrip("/") if root in name else name.rsplit("/", 1)[-1]
                final = f"{place}/{name}"
                parent, _, last = final.rpartition("/")
                target.create_dir(parent, recursive=True)
                draft = f"{parent}/.{last}.{uuid.uuid4().hex}"
                h, size = hashlib.sha256(), 0
                with store.open_input_stream(f"{root}/{name}") as source, target.open_output_stream(draft) as sink:
                    while block := source.read(CHUNK):
                        h.update(block)
                        size += len(block)
                        sink.write(block)
                with target.open_input_stream(draft) as again:
                    back, _ = digest(again)
                target.move(draft, final)
                rows.append((name, h.hexdigest(), size, back))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["name", "sha256", "bytes", "copy_sha256"])

    tasks = max(1, min(n, -(-total // TASK_BYTES)))
    dealt = listed.select("path").repartition(tasks, F.xxhash64("path"))
    return settled(spark, dealt.mapInArrow(run, "name string, sha256 string, bytes long, copy_sha256 string"), "copied")


def saved(spark: SparkSession, folder: str, destination: str, expected: DataFrame | None = None) -> int:
    """Copy a run's folder to a new place, and check the copy against the ledger of the original, and that against `expected` (name, sha256)
    where it is given: the number of files. A destination that stands already or lies in the folder, and a copy that differs, are errors; the copy is then
    taken away. The driver sees no file, only whether ledgers agree."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(destination).getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(path(destination)):
        raise ValueError(f"{destination} stands already")
    if f"{destination.rstrip('/')}/".startswith(f"{folder.rstrip('/')}/"):
        raise ValueError(f"{destination} lies in {folder}")
    try:
        done = copied(spark, folder, destination)
        bad = done.where("sha256 <> copy_sha256").select("name")
        if expected is not None:
            rows = done.select("name", "sha256").join(expected.select("name", F.col("sha256").alias("_want")), "name", "full")
            bad = bad.unionByName(rows.where(~F.col("sha256").eqNullSafe(F.col("_want"))).select("name"))
        first = bad.orderBy("name").first()
        if first is not None:
            raise ValueError(f"the copy at {destination} differs: {first['name']}")
        return done.count()
    except Exception:
        store.delete(path(destination), True)
        raise


def decisions(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The decisions of all runs below a folder (one folder each): run and the fields of the schema. Runs without one, and files that
    are no strict JSON, are left out."""
    rows = strict_json(spark, f"{folder}/*/decision.json", schema).where("valid and value is not null")
    return rows.select(F.element_at(F.split("path", "/"), -2).alias("run"), "value.*")
