"""References to lines of files at any depth of nested documents, and what is wrong with them.

One pass over the documents finds all references, without a shuffle and without tables between levels. Spark's VARIANT says which documents are JSON and
reads the fields of each reference; a walk of the parsed document says where the references stand."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import gate

#: What makes an object a reference.
FIELDS = ("path", "start_line", "end_line", "sha256")
#: References that leave the walk at a time.
ROWS = 4096


class Number(str):
    """A number as it is written."""


_decoder = json.JSONDecoder(parse_int=Number, parse_float=Number, strict=False)


def text_of(value: object) -> str:
    """The JSON of a parsed value, numbers as they were written."""
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{text_of(v)}" for k, v in value.items()) + "}"
    return f"[{','.join(map(text_of, value))}]" if isinstance(value, list) else json.dumps(value)


def places(document: str, name: str | None) -> Iterator[tuple[str | None, str]]:
    """Where each object with all FIELDS stands, and the JSON of its FIELDS and root."""
    left = [(name, _decoder.raw_decode(document.lstrip())[0])]
    while left:
        at, value = left.pop()
        if isinstance(value, dict):
            if all(f in value for f in FIELDS):
                yield at, text_of({f: value[f] for f in (*FIELDS, "root") if f in value})
            below = value.items()
        else:
            below = enumerate(value) if isinstance(value, list) else ()
        left += ((f"{k}" if at is None else f"{at}.{k}", v) for k, v in below if isinstance(v, (dict, list)))


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, where, what = [], [], []

        def made(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(where, pa.binary()).cast(pa.string()), pa.array(what, pa.string())], ["run_id", "location", "value"])

        for i in range(batch.num_rows):
            name = batch.column(1)[i].as_py()
            for at, value in places(batch.column(2)[i].as_py(), name):
                row.append(i)
                where.append(None if at is None else at.encode("utf-8", "replace"))
                what.append(value)
                if len(row) == ROWS:
                    yield made()
                    row, where, what = [], [], []
        if row:
            yield made()


def references(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """documents (run_id, artifact, document: JSON text) -> (run_id, location, root, path, start_line, end_line, sha256): every object that
    has all FIELDS, wherever it stands, also inside another one. location is the artifact's name and the keys and places (from 0) down to it, with dots between.

    root is `project` where the object names none. Fields of another type are null. Null documents, and those that are no JSON, have no rows (see sources.artifacts.strict_json);
    repeated documents have theirs each time."""
    rows = documents.select("run_id", F.col("artifact").cast("string").alias("artifact"), "document").where(F.try_parse_json("document").isNotNull())
    rows = rows.mapInArrow(walked, f"run_id {documents.schema['run_id'].dataType.simpleString()}, location string, value string")
    rows = rows.withColumn("value", F.parse_json("value"))
    get = lambda f, kind: F.try_variant_get("value", f"$.{f}", kind).alias(f)
    return rows.select("run_id", "location", F.coalesce(get("root", "string"), F.lit("project")).alias("root"), get("path", "string"), get("start_line", "bigint"), get("end_line", "bigint"), get("sha256", "string"))


def problems(spark: SparkSession, documents: DataFrame, ledger: DataFrame) -> DataFrame:
    """(run_id, location, root, path, problem): references of all documents against the ledger of checked inputs (root, path, sha256,
    n_lines), the first problem of each: a file that is no checked input, another hash, lines that it has not."""
    refs = references(spark, documents).withColumnRenamed("location", "fact_id")
    return gate.evidence_problems(refs, ledger).withColumnRenamed("fact_id", "location")
