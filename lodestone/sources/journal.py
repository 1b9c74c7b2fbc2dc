"""The journal of stages: events appended once, whatever happens to writers.

An append is a set of files that appear whole; each event has an id, and an id that stands twice (a writer that tried again) counts
once. Files that others write line by line may end in the middle of a line: such a tail is found by its missing line feed, kept where it
is a whole event after all, and left out otherwise; repaired() takes it away."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.storage import settled

#: The stages of a run.
STAGES = ("inventory", "plan", "draft", "validation", "decision", "publish", "lint", "query", "regression", "error")
SCHEMA = "schema_version int, event_id string, timestamp string, stage string, run_id string, page_id string, outcome string, details map<string,string>"


def recorded(events: DataFrame, path: str) -> None:
    """Append events (stage, run_id, page_id, and outcome, details, event_id and timestamp where they are given). A stage that there is
    not is an error, before anything is written. Without an event_id, it is the hash of the event, so that the same event written
    again is one event; give one to tell equal events apart."""
    have = set(events.columns)
    rows = events.withColumn("schema_version", F.lit(1)).withColumn("outcome", F.coalesce(F.col("outcome") if "outcome" in have else F.lit(None), F.lit("ok")))
    rows = rows.withColumn("details", F.col("details") if "details" in have else F.lit(None).cast("map<string,string>"))
    rows = rows.withColumn("timestamp", F.coalesce(F.col("timestamp") if "timestamp" in have else F.lit(None), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    own = F.sha2(F.to_json(F.struct(*(c for c in ("stage", "run_id", "page_id", "outcome", "details")), *(["timestamp"] if "timestamp" in have else []))), 256)
    rows = rows.withColumn("event_id", F.coalesce(F.col("event_id") if "event_id" in have else F.lit(None), own))
    wrong = rows.where(F.coalesce(~F.col("stage").isin(*STAGES), F.lit(True))).select("stage").first()
    if wrong is not None:
        raise ValueError(f"no stage: {wrong[0]!r}")
    rows.select(*(c.split()[0] for c in SCHEMA.split(", "))).write.mode("append").json(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value, whole): the lines of all files; whole: the line is a JSON object, and so an event."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim("value") != "")
    return rows.withColumn("whole", F.rlike("value", F.lit(r"^\s*\{")) & F.try_parse_json("value").isNotNull())


def read(spark: SparkSession, path: str) -> DataFrame:
    """The events, each once, in the columns of SCHEMA. Lines that are no JSON object are left out; events without an id count each."""
    rows = lines(spark, path).where("whole").select(F.from_json("value", SCHEMA).alias("e")).select("e.*")
    once = rows.where("event_id is not null").dropDuplicates(["event_id"])
    return once.unionByName(rows.where("event_id is null"))


def torn(spark: SparkSession, path: str) -> DataFrame:
    """(file, tail, whole) of files that do not end in a line feed: what follows the last one, and whether it is an event."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    text = F.decode("content", "UTF-8")
    tail = files.select(F.col("_metadata.file_path").alias("file"), text.alias("text")).where(~F.endswith("text", F.lit("\n"))).select("file", F.substring_index("text", "\n", -1).alias("tail"))
    return tail.withColumn("whole", F.rlike("tail", F.lit(r"^\s*\{")) & F.try_parse_json("tail").isNotNull())


def repaired(spark: SparkSession, path: str) -> int:
    """Write the events of torn files anew and take those files away: their number. Killed in between, events stand twice and still
    count once."""
    files = settled(spark, torn(spark, path).select("file"), "torn")
    names = [r["file"] for r in files.collect()]  # one for each writer that was killed
    if names:
        kept = settled(spark, lines(spark, path).join(F.broadcast(files), "file", "left_semi").where("whole").select("value"), "events")
        kept.coalesce(1).write.mode("append").text(path)
        for name in names:
            at = spark._jvm.org.apache.hadoop.fs.Path(name)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, False)
    return len(names)
