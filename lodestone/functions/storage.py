"""Tables between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: A table of few files has this many for each core of the cluster, or one for so many bytes of what it is made of, if that is more.
FILES_PER_CORE = 2
FILE_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session (one machine, as in tests) gets a temporary folder; on a cluster
    that would be invisible to executors, so there it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def source_bytes(df: DataFrame) -> int:
    """Bytes of the files that the rows are read from, as the scans of the plan know them; a file that is read twice counts twice. Rows
    from elsewhere, whose size no one knows (the plan gives them the largest number there is), do not count."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 62)


def settled(spark: SparkSession, df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """The rows from a written table: cuts the lineage, survives lost executors, and gives the planner the table's true
    size, so that only a small one is broadcast.

    few: for rows that come out of a shuffle, where its partitions are many for the data: as many files as FILES_PER_CORE and FILE_BYTES
    say, not one for each partition. Tasks grow in number with the bytes that are read, whatever the cores, up to the partitions of
    the shuffle, each of which is still taken on its own. A file has its price in any store; in a local folder Hadoop
    starts a chmod for it and one for its checksum, and until that runs, the new process shares the executor's whole memory,
    which whoever adds up processes counts twice."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if few:
        df = df.coalesce(min((1 << 31) - 1, max(FILES_PER_CORE * spark.sparkContext.defaultParallelism, -(-source_bytes(df) // FILE_BYTES))))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table of settled() that nothing reads any more."""
    for name in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(name.rsplit("/", 1)[0])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
