import glob

from lodestone.functions import storage
from pyspark.sql import functions as F


def test_tasks_follow_bytes_and_not_cores(spark, tmp_path, monkeypatch):
    spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    size = storage.source_bytes(table)
    assert 10_000_000 < size < 20_000_000 and storage.source_bytes(table.join(table.withColumnRenamed("x", "y"), "id")) == 2 * size
    rows = table.repartition(40, "id")
    files = lambda df: len(glob.glob(df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0] + "/part-*"))
    few = storage.FILES_PER_CORE * spark.sparkContext.defaultParallelism
    assert files(storage.settled(spark, rows, "few", few=True)) == few
    monkeypatch.setattr(storage, "FILE_BYTES", size // 20)
    assert files(storage.settled(spark, rows, "few", few=True)) in (20, 21)
    monkeypatch.setattr(storage, "FILE_BYTES", size // 1000)
    out = storage.settled(spark, rows, "few", few=True)
    assert files(out) == 40 and out.count() == 200_000  # every partition of the shuffle on its own
    assert files(storage.settled(spark, rows, "all")) == 40
    unknown = spark.createDataFrame([(1,)], "id long").repartition(7, "id")  # rows of unknown size: few files
    assert storage.source_bytes(unknown) == 0 and storage.settled(spark, unknown, "few", few=True).count() == 1
