"""Several tables as one commit, and inputs that must not change while they are read.

Below a root lie `_versions/<id>/<table>`, never changed once written, and `_commits/<number>.json`, one small document for each commit. A
commit writes all its tables first and then makes its document appear under the next number, in one step that fails if the number is
taken: readers see the old tables or the new ones, and of two writers that start from the same number one wins. A writer
that is killed leaves a version that no commit names."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.storage import forget, settled


class Conflict(ValueError):
    """The catalogue is not at the commit that the work was based on, or an input changed while it was read."""


@dataclass(frozen=True)
class Commit:
    """number: 0 before the first one. folders: of each table, where this commit has it."""

    number: int
    folders: Mapping[str, str]

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self.folders:
            raise ValueError(f"commit {self.number} has no table {name}")
        return spark.read.parquet(self.folders[name])


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def current(spark: SparkSession, root: str, number: int | None = None) -> Commit:
    """The latest commit below root, or that of a number."""
    store, folder = _store(spark, f"{root}/_commits")
    names = sorted(x.getPath().getName() for x in store.listStatus(folder)) if store.exists(folder) else []
    names = [n for n in names if n.endswith(".json") and number in (None, int(n[:-5]))]
    if not names:
        if number:
            raise ValueError(f"there is no commit {number} below {root}")
        return Commit(0, {})
    text = spark.read.text(f"{root}/_commits/{names[-1]}", wholetext=True).first()[0]
    return Commit(int(names[-1][:-5]), {k: v if "://" in v or v.startswith("/") else f"{root}/{v}" for k, v in json.loads(text)["tables"].items()})


def _linked(source: str, target: str) -> bool:
    """On the local file system: a hard link does not overwrite."""
    try:
        os.link(source, target)
    except FileExistsError:
        return False
    os.unlink(source)
    return True


def _renamed(spark: SparkSession, source, target) -> bool:
    """On any other: a rename that does not overwrite, one step where the file system has such a step (HDFS has)."""
    jvm = spark._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration()).rename(source, target, options)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    return True


def _appear(spark: SparkSession, made: str, name: str) -> bool:
    """Give a finished file its name, if nothing has that name."""
    store, source = _store(spark, made)
    target = _store(spark, name)[1]
    done = _linked(source.toUri().getPath(), target.toUri().getPath()) if store.getUri().getScheme() == "file" else _renamed(spark, source, target)
    if not done:
        store.delete(source, False)
    return done


def commit(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], based_on: int | None = None, keep: bool = False, check: Callable[[], None] | None = None) -> int:
    """Write the tables and make them the current ones, all or none: the number of the commit. based_on: the commit that they
    were computed from (the one before by default, as it is when this begins); if another came in between, nothing is committed and
    Conflict is raised. check() is called when all is written, and may raise to stop the commit. keep: tables of the current commit that are not given stay as they are."""
    before = current(spark, root)
    if based_on is not None and based_on != before.number:
        raise Conflict(f"{root} is at commit {before.number}, not {based_on}")
    version = f"_versions/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    if check is not None:
        check()
    named = (dict(before.folders) if keep else {}) | {name: f"{version}/{name}" for name in tables}
    draft = f"{root}/_commits/.{uuid.uuid4().hex}"
    store, at = _store(spark, draft)
    out = store.create(at, False)
    out.write(bytearray(json.dumps({"tables": named}, sort_keys=True).encode()))
    out.close()
    number = before.number + 1
    if not _appear(spark, draft, f"{root}/_commits/{number:020d}.json"):
        store.delete(_store(spark, f"{root}/{version}")[1], True)
        raise Conflict(f"another commit {number} came first")
    return number


def unnamed(spark: SparkSession, root: str) -> list[str]:
    """Versions that no commit names: of killed writers, or of writers still at work."""
    store, folder = _store(spark, f"{root}/_versions")
    have = {x.getPath().getName() for x in store.listStatus(folder)} if store.exists(folder) else set()
    names = {f.split("/_versions/")[1].split("/")[0] for n in range(1, current(spark, root).number + 1) for f in current(spark, root, n).folders.values() if "/_versions/" in f}
    return sorted(have - names)


# The read barrier ------------------------------------------------------------------------------------------------------


def frame(spark: SparkSession, folders: Sequence[str], content: bool = True) -> DataFrame:
    """(path, bytes, state) of all files below the folders: their hashes, or for tables with large files (content=False) the time of their last
    change, which reads none of them. Hidden files and a folder that is not there have no rows."""
    there = [f for f in folders if (lambda s, p: s.exists(p))(*_store(spark, f))]
    if not there:
        return spark.createDataFrame([], "path string, bytes long, state string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(there))
    state = F.sha2("content", 256) if content else F.col("modificationTime").cast("string")
    return files.select("path", F.col("length").alias("bytes"), state.alias("state"))


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two frames: added, removed, changed."""
    rows = before.select("path", F.struct("bytes", "state").alias("a")).join(after.select("path", F.struct("bytes", "state").alias("b")), "path", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return rows.select("path", change.alias("change")).where("change is not null")


def guarded(spark: SparkSession, folders: Sequence[str], work: Callable[[], DataFrame], content: bool = True) -> tuple[DataFrame, DataFrame]:
    """What work() returns, from a written table, and the differences (path, change) of the folders' files between its beginning and
    its end. Rows of the result stand for one state of the inputs only if there are no differences."""
    before = settled(spark, frame(spark, folders, content), "frame")
    done = settled(spark, work(), "guarded")
    changed = settled(spark, differences(before, frame(spark, folders, content)), "changed")
    forget(spark, before)
    return done, changed


def stable(spark: SparkSession, folders: Sequence[str], work: Callable[[], DataFrame], content: bool = True) -> DataFrame:
    """As guarded(), but Conflict is raised if anything changed."""
    done, changed = guarded(spark, folders, work, content)
    first = changed.orderBy("path").first()
    if first is not None:
        raise Conflict(f"{first['path']} was {first['change']} while it was read; try again")
    return done
