import threading

import pytest
from lodestone.operators import evaluation
from lodestone.sources import snapshots
from pyspark.sql import functions as F


def numbers(spark, n):
    return spark.range(n).select("id")


def fails(spark):
    return spark.range(3).select(F.raise_error(F.lit("the writer was killed")).cast("long").alias("id"))


def seen(spark, root, number=None):
    at = snapshots.current(spark, root, number)
    return at.number, {name: at.table(spark, name).count() for name in at.folders}


def test_a_killed_writer_leaves_the_old_pair(spark, tmp_path):
    root = f"file://{tmp_path}/catalogue"
    assert seen(spark, root) == (0, {})
    assert snapshots.commit(spark, root, {"nodes": numbers(spark, 3), "edges": numbers(spark, 5)}) == 1
    for order in (("nodes", "edges"), ("edges", "nodes")):  # before any table, and between two
        with pytest.raises(Exception, match="killed"):
            snapshots.commit(spark, root, {order[0]: numbers(spark, 9), order[1]: fails(spark)})
        with pytest.raises(Exception, match="killed"):
            snapshots.commit(spark, root, {order[0]: fails(spark), order[1]: numbers(spark, 9)})
        assert seen(spark, root) == (1, {"nodes": 3, "edges": 5})
    assert len(snapshots.unnamed(spark, root)) == 4
    # killed with all tables written, before the commit appears
    appear, snapshots._appear = snapshots._appear, lambda *a: (_ for _ in ()).throw(KeyboardInterrupt())
    try:
        with pytest.raises(KeyboardInterrupt):
            snapshots.commit(spark, root, {"nodes": numbers(spark, 9), "edges": numbers(spark, 9)})
    finally:
        snapshots._appear = appear
    assert seen(spark, root) == (1, {"nodes": 3, "edges": 5})
    assert snapshots.commit(spark, root, {"nodes": numbers(spark, 4)}, keep=True) == 2
    assert seen(spark, root) == (2, {"nodes": 4, "edges": 5}) and seen(spark, root, 1) == (1, {"nodes": 3, "edges": 5})
    with pytest.raises(ValueError, match="no table"):
        snapshots.current(spark, root).table(spark, "gaps")
    with pytest.raises(ValueError, match="no commit 7"):
        snapshots.current(spark, root, 7)


class Slow(dict):
    """Tables that wait until all writers have looked at the current commit."""

    def __init__(self, tables, gate):
        super().__init__(tables)
        self.gate = gate

    def items(self):
        self.gate.wait(60)
        return super().items()


def test_of_two_writers_one_wins(spark, tmp_path):
    root = str(tmp_path / "catalogue")
    snapshots.commit(spark, root, {"nodes": numbers(spark, 1)})
    gate, got = threading.Barrier(3), {}

    def write(n):
        try:
            got[n] = snapshots.commit(spark, root, Slow({"nodes": numbers(spark, n)}, gate), based_on=1)
        except snapshots.Conflict:
            got[n] = None

    writers = [threading.Thread(target=write, args=(n,)) for n in (10, 20, 30)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    won = [n for n, x in got.items() if x == 2]
    assert len(won) == 1 and sorted(map(str, got.values())) == ["2", "None", "None"]
    assert seen(spark, root) == (2, {"nodes": won[0]}) and snapshots.unnamed(spark, root) == []
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, root, {"nodes": numbers(spark, 5)}, based_on=1)


def test_a_rename_that_does_not_overwrite(spark, tmp_path):
    path = spark._jvm.org.apache.hadoop.fs.Path
    for name in ("a", "b", "c"):
        (tmp_path / name).write_text(name)
    at = lambda n: path(f"file://{tmp_path}/{n}")
    assert snapshots._renamed(spark, at("a"), at("new")) and not snapshots._renamed(spark, at("b"), at("new"))
    assert (tmp_path / "new").read_text() == "a" and (tmp_path / "b").exists()


def test_inputs_that_change_while_they_are_read(spark, tmp_path):
    runs = tmp_path / "runs"
    for run in ("r1", "r2", "r3"):
        (runs / run).mkdir(parents=True)
        for name in ("facts.json", "manifest.json"):
            (runs / run / name).write_text(run + name)
    required = spark.createDataFrame([(r, "c", "rule", "section", False, "technical") for r in ("r1", "r2", "r3")], "run_id string, id string, rule_id string, source string, blocking boolean, category string")
    checks = spark.createDataFrame([(r, "c", "ok", False) for r in ("r1", "r2", "r3")], "run_id string, plan_check_id string, status string, blocking boolean")

    def work(change):
        def run():
            change()
            return evaluation.evaluated(required, checks, {"links": required.select("run_id").limit(0)})

        return run

    def change():
        (runs / "r2" / "facts.json").write_text("other")
        (runs / "r3" / "manifest.json").unlink()
        (runs / "r1" / ".hidden").write_text("x")

    folder = f"file://{runs}"
    done, changed = snapshots.guarded(spark, [folder], work(change))
    assert sorted((r["path"].rsplit("/", 2)[1:], r["change"]) for r in changed.collect()) == [(["r2", "facts.json"], "changed"), (["r3", "manifest.json"], "removed")]
    own = changed.select(F.element_at(F.split("path", "/"), -2).alias("run_id"))
    got = {r["run_id"]: (r["decision"], r["changed"]) for r in evaluation.barred(done, own).collect()}
    assert got == {"r1": ("ready", 0), "r2": ("blocked", 1), "r3": ("blocked", 1)}
    with pytest.raises(snapshots.Conflict, match="added"):
        snapshots.stable(spark, [folder, f"{folder}/none"], work(lambda: (runs / "r1" / "new.json").write_text("x")))
    assert snapshots.stable(spark, [folder], work(lambda: None)).count() == 3
    assert snapshots.frame(spark, [f"{folder}/none"]).count() == 0
    table = f"{folder}/table"
    numbers(spark, 3).write.parquet(table)
    with pytest.raises(snapshots.Conflict):
        snapshots.stable(spark, [table], lambda: numbers(spark, 1).write.mode("append").parquet(table) or numbers(spark, 1), content=False)
