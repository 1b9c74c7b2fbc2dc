import hashlib
import json
import os

import pytest
from lodestone.__main__ import main
from lodestone.sources import artifacts, journal

KIND = "stage string, run_id string, page_id string"


def test_append_once_and_torn_tails(spark, tmp_path):
    at = str(tmp_path / "journal")
    rows = spark.createDataFrame([("plan", "r", "p"), ("draft", "r", None)], KIND)
    twice = spark.createDataFrame([("plan", "r", "p", "e1", "t"), ("plan", "r", "p", "e2", "t")], f"{KIND}, event_id string, timestamp string")
    journal.recorded(rows, at)
    journal.recorded(rows, at)  # a writer that tried again
    journal.recorded(twice, at)
    assert journal.read(spark, at).count() == 4
    with pytest.raises(ValueError, match="no stage"):
        journal.recorded(spark.createDataFrame([("plan", "r", "p"), ("sleep", "r", "p")], KIND), at)
    assert journal.read(spark, at).count() == 4
    whole = json.dumps({"event_id": "e9", "stage": "lint", "outcome": "ok", "details": {"a": "b"}})
    (tmp_path / "journal" / "a.json").write_text(whole.replace("e9", "e8") + "\n" + whole + "\n" + '{"event_id": "e10", "sta')  # killed within a line
    (tmp_path / "journal" / "b.json").write_text(whole + "\n" + whole.replace("e9", "e11"))  # killed before the line feed
    (tmp_path / "journal" / "c.json").write_text("[1]\nnull\n\n" + '{"stage": "query"}\n{"stage": "query"}\n')
    ids = sorted(r["event_id"] or "" for r in journal.read(spark, at).collect())
    assert len(ids) == 4 + 3 + 2 and ids.count("") == 2 and {"e8", "e9", "e11"} < set(ids)
    assert {(os.path.basename(r["file"]), r["whole"]) for r in journal.torn(spark, at).collect()} == {("a.json", False), ("b.json", True)}
    before = sorted(map(str, journal.read(spark, at).collect()))
    assert journal.repaired(spark, at) == 2 and journal.repaired(spark, at) == 0
    assert sorted(map(str, journal.read(spark, at).collect())) == before and not (tmp_path / "journal" / "a.json").exists()
    journal.recorded(rows, at)
    assert journal.read(spark, at).count() == 9


def run_folder(tmp_path, n=30):
    files = {f"d{i % 4}/f {i}.bin": os.urandom(i * 1000) for i in range(n)} | {"manifest.json": b"{}", "Ünï.md": b"x"}
    for name, data in files.items():
        (tmp_path / "run" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "run" / name).write_bytes(data)
    return files


def test_verified_copy(spark, tmp_path, monkeypatch, capsys):
    files = run_folder(tmp_path)
    monkeypatch.setattr(artifacts, "TASK_BYTES", 50_000)
    source, to = str(tmp_path / "run"), tmp_path / "archive"
    ledger = spark.createDataFrame([(n, hashlib.sha256(d).hexdigest()) for n, d in files.items()], "name string, sha256 string")
    assert artifacts.saved(spark, source, str(to), ledger) == len(files)
    assert {str(p.relative_to(to)): p.read_bytes() for p in to.rglob("*") if p.is_file()} == files
    for bad, why in ((str(to), "stands already"), (f"{source}/inside", "lies in")):
        with pytest.raises(ValueError, match=why):
            artifacts.saved(spark, source, bad)
    other = tmp_path / "other"
    with pytest.raises(ValueError, match="differs: d0/f 4.bin"):
        artifacts.saved(spark, source, str(other), ledger.where("name <> 'd0/f 4.bin'"))
    assert not other.exists()
    assert artifacts.drifted(spark, ledger, source).count() == 0 and artifacts.ledger(spark, source).where("bytes = 0").count() == 1  # an empty file is there
    ledger.write.parquet(f"{tmp_path}/ledger")
    assert main(["bundle", source, f"{tmp_path}/ledger", "--save", str(other)]) == 0 and json.loads(capsys.readouterr().out)["files"] == len(files)


def test_a_broken_task_leaves_no_half_file(spark, tmp_path):
    files = run_folder(tmp_path, 6)
    blocked = tmp_path / "archive" / "d1"  # a file stands where the copy needs a folder
    blocked.parent.mkdir()
    blocked.write_text("in the way")
    with pytest.raises(Exception, match="d1"):
        artifacts.copied(spark, str(tmp_path / "run"), str(tmp_path / "archive")).count()
    left = {str(p.relative_to(tmp_path / "archive")): p.read_bytes() for p in (tmp_path / "archive").rglob("*") if p.is_file() and not p.name.startswith(".")}
    assert left.pop("d1") == b"in the way" and all(files[n] == d for n, d in left.items())


def test_decisions_of_all_runs(spark, tmp_path):
    for run, data in (("a", b'{"decision": "ready"}'), ("b", b"{"), ("c", None), ("d", b'{"decision": "revise", "decision": "ready"}'), ("e", b'{"decision": "revise"}')):
        (tmp_path / run).mkdir()
        if data:
            (tmp_path / run / "decision.json").write_bytes(data)
    assert {(r["run"], r["decision"]) for r in artifacts.decisions(spark, str(tmp_path), "decision string").collect()} == {("a", "ready"), ("e", "revise")}
