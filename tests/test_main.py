import json

import pytest
from lodestone.__main__ import main


def lines(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines()]


def test_inventory_lint_identity(spark, tmp_path, capsys):
    (tmp_path / "a.sql").write_text("insert into s.t select x from s.u")
    (tmp_path / "index.md").write_text("# I\n\n[a](a.sql) [b](gone.md)\n")
    assert main(["inventory", str(tmp_path)]) == 0
    assert {(r["path"], r["construct"]) for r in lines(capsys)} == {("a.sql", "INSERT"), ("a.sql", "SELECT")}
    assert main(["lint", str(tmp_path)]) == 1 and [(r["code"], r["file"]) for r in lines(capsys)] == [("broken_link", "index.md")]
    assert main(["identity", "table", "s", "a b"]) == 0 and lines(capsys)[0]["key"] == "table+s+a%20b"
    assert main(["identity", "function", "s", "f", "--arguments", "a int"]) == 0 and lines(capsys)[0]["key"] == "function+s+f(integer)"


def test_index_and_query(spark, tmp_path, capsys):
    objects = "run_id string, page_id string, id string, kind string, schema string, name string, signature string, key string, scope string"
    operations = "run_id string, page_id string, id string, `order` int, kind string, reads array<string>, writes array<string>, calls array<string>, dynamic boolean"
    at = str(tmp_path)
    spark.createDataFrame([("r", "p", "o", "view", "s", "v", None, "view+s+v", None), ("r", None, "t", "table", "s", "t", None, "table+s+t", None)], objects).write.parquet(f"{at}/objects")
    spark.createDataFrame([("r", "p", "a", 1, "SELECT", ["t"], [], [], False)], operations).write.parquet(f"{at}/operations")
    assert main(["index", "--catalogue", at]) == 0 and main(["query", "--catalogue", at, "--affected", "table+s+t"]) == 0
    assert [(r["node"], r["depth"]) for r in lines(capsys)] == [("view+s+v", 1)]
    assert main(["query", "--catalogue", at, "--dependencies", "view+s+v"]) == 0 and lines(capsys)[0]["reads"] == ["table+s+t"]
    assert main(["query", "--catalogue", at, "--consumers", "nobody"]) == 2 and main(["query", "--catalogue", at]) == 2


def test_gate_and_publish(spark, tmp_path, capsys):
    at = str(tmp_path)
    spark.createDataFrame([("r", "a", False)], "run_id string, id string, blocking boolean").write.parquet(f"{at}/required")
    for status, code in (("ok", 0), ("defect", 1)):
        spark.createDataFrame([("r", "a", status, False)], "run_id string, plan_check_id string, status string, blocking boolean").write.parquet(f"{at}/{status}")
        assert main(["gate", "--required", f"{at}/required", "--checks", f"{at}/{status}"]) == code
    run = tmp_path / "run1"
    (run / "d").mkdir(parents=True)
    (run / "d/a.md").write_text("x")
    tree = tmp_path / "tree"
    assert main(["publish", str(tree), "--run", str(run), "--dry-run"]) == 0 and not (tree / "d/a.md").exists()
    assert main(["publish", str(tree), "--run", str(run)]) == 0 and (tree / "d/a.md").read_text() == "x" and main(["publish", str(tree), "--recover"]) == 0
    with pytest.raises(SystemExit):
        main(["nothing"])
