import os

import pytest
from lodestone.operators import lint, markdown
from lodestone.sources import publication as P


def test_publish_conflict_rollback_and_repair(tmp_path):
    files = {"a.md": b"one", "d/b.json": P.document({"b": 1, "a": "é"}), "gone.md": None}
    (tmp_path / "gone.md").write_bytes(b"old")
    plan = P.prepare(tmp_path, files)
    assert "+one" in P.preview(tmp_path, files)
    assert P.publish(tmp_path, "r1", plan) == "committed" and P.publish(tmp_path, "r1", plan) == "unchanged"
    assert (tmp_path / "a.md").read_bytes() == b"one" and not (tmp_path / "gone.md").exists() and b"\\u00e9" in (tmp_path / "d/b.json").read_bytes()
    second = P.prepare(tmp_path, {"a.md": b"two", "c.md": b"new"})

    def fault(step):
        if step == "commit":
            raise OSError("no space")

    with pytest.raises(OSError):
        P.publish(tmp_path, "r2", second, fault=fault)
    assert (tmp_path / "a.md").read_bytes() == b"one" and not (tmp_path / "c.md").exists() and P.states(tmp_path) == {"committed": 1, "rolled_back": 1}
    with pytest.raises(P.Conflict):
        P.publish(tmp_path, "r2", second, ready=lambda: False)
    (tmp_path / "a.md").write_bytes(b"edited")
    with pytest.raises(P.Conflict):
        P.publish(tmp_path, "r2", second)

    class Crash(BaseException):
        pass

    def crash(step):
        if step == "c.md":
            raise Crash

    third = P.prepare(tmp_path, {"a.md": b"three", "c.md": b"new"})
    with pytest.raises(Crash):
        P.publish(tmp_path, "r3", third, fault=crash)
    assert (tmp_path / "a.md").read_bytes() == b"three"
    assert P.repair(tmp_path) == {"r3": "rolled_back"} and (tmp_path / "a.md").read_bytes() == b"edited"
    with pytest.raises(Crash):
        P.publish(tmp_path, "r3", P.prepare(tmp_path, {"a.md": b"three", "c.md": b"new"}), fault=crash)
    (tmp_path / "a.md").write_bytes(b"by hand")
    assert P.repair(tmp_path) == {"r3": "conflict"} and (tmp_path / "a.md").read_bytes() == b"by hand"


def test_lock_and_paths(tmp_path):
    with P.locked(tmp_path):
        with pytest.raises(P.Busy):
            with P.locked(tmp_path, 0.1):
                pass
    (tmp_path / ".lodestone/lock").write_text(f"{os.uname().nodename} 999999999 x")
    with P.locked(tmp_path, 0.1):
        pass
    (tmp_path / "link").symlink_to("/tmp")
    for bad in ("", "/etc/x", "../x", "a/../../x", "c:x", "a\\b", "link/x"):
        with pytest.raises(ValueError):
            P.inside(tmp_path, bad)


def test_merge():
    page = lambda head, body: f"{head}{P.BEGIN}{body}{P.END}tail"
    assert P.merged(None, None, page("", "x")) == page("", "x")
    assert P.merged(page("", "x"), page("mine", "x"), page("", "y")) == page("mine", "y")
    for base, current in ((page("", "x"), page("", "edited")), (None, page("", "x")), (page("", "x"), "no marks")):
        with pytest.raises(P.Conflict):
            P.merged(base, current, page("", "y"))


def test_lint(spark):
    texts = [
        ("index.md", "# Index\n\n[a](p/a.md) [top](#index) [no](#nothing) [out](../x.md) [ext](https://x.y/z) `[code](no.md)`\n"),
        ("p/a.md", "# A b\n\n[up](../index.md#index) [me](#a-b) [gone](c.md) ![img](none.png) [sql](../s/q.sql#L2-L3) [far](../s/q.sql#L3-L9) [sp](b%20c+d.md)\n\n```\n[x](y.md)\n```\n"),
        ("p/b c+d.md", "text"), ("empty.md", ""), ("null.md", None),
    ]
    blocks = markdown.parsed(spark.createDataFrame(texts, "doc string, text string"))
    files = spark.createDataFrame([(d, 1) for d, _ in texts] + [("s/q.sql", 3)], "path string, n_lines int")
    meta = spark.createDataFrame([("p/a.md", "k"), ("p/z.md", "k"), ("p/a.md", None)], "page_id string, key string")
    got = {(r["code"], r["file"], r["message"]) for r in lint.lint(blocks, files, meta).collect()}
    assert got == {
        ("broken_anchor", "index.md", "#nothing"), ("link_outside_root", "index.md", "../x.md"), ("broken_link", "p/a.md", "c.md"), ("bad_line_anchor", "p/a.md", "../s/q.sql#L3-L9"),
        ("unlisted_page", "p/b c+d.md", "not in the index"), ("unlisted_page", "empty.md", "not in the index"), ("unlisted_page", "null.md", "not in the index"),
        ("page_missing", "p/z.md", "metadata without a page"), ("repeated_key", "p/a.md", "k"), ("repeated_page", "p/a.md", "several metadata"),
    }
