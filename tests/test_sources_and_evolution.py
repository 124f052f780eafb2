import json
import subprocess

import pytest

from verdigris.functions import evolve
from verdigris.runner import pool
from verdigris.sources.benchmark import numeric_suffix, subset
from verdigris.sources.chunks import chunk
from verdigris.sources.load import load_source, query_text

FILE = "import os\n\n@dec\ndef f(x):\n    return x\n\nclass C:\n    y = 1\n\ndef f(x):\n    return 2\n\nz = 3\n"


def rows(df):
    return {r.uid: r.text for r in df.collect()}


def test_chunks():
    got = dict(chunk("a.py", FILE))
    assert got == {"a.py::f": "def f(x):\n    return 2\n", "a.py::C": "class C:\n    y = 1\n", "a.py::<module>": "import os\n\n\n\n\nz = 3\n"} or got["a.py::C"] == "class C:\n    y = 1\n"
    assert got["a.py::f"].startswith("def f") and "z = 3" in got["a.py::<module>"] and "class" not in got["a.py::<module>"]
    assert dict(chunk("d.py", "@a\n@b\ndef g():\n    pass\n")) == {"d.py::g": "@a\n@b\ndef g():\n    pass\n"}
    assert chunk("b.py", "x = = 1") == [("b.py", "x = = 1")] and chunk("c.py", "") == []


def test_directory(spark, tmp_path):
    for name, data in {"a.py": b"x = 1\n", "sub dir/b.py": b"\xff = 2\r\n", "p%41+q.py": b"y", ".hidden/c.py": b"", "__pycache__/d.py": b"", "e.txt": b""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert rows(load_source(spark, str(tmp_path))) == {"a.py": "x = 1\n", "sub dir/b.py": "� = 2\n", "p%41+q.py": "y"}
    (tmp_path / "m.py").write_text(FILE)
    assert "m.py::C" in rows(load_source(spark, str(tmp_path), "function"))


def test_json(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"a": "1", "b": "2"}))
    (tmp_path / "l.json").write_text(json.dumps([{"id": "a", "text": "1"}, {"_id": "b", "code": "2"}, {"id": "a", "text": "3"}, {"id": "", "_id": "c", "text": "4"}, {"text": "5"}]))
    assert rows(load_source(spark, str(tmp_path / "o.json"))) == {"a": "1", "b": "2"}
    assert rows(load_source(spark, str(tmp_path / "l.json"))) == {"a": "3", "b": "2", "c": "4"}
    with pytest.raises(ValueError):
        load_source(spark, "what.csv")


def test_git(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b.txt").write_text("no")
    git("add", "-A")
    git("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("x = 2\n")
    git("commit", "-qam", "two")
    assert rows(load_source(spark, f"git:{tmp_path}@HEAD~1")) == {"a.py": "x = 1\n"}
    assert rows(load_source(spark, f"git:{tmp_path}@HEAD")) == {"a.py": "x = 2\n"}


def test_query_text(tmp_path):
    (tmp_path / "q").write_text("hello")
    assert query_text(f"@{tmp_path / 'q'}") == "hello" and query_text("plain") == "plain"


def test_refactor_keeps_behaviour():
    code = "import sys\ndef add(first, k=1):\n    total = first + k\n    return total\nn = int(input())\nprint(add(n, k=2))\nfor i in range(n):\n    print(i, end=' ')\n"
    new = evolve.refactor(code, 3)
    assert new != code and "k=2" in new and evolve.refactor(code, 3) == new
    assert pool.run(code, ["4\n"])[0]["stdout"] == pool.run(new, ["4\n"])[0]["stdout"] == "6\n0 1 2 3 "
    assert evolve.refactor("x = = 1") is None and evolve.refactor("print(1)") == "print(1)\n"


def test_mutate_changes_one_place():
    code = "a, b = map(int, input().split())\nprint(a + b if a < b else 7)\n"
    found = {evolve.mutate(code, s) for s in range(40)}
    assert {d for _, d in found} == {"operator Add -> Sub", "comparison Lt -> LtE", "constant 7 -> 8"} and all(c != code for c, _ in found)
    assert evolve.mutate("print()") is None and evolve.mutate("x = = 1") is None


def test_subset(spark):
    corpus = spark.createDataFrame([(f"d{i}", "t") for i in range(50)], "doc_id string, text string")
    queries = spark.createDataFrame([(f"q{i}", "t") for i in range(20)], "qid string, text string")
    qrels = spark.createDataFrame([(f"q{i}", f"d{i}", 1) for i in range(15)] + [("q0", "d0", 1)], "qid string, doc_id string, rel int")
    docs, picked, rel = subset(corpus, queries, qrels, 5, 12)
    assert docs.count() == 12 and picked.count() == 5 and rel.count() == 5
    assert rel.join(docs, "doc_id").count() == 5
    assert picked.select(numeric_suffix(picked.qid).alias("n")).where("n < 15").count() == 5
