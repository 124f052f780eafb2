import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris import cli
from verdigris.config import Settings, load_params
from verdigris.operators.encoding import HashingEncoder, encode
from verdigris.plans.engine import Engine
from verdigris.service import App, Problem

QUERY = "A word and a number n stand on one line. Print the word n times without blanks.\n\n-----Examples-----\nInput\nab 3\n\nOutput\nababab\n\nInput\nxyz 2\n\nOutput\nxyzxyz\n"
RIGHT = "word, n = input().split()\nprint(word * int(n))\n"
ALIKE = "word, n = input().split()\nprint(word, int(n))  # print the word n times, a number n on one line\n"
OTHER = "rows = sorted(open(0))\nprint(len(rows), rows[-1])\n"


def snippets(spark, rows):
    return spark.createDataFrame(rows, "uid string, text string")


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    home = f"file://{tmp_path_factory.mktemp('home')}"
    e = Engine(spark, Settings(home=home, top_verify=2, expand=2, case_timeout=1.0))
    assert e.stores() == []
    one = e.add_version("demo", "v1", snippets(spark, [("twice", RIGHT), ("rows", OTHER), ("none", None)]), parent=None)
    assert one["diff"] == {"added": 2, "removed": 0, "modified": 0, "unchanged": 0} and one["newly_embedded"] == 2
    two = e.add_version("demo", "v2", snippets(spark, [("twice", ALIKE), ("more", "print(1)\n"), ("rows", None)]), partial=True)
    assert two["diff"] == {"added": 1, "removed": 1, "modified": 1, "unchanged": 0} and two["newly_embedded"] == 2
    three = e.add_version("demo", "v3", snippets(spark, [("twice", RIGHT)]), partial=True)
    assert three["diff"] == {"added": 0, "removed": 0, "modified": 1, "unchanged": 1} and three["newly_embedded"] == 0
    return e


def test_verification_reranks(engine):
    dense = engine.search(QUERY, "demo", "all", k=3, verify=False)
    assert dense["hits"][0]["meta"]["uid"] == "twice" and dense["stats"]["verified"] == 0
    found = engine.search(QUERY, "demo", "all", k=3)
    top = found["hits"][0]
    assert top["verification"]["tier"] == "pass_all" and top["text"] == RIGHT and top["meta"]["versions"] == ["v1", "v3"]
    assert found["profile"]["kind"] == "task_with_examples" and found["stats"]["verified"] == 2 and found["stats"]["expanded"] == 0
    assert "1 candidates reproduce" in cli.notice(found) and "pass_all" in cli.printed(found, 1) and "2/2" in cli.printed(found, 1)
    before = engine.executions().count()
    engine.search(QUERY, "demo", "all", k=3)
    assert engine.executions().count() == before > 0  # nothing ran again


def test_expansion_goes_on_only_without_a_pass(engine):
    wrong = QUERY.replace("ababab", "ba").replace("xyzxyz", "zy")
    found = engine.search(wrong, "demo", "all", k=4)
    assert found["stats"]["expanded"] == 1 and found["stats"]["verified"] == 4 and found["stats"]["pass_all"] == 0


def test_question_is_ranked_by_similarity(engine):
    found = engine.search("sorted rows of the file, print len", "demo", "v1", k=2)
    assert found["hits"][0]["id"] == "rows" and found["stats"]["verified"] == 0 and found["hits"][0]["verification"] is None


def test_store_history(engine, spark):
    store = engine.store("demo")
    assert store.versions() == ["v1", "v2", "v3"] and store.resolve("HEAD") == "v3" and store.latest() == "v3"
    rows = [(r.version, r.changed, r.reverted_to, r.text) for r in store.lineage("twice", texts=True).collect()]
    assert rows == [("v1", True, None, RIGHT), ("v2", True, None, ALIKE), ("v3", True, 1, RIGHT)]
    assert [r.changed for r in store.lineage("rows").collect()] == [True, True, False]
    places = store.occurrences().collect()
    assert len({r.sha for r in places}) == 4 and sorted(r.n for r in places) == [1, 1, 2, 2, 2, 2] and all(r.n == sum(q.sha == r.sha for q in places) for r in places)
    for bad in ("all", "latest", "-x", "x" * 65):
        with pytest.raises(ValueError):
            store.add_version(bad, snippets(spark, [("a", "b")]))
    with pytest.raises(ValueError):
        store.add_version("v1", snippets(spark, [("a", "b")]))
    for unknown in ("v9", "all"):
        with pytest.raises(KeyError):
            store.resolve(unknown)
    with pytest.raises(KeyError):
        engine.store("nothing").resolve(None)
    assert engine.stores() == ["demo"]


def test_replace_keeps_the_place(engine, spark):
    store = engine.store("again")
    store.add_version("a", snippets(spark, [("x", "1")]))
    store.add_version("b", snippets(spark, [("x", "1"), ("y", "2")]))
    counts = store.add_version("b", snippets(spark, [("x", "3")]), replace=True)
    assert counts == {"added": 0, "removed": 0, "modified": 1, "unchanged": 0} and store.versions() == ["a", "b"]
    assert [r.uid for r in store.entries("b").collect()] == ["x"]


def test_empty_view_and_null_query(engine, spark):
    engine.store("empty").add_version("a", snippets(spark, []))
    found = engine.search_many(spark.createDataFrame([("q", None), ("r", QUERY)], "qid string, text string"), "empty")
    assert found.hits.count() == 0 and found.profiles.count() == 2 and found.stats().first().verified == 0


def test_encoder_counts_and_roles(spark):
    rows = spark.createDataFrame([("a", "x y"), ("b", "x y"), ("c", None), ("d", "")], "id string, text string")
    got = {r.id: r.embedding for r in encode(rows, HashingEncoder(8)).collect()}
    assert got["a"] == got["b"] and got["c"] is None and sum(got["d"]) == 0 and abs(sum(x * x for x in got["a"]) - 1) < 1e-6
    with pytest.raises(ValueError):
        encode(rows, HashingEncoder(8), "other")


def test_service(engine):
    app = App(engine, [{"id": "q1", "text": QUERY, "gold": "twice", "title": "t", "evolving": True}])
    info = app.handle("GET", "/api/info")
    assert [v["name"] for v in info["stores"]["demo"]] == ["v1", "v2", "v3"] and info["stores"]["demo"][1]["snippets"] == 2
    assert app.handle("GET", "/api/samples")[0]["gold"] == "twice" and app.handle("GET", "/api/sample/q1")["text"] == QUERY
    out = app.handle("POST", "/api/search", json.dumps({"query": QUERY, "store": "demo", "k": 500}).encode())
    assert out["gold"] == "twice" and out["gold_sha"] == out["hits"][0]["sha"] and len(out["hits"]) <= 50
    assert [h["changed"] for h in app.handle("GET", "/api/lineage?store=demo&uid=twice")] == [True, True, True]
    for method, path, body, status in (("GET", "/api/sample/zz", b"", 404), ("POST", "/api/search", b"{}", 422), ("POST", "/api/search", json.dumps({"query": "x", "store": "demo", "version": "v9"}).encode(), 400), ("GET", "/x", b"", 404)):
        with pytest.raises(Problem) as e:
            app.handle(method, path, body)
        assert e.value.status == status
    assert "<form" in app.handle("GET", "/")


def test_command_line(engine, spark, tmp_path, capsys):
    (tmp_path / "q.txt").write_text(QUERY)
    (tmp_path / "s.jsonl").write_text('{"id": "sum", "text": "print(2)"}\n\n{"_id": "z", "code": "print(3)"}\nbroken\n{"id": "z", "text": "print(4)"}\n')
    home = ["--home", engine.home]
    out = cli.main([*home, "search", f"@{tmp_path / 'q.txt'}", "--store", "demo", "--version", "v1", "--json"], spark)
    assert json.loads(out)["hits"][0]["id"] == "twice"
    info = json.loads(cli.main([*home, "add-version", "line", "v1", str(tmp_path / "s.jsonl")], spark))
    assert info["diff"]["added"] == 2
    assert "v2" in cli.main([*home, "versions", "demo"], spark)
    assert json.loads(cli.main([*home, "diff", "demo", "v1", "v2"], spark)) == {"added": 1, "removed": 1, "modified": 1, "unchanged": 0}
    capsys.readouterr()


def test_diagnostics_and_files(engine, spark, tmp_path):
    queries = spark.createDataFrame([("q", QUERY), ("plain", "rows of a file")], "qid string, text string")
    engine.search(QUERY, "demo", "all", k=3)
    found = engine.search_many(queries, "demo", "all", k=3)
    assert set(found.timings_s) == {"profile", "embed_query", "embed_items", "dense", "verify", "fuse", "total"} and found.dense_top.count() >= found.hits.count()
    assert found.counters() == {"verified": 2, "executed": 0, "cache_hits": 2} and {r.kind: r.n_queries for r in found.kinds().collect()}["task_with_examples"] == 1
    scores = found.by_query()
    assert set(scores) == {"q", "plain"} and max(scores["q"], key=scores["q"].get) == found.hits.where("qid = 'q' AND rank = 1").first().id
    found.write_rankings(f"file://{tmp_path}/ranks")
    rows = spark.read.option("header", True).csv(f"file://{tmp_path}/ranks").collect()
    assert len(rows) == found.hits.count() and set(rows[0].asDict()) == {"query_id", "rank", "doc_id", "score", "verification"}
    one = engine.search(QUERY, "demo", "all", k=1)
    assert one["stats"]["query_embedding_cached"] and one["stats"]["executed"] == 0 and one["timings_ms"]["total"] >= one["timings_ms"]["dense"]
    assert engine.search("never asked before", "demo", "v1", k=1)["stats"]["query_embedding_cached"] is False
    with engine as e:
        e.warm_up()


def test_samples_file(spark, tmp_path):
    from verdigris.service import load_samples

    spark.createDataFrame([("q1", QUERY), ("q2", "x" * 200 + "\nmore"), ("q3", None), ("q4", "nobody judged it")], "qid string, text string").write.parquet(f"file://{tmp_path}/q")
    spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q2", "c", 1), ("q4", "d", 0)], "qid string, doc_id string, rel int").write.parquet(f"file://{tmp_path}/r")
    cli.main(["export-samples", f"{tmp_path}/q", f"{tmp_path}/r", f"{tmp_path}/s.json"], spark)
    got = {s["id"]: s for s in load_samples(f"{tmp_path}/s.json")}
    assert set(got) == {"q1", "q2"} and got["q1"]["gold"] == "b" and got["q1"]["evolving"] and not got["q2"]["evolving"] and len(got["q2"]["title"]) == 90


def test_encoder_from_a_folder(spark, tmp_path):
    import hashlib

    import numpy as np
    from tokenizers import Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import Whitespace

    from verdigris.operators.encoders import FolderEncoder

    t = Tokenizer(WordLevel({"[UNK]": 0, "a": 1, "b": 2}, unk_token="[UNK]"))
    t.pre_tokenizer = Whitespace()
    t.save(f"{tmp_path}/tokenizer.json")
    np.save(tmp_path / "vectors.npy", np.array([[0, 0, 0], [3, 0, 0], [0, 4, 0]], np.float32))
    revision = hashlib.sha256((tmp_path / "vectors.npy").read_bytes()).hexdigest()[:10]
    encoder = FolderEncoder(str(tmp_path), revision, max_length=2)
    rows = spark.createDataFrame([("x", "a b a a"), ("y", "a"), ("z", ""), ("n", None), ("u", "what")], "id string, text string")
    got = {r.id: r.embedding for r in encode(rows, encoder).collect()}
    assert got["n"] is None and got["y"] == [1, 0, 0] and got["z"] == got["u"] == [0, 0, 0]
    assert np.allclose(got["x"], [0.6, 0.8, 0])  # two tokens are read
    with pytest.raises(ValueError):
        FolderEncoder(str(tmp_path), "0000").encode(["a"])


def test_studies(engine, spark, tmp_path):
    from verdigris.operators.encoding import HashingEncoder
    from verdigris.plans import studies

    texts = [("p1", RIGHT), ("p2", ALIKE), ("p3", OTHER), ("p4", "not python ("), ("p5", None)]
    docs = spark.createDataFrame(texts, "uid string, text string")
    queries, qrels = spark.createDataFrame([("q1", QUERY)], "qid string, text string"), spark.createDataFrame([("q1", "p1", 1)], "qid string, doc_id string, rel int")
    how = Settings(top_verify=2, expand=2, case_timeout=1.0)
    lines = {(r.uid, r.version): r for r in studies.evolved_versions(docs).collect()}
    assert ("p4", "v1") not in lines and lines["p1", "v1"].text == RIGHT and lines["p1", "v2"].role == "regression" and len({lines["p1", v].text for v in ("v1", "v2", "v3")}) == 3
    modes = {r["mode"]: r for r in studies.evolution_study(queries, docs, qrels, HashingEncoder(), how).collect()}
    assert modes["expanded"].correct_at_1 == 1.0 and modes["expanded"].regression_above == 0.0 and modes["dense"].n_queries == 1
    table, results = studies.ablation(queries, docs.where("text IS NOT NULL").selectExpr("uid AS id", "sha1(text) AS sha", "text"), qrels, HashingEncoder(), how)
    by = {r["mode"]: r for r in table.collect()}
    assert by["dense"].executed == 0 and by["verified"].executed == 2 and by["expanded"].mrr == 1.0 and studies.gold_movement(results, qrels).first().first_after == 1
    rates = {r.gold: r for r in studies.feasibility_study(queries, docs.withColumnRenamed("uid", "id"), qrels, how).collect()}
    assert rates[True].pass_all == 1 and rates[True].mean_examples == 2.0
    store = engine.store("shown")
    studies.demo_store(store, docs, spark.createDataFrame([("p1",)], "uid string"), deleted=1)
    assert store.versions() == ["v1", "v2", "v3"] and [r.reverted_to for r in store.lineage("p1").collect()] == [None, None, 1]
    assert {r["diff"].modified for r in store.history().collect()} == {0, 1} and store.history().collect()[1]["diff"].removed == 1


def test_parameters(tmp_path):
    (tmp_path / "p.json").write_text('{"temperature": 0.5, "other": 1}')
    assert load_params(str(tmp_path / "p.json"))["temperature"] == 0.5 and load_params(str(tmp_path / "p.json"))["llr"]["pass_all"] == 7.0


def test_change_stream(engine, spark, tmp_path):
    from verdigris.streaming.changes import follow_changes, outcome_counts

    feed = tmp_path / "feed"
    store = engine.store("streamed")
    schema = "uid string, text string, at bigint"
    for rows in ([("a", "1", 1), ("a", "2", 2), ("b", "3", 1)], [("b", None, 3), ("c", "4", 3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(feed))
        follow_changes(spark.readStream.schema(schema).parquet(str(feed)), store, str(tmp_path / "at")).awaitTermination(60)
    assert store.versions() == ["batch-000000000", "batch-000000001"]
    assert {r.uid for r in store.entries().collect()} == {"a", "c"}
    events = spark.createDataFrame([("2024-01-01 00:10:00", "x", 1.0), ("2024-01-01 00:20:00", "x", 3.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    row = outcome_counts(events).first()
    assert row.n == 2 and row.mean_value == 2.0


def test_programs_that_ask_for_nothing_run_once_for_all_inputs(spark, tmp_path):
    from verdigris.operators.execution import execute

    def job(code, *inputs):
        return (code, list(inputs))

    blind = "print('blind', 41)\nraise SystemExit"
    jobs = spark.createDataFrame([*[job(blind, f"{i}\n", "x\n") for i in range(40)], *[job("n = int(input())\nprint(n + 41)", f"{i}\n") for i in range(40)], job(blind), job("print(input())", "a\n"), (None, ["a"]), (blind, None)], "code string, inputs array<string>")
    done = execute(jobs.union(jobs), 5.0)
    got = {tuple(c.stdout for c in r.cases): r["any"] for r in done.collect()}
    assert done.count() == 82 and got == {("blind 41\n",) * 2: True, (): True, ("a\n",): False} | {(f"{i + 41}\n",): False for i in range(40)}
    # what is known of a program holds for its new inputs, whether or not the table says for which
    known = done.where("any").limit(1)
    again = execute(spark.createDataFrame([job(blind, "new\n")], jobs.schema), 5.0, known=known).first()
    assert again["any"] and again.cases[0] == known.first().cases[0]
    assert execute(jobs, 5.0, known=done.drop("any")).count() == 0


def test_groups_meet_once_and_leave_ties_to_the_smaller_id(spark, monkeypatch):
    from verdigris.operators import topk

    monkeypatch.setattr(topk, "GROUP_QUERIES", 7)
    monkeypatch.setattr(topk, "GROUP_ITEMS", 150)
    rng = np.random.default_rng(3)
    y, x = rng.integers(-2, 3, (500, 6)).astype(np.float32), rng.integers(-2, 3, (20, 6)).astype(np.float32)
    rows = lambda m, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(-1, None)], f"{name} int, embedding array<float>")
    found = topk.dense_topk_blocks(rows(x, "qid"), rows(y, "id"), 9, block=4)
    best = np.argsort(-(x.astype(float) @ y.T), axis=1, kind="stable")[:, :9]
    assert {(r.qid, r.dense_rank): r.id for r in found.collect()} == {(i, j + 1): best[i, j] for i in range(20) for j in range(9)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert topk.dense_topk_blocks(rows(x[:0], "qid"), rows(y, "id"), 9).count() == topk.dense_topk_blocks(rows(x, "qid"), rows(y[:0], "id"), 9).count() == 0


def test_studies_compare_each_query_and_document_once(spark, monkeypatch):
    from verdigris.plans import search as S
    from verdigris.plans import studies

    queries = spark.createDataFrame([("q1", "Add two numbers.\n\nInput\n1 2\nOutput\n3"), ("q2", "Reverse a text.")], "qid string, text string")
    docs = spark.createDataFrame([(f"d{i}", f"a, b = map(int, input().split())\nprint(a + b + {i})\n") for i in range(60)], "uid string, text string")
    qrels = spark.createDataFrame([("q1", "d0", 1), ("q2", "d7", 1)], "qid string, doc_id string, rel int")
    met = []
    monkeypatch.setattr(S, "dense_topk_blocks", lambda *a, f=S.dense_topk_blocks: met.append(a[2]) or f(*a))
    how = Settings(depth=55, top_verify=2, expand=3)
    view = S.corpus_view(docs.withColumnRenamed("uid", "id"))
    _, results = studies.ablation(queries, view, qrels, HashingEncoder(), how)
    assert met == [55] and results["dense"].hits.count() == 100 and results["dense"].hits.agg({"rank": "max"}).first()[0] == 50
    alone = S.search(queries, view, HashingEncoder(), how, k=50)
    pick = lambda r: {(x.qid, x.id, x.rank, x.tier) for x in r.hits.collect()}
    assert pick(results["expanded"]) == pick(alone)
    assert studies.evolution_study(queries, docs, qrels, HashingEncoder(), how).count() == 2 and len(met) == 3
