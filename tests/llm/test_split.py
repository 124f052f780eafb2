import random

from verdigris.llm.split import split_oversized


def pieces_of(spark, texts, limit, overlap):
    df = spark.createDataFrame(list(texts.items()), "rec string, text string").selectExpr("*", "'x' AS piece", "1 AS start")
    out = {}
    for r in split_oversized(df, limit, overlap).collect():
        out.setdefault(r.rec, []).append(r)
    return {k: sorted(v, key=lambda r: r.piece) for k, v in out.items()}


def test_pieces_keep_limit_overlap_and_text(spark):
    rng = random.Random(4)
    alphabet = ["a", "b ", "\n", "\r\n", ". ", "é", "é", "𝒳", "漢", "。", "\t", "word ", "\n\n", "x" * 30]
    texts = {f"t{i}": "".join(rng.choice(alphabet) for _ in range(rng.randint(50, 900))) for i in range(40)}
    texts |= {"run": "z" * 5000, "emoji": "😀" * 700, "null": None, "empty": "", "exact": "q" * 100, "over": "q" * 101, "mixed": "😀a" * 300}
    got = pieces_of(spark, texts, 100, 20)
    assert set(got) == {k for k, t in texts.items() if t and len(t) > 100}
    for k, rows in got.items():
        t = texts[k]
        assert "".join(r.text[r.overlap :] for r in rows) == t
        assert [r.piece for r in rows] == list(range(1, len(rows) + 1)) and rows[0].n_pieces == len(rows)
        for r in rows:
            assert 0 < len(r.text) <= 100 and 0 <= r.overlap <= 20 and t[r.start : r.start + len(r.text)] == r.text
        assert rows[0].overlap == 0 and all(r.overlap for r in rows[1:] if k == "run")


def test_strongest_seam_wins(spark):
    text = "def a():\n    return 1\n\n" + "def b():\n    x = 2\n    return x\n\n" + "def c():\n    return 3\n"
    rows = pieces_of(spark, {"t": text}, 60, 0)["t"]
    assert [r.text.split("(")[0] for r in rows] == ["def a", "def c"] or rows[0].text.endswith("\n\n")
    prose = "One sentence here. Another one follows it now. And the last is long enough to go over."
    assert pieces_of(spark, {"t": prose}, 60, 0)["t"][0].text.rstrip().endswith("now.")


def test_no_rows(spark):
    assert pieces_of(spark, {"a": None, "b": "short"}, 10, 2) == {}
