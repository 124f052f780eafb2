import pytest
from pyspark.sql import functions as F

from verdigris.llm import language as G
from verdigris.llm import language_spark as S

TEXTS = {
    "en": "The first line contains the number of cases. Each of the next lines holds two numbers. Print the sum of all numbers for each case.",
    "de": "Die erste Zeile enthält die Anzahl der Fälle. Jede der nächsten Zeilen enthält zwei Zahlen. Gib die Summe aller Zahlen aus.",
    "fr": "La première ligne contient le nombre de cas. Chacune des lignes suivantes contient deux nombres. Affichez la somme des nombres.",
    "es": "La primera línea contiene el número de casos. Cada una de las líneas siguientes tiene dos números. Imprime la suma de los números.",
    "pt": "A primeira linha contém o número de casos. Cada uma das linhas seguintes tem dois números. Imprima a soma dos números.",
    "it": "La prima riga contiene il numero di casi. Ognuna delle righe seguenti contiene due numeri. Stampa la somma dei numeri.",
    "pl": "Pierwszy wiersz zawiera liczbę przypadków. Każdy z następnych wierszy zawiera dwie liczby. Wypisz sumę wszystkich liczb.",
    "ru": "Первая строка содержит количество случаев. Каждая из следующих строк содержит два числа. Выведите сумму чисел.",
    "uk": "Перший рядок містить кількість випадків. Кожен із наступних рядків містить два числа. Виведіть суму чисел.",
    "zh": "第一行包含测试的数量。接下来的每一行包含两个整数。请输出所有整数的和。",
}


@pytest.fixture(scope="module")
def model():
    rows = [(t, code) for code, t in TEXTS.items() for _ in range(6)]
    rows += [(TEXTS["de"], "en"), (TEXTS["ru"], "pl"), (TEXTS["en"], None), (None, "en"), ("", "de")]  # labels may be wrong
    return G.train(rows)


@pytest.mark.parametrize("label,want", [("en", {"en"}), ("en-US", {"en"}), ("RU", {"ru"}), ("Russian", {"ru"}), ("en/pl", {"en", "pl"}), ("uk+en", {"uk", "en"}), ("zh_CN", {"zh"}), (None, set()), ("", set()), ("und", set()), ("??", set()), ("ger", {"de"})])
def test_labels(label, want):
    assert G.named_languages(label) == want


def test_unseen_sentences(model):
    held = {"en": "Find the number of lines that hold the largest sum.", "de": "Bestimme die Anzahl der Zeilen mit der größten Summe.", "ru": "Найдите количество строк с наибольшей суммой.", "uk": "Знайдіть кількість рядків із найбільшою сумою.", "zh": "请找出和最大的行的数量。", "fr": "Trouvez le nombre de lignes dont la somme est la plus grande.", "it": "Trova il numero di righe con la somma più grande.", "pl": "Znajdź liczbę wierszy o największej sumie."}
    for code, t in held.items():
        assert model.document(t)[0] == code, t


def test_case_accents_and_backoff(model):
    assert model.document(TEXTS["fr"].upper())[0] == "fr"
    assert model.document("Einzelzeilenanzahlen enthaltende Zahlenzeilenfälle")[0] == "de"  # no word of it was seen
    known, unknown = model.word("zahlen"), model.word("zahlenzeile")
    assert known.argmax() == unknown.argmax() == G.LANGUAGES.index("de")


def test_segments_of_a_mixed_text(model):
    text = TEXTS["en"] + "\n-----Input-----\n" + TEXTS["ru"] + "\n```\nfor i in range(3):\n    print(i)\n```\n3 4\n"
    got = model.segments(text)
    assert [s[2] for s in got] == ["en", "ru"] and all(0.5 < s[3] <= 1 for s in got)
    assert text[got[1][0] : got[1][1]].startswith("Первая") and "range" not in "".join(text[s:e] for s, e, _, _ in got)


def test_borrowed_word_and_heading_do_not_count(model):
    text = TEXTS["de"] + " Der Input enthält auch zwei Zahlen.\n-----Sample Input-----\n" + "Sample Output\n1 2"
    assert model.sentence_languages(text) == {"de"}


def test_tables(spark, model):
    rows = [("a", TEXTS["de"], "en"), ("a", TEXTS["de"], "en"), ("b", TEXTS["en"], "English"), ("c", TEXTS["en"] + "\n" + TEXTS["zh"], "en-GB"), ("d", None, "en"), ("e", "", None), ("f", "!!! 123", "en"), (None, TEXTS["fr"], None)]
    df = spark.createDataFrame(rows, "qid string, text string, language string").withColumn("k", F.lit(1)).withColumn("confidence", F.lit("x"))
    assert {tuple(r) for r in S.unnamed_languages(df, model).collect()} == {("a", "de"), ("c", "zh")}
    docs = {r.qid: (r.language, r.confidence) for r in S.text_languages(df, model).collect()}
    assert docs["a"][0] == "de" and docs["e"] == (None, 0.0) and docs["f"] == (None, 0.0) and "d" not in docs
    segments = [(r.segment, r.language) for r in S.segment_languages(df.where("qid = 'c'"), model).orderBy("segment").collect()]
    assert segments == [(1, "en"), (2, "zh")]
    empty = df.where("false")
    assert S.unnamed_languages(empty, S.fit_model(empty)).count() == 0


def test_very_long_text(model):
    assert model.document("die Zahl ist nicht eine Summe. " * 20_000)[0] == "de"
