import itertools
import re
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from verdigris.llm import personal as P
from verdigris.llm import personal_grammar as G
from verdigris.llm import personal_spark as S

GIVEN, FAMILY = ["Ada", "Boris", "Clara", "Dmitri"], ["Stonefield", "Kowalle", "O'Brannan"]


@pytest.fixture(scope="module")
def model():
    texts = [f"Thanks to {g} {f} for the proof. Help {g} to count." for g in GIVEN for f in [*FAMILY, "Wexler", "Quillon"]] + ["the blue kettle and the old mill road"] * 5
    return P.train(texts, GIVEN, FAMILY)


def found(model, text):
    return {(k, text[s:e]) for s, e, k in model.find(text)}


@pytest.mark.parametrize(
    "text,want",
    [
        ("Write to ada.stonefield@mail.example.org if it is down.", {("email", "ada.stonefield@mail.example.org")}),
        ("CC: boris-12 [at] mail [dot] example", {("email", "boris-12 [at] mail [dot] example")}),
        ("You can reach me at +44 1632 960 257 after six.", {("phone", "+44 1632 960 257")}),
        ("cell 1 (312) 555 0176 ext. 19, ask for the night desk", {("phone", "1 (312) 555 0176 ext. 19")}),
        ("My tax id is QQ 11 86 08 C, do I need it for the invoice?", {("identity", "QQ 11 86 08 C")}),
        ("For the prize form: SSN 666-11-2474.", {("identity", "666-11-2474")}),
        ("Please ship the shirt to 104 Fenaholm Street, Apt 4B, second door.", {("address", "104 Fenaholm Street, Apt 4B")}),
        ("The finals are held at 329 Ferrycross Rd #50.", {("address", "329 Ferrycross Rd #50")}),
        ("Das Paket geht an Lumenfortweg 48.", {("address", "Lumenfortweg 48")}),
        ("Живу по адресу ул. Тихоречная, д. 89, кв. 88.", {("address", "ул. Тихоречная, д. 89, кв. 88")}),
        ("Thanks to Clara Wexler for the proof.", {("name", "Clara Wexler")}),
        ("Reported by KOWALLE, BORIS during the mirror.", {("name", "KOWALLE, BORIS")}),
        ("# author: A. Stonefield <x1@mail.example>", {("name", "A. Stonefield"), ("email", "x1@mail.example")}),
        ("Help Ada to decide. Boris keeps 12 ropes in a row.", set()),
        ("Team Blue Kettle finished with 12 points. The Old Mill Road puzzle has 36 inputs.", set()),
        ("Mod is 1000000007 and the base is 9973327. Version 2.100000.1 uses 192.0.2.300.", set()),
        ("`a = sign @ light_tick.T` and @lru_cache(maxsize=None)", set()),
        ("61 92 60 67 31", set()),
        ("", set()),
    ],
)
def test_finds(model, text, want):
    assert found(model, text) == want


def test_accuracy_on_other_texts_of_the_grammar(model):
    data = G.training_texts(model.lexicon, 400, seed=77)
    hit = wrong = missed = 0
    for text, gold in data:
        got, gold = set(model.find(text)), set(gold)
        hit, wrong, missed = hit + len(got & gold), wrong + len(got - gold), missed + len(gold - got)
    assert hit / (hit + wrong) > 0.93 and hit / (hit + missed) > 0.9


# Written by hand, not by the grammar: formats and sentences of everyday use.  The first list was looked at while the
# grammar was written, the second one was not.
SEEN = [
    ('You may phone our caretaker on +91 98765 43210 today', [('phone', '+91 98765 43210')]),
    ('Mobile 0412 345 678, leave a message', [('phone', '0412 345 678')]),
    ('CPF 123.456.789-09 is on the receipt', [('identity', '123.456.789-09')]),
    ('Mieszkam przy ul. Długa 15/3 od maja', [('address', 'ul. Długa 15/3')]),
    ('Entregue na Rua das Flores 120 amanhã', [('address', 'Rua das Flores 120')]),
    ('my colleague Priya Raghunathan fixed it', [('name', 'Priya Raghunathan')]),
    ('Dr. Helena Marquardt wird das prüfen', [('name', 'Helena Marquardt')]),
    ('my new mobile is 07700 900123', [('phone', '07700 900123')]),
    ('Call +1 415-555-2671 before noon', [('phone', '+1 415-555-2671')]),
    ('Meine Handynummer: 0151 23456789', [('phone', '0151 23456789')]),
    ('Mon portable : 06 12 34 56 78', [('phone', '06 12 34 56 78')]),
    ('tel. 22 635 12 47 lub mejl', [('phone', '22 635 12 47')]),
    ('Chiamami al 347 123 4567 stasera', [('phone', '347 123 4567')]),
    ('Звоните +7 921 555-12-34 после обеда', [('phone', '+7 921 555-12-34')]),
    ('Мій телефон +380 67 123 45 67', [('phone', '+380 67 123 45 67')]),
    ('fax (020) 7946 0018', [('phone', '(020) 7946 0018')]),
    ('PESEL 85010112345 podaj w formularzu', [('identity', '85010112345')]),
    ('codice fiscale RSSMRA85T10A562S, grazie', [('identity', 'RSSMRA85T10A562S')]),
    ('Her SSN is 078-05-1120.', [('identity', '078-05-1120')]),
    ('NI number AB 12 34 56 C on the form', [('identity', 'AB 12 34 56 C')]),
    ('Mi DNI es 12345678Z.', [('identity', '12345678Z')]),
    ('СНИЛС 112-233-445 95 указан в анкете', [('identity', '112-233-445 95')]),
    ('Reisepass C01X00T47 läuft ab', [('identity', 'C01X00T47')]),
    ('passport no. 533380006 expires soon', [('identity', '533380006')]),
    ('Steuer-ID: 65 929 970 489', [('identity', '65 929 970 489')]),
    ('Adhaar aside, my Aadhaar is 2345 6789 0123', [('identity', '2345 6789 0123')]),
    ('Ship it to 221B Baker Street, please', [('address', '221B Baker Street')]),
    ('We meet at 1600 Pennsylvania Avenue on Monday', [('address', '1600 Pennsylvania Avenue')]),
    ('Das Büro liegt in der Lindenstraße 14', [('address', 'Lindenstraße 14')]),
    ('Livrez au 12 bis, rue des Lilas demain', [('address', '12 bis, rue des Lilas')]),
    ('Vivo en Calle Mayor, 5, 3º B desde enero', [('address', 'Calle Mayor, 5, 3º B')]),
    ('Abito in Via Garibaldi 22 con mia sorella', [('address', 'Via Garibaldi 22')]),
    ('Адрес: ул. Садовая, д. 7, кв. 12', [('address', 'ул. Садовая, д. 7, кв. 12')]),
    ('Apt 9, 45 Elm Drive has a red door', [('address', 'Apt 9, 45 Elm Drive')]),
    ('Send drafts to maria.lopez+work@uni-salamanca.es today', [('email', 'maria.lopez+work@uni-salamanca.es')]),
    ('jan_kowalski [at] poczta [dot] pl answers quickly', [('email', 'jan_kowalski [at] poczta [dot] pl')]),
    ('contact: k.ono(at)lab.example.jp', [('email', 'k.ono(at)lab.example.jp')]),
    ('QUESTIONS@HELPDESK.ORG is read daily', [('email', 'QUESTIONS@HELPDESK.ORG')]),
    ('Many thanks to Giulia Ferrante for the slides', [('name', 'Giulia Ferrante')]),
    ('Kind regards,\nTomasz Wilczek', [('name', 'Tomasz Wilczek')]),
    ('Спасибо, Ольга Крылова нашла ошибку', [('name', 'Ольга Крылова')]),
    ('The talk was by J. Abernathy on Friday', [('name', 'J. Abernathy')]),
    ('Professor Anneke van Dijk disagrees', [('name', 'Anneke van Dijk')]),
    ('# author: Lucas Moreau <lucas@moreau.example>', [('name', 'Lucas Moreau'), ('email', 'lucas@moreau.example')]),
    ('The room holds 120 people on 3 floors', []),
    ('Take the result modulo 1000000007 in C++17', []),
    ('Flight 2207 leaves at 18:45 on 2025-03-14', []),
    ('New York City has 5 boroughs', []),
    ('See RFC 2822, section 3.4.1, page 15', []),
    ('values: 12 45 78 101 343 99 2 8', []),
    ('Matrix A @ B.T has 64 columns', []),
    ('The Golden Gate Bridge opened in 1937', []),
]
UNSEEN = [
    ("Could you phone me on 020 8366 1177 tomorrow?", [("phone", "020 8366 1177")]),
    ("Our hotline +49 30 901820 is staffed", [("phone", "+49 30 901820")]),
    ("WhatsApp +55 11 98765-4321 works best", [("phone", "+55 11 98765-4321")]),
    ("Ligue para (21) 98888-7777", [("phone", "(21) 98888-7777")]),
    ("Teléfono 91 123 45 67, pregunte por Marta", [("phone", "91 123 45 67")]),
    ("Contact number: 416-555-0199 ext. 12", [("phone", "416-555-0199 ext. 12")]),
    ("ИНН 7707083893 проверен", [("identity", "7707083893")]),
    ("паспорт 45 08 123456 выдан давно", [("identity", "45 08 123456")]),
    ("Numer PESEL to 92071314764", [("identity", "92071314764")]),
    ("My national insurance number is QQ123456C", [("identity", "QQ123456C")]),
    ("NIE: X1234567L", [("identity", "X1234567L")]),
    ("We live at 14 Cherry Tree Lane now", [("address", "14 Cherry Tree Lane")]),
    ("Come to 77 Massachusetts Ave, Apt 3C for dinner", [("address", "77 Massachusetts Ave, Apt 3C")]),
    ("Treffpunkt: Am Kupfergraben 6", [("address", "Am Kupfergraben 6")]),
    ("Le bureau est au 5 avenue de Verdun", [("address", "5 avenue de Verdun")]),
    ("Vía libre, pero vivo en Avda. de América 33", [("address", "Avda. de América 33")]),
    ("Доставка: проспект Мира, 101", [("address", "проспект Мира, 101")]),
    ("Please copy s.nakamura@cs.univ.example on this", [("email", "s.nakamura@cs.univ.example")]),
    ("ask billing [at] shop [dot] example for it", [("email", "billing [at] shop [dot] example")]),
    ("Thanks to Beatriz Carvalho we found it", [("name", "Beatriz Carvalho")]),
    ("our coach Dmitry Sokolov agrees", [("name", "Dmitry Sokolov")]),
    ("Frau Annegret Lohmann schickt das", [("name", "Annegret Lohmann")]),
    ("Version 3.11.4 needs 512 MB and 2 cores", []),
    ("The sum over 12 34 56 78 90 12 is 282", []),
    ("Old Town Square has 3 exits", []),
    ("Ada runs 5 tests", []),
]


@pytest.mark.parametrize("cases", [SEEN, UNSEEN])
def test_handwritten_cases(model, cases):
    wanted = {(i, *w) for i, (_, want) in enumerate(cases) for w in want}
    got = {(i, *f) for i, (text, _) in enumerate(cases) for f in found(model, text)}
    assert len(got & wanted) >= 0.9 * len(wanted) and len(got & wanted) >= 0.9 * len(got), (wanted - got, got - wanted)


TABLES = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
def test_no_sentence_of_the_grammar_stands_in_a_table():
    texts = set()
    for table in ("documents", "queries", "corpus", "hits"):
        texts.update(t for t in pq.read_table(TABLES / f"{table}.parquet", columns=["text"])["text"].to_pylist() if t)
    everything = "\0".join(texts).lower()
    lists = [x for by in G.OPENINGS.values() for lines in by.values() for x in lines] + [x for lines in G.CLOSES.values() for x in lines] + G.LAYOUTS + G._WITH_ONE + G._OTHER_NUMBERS + G._LOOKALIKES
    pieces = {p.strip().lower() for line in lists for p in re.split(r"\{\w+\}|#", line)}
    assert not [p for p in pieces if len(p) >= 15 and p in everything and p != "pièce d'identité"]
    lexicon = P.Lexicon(GIVEN, FAMILY)
    lines = {line for text, _ in G.training_texts(lexicon, 2000) for line in text.split("\n")}
    own = {line for t in texts for line in t.split("\n")}
    assert not [x for x in lines & own if len(x) >= 15 and re.search(r"[^\W\d_]{3}", x)]


def test_sums_over_all_cuts():
    """The partition function, span and transition shares against listing every set of spans that do not overlap."""
    rng = np.random.default_rng(3)
    text = [(0, 2, "name", ["a"], True), (1, 4, "phone", ["b", "c"], False), (2, 5, "email", ["c"], True), (5, 6, "name", ["a", "d"], False), (4, 8, "address", ["d"], False)]
    text.sort(key=lambda c: (c[1], c[0]))
    index = {f: i for i, f in enumerate("abcd")}
    weights, steps = rng.normal(size=4), rng.normal(size=(6, 5))

    def total(chosen):
        last, out = 5, 0.0
        for i in chosen:
            k = P._NUMBER_OF[text[i][2]]
            out += sum(weights[index[f]] for f in text[i][3]) + steps[last, k]
            last = k
        return out

    apart = lambda chosen: all(text[a][1] <= text[b][0] for a, b in zip(chosen, chosen[1:]))
    cuts = [c for n in range(6) for c in itertools.combinations(range(5), n) if apart(c)]
    parts = np.exp([total(c) for c in cuts])
    gold = tuple(i for i, c in enumerate(text) if c[4])
    loss, by_weight, by_step = P._Lattice([text, text[:1]], index).gradient(weights, steps)
    alone, _, _ = P._Lattice([text[:1]], index).gradient(weights, steps)
    assert np.isclose(loss - alone, np.log(parts.sum()) - total(gold))
    for x, g in ((weights, by_weight), (steps, by_step)):
        for at in list(np.ndindex(x.shape))[:12]:
            x[at] += 1e-5
            up = P._Lattice([text, text[:1]], index).gradient(weights, steps)[0]
            x[at] -= 2e-5
            down = P._Lattice([text, text[:1]], index).gradient(weights, steps)[0]
            x[at] += 1e-5
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5
    scored = [(s, e, kind, sum(weights[index[f]] for f in names)) for s, e, kind, names, _ in text]
    best = cuts[int(np.argmax(parts))]
    assert P.best_cut(scored, steps.tolist()) == [text[i][:3] for i in best]


def test_pruning_changes_nothing(model):
    """Spans that are dropped early are never part of the best cut."""
    for text, _ in G.training_texts(model.lexicon, 150, seed=5):
        scored = [(s, e, k, model.key_score(k, key) + sum(model.weights.get(f"{k}~{f}", 0.0) for f in context)) for s, e, k, key, context in P.spans(text, model.lexicon)]
        assert P.best_cut(scored, model.steps) == model.find(text)


def test_lexicon_learns_from_company(model):
    assert model.lexicon.mark("Wexler") == "f" and model.lexicon.mark("kettle") == "c" and model.lexicon.mark("Zzyzx") == "u"


def test_best_set_does_not_overlap():
    none = [[0.0] * 5] * 6
    scored = [(0, 5, "phone", 1.0), (3, 9, "identity", 1.5), (9, 12, "name", 1.0), (0, 12, "email", 2.2)]
    assert P.best_cut(scored, none) == [(3, 9, "identity"), (9, 12, "name")]
    assert P.best_cut([(0, 5, "phone", -1.0)], none) == []


def test_replaced_text_keeps_the_rest(spark, model):
    rows = [(1, "Call 01632 960 257\r\nor\tada@mail.example.org, ok? é"), (2, None), (3, ""), (4, "nothing here"), (5, "word " * 100_000 + "SSN 666-11-2474"), (None, "Thanks to Ada Kowalle for the proof. Thanks to Ada Kowalle for the proof.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("k", F.lit("x")).withColumn("kind", F.lit(1))
    new = {r.doc_id: r.text for r in S.replace_personal(df, model).collect()}
    assert new[1] == "Call [PHONE]\r\nor\t[EMAIL], ok? é" and new[2] is None and new[3] == "" and new[4] == "nothing here" and new[5].endswith("SSN [IDENTITY]")
    got = [tuple(r) for r in S.find_personal(df, model).collect()]
    assert len(got) == len(set(got)) and (None, "name", "Ada Kowalle") in got and (5, "identity", "666-11-2474") in got and len(got) == 4


def test_fitting_on_tables(spark):
    docs = spark.createDataFrame([("Thanks to Ada Kowalle for the proof.",), (None,), ("",)], "text string")
    parts = spark.createDataFrame([("Ada", "given"), ("Kowalle", "family"), (None, "given")], "part_name string, kind string")
    assert found(S.fit_model(docs, parts), "Thanks to Ada Kowalle for the proof.") == {("name", "Ada Kowalle")}
    assert S.fit_model(docs.where("false"), parts.where("false")).find("nothing") == []


def test_lexicon_counts_every_document(spark):
    """Names with just two partners among many documents are learned, as by one pass over all texts."""
    rare = [f"{a}{b}" for a in ("Quil", "Wex", "Zan", "Tor") for b in ("marsh", "dorp", "lund", "vik", "ton")]
    texts = [f"Thanks to {g} {f} for the proof." for f in rare for g in GIVEN[:2]] + [f"the kettle {i} stood by the mill" for i in range(30_000)] + ["Kettle, Ada", "Stonefield, Ada", "", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    parts = spark.createDataFrame([(g, "given") for g in GIVEN] + [(f, "family") for f in FAMILY], "part_name string, kind string")
    lexicon = S.fit_model(docs, parts).lexicon
    assert all(lexicon.mark(f) == "f" for f in rare) and lexicon.mark("kettle") == "c"
    assert lexicon.of == P.learn_lexicon([t for t in texts if t], GIVEN, FAMILY).of
