"""Queries of problem 2: near duplicates within and across corpus and hits."""

from verdigris.llm.near_duplicates import all_pairs, classes, near_duplicates
from verdigris.llm.records import corpus_texts, shown_texts
from verdigris.runtime import read_table, spread

#: As the statement of the problem has it for these tables.
WIDTH, THRESHOLD = 3, 0.6


def records(spark, sf_dir):
    return corpus_texts(spread(read_table(spark, sf_dir, "corpus"))).unionByName(shown_texts(read_table(spark, sf_dir, "hits")))


def p2_found(spark, sf_dir):
    return all_pairs(*near_duplicates(records(spark, sf_dir), WIDTH, THRESHOLD))


def p2_classes(spark, sf_dir):
    return classes(*near_duplicates(records(spark, sf_dir), WIDTH, THRESHOLD))


QUERIES = {"p2_found": p2_found, "p2_classes": p2_classes}
SQL = {
    "p2_found": """
WITH shown AS (SELECT hit_id, text, row_number() OVER (PARTITION BY hit_id ORDER BY logged_at DESC NULLS LAST, text DESC) AS rn FROM hits WHERE hit_id IS NOT NULL AND text IS NOT NULL),
records AS (SELECT doc_id AS rec, text FROM corpus WHERE doc_id IS NOT NULL AND text IS NOT NULL UNION ALL SELECT hit_id, text FROM shown WHERE rn = 1),
tokens AS (SELECT rec, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM records),
sets AS (SELECT rec, list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS s FROM tokens WHERE len(t) >= 3),
runs AS (SELECT rec, len(s) AS n, unnest(s) AS run FROM sets),
pairs AS (SELECT a.rec AS rec_a, b.rec AS rec_b, a.n AS n, b.n AS m, count(*) AS shared FROM runs a JOIN runs b ON a.run = b.run AND a.rec < b.rec GROUP BY ALL)
SELECT rec_a, rec_b FROM pairs WHERE 10 * shared >= 6 * (n + m - shared)"""
}
