"""Queries on statements and snippets: profiles, samples, chunks, evolution, encoding, and the whole search."""

import functools

from pyspark.sql import functions as F

from verdigris.config import Settings
from verdigris.functions import profile as P
from verdigris.functions.udfs import extract_samples, mutate, refactor
from verdigris.operators.encoding import HashingEncoder, vector_key
from verdigris.plans.search import corpus_view, profiles, search
from verdigris.runtime import read_table, spread
from verdigris.sources.benchmark import gold_of_texts, judged_queries, numeric_suffix, shard, subset
from verdigris.sources.benchmark import title_line as title_of
from verdigris.sources.chunks import chunked

ENCODER = HashingEncoder()


def _queries(spark, sf_dir):
    """One row per query: rows that were sent again are one."""
    return read_table(spark, sf_dir, "queries").groupBy("qid").agg(F.max("text").alias("text"))


def _snippets(spark, sf_dir):
    return read_table(spark, sf_dir, "corpus").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text")


def script_language(spark, sf_dir):
    return _queries(spark, sf_dir).where("text IS NOT NULL").select("qid", P.script_language(F.col("text")).alias("language"))


def section_headers(spark, sf_dir):
    return _queries(spark, sf_dir).where("text IS NOT NULL").select("qid", F.array_join(P.headers(F.col("text")), "|").alias("titles"))


def call_examples(spark, sf_dir):
    return _queries(spark, sf_dir).where("text IS NOT NULL").select("qid", P.call_examples(F.col("text")).cast("bigint").alias("n"))


def title_line(spark, sf_dir):
    return _queries(spark, sf_dir).where("text IS NOT NULL").select("qid", title_of(F.col("text")).alias("title"))


def semi_filter_queries(spark, sf_dir):
    return judged_queries(_queries(spark, sf_dir), read_table(spark, sf_dir, "qrels")).select("qid")


def gold_lookup(spark, sf_dir):
    """Documents judged right for the exact text of a query."""
    return gold_of_texts(_queries(spark, sf_dir), read_table(spark, sf_dir, "qrels"))


def sampled_subset(spark, sf_dir):
    """A sampling operator: fifty judged queries drawn by hash order, and three hundred documents with theirs among them."""
    docs, picked, rel = subset(read_table(spark, sf_dir, "corpus").where("doc_id IS NOT NULL"), _queries(spark, sf_dir), read_table(spark, sf_dir, "qrels").where("doc_id IS NOT NULL"), 50, 300)
    one = lambda what, rows, key: rows.select(F.lit(what).alias("what"), F.col(key).alias("key"))
    return one("doc", docs, "doc_id").unionByName(one("query", picked, "qid")).unionByName(one("pair", rel.withColumn("k", F.concat_ws(" ", "qid", "doc_id")), "k"))


def shard_counts(spark, sf_dir):
    parts = [shard(_queries(spark, sf_dir), "qid", 8, i).select(F.lit(i).cast("bigint").alias("shard"), "qid") for i in range(8)]
    return functools.reduce(lambda a, b: a.unionByName(b), parts).groupBy("shard").agg(F.count("*").alias("n"), F.min("qid").alias("least"))


def external_rows(spark, sf_dir):
    rows = read_table(spark, sf_dir, "corpus").select(F.col("doc_id").alias("id"), F.col("origin").alias("title"), "text")
    return corpus_view(rows).select("id", "sha")


def vector_keys(spark, sf_dir):
    return _snippets(spark, sf_dir).select("id", vector_key(F.col("text"), ENCODER, "document").alias("key"))


def query_profiles(spark, sf_dir):
    return profiles(_queries(spark, sf_dir)).select("qid", "kind", "language", "platform", "n_examples", "n_function_examples", F.array_join("titles", "|").alias("titles"), "verifiable")


def sample_tests(spark, sf_dir):
    rows = _queries(spark, sf_dir).where("text IS NOT NULL").select("qid", F.posexplode(extract_samples("text")).alias("n", "e"))
    return rows.select("qid", "n", "e.input", "e.output")


def evolving_queries(spark, sf_dir):
    """Short statements with samples, the ones a demonstration lets evolve."""
    rows = _queries(spark, sf_dir).where(F.char_length("text") < 1400)
    return rows.where(F.size(extract_samples("text")) > 0).select("qid")


def function_chunks(spark, sf_dir):
    return chunked(spread(_snippets(spark, sf_dir)).select(F.concat("id", F.lit(".py")).alias("uid"), "text"), "function")


def refactored(spark, sf_dir):
    rows = spread(_snippets(spark, sf_dir).where("text IS NOT NULL"))
    return rows.select("id", refactor("text", F.lit(1)).alias("code")).where("code IS NOT NULL")


def mutants(spark, sf_dir):
    rows = spread(_snippets(spark, sf_dir).where("text IS NOT NULL"))
    return rows.select("id", mutate("text", numeric_suffix(F.col("id"))).alias("m")).where("m.code IS NOT NULL").select("id", "m.code", "m.description")


#: Executions of this session's registered searches by application and tables; as in the engine, no job is run twice.
_executed: dict = {}


def executions_so_far(spark, sf_dir):
    return _executed.get((spark.sparkContext.applicationId, sf_dir))


def remember_executions(spark, sf_dir, new):
    known = executions_so_far(spark, sf_dir)
    _executed[spark.sparkContext.applicationId, sf_dir] = new if known is None else known.unionByName(new)


def verified_search(spark, sf_dir):
    """Every query against every snippet: profile, encode, best by similarity, run on the samples, fuse, rank."""
    found = search(_queries(spark, sf_dir), corpus_view(_snippets(spark, sf_dir)), ENCODER, Settings(), k=10, executions=executions_so_far(spark, sf_dir))
    remember_executions(spark, sf_dir, found.executions)
    return found.hits.select("qid", "id", "rank", "dense_rank", F.round("dense", 5).alias("dense"), F.round("score", 4).alias("score"), "tier", "passed", "total", "variant")


QUERIES = {f.__name__: f for f in (script_language, section_headers, call_examples, title_line, semi_filter_queries, gold_lookup, sampled_subset, shard_counts, external_rows, vector_keys, query_profiles, sample_tests, evolving_queries, function_chunks, refactored, mutants, verified_search)}
_Q = "WITH q AS (SELECT qid, max(text) AS text FROM queries GROUP BY qid)"
_KEY = "sha1('hashing' || chr(0) || 'document' || chr(0) || '' || chr(0) || '1024' || chr(0) || text || chr(0))"
SQL = {
    "script_language": f"{_Q} SELECT qid, CASE WHEN len(regexp_extract_all(text, '[\\x{{0400}}-\\x{{04FF}}]')) > 0.2 * greatest(1, len(regexp_extract_all(text, '[A-Za-z\\x{{0400}}-\\x{{04FF}}]'))) THEN 'ru' ELSE 'en' END AS language FROM q WHERE text IS NOT NULL",
    "section_headers": _Q + r""" SELECT qid, array_to_string(list_filter(list_transform(regexp_extract_all(text, '(?m)^[ \t]*(?:-{3,}|={3,})[ \t]*(.*?)[ \t]*(?:-{3,}|={3,})[ \t]*$', 1), lambda h: trim(regexp_replace(trim(h), ':+$', ''))), lambda h: h <> ''), '|') AS titles FROM q WHERE text IS NOT NULL""",
    "call_examples": _Q + r""" SELECT qid, len(regexp_extract_all(text, '(?m)^[\t\f\r ]*Input[\t\f\r ]*:[\t\f\r ]*([^\s].*?)\s*$\s*^[\t\f\r ]*Output[\t\f\r ]*:[\t\f\r ]*([^\s].*?)[\t\f\r ]*$'))::BIGINT AS n FROM q WHERE text IS NOT NULL""",
    "title_line": _Q + r""" SELECT qid, substring(regexp_extract(text, '^\s*([^\n]*)', 1), 1, 90) AS title FROM q WHERE text IS NOT NULL""",
    "semi_filter_queries": _Q + " SELECT qid FROM q WHERE qid IN (SELECT qid FROM qrels WHERE qid IS NOT NULL)",
    "gold_lookup": _Q + " SELECT DISTINCT sha1(text) AS text_sha, doc_id FROM q JOIN qrels USING (qid) WHERE text IS NOT NULL AND rel > 0",
    "sampled_subset": _Q
    + """, j AS (SELECT qid FROM q WHERE qid IN (SELECT qid FROM qrels WHERE qid IS NOT NULL AND doc_id IS NOT NULL)), p AS (SELECT qid FROM j ORDER BY sha1('7|' || qid), qid LIMIT 50),
r AS (SELECT DISTINCT qid, doc_id FROM qrels WHERE doc_id IS NOT NULL AND qid IN (SELECT qid FROM p)), d AS (SELECT doc_id FROM corpus WHERE doc_id IS NOT NULL ORDER BY doc_id NOT IN (SELECT doc_id FROM r), sha1('7|' || doc_id), doc_id LIMIT 300)
SELECT 'doc' AS what, doc_id AS key FROM d UNION ALL SELECT 'query', qid FROM p UNION ALL SELECT 'pair', qid || ' ' || doc_id FROM r""",
    "shard_counts": _Q + " SELECT ('0x' || left(md5(qid), 8))::BIGINT % 8 AS shard, count(*) AS n, min(qid) AS least FROM q WHERE qid IS NOT NULL GROUP BY 1",
    "external_rows": "SELECT doc_id AS id, sha1(CASE WHEN coalesce(origin, '') <> '' THEN concat_ws(chr(10), origin, text) ELSE text END) AS sha FROM corpus WHERE doc_id IS NOT NULL",
    "vector_keys": f"SELECT doc_id AS id, {_KEY} AS key FROM corpus WHERE doc_id IS NOT NULL",
}
