"""Queries on similarity, evidence, ranking and its quality."""

from pyspark.sql import functions as F

from verdigris.functions import evidence as E
from verdigris.functions.vectors import norm
from verdigris.operators import metrics as M
from verdigris.operators.hits import last_logged
from verdigris.functions.udfs import same_output
from verdigris.operators.topk import dense_topk, dense_topk_blocks as blocks, rank_within
from verdigris.operators.verification import first_round, next_round
from verdigris.plans.search import ranking_rows, shown
from verdigris.runtime import read_table
from verdigris.schemas import BROKEN, TIERS, UNRUNNABLE

FIRST, MORE = 20, 30


def _vectors(spark, sf_dir):
    rows = read_table(spark, sf_dir, "embeddings")
    items = rows.select(F.col("vec_id").alias("id"), "embedding")
    return items.where("id % 100 = 0").withColumnRenamed("id", "qid"), items


def _hits(spark, sf_dir, *columns):
    return last_logged(read_table(spark, sf_dir, "hits"), *columns)


def _topk(find):
    def query(spark, sf_dir):
        asked, items = _vectors(spark, sf_dir)
        return find(asked, items, 10).select("qid", "id", F.round("dense", 6).alias("dense"), F.col("dense_rank").cast("bigint").alias("dense_rank"))

    return query


def vector_norms(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 5).alias("length"))


def fused_rank(spark, sf_dir):
    rows = _hits(spark, sf_dir, "search_id", "dense", "dense_rank", "verification.tier AS tier").where("dense IS NOT NULL AND search_id IS NOT NULL")
    scored = rows.withColumn("fused", F.round(E.fused(F.col("dense"), F.col("tier")), 6))
    ranked = rank_within(scored, "search_id", F.desc("fused"), F.asc_nulls_last("dense_rank"), "hit_id", to="fused_rank")
    return ranked.select("search_id", "hit_id", "fused", F.col("fused_rank").cast("bigint").alias("fused_rank"))


def tier_histogram(spark, sf_dir):
    rows = _hits(spark, sf_dir, "view_name", "verification.tier AS tier").where("tier IS NOT NULL")
    return rows.groupBy("view_name").agg(*E.histogram(F.col("tier")), F.count("*").alias("n"))


def adaptive_expand(spark, sf_dir):
    """The candidates that each round of a staged verification would check, going by the logged tiers."""
    rows = _hits(spark, sf_dir, "search_id", "dense_rank", "verification.tier AS tier").where("search_id IS NOT NULL AND dense_rank IS NOT NULL")
    ranked = rows.select(F.col("search_id").alias("qid"), F.col("hit_id").alias("id"), "dense_rank", "tier")
    first = first_round(ranked, FIRST)
    second = next_round(ranked, ranked.where(F.col("dense_rank") <= FIRST), FIRST, MORE)
    both = first.withColumn("round", F.lit(1).cast("bigint")).unionByName(second.withColumn("round", F.lit(2).cast("bigint")))
    return both.select(F.col("qid").alias("search_id"), F.col("id").alias("hit_id"), "round")


def judge_tier(spark, sf_dir):
    """Events read as cases of a job per user and day, and the tier of each job."""
    e = read_table(spark, sf_dir, "events")
    kind = F.col("event_type")
    status = F.when(kind.isin("click", "purchase"), "ok").when(kind == "view", "import_error").when(kind == "signup", "blocked").otherwise("runtime_error")
    cases = e.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), status.alias("status"), ((status == "ok") & F.coalesce(F.col("value") > 20, F.lit(False))).alias("ok"))
    per = cases.groupBy("user_id", "day").agg(F.count_if("ok").alias("passed"), F.count("*").alias("total"), F.bool_and(F.col("status").isin(*UNRUNNABLE)).alias("dull"), F.bool_or(F.col("status") == "ok").alias("ran"), F.bool_or(F.col("status").isin(*BROKEN)).alias("broke"))
    tier = E.tier_of(F.col("passed"), F.col("total"), F.col("total") > 0, F.col("dull"), F.lit(False), F.col("ran"), F.col("broke"))
    return per.select("user_id", "day", "passed", "total", tier.alias("tier"))


def output_match(spark, sf_dir):
    """Whether the shown text of a hit equals the document it names, as a judge compares outputs."""
    shown_texts = _hits(spark, sf_dir, "id", "text").where("text IS NOT NULL")
    docs = read_table(spark, sf_dir, "corpus").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("text").alias("wanted"))
    return shown_texts.join(docs, "id").select("hit_id", same_output("text", "wanted").alias("same"))


def _ranked(spark, sf_dir):
    """(qid, doc_id, rank): documents of the view over the corpus in the best order that any search of a query gave."""
    rows = _hits(spark, sf_dir, "qid", "view_name", "id", "rank", "dense_rank").where("view_name = 'corpus' AND qid IS NOT NULL AND id IS NOT NULL")
    best = rows.groupBy("qid", F.col("id").alias("doc_id")).agg(F.min("rank").alias("r"), F.min("dense_rank").alias("dense_rank"))
    return rank_within(best, "qid", F.asc_nulls_last("r"), "doc_id", to="rank").select("qid", "doc_id", "rank", "dense_rank")


def ndcg_mrr_recall(spark, sf_dir):
    per = M.query_metrics(_ranked(spark, sf_dir), read_table(spark, sf_dir, "qrels"))
    return per.select("qid", *[F.round(c, 6).alias(c) for c in per.columns if c != "qid"])


def mean_metrics(spark, sf_dir):
    return M.mean_metrics(M.query_metrics(_ranked(spark, sf_dir), read_table(spark, sf_dir, "qrels")), 4)


def movement(spark, sf_dir):
    gold = M.judged(read_table(spark, sf_dir, "qrels")).where("rel > 0")
    return M.movement(gold.join(_ranked(spark, sf_dir), ["qid", "doc_id"], "left").select("qid", F.col("dense_rank").alias("before"), F.col("rank").alias("after")))


def version_correct(spark, sf_dir):
    """Hits of views over all versions, those that pass being correct and those that fail regressions."""
    rows = _hits(spark, sf_dir, "search_id", "view_name", "rank", "verification.tier AS tier").where("view_name = 'all' AND search_id IS NOT NULL")
    role = F.when(F.col("tier") == "pass_all", "correct").when(F.col("tier").isin("wrong_answer", "error"), "regression").otherwise("other")
    return M.version_metrics(rows.select(F.col("search_id").alias("qid"), "rank", role.alias("role")))


def _gold_tiers(spark, sf_dir):
    gold = M.judged(read_table(spark, sf_dir, "qrels")).where("rel > 0").select("qid", F.col("doc_id").alias("id"), F.lit(True).alias("gold"))
    rows = _hits(spark, sf_dir, "qid", "id", "verification.tier AS tier").where("tier IS NOT NULL")
    return rows.join(gold, ["qid", "id"], "left").withColumn("gold", F.coalesce("gold", F.lit(False)))


def feasibility(spark, sf_dir):
    rows = _gold_tiers(spark, sf_dir)
    return rows.groupBy("gold").agg(*E.histogram(F.col("tier")), F.round(F.avg((F.col("tier") == "pass_all").cast("double")), 4).alias("pass_rate"))


def likelihood_ratios(spark, sf_dir):
    counts = _gold_tiers(spark, sf_dir).groupBy("tier").agg(F.count_if("gold").alias("pos"), F.count_if(~F.col("gold")).alias("neg"))
    return M.likelihood_ratios(counts, TIERS)


def _as_results(spark, sf_dir):
    """Logged hits as a search returns them."""
    rows = _hits(spark, sf_dir, "search_id AS qid", "id", "sha", "rank", "dense", "dense_rank", "score", "verification.tier AS tier", "verification.passed AS passed", "verification.total AS total", "verification.variant AS variant", "verification.seconds AS seconds")
    return rows


def response_rows(spark, sf_dir):
    rows = shown(_as_results(spark, sf_dir))
    return rows.select("hit_id", "qid", "id", "sha", F.col("rank").cast("bigint").alias("rank"), "dense", "score", F.col("verification.tier").alias("tier"), F.col("verification.seconds").alias("seconds"), F.col("verification").isNotNull().alias("verified"))


def ranking_file(spark, sf_dir):
    return ranking_rows(_as_results(spark, sf_dir))


QUERIES = {"dense_topk": _topk(dense_topk), "dense_topk_blocks": _topk(blocks)} | {f.__name__: f for f in (vector_norms, fused_rank, tier_histogram, adaptive_expand, judge_tier, output_match, ndcg_mrr_recall, mean_metrics, movement, version_correct, feasibility, likelihood_ratios, response_rows, ranking_file)}

_TOPK = """
WITH scored AS (SELECT q.vec_id AS qid, d.vec_id AS id, list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS dense
  FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, id) AS dense_rank FROM scored)
SELECT qid, id, round(dense, 6) AS dense, dense_rank FROM ranked WHERE dense_rank <= 10"""
_LAST = "WITH h AS (SELECT *, verification.tier AS tier FROM (SELECT *, row_number() OVER (PARTITION BY hit_id ORDER BY logged_at DESC NULLS LAST, search_id DESC, score DESC) AS rn FROM hits WHERE hit_id IS NOT NULL) WHERE rn = 1)"
_EVIDENCE = "CASE tier WHEN 'pass_all' THEN 7e0 WHEN 'pass_partial' THEN 1.5e0 WHEN 'wrong_answer' THEN -2e0 WHEN 'error' THEN -3e0 ELSE 0e0 END"
_TIER_COUNTS = ", ".join(f"count(*) FILTER (tier = '{t}') AS {t}" for t in TIERS)
_REL = "rel AS (SELECT qid, doc_id, max(coalesce(rel, 0))::DOUBLE AS rel FROM qrels WHERE qid IS NOT NULL AND doc_id IS NOT NULL GROUP BY qid, doc_id)"
_RANKED = """best AS (SELECT qid, id AS doc_id, min(rank) AS r, min(dense_rank) AS dense_rank FROM h WHERE view_name = 'corpus' AND qid IS NOT NULL AND id IS NOT NULL GROUP BY qid, id),
ranked AS (SELECT qid, doc_id, dense_rank, row_number() OVER (PARTITION BY qid ORDER BY r NULLS LAST, doc_id) AS rank FROM best)"""
_PER_QUERY = f"""{_LAST}, {_REL}, {_RANKED},
x AS (SELECT a.*, b.rank, row_number() OVER (PARTITION BY a.qid ORDER BY rel DESC, a.doc_id) AS ideal FROM rel a LEFT JOIN ranked b ON a.qid = b.qid AND a.doc_id = b.doc_id),
per AS (SELECT qid, coalesce(sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) END), 0) / nullif(sum(CASE WHEN ideal <= 10 THEN rel / log2(ideal + 1) END), 0) AS n,
  coalesce(1e0 / min(rank) FILTER (rel > 0 AND rank <= 10), 0) AS mrr, count(*) FILTER (rel > 0) AS p, count(*) FILTER (rel > 0 AND rank <= 1) AS a, count(*) FILTER (rel > 0 AND rank <= 10) AS b, count(*) FILTER (rel > 0 AND rank <= 50) AS c FROM x GROUP BY qid),
m AS (SELECT qid, coalesce(n, 0) AS ndcg, mrr, coalesce(a / nullif(p, 0), 0) AS recall_at_1, coalesce(b / nullif(p, 0), 0) AS recall_at_10, coalesce(c / nullif(p, 0), 0) AS recall_at_50 FROM per)"""
_METRICS = ("ndcg", "mrr", "recall_at_1", "recall_at_10", "recall_at_50")
_GOLD = f"{_LAST}, {_REL}, g AS (SELECT h.tier, r.qid IS NOT NULL AS gold FROM h LEFT JOIN rel r ON h.qid = r.qid AND h.id = r.doc_id AND r.rel > 0 WHERE tier IS NOT NULL)"
_TOKENS = r"list_filter(string_split_regex({}, '[\s\x1c-\x1f\x0b\x85\xa0]+'), lambda t: t <> '')"
SQL = {
    "dense_topk": _TOPK,
    "dense_topk_blocks": _TOPK,
    "vector_norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS length FROM embeddings",
    "fused_rank": f"{_LAST}, f AS (SELECT search_id, hit_id, dense_rank, round(dense / 0.02::DOUBLE + {_EVIDENCE}, 6) AS fused FROM h WHERE dense IS NOT NULL AND search_id IS NOT NULL) SELECT search_id, hit_id, fused, row_number() OVER (PARTITION BY search_id ORDER BY fused DESC, dense_rank NULLS LAST, hit_id) AS fused_rank FROM f",
    "tier_histogram": f"{_LAST} SELECT view_name, {_TIER_COUNTS}, count(*) AS n FROM h WHERE tier IS NOT NULL GROUP BY view_name",
    "adaptive_expand": f"""{_LAST}, r AS (SELECT search_id, hit_id, dense_rank, tier FROM h WHERE search_id IS NOT NULL AND dense_rank IS NOT NULL), done AS (SELECT search_id FROM r WHERE dense_rank <= {FIRST} AND tier = 'pass_all')
SELECT search_id, hit_id, 1::BIGINT AS round FROM r WHERE dense_rank <= {FIRST} UNION ALL SELECT search_id, hit_id, 2 FROM r WHERE dense_rank > {FIRST} AND dense_rank <= {FIRST + MORE} AND search_id NOT IN (SELECT search_id FROM done)""",
    "judge_tier": """
WITH c AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_type IN ('click', 'purchase') THEN 'ok' WHEN event_type = 'view' THEN 'import_error' WHEN event_type = 'signup' THEN 'blocked' ELSE 'runtime_error' END AS status, value FROM events),
p AS (SELECT user_id, day, count(*) FILTER (status = 'ok' AND value > 20) AS passed, count(*) AS total, bool_and(status IN ('syntax_error', 'import_error', 'blocked')) AS dull, bool_or(status = 'ok') AS ran, bool_or(status = 'runtime_error') AS broke FROM c GROUP BY user_id, day)
SELECT user_id, day, passed, total, CASE WHEN passed = total THEN 'pass_all' WHEN passed > 0 THEN 'pass_partial' WHEN dull THEN 'unverified' WHEN ran AND NOT broke THEN 'wrong_answer' ELSE 'error' END AS tier FROM p""",
    "output_match": f"""{_LAST}, t AS (SELECT hit_id, {_TOKENS.format("h.text")} AS a, {_TOKENS.format("c.text")} AS b FROM h JOIN corpus c ON h.id = c.doc_id WHERE h.text IS NOT NULL AND c.text IS NOT NULL)
SELECT hit_id, len(a) = len(b) AND list_bool_and(list_concat([true], list_transform(list_zip(a, b), lambda p: lower(p[1]) = lower(p[2]) OR coalesce(abs(try_cast(p[1] AS DOUBLE) - try_cast(p[2] AS DOUBLE)) <= 1e-6 * greatest(1e0, abs(try_cast(p[2] AS DOUBLE))), false)))) AS same FROM t""",
    "ndcg_mrr_recall": f"{_PER_QUERY} SELECT qid, {', '.join(f'round({c}, 6) AS {c}' for c in _METRICS)} FROM m",
    "mean_metrics": f"{_PER_QUERY} SELECT {', '.join(f'round(avg({c}), 4) AS {c}' for c in _METRICS)}, count(*) AS n_queries FROM m",
    "movement": f"{_LAST}, {_REL}, {_RANKED} SELECT count(*) FILTER (rank < dense_rank) AS moved_up, count(*) FILTER (rank > dense_rank) AS moved_down, count(*) FILTER (dense_rank = 1) AS first_before, count(*) FILTER (rank = 1) AS first_after FROM rel a LEFT JOIN ranked b ON a.qid = b.qid AND a.doc_id = b.doc_id WHERE rel > 0",
    "version_correct": f"{_LAST}, p AS (SELECT search_id, coalesce(min(rank) FILTER (tier = 'pass_all'), 1000000) AS good, coalesce(min(rank) FILTER (tier IN ('wrong_answer', 'error')), 1000000) AS bad FROM h WHERE view_name = 'all' AND search_id IS NOT NULL GROUP BY search_id) SELECT count(*) AS n_queries, round(avg((good = 1)::INT), 4) AS correct_at_1, round(avg((bad < good)::INT), 4) AS regression_above FROM p",
    "feasibility": f"{_GOLD} SELECT gold, {_TIER_COUNTS}, round(avg((tier = 'pass_all')::INT), 4) AS pass_rate FROM g GROUP BY gold",
    "likelihood_ratios": f"""{_GOLD}, t(tier) AS (VALUES {", ".join(f"('{t}')" for t in TIERS)}), c AS (SELECT t.tier, count(*) FILTER (gold) AS pos, count(*) FILTER (NOT gold) AS neg FROM t LEFT JOIN g ON t.tier = g.tier GROUP BY t.tier)
SELECT tier, CASE WHEN tier = 'unverified' THEN 0e0 ELSE round(ln(((pos + 1) / ((SELECT sum(pos) FROM c) + 5)) / ((neg + 1) / ((SELECT sum(neg) FROM c) + 5))), 4) END AS llr FROM c""",
    "response_rows": f"{_LAST} SELECT hit_id, search_id AS qid, id, sha, rank::BIGINT AS rank, round(dense, 5) AS dense, round(score, 4) AS score, tier, CASE WHEN tier IS NOT NULL THEN round(verification.seconds, 4) END AS seconds, tier IS NOT NULL AS verified FROM h",
    "ranking_file": f"{_LAST} SELECT search_id AS query_id, rank::BIGINT AS rank, id AS doc_id, round(score, 4) AS score, coalesce(tier, '') AS verification FROM h WHERE rank <= 10",
}
