"""Queries that run the versioned store, the loaders, the encoder and the runner themselves, and their SQL."""

import uuid

from pyspark.sql import functions as F

from verdigris.operators import versions as V
from verdigris.operators.encoding import QUERY_INSTRUCTION, HashingEncoder, encode, encode_missing, missing, vector_key
from verdigris.operators.execution import execute, execution_key
from verdigris.operators.hits import last_logged
from verdigris.operators.store import Store, stores
from verdigris.operators.verification import judged
from verdigris.runtime import materialise, read_table, shared_dir
from verdigris.sources.files import from_jsonl
from verdigris.sources.load import load_source

ENCODER = HashingEncoder()
_built: dict = {}


def _store(spark, sf_dir) -> Store:
    """A store of three versions, built once for a session and its tables: all documents; a change set of the shown texts,
    in which documents without an origin are deleted; all documents again, named v2 of another parent."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        store = Store(spark, f"{shared_dir(spark)}/verdigris/stores-{uuid.uuid4().hex}", "demo")
        corpus = read_table(spark, sf_dir, "corpus").where("doc_id IS NOT NULL")
        whole = corpus.select(F.col("doc_id").alias("uid"), "text")
        shown = last_logged(read_table(spark, sf_dir, "hits"), "view_name", "id", "text").where("view_name = 'corpus' AND text IS NOT NULL")
        gone = corpus.where("origin IS NULL").select(F.col("doc_id").alias("uid"), F.lit(None).cast("string").alias("text"))
        changes = shown.select(F.col("id").alias("uid"), "text").join(gone.select("uid"), "uid", "left_anti").unionByName(gone)
        store.add_version("first", whole, parent=None, source="corpus")
        store.add_version("second", changes, source="hits", partial=True)
        store.add_version("third", whole, parent="first", source="corpus")
        _built[key] = store
    return _built[key]


def store_versions_kept(spark, sf_dir):
    """History of the store: what each version is made from and how it differs from its parent."""
    rows = _store(spark, sf_dir).history()
    return rows.select("version", F.col("seq").cast("bigint").alias("seq"), "parent", "source", *[F.col(f"diff.{c}").alias(c) for c in V.CHANGES])


def store_names(spark, sf_dir):
    store = _store(spark, sf_dir)
    return spark.createDataFrame([(n, store.resolve("HEAD"), len(store.versions())) for n in stores(spark, store.root)], "store string, latest string, n_versions bigint")


def store_entries(spark, sf_dir):
    return _store(spark, sf_dir).entries("second")


def store_blobs(spark, sf_dir):
    """Contents that the store holds: each once, though three versions gave most of them."""
    return _store(spark, sf_dir).blobs().select("sha", F.char_length("text").cast("bigint").alias("n_chars"))


def store_view(spark, sf_dir):
    items = _store(spark, sf_dir).view("all")
    return items.select("id", "sha", "uid", F.array_join("versions", ",").alias("versions"), F.col("latest_index").cast("bigint").alias("latest_index"), F.col("n_versions").cast("bigint").alias("n_versions"), F.char_length("text").cast("bigint").alias("n_chars"))


def store_lineage(spark, sf_dir):
    rows = _store(spark, sf_dir).lineage(None, texts=True)
    return rows.select("uid", "version", "sha", "changed", F.col("reverted_to").cast("bigint").alias("reverted_to"), F.char_length("text").cast("bigint").alias("n_chars"))


def store_diff(spark, sf_dir):
    return _store(spark, sf_dir).diff("first", "second").select("uid", "change")


def loaded_table(spark, sf_dir):
    return load_source(spark, f"table:{sf_dir}/documents.parquet").select("uid", F.sha1("text").alias("sha"))


def loaded_jsonl(spark, sf_dir):
    """Documents written as JSON Lines and read back; of rows sent again the last one counts."""
    path = f"{shared_dir(spark)}/verdigris/lines-{uuid.uuid4().hex}"
    read_table(spark, sf_dir, "corpus").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("text").alias("code")).write.json(path)
    return from_jsonl(spark, path).select("uid", F.sha1("text").alias("sha"))


def _measured(rows):
    """What tells two bags of words apart: how many places are filled, the greatest one, and the length."""
    filled = F.filter("embedding", lambda x: x != 0)
    return rows.select("id", F.size(filled).cast("bigint").alias("n_places"), F.round(F.array_max("embedding").cast("double"), 3).alias("greatest"), F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)), 4).alias("length"))


def encoded_documents(spark, sf_dir):
    rows = read_table(spark, sf_dir, "corpus").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    return _measured(encode(rows, ENCODER, "document")).where("n_places >= 0")


def encoded_queries(spark, sf_dir):
    """Queries as they are encoded: behind the instruction."""
    rows = read_table(spark, sf_dir, "queries").groupBy("qid").agg(F.max("text").alias("text")).select(F.col("qid").alias("id"), "text")
    return _measured(encode(rows, ENCODER, "query", QUERY_INSTRUCTION)).where("n_places >= 0")


def encode_counts(spark, sf_dir):
    """How many texts there are, how many are encoded as equal ones share a vector, and how many once the cache has them."""
    rows = read_table(spark, sf_dir, "corpus").where("doc_id IS NOT NULL AND text IS NOT NULL")
    keyed = rows.select(vector_key(F.col("text"), ENCODER, "document").alias("key"), "text")
    cache = materialise(encode_missing(keyed, ENCODER), "cache")
    n = keyed.agg(F.count("*").alias("n_texts")).join(F.broadcast(cache.agg(F.count("*").alias("n_encoded"))), F.lit(True))
    return n.join(F.broadcast(missing(keyed, cache).agg(F.count("*").alias("n_again"))), F.lit(True))


# Fixed programs: each prints the sum of the two numbers it is given, or fails in its own way.
PROGRAMS = (
    "a, b = map(int, input().split())\nprint(a + b)\n",
    "data = list(map(int, input().split()))\nprint(sum(data))\nreturn\n",
    "print sum(map(int, raw_input().split()))\n",
    "print(int(input()))\n",
    "import os\nos.system('true')\n",
    "import nothing_of_that_name\n",
    "def (\n",
)


def _jobs(spark, sf_dir):
    """A job for every part: one of the programs on two inputs made from its numbers."""
    which = F.array(*map(F.lit, PROGRAMS))
    text = F.concat_ws(" ", F.col("p_partkey").cast("string"), F.col("p_size").cast("string"))
    again = F.concat_ws(" ", F.col("p_size").cast("string"), F.col("p_size").cast("string"))
    return read_table(spark, sf_dir, "part").select("p_partkey", F.get(which, (F.col("p_partkey") % len(PROGRAMS)).cast("int")).alias("code"), F.array(text, again).alias("inputs"))


def executed_cases(spark, sf_dir):
    jobs = _jobs(spark, sf_dir).withColumn("key", execution_key(F.col("code"), F.col("inputs"), 5.0))
    done = jobs.select("p_partkey", "key").join(execute(jobs, 5.0), "key").select("p_partkey", F.posexplode("cases").alias("n", "c"))
    return done.select("p_partkey", F.col("n").cast("bigint").alias("n"), "c.status", F.trim(F.regexp_replace("c.stdout", "\\s+$", "")).alias("stdout"), "c.variant")


def executed_once(spark, sf_dir):
    """Jobs, distinct ones that run, and those that run once their results are known."""
    jobs = _jobs(spark, sf_dir).select("code", F.array(F.get("inputs", F.lit(1))).alias("inputs"))
    known = materialise(execute(jobs, 5.0), "known")
    n = jobs.agg(F.count("*").alias("n_jobs")).join(F.broadcast(known.agg(F.count("*").alias("n_run"))), F.lit(True))
    return n.join(F.broadcast(execute(jobs, 5.0, known=known).agg(F.count("*").alias("n_again"))), F.lit(True))


def judged_cases(spark, sf_dir):
    """Events as the cases of a job per user and day, judged like executions: an event prints its type and a value is expected."""
    e = read_table(spark, sf_dir, "events").where("user_id IS NOT NULL AND event_id IS NOT NULL")
    kind = F.col("event_type")
    status = F.when(kind.isin("click", "purchase"), "ok").when(kind == "view", "import_error").when(kind == "signup", "blocked").otherwise("runtime_error")
    case = F.struct(status.alias("status"), F.concat(F.lit(" "), kind, F.lit(" 0.3333333\n")).alias("stdout"), F.lit("").alias("error"), (F.col("event_id") % 97 / 10.0).alias("seconds"), F.when(F.col("user_id") % 5 == 0, "py2").otherwise("as_is").alias("variant"))
    example = F.struct(F.lit("").alias("input"), F.when(F.coalesce("value", F.lit(0.0)) > 20, F.concat(F.upper(kind), F.lit("  0.33333331"))).otherwise(F.lit("none 1")).alias("output"))
    rows = e.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.struct("event_id", case.alias("case"), example.alias("example")).alias("x")).groupBy("user_id", "day").agg(F.array_sort(F.collect_list("x")).alias("x"))
    done = judged(rows.select("user_id", "day", F.transform("x", lambda x: x["case"]).alias("cases"), F.transform("x", lambda x: x["example"]).alias("examples")))
    return done.select("user_id", "day", "tier", F.col("passed").cast("bigint").alias("passed"), F.col("total").cast("bigint").alias("total"), "variant", F.round("seconds", 6).alias("seconds"), F.array_join(F.transform("labelled", lambda c: c["status"]), ",").alias("labels"))


QUERIES = {f.__name__: f for f in (store_versions_kept, store_names, store_entries, store_blobs, store_view, store_lineage, store_diff, loaded_table, loaded_jsonl, encoded_documents, encoded_queries, encode_counts, executed_cases, executed_once, judged_cases)}

_STORE = """
WITH whole AS (SELECT doc_id AS uid, max(text) AS text FROM corpus WHERE doc_id IS NOT NULL GROUP BY doc_id),
last AS (SELECT *, row_number() OVER (PARTITION BY hit_id ORDER BY logged_at DESC NULLS LAST, view_name DESC, id DESC, text DESC) AS rn FROM hits WHERE hit_id IS NOT NULL),
gone AS (SELECT DISTINCT doc_id AS uid FROM corpus WHERE doc_id IS NOT NULL AND origin IS NULL),
changes AS (SELECT id AS uid, max(text) AS text FROM last WHERE rn = 1 AND view_name = 'corpus' AND text IS NOT NULL AND id NOT IN (SELECT uid FROM gone) GROUP BY id),
a AS (SELECT uid, sha1(text) AS sha, text FROM whole WHERE text IS NOT NULL),
b AS (SELECT uid, sha, text FROM a WHERE uid NOT IN (SELECT uid FROM gone) AND uid NOT IN (SELECT uid FROM changes) UNION ALL SELECT uid, sha1(text), text FROM changes),
d AS (SELECT coalesce(b.uid, a.uid) AS uid, CASE WHEN a.sha IS NULL THEN 'added' WHEN b.sha IS NULL THEN 'removed' WHEN a.sha <> b.sha THEN 'modified' ELSE 'unchanged' END AS change FROM a FULL JOIN b ON a.uid = b.uid),
rows AS (SELECT 1 AS snap, 'first' AS version, uid, sha, text FROM a UNION ALL SELECT 2, 'second', uid, sha, text FROM b UNION ALL SELECT 3, 'third', uid, sha, text FROM a)
"""
_BAG = """
t AS (SELECT id, list_transform(regexp_extract_all(lower(text), '[A-Za-z_]+|\\d+'), lambda w: right(md5(w), 2)) AS w FROM texts WHERE text IS NOT NULL),
c AS (SELECT id, place, count(*)::DOUBLE AS n FROM (SELECT id, unnest(w) AS place FROM t) GROUP BY ALL)
SELECT t.id, count(c.n) AS n_places, round(coalesce(max(c.n) / sqrt(sum(c.n * c.n)), 0), 3) AS greatest, CASE WHEN count(c.n) > 0 THEN 1e0 ELSE 0e0 END AS length FROM t LEFT JOIN c ON t.id = c.id GROUP BY t.id"""
_KEY = "sha1('hashing' || chr(0) || 'document' || chr(0) || '' || chr(0) || '1024' || chr(0) || text || chr(0))"
SQL = {
    "store_versions_kept": _STORE
    + """, n AS (SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'unchanged') AS unchanged FROM d), s AS (SELECT count(*) AS k FROM a)
SELECT 'first' AS version, 0::BIGINT AS seq, NULL AS parent, 'corpus' AS source, k AS added, 0::BIGINT AS removed, 0::BIGINT AS modified, 0::BIGINT AS unchanged FROM s
UNION ALL SELECT 'second', 1, 'first', 'hits', added, removed, modified, unchanged FROM n
UNION ALL SELECT 'third', 2, 'first', 'corpus', 0, 0, 0, k FROM s""",
    "store_names": "SELECT 'demo' AS store, 'third' AS latest, 3::BIGINT AS n_versions",
    "store_entries": _STORE + "SELECT uid, sha FROM b",
    "store_blobs": _STORE + "SELECT sha, max(length(text))::BIGINT AS n_chars FROM rows GROUP BY sha",
    "store_view": _STORE
    + """, once AS (SELECT snap, version, sha, min(uid) AS uid, max(text) AS text FROM rows GROUP BY ALL)
SELECT arg_min(uid, snap) || '@' || sha[1:8] AS id, sha, arg_min(uid, snap) AS uid, string_agg(version, ',' ORDER BY snap) AS versions, (max(snap) - 1)::BIGINT AS latest_index, 3::BIGINT AS n_versions, max(length(text))::BIGINT AS n_chars FROM once GROUP BY sha""",
    "store_lineage": _STORE
    + """, grid AS (SELECT p.uid, s.snap, s.version, r.sha, r.text FROM (SELECT DISTINCT uid FROM rows) p CROSS JOIN (VALUES (1, 'first'), (2, 'second'), (3, 'third')) s(snap, version) LEFT JOIN rows r ON r.uid = p.uid AND r.snap = s.snap),
c AS (SELECT *, sha IS DISTINCT FROM lag(sha) OVER (PARTITION BY uid ORDER BY snap) AS changed, min(snap) OVER (PARTITION BY uid, sha) AS first FROM grid)
SELECT uid, version, sha, changed, CASE WHEN changed AND sha IS NOT NULL AND first < snap THEN first::BIGINT END AS reverted_to, length(text)::BIGINT AS n_chars FROM c""",
    "store_diff": _STORE + "SELECT uid, change FROM d",
    "loaded_table": "SELECT doc_id::VARCHAR AS uid, sha1(text) AS sha FROM documents WHERE doc_id IS NOT NULL",
    "loaded_jsonl": "SELECT doc_id AS uid, sha1(max(text)) AS sha FROM corpus WHERE doc_id IS NOT NULL GROUP BY doc_id",
    "encoded_documents": "WITH texts AS (SELECT doc_id AS id, text FROM corpus WHERE doc_id IS NOT NULL), " + _BAG,
    "encoded_queries": f"WITH texts AS (SELECT qid AS id, 'Instruct: {QUERY_INSTRUCTION}' || chr(10) || 'Query: ' || max(text) AS text FROM queries GROUP BY qid), " + _BAG,
    "encode_counts": f"SELECT count(*) AS n_texts, count(DISTINCT {_KEY}) AS n_encoded, 0::BIGINT AS n_again FROM corpus WHERE doc_id IS NOT NULL AND text IS NOT NULL",
    "executed_cases": """
WITH j AS (SELECT p_partkey, p_partkey % 7 AS w, n, CASE n WHEN 0 THEN p_partkey + p_size ELSE p_size + p_size END AS total FROM part, (VALUES (0::BIGINT), (1)) t(n))
SELECT p_partkey, n, CASE w WHEN 3 THEN 'runtime_error' WHEN 4 THEN 'blocked' WHEN 5 THEN 'import_error' WHEN 6 THEN 'syntax_error' ELSE 'ok' END AS status, CASE WHEN w < 3 THEN total::VARCHAR ELSE '' END AS stdout,
  CASE w WHEN 1 THEN 'wrapped' WHEN 2 THEN 'py2' ELSE 'as_is' END AS variant FROM j""",
    "executed_once": "SELECT count(*) AS n_jobs, count(DISTINCT (p_partkey % 7, p_size)) AS n_run, 0::BIGINT AS n_again FROM part",
    "judged_cases": """
WITH c AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, CASE WHEN event_type IN ('click', 'purchase') THEN 'ok' WHEN event_type = 'view' THEN 'import_error' WHEN event_type = 'signup' THEN 'blocked' ELSE 'runtime_error' END AS status, coalesce(value, 0) > 20 AS wanted, event_id % 97 / 10e0 AS seconds FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL),
p AS (SELECT user_id, day, count(*) FILTER (status = 'ok' AND wanted) AS passed, count(*) AS total, bool_and(status IN ('syntax_error', 'import_error', 'blocked')) AS dull, bool_or(status = 'ok') AS ran, bool_or(status = 'runtime_error') AS broke, max(seconds) AS seconds,
  string_agg(CASE WHEN status = 'ok' AND wanted THEN 'pass' WHEN status = 'ok' THEN 'wrong_answer' ELSE status END, ',' ORDER BY event_id) AS labels FROM c GROUP BY user_id, day)
SELECT user_id, day, CASE WHEN passed = total THEN 'pass_all' WHEN passed > 0 THEN 'pass_partial' WHEN dull OR user_id % 5 = 0 THEN 'unverified' WHEN ran AND NOT broke THEN 'wrong_answer' ELSE 'error' END AS tier, passed, total, CASE WHEN user_id % 5 = 0 THEN 'py2' ELSE 'as_is' END AS variant, round(seconds, 6) AS seconds, labels FROM p""",
}
