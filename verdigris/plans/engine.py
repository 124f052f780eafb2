"""The library's entry object: named stores, caches of vectors and executions, search over any version or all."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris import schemas
from verdigris.config import Settings
from verdigris.functions.evidence import recency
from verdigris.operators.encoding import QUERY_INSTRUCTION, Encoder, HashingEncoder, encode_missing, missing, query_prefix, vector_key
from verdigris.operators.store import Store, stores, table_or_empty
from verdigris.plans.search import Result, search, shown
from verdigris.runtime import materialise


class Engine:
    """Stores live below ``settings.home``/stores, vectors and executions beside them, both keyed by content.

    Adding a version only encodes content that no version had, and a run is never repeated.
    """

    def __init__(self, spark: SparkSession, settings: Settings | None = None, encoder: Encoder | None = None, verify: bool = True):
        self.spark, self.settings = spark, settings or Settings.of(spark)
        self.encoder, self.verify = encoder or HashingEncoder(), verify
        self.home = self.settings.home.rstrip("/")

    def store(self, name: str) -> Store:
        return Store(self.spark, f"{self.home}/stores", name)

    def stores(self) -> list[str]:
        return stores(self.spark, f"{self.home}/stores")

    def _cache(self, what: str, schema) -> DataFrame:
        return table_or_empty(self.spark, f"{self.home}/{what}", schema)

    def vectors(self) -> DataFrame:
        return self._cache("vectors", schemas.VECTORS)

    def executions(self) -> DataFrame:
        return self._cache("executions", schemas.EXECUTIONS)

    def _add(self, rows: DataFrame, what: str) -> int:
        """Append rows whose key the cache lacks; how many there were.  Repeating it adds nothing."""
        new = materialise(rows, what)
        new.write.mode("append").parquet(f"{self.home}/{what}")
        return new.count()

    def encode_new(self, view: DataFrame) -> int:
        """Encode the contents of a view that have no vector yet; how many."""
        keyed = view.where("text IS NOT NULL").select(vector_key(F.col("text"), self.encoder, "document").alias("key"), "text")
        return self._add(encode_missing(keyed, self.encoder, self.vectors()), "vectors")

    def unencoded(self, view: DataFrame) -> int:
        keyed = view.where("text IS NOT NULL").select(vector_key(F.col("text"), self.encoder, "document").alias("key"), "text")
        return missing(keyed, self.vectors()).count()

    def add_version(self, store: str, version: str, snippets: DataFrame, parent: str | None = "latest", source: str = "", partial: bool = False, replace: bool = False, build: bool = True) -> dict:
        """Register a version and encode what is new; what changed, and how long it took."""
        began = time.perf_counter()
        st = self.store(store)
        info = {"store": store, "version": version, "diff": st.add_version(version, snippets, parent, source, replace, partial)}
        info["register_s"] = round(time.perf_counter() - began, 3)
        if build:
            began = time.perf_counter()
            info["newly_embedded"] = self.encode_new(st.view(version))
            info["index_build_s"] = round(time.perf_counter() - began, 3)
            info["snippets"] = st.entries(version).count()
        return info

    def search_many(self, queries: DataFrame, store: str, version: str = "latest", k: int = 10, verify: bool = True) -> Result:
        """Search (qid, text) in a version or in ``all``, where newer content wins between equals."""
        view = self.store(store).view(version)
        bonus = recency(F.col("latest_index"), F.col("n_versions")) if version == "all" else None
        found = search(queries, view, self.encoder, self.settings, k, verify and self.verify, self.vectors(), self.executions(), bonus, QUERY_INSTRUCTION)
        if found.queries_cached == 0:
            asked = queries.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("key", vector_key(F.col("text"), self.encoder, "query", QUERY_INSTRUCTION))
            self._add(encode_missing(asked, self.encoder, self.vectors(), query_prefix(QUERY_INSTRUCTION)), "vectors")
        if found.executions is not None:
            self._add(found.executions, "executions")
        return found

    def search(self, query: str, store: str, version: str = "latest", k: int = 10, verify: bool = True) -> dict:
        """One query's answer as plain values: profile, hits with texts, stats and milliseconds."""
        began = time.perf_counter()
        queries = self.spark.createDataFrame([("q", query)], "qid string, text string")
        found = self.search_many(queries, store, version, k, verify)
        view = self.store(store).view(version)
        hits = shown(found.hits.drop("sha", "uid", "versions", "latest_index", "n_versions")).join(view, "id").orderBy("rank").collect()  # k rows
        profile = found.profiles.first().asDict(recursive=True)
        answers = []
        for h in hits:
            r = h.asDict(recursive=True)
            check = r["verification"] and r["verification"] | {"cases": r["labelled"]}
            answers.append({k: r[k] for k in ("rank", "id", "sha", "dense", "dense_rank", "score")} | {"verification": check, "meta": {"uid": r["uid"], "versions": r["versions"]}, "text": r["text"]})
        stats = found.stats().first().asDict() | found.counters() | {"candidates": view.count(), "view": f"{store}@{version}", "query_embedding_cached": found.queries_cached > 0}
        took = {k: round(1e3 * s, 1) for k, s in found.timings_s.items()} | {"total": round((time.perf_counter() - began) * 1e3, 1)}
        return {"query": query, "profile": profile, "hits": answers, "stats": stats, "timings_ms": took}

    def warm_up(self) -> None:
        """One search of every store, so that plans, workers and their children are there for the first request."""
        for name in self.stores():
            self.search("warm up", name, "latest", 1)

    def close(self) -> None:
        """Forget cached plans and tables; the stores stay.  Children end with their Python workers."""
        self.spark.catalog.clearCache()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()
