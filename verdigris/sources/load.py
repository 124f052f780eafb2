"""One entry for every kind of source, by how it is written."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from verdigris.sources.chunks import chunked
from verdigris.sources.files import from_directory, from_json, from_jsonl
from verdigris.sources.git import from_git


def load_source(spark: SparkSession, spec: str, chunk: str = "file") -> DataFrame:
    """(uid, text) of ``git:REPO@REF``, ``table:PATH`` (Parquet with doc_id or uid, and text), a folder, .jsonl or .json."""
    if spec.startswith("git:"):
        repo, _, ref = spec[4:].rpartition("@")
        return chunked(from_git(spark, repo or ".", ref or "HEAD"), chunk)
    if spec.startswith("table:"):
        rows = spark.read.parquet(spec[6:])
        key = "uid" if "uid" in rows.columns else "doc_id"
        return rows.selectExpr(f"cast({key} AS string) AS uid", "text").where("uid IS NOT NULL")
    if _is_folder(spark, spec):
        return chunked(from_directory(spark, spec), chunk)
    if spec.endswith(".jsonl"):
        return from_jsonl(spark, spec)
    if spec.endswith(".json"):
        return from_json(spark, spec)
    raise ValueError(f"unrecognised source {spec!r}")


def _is_folder(spark: SparkSession, spec: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spec)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(path) and files.getFileStatus(path).isDirectory()


def query_text(argument: str) -> str:
    """The query itself, the content of ``@file``, or standard input for ``-``."""
    if argument == "-":
        return sys.stdin.read()
    if argument.startswith("@"):
        with open(argument[1:], encoding="utf-8") as f:
            return f.read()
    return argument
