"""Snippets from folders, JSON and JSON Lines files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders that hold no sources; hidden ones neither.
SKIPPED = ("__pycache__", "node_modules")


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """UTF-8 with marks in place of bytes that are none."""
    return content.map(lambda b: b.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n"))


def from_directory(spark: SparkSession, root: str, extension: str = ".py") -> DataFrame:
    """(uid, text) of the files below ``root`` with the extension; uid is the path from there, with forward slashes.

    ``root`` is a folder of any file system that Spark knows.  Names are filtered before contents are decoded.  A
    folder without such files gives no rows.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{extension}").load(base)
    folders = F.slice(F.split("uid", "/"), F.lit(1), F.greatest(F.size(F.split("uid", "/")) - 1, F.lit(0)))
    kept = files.select(F.substr("path", F.lit(len(base) + 2)).alias("uid"), "content").where(~F.exists(folders, lambda d: d.startswith(".") | d.isin(*SKIPPED)))
    return kept.select("uid", decoded("content").alias("text"))


_RECORD = "id string, _id string, text string, code string"


def _records(rows: DataFrame) -> DataFrame:
    """(uid, text) of parsed records ``r`` with a position ``at``: the last of a uid counts, records without one are left out.

    An empty or zero ``id`` falls back to ``_id``.
    """
    given = F.when(F.col("r.id").isin("", "0", "false"), None).otherwise(F.col("r.id"))
    named = rows.select(F.coalesce(given, F.col("r._id")).alias("uid"), F.coalesce("r.text", "r.code").alias("text"), "at").where("uid IS NOT NULL")
    return named.groupBy("uid").agg(F.max_by("text", "at").alias("text"))


def from_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(uid, text) from lines of JSON with ``id`` or ``_id`` and ``text`` or ``code``; blank and broken lines are left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")  # of several files the later path counts
    return _records(lines.select(F.from_json("value", _RECORD).alias("r"), F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line")).alias("at")))


def from_json(spark: SparkSession, path: str) -> DataFrame:
    """(uid, text) from one JSON file: an object of texts by uid, or a list of records as in :func:`from_jsonl`."""
    whole = spark.read.text(path, wholetext=True)
    is_list = F.ltrim("value").startswith("[")
    listed = whole.where(is_list).select(F.posexplode(F.from_json("value", f"array<struct<{_RECORD.replace(' string', ':string')}>>")).alias("at", "r"))
    mapped = whole.where(~is_list).select(F.explode(F.from_json("value", "map<string,string>")).alias("uid", "text"))
    return _records(listed).unionByName(mapped)
