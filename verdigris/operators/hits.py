"""Logged hits of earlier searches."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_logged(hits: DataFrame, *columns: str) -> DataFrame:
    """(hit_id, columns...) of the row of each hit_id logged last; at equal times the greatest values count.

    ``columns`` are expressions with aliases; only they travel.  Rows without a hit_id are left out.
    """
    narrow = hits.where("hit_id IS NOT NULL").selectExpr("hit_id", "logged_at", *columns)
    names = [c for c in narrow.columns if c not in ("hit_id", "logged_at")]
    return narrow.groupBy("hit_id").agg(F.max(F.struct("logged_at", *names)).alias("r")).select("hit_id", *[F.col(f"r.{c}").alias(c) for c in names])
