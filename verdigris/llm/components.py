"""Connected components of a graph given as links, by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.runtime import materialise, release


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of (a, b) links: ``root`` is the smallest node of its component.

    Each step is one aggregation of the smallest neighbour (pre-aggregated, so a node of any degree is no hot key) and
    one join.  The tables of a step are written to the shared folder; nothing is gathered on the driver.
    """
    edges = materialise(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours go to the smallest one
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # small star: smaller neighbours and the node itself go to the smallest one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = materialise(small, "links")
        # both are sets: equal sizes and no new link mean that nothing moved
        same = new.join(edges, ["u", "v"], "left_anti").isEmpty() and edges.join(new, ["u", "v"], "left_anti").isEmpty()
        release(edges)
        edges = new
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
