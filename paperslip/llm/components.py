"""Connected components by alternating large and small stars, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperslip.llm.scratch import written


def connected(edges: DataFrame, *, max_rounds: int = 50) -> DataFrame:
    """(node, component) of every node of edges (src, dst): the smallest node that it is linked to.

    Each round hangs every node's larger neighbours, then its smaller ones, on the smallest of them; edges
    stay as many as before at most. Rows with nulls and loops are left out. No edges give no rows. The
    rounds (a logarithm of the longest chain, about) end when the edges stay the same.
    """
    spark = edges.sparkSession
    now = written(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u > v").distinct(), "edges")
    sign = None
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        large = both.join(low, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        joined = large.join(least, F.col("u") == F.col("k"))
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).distinct()
        now = written(small, "edges")
        n, total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, total) == sign:
            break
        sign = (n, total)
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def labelled(nodes: DataFrame, node: str, edges: DataFrame) -> DataFrame:
    """nodes with `component` added: the label from `connected`, or the node itself where it has no edge."""
    found = connected(edges).withColumnRenamed("node", "_node").withColumnRenamed("component", "_component")
    return nodes.join(found, F.col(node) == F.col("_node"), "left").withColumn("component", F.coalesce("_component", F.col(node))).drop("_node", "_component")
