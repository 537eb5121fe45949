"""Connected components of a table of links, by alternating stars; every round is written to the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm._spark import settle


def components(links: DataFrame) -> DataFrame:
    """node, comp (the least node it is connected with) for the nodes of links (a, b); self-links and nulls are ignored."""
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and u <> v")
    edges, before = settle(pairs.distinct()), None
    while True:
        large = _star(edges.select("u", "v").union(edges.select("v", "u")), F.col("v") > F.col("u"))
        small = _star(large, F.lit(True), own=True)
        edges = settle(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select("v", "v").distinct())
        before = now


def _star(edges: DataFrame, choose, own: bool = False) -> DataFrame:
    """Links the chosen neighbours of each u, and u itself with ``own``, to the least of u and its neighbours."""
    edges = edges.toDF("u", "v")
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    out = edges.filter(choose).join(least, F.col("u") == F.col("w")).select(F.col("v").alias("x"), "m")
    if own:
        out = out.union(least.select("w", "m"))
    return out.filter("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
