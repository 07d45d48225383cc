"""Connected components of a link table, as Spark joins (large star / small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcards.llm.storage import cut, drop


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``links (a, b)`` long -> ``(node, component)``, component = smallest node.

    Every node of a link is returned; self links and repeated links are
    allowed; an empty table gives an empty one.  Alternates large-star and
    small-star rounds until nothing changes (logarithmic in practice).  The
    smallest neighbour comes from a map-side combined aggregate and is joined
    back, so a node with a third of all links is a skewed join side that AQE
    splits, never one group in one task.  Only two numbers per round reach the
    driver."""
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .where("a != b").distinct(), name)
    seen = None
    apart = (F.col("a") + F.lit(0)).alias("a")   # dealt anew, so that AQE may split the join's hot nodes
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).select(apart, "m")
        large = (both.join(low, "a").where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low.select(apart, "m"), "a").where("b != m")
                 .select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).where("a != b").distinct())
        nxt = cut(small, name)
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(edges)
        edges = nxt
        if now == seen:
            break
        seen = now
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = out.unionByName(out.select(F.col("component").alias("node"), "component").distinct())
    out._shared_path = edges._shared_path
    return out
