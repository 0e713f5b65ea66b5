"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preftable.llm.scratch import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for every node in a link; the label is the smallest node of its component.

    Each round links every node's larger neighbours to its smallest one (large star), then a node's
    smaller neighbours to the smallest (small star); the links end as one star for each component,
    after a number of rounds that is logarithmic in practice. Rounds are written tables; only two
    numbers a round reach the driver. Minima are pre-aggregated, so a node with very many links is
    spread. Null ends and self links are ignored; no links give no rows.
    """
    u, v = F.col(a), F.col(b)
    edges = links.filter(u.isNotNull() & v.isNotNull() & (u != v))
    edges = staged(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = staged(small.select("e.*").filter("u != v").distinct(), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
