"""Connected components by alternating star contractions, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairloom.operators.storage import cut


def _summary(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Columns node, component: the smallest node that can be reached, for every node of a link.

    Neighbourhoods are never gathered: each contraction is a grouped minimum joined back to the links, so a
    node with very many neighbours is split by adaptive execution like any skewed join. Null ends, loops and
    repeated links change nothing; without links the result is empty.
    """
    edges = (
        links.select(F.col(a).alias("x"), F.col(b).alias("y"))
        .where("x is not null and y is not null")
        .select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
        .distinct()
    )
    nodes = edges.select("u").union(edges.select("v")).distinct().select(F.col("u").alias("node"))
    edges = cut(edges.where("u <> v"))
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        edges = cut(small)
        after = _summary(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return nodes.join(edges, nodes["node"] == edges["u"], "left").select("node", F.coalesce("v", "node").alias("component"))
