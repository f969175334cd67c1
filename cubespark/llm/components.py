"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubespark.llm.common import discard, saved

#: A node's edges are dealt over so many tasks.
SALTS = 256


def with_least(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with low, the least b of each a.

    Minima are taken of a's edges in salted parts, then of the parts, and come back the same way: a hub with a third of
    all edges costs a task at most its share of them and SALTS partial minima.
    """
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("a", "salt").agg(F.min("b").alias("low"))
    least = parts.groupBy("a").agg(F.min("low").alias("low"))
    return salted.join(parts.select("a", "salt").join(least, "a"), ["a", "salt"]).select("a", "b", "low")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) of every node that is not the smallest of its component; edges has columns a and b.

    Each step is written to the shared folder; only a count and a checksum of the edges reach the driver. Repeated edges
    and loops change nothing; edges with a null end are left out; an empty table gives no rows.
    """
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("low", "a").alias("b")).where("a <> b").distinct()
        # a is the larger end of each edge now
        small = with_least(large).select(F.explode(F.array(F.struct("b", "low"), F.struct(F.col("a").alias("b"), "low"))).alias("e"))
        last, edges = edges, saved(small.select(F.col("e.b").alias("a"), F.col("e.low").alias("b")).where("a <> b").distinct(), "edges")
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == now:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out.saved_path = edges.saved_path
    return out
