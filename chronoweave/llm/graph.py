"""Connected components of a distributed edge list by alternating large-star and small-star steps.

Each step is a grouped minimum and an equi-join; neither a component nor a neighbourhood is
gathered anywhere. Steps are written to the shared folder, so a lost executor costs one step.

A step on few edges is one job of few tasks: planned anew after each of its exchanges, as larger ones are, it would be eight jobs,
each with a thread and plans in the driver's memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UNBROADCAST, settings, tallied

#: Edges of a step that is one job, and of a task of it.
FEW, EACH = 200_000, 10_000


def _planning(spark: SparkSession, edges: int) -> dict[str, str]:
    """Settings for a step over so many edges."""
    if edges > FEW:
        return {}
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-edges // EACH))
    return UNBROADCAST | {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(max(parts, 1))}


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, with their number and a checksum."""
    return tallied(edges, "edges", F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links of comparable nodes -> (node, root): root is the smallest node of the component.

    Nodes without links are absent; self-links and repeated links are allowed; an empty edge list
    gives an empty result.
    """
    kind = edges.schema["a"].dataType
    edges, now = _written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while now[0] and now != before:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), "m"), F.struct("a", "m"))).alias("e"))
        before = now
        with settings(edges.sparkSession, _planning(edges.sparkSession, now[0])):
            edges, now = _written(small.select("e.a", F.col("e.m").alias("b")).where("a <> b").distinct())
    links = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return links.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()).select(F.col("node").cast(kind), F.col("root").cast(kind))
