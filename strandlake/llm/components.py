"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two group-wise minima (combined before the shuffle) and two joins of written tables,
which adaptive execution can split where a hub has many edges. Only one checksum row reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import drop_path, stage


def _minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame, made: list[str]) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = stage(_minimum(both), "cc-low", made)
    return both.join(low, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, made: list[str]) -> DataFrame:
    low = stage(_minimum(edges), "cc-low", made)
    joined = edges.join(low, F.col("u") == F.col("k"))
    return joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u long, v long), any direction, repeats and loops allowed.

    Returns (node, component) for every node that has an edge to another node; ``component`` is the smallest
    node reachable. Nodes without such an edge aren't listed. Nulls are ignored.
    """
    spark, made = edges.sparkSession, []
    known = edges.where("u is not null and v is not null and u <> v")
    current = stage(known.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges", made)
    seen = None
    while True:
        large = stage(_large_star(current, made), "cc-large", made)
        current = stage(_small_star(large, made), "cc-small", made)
        for path in made[:-1]:  # only the last table is read from here on
            drop_path(spark, path)
        del made[:-1]
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
