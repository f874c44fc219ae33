"""Joins and set operations over variant tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_record(known: DataFrame) -> DataFrame:
    """The first record (by id) of each contig and position."""
    return known.withColumn("_n", F.row_number().over(Window.partitionBy("chr", "pos").orderBy("id"))).where("_n = 1").drop("_n")


def annotate(calls: DataFrame, known: DataFrame) -> DataFrame:
    """``id`` of the known variant at the same position with the same reference and a common alternative (arrays), else ``.``."""
    k = first_record(known).select("chr", "pos", F.col("ref").alias("_ref"), F.col("alt").alias("_alt"), F.col("id").alias("_id"))
    match = (F.col("ref") == F.col("_ref")) & F.arrays_overlap("alt", "_alt")
    return calls.join(k, ["chr", "pos"], "left").withColumn("id", F.when(match, F.col("_id")).otherwise(".")).drop("_ref", "_alt", "_id")


def provenance(sets: list[DataFrame]) -> DataFrame:
    """(chr, pos, mask): bit i is set where set i holds the position."""
    marked = [s.select("chr", "pos", F.lit(1 << i).alias("bit")) for i, s in enumerate(sets)]
    union = marked[0]
    for other in marked[1:]:
        union = union.unionByName(other)
    return union.groupBy("chr", "pos").agg(F.bit_or("bit").alias("mask"))


def merge_details(left: DataFrame, right: DataFrame, keys: list[str], info: list[str]) -> DataFrame:
    """Left join of two call tables; detail columns get the suffixes A and R."""
    a = left.withColumnsRenamed({c: f"{c}A" for c in info})
    b = right.withColumnsRenamed({c: f"{c}R" for c in info})
    return a.join(b, keys, "left")


def concordance(truth: DataFrame, calls: DataFrame, depth: Column) -> DataFrame:
    """Truth records by verdict: found, zygosity, allele, coverage or missing. Both hold (chr, pos, alt, gt)."""
    c = calls.select("chr", "pos", F.col("alt").alias("_alt"), F.col("gt").alias("_gt"))
    verdict = F.when(F.col("_alt").isNull(), F.when(depth < 8, "coverage").otherwise("missing")).when(F.col("_alt") != F.col("alt"), "allele").when(F.col("_gt") != F.col("gt"), "zygosity").otherwise("found")
    return truth.join(c, ["chr", "pos"], "left").withColumn("verdict", verdict)
