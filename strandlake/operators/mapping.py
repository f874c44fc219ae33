"""Classification and routing of mapped pairs, mapping statistics, store summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = 0x4000000  # positions of a store part
NEAR = 1023  # farthest distance of a pair's mates


def pair_class(mm: Column, only_n: Column, indels: Column) -> Column:
    """p, N, m or g: perfect, only N mismatches, mismatches, gapped."""
    return F.when(indels > 0, "g").when(mm == 0, "p").when(only_n, "N").otherwise("m")


def route(pairs: DataFrame) -> DataFrame:
    """Adds ``family`` (UM unmapped, HM half-mapped, C chimera, M multiple, else the class), ``part`` and ``bucket``.

    Needs chr1, chr2, pos1, pos2 (0: unmapped), klass, n_matches."""
    mapped1, mapped2 = F.col("pos1") > 0, F.col("pos2") > 0
    far = (F.col("chr1") != F.col("chr2")) | (F.abs(F.col("pos1") - F.col("pos2")) > NEAR)
    family = F.when(~mapped1 & ~mapped2, "UM").when(~(mapped1 & mapped2), "HM").when(far, "C").when(F.col("n_matches") > 1, "M").otherwise(F.col("klass"))
    low = F.when(mapped1 & mapped2, F.least("pos1", "pos2")).otherwise(F.greatest("pos1", "pos2"))
    return pairs.withColumn("family", family).withColumn("part", (low / PART).cast("int"))


def chimera_bucket(chr1: Column, chr2: Column, chr_max: int = 24) -> Column:
    """The contig of both mates, or min(distance of contigs, 8) behind the last contig."""
    return F.when(chr1 == chr2, chr1).otherwise(F.least(F.abs(chr1 - chr2), F.lit(8)) + chr_max)


def unmapped_bucket(seq1: Column, seq2: Column) -> Column:
    """The first base of both mates."""
    return F.concat(F.substring(seq1, 1, 1), F.substring(seq2, 1, 1))


def mapping_statistics(pairs: DataFrame) -> DataFrame:
    """Pairs per contig and category (Pair, TooFar), a column per class, with totals."""
    category = F.when(F.abs("delta") > NEAR, "TooFar").otherwise("Pair").alias("category")
    return pairs.groupBy("chr", category).agg(*[F.count_if(F.col("klass") == k).alias(f"n_{k.lower() if k != 'N' else 'only_n'}") for k in "pNmg"], F.count("*").alias("n_total"))
