"""Chromatin contacts: the restriction fragment of each mate and contact multiplicity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.intervals import next_site


def is_contact(same: Column, facing: Column, gap: Column, near: int = 2048) -> Column:
    """Not a plain pair: on one contig, facing each other, 0 <= gap < ``near``."""
    return ~(same & facing & gap.between(0, near - 1))


def few_mismatches(mapq: Column, length: Column, most: int) -> Column:
    """Mismatches as the quality tells them: 254 for none, less in proportion to the read."""
    return (254 - mapq) * length <= most * 254


def with_sites(pairs: DataFrame, sites: DataFrame, mate: int) -> DataFrame:
    """Adds ``site{mate}``: for forward mates the smallest site >= pos + len - 4, for reverse ones the smallest site > pos."""
    at = F.when(F.col(f"rev{mate}"), F.col(f"pos{mate}") + 1).otherwise(F.col(f"pos{mate}") + F.col(f"len{mate}") - 4)
    return next_site(pairs.withColumn("_q", at), sites, "_q", "site", f"site{mate}").drop("_q")


def multiplicity(contacts: DataFrame) -> DataFrame:
    """Site pairs with several distinct contacts."""
    distinct = contacts.select("chr1", "pos1", "site1", "chr2", "pos2", "site2").distinct()
    return distinct.groupBy("chr1", "site1", "chr2", "site2").agg(F.count("*").alias("n")).where("n > 1")
