"""Pair filters of the callers and coverage tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def well_behaved(limit: int = 1034) -> Column:
    """Pairs closer than ``limit`` (0: no limit) whose mates lie on different strands."""
    near = F.abs("delta") < limit if limit else F.lit(True)
    return near & (F.col("rev1") != F.col("rev2"))


def on_contig(pairs: DataFrame, contigs: DataFrame) -> DataFrame:
    """Pairs with both mates at 1..contig length.

    The dictionary has a row per contig and is sent to the tasks: a join by ``chr`` would deal all pairs out by contig, and what follows by
    contig and tile would stay so, a contig in one task."""
    inside = F.col("pos1").between(1, F.col("contig_len")) & F.col("pos2").between(1, F.col("contig_len"))
    return pairs.join(F.broadcast(contigs), "chr").where(inside)


def fragments(pairs: DataFrame) -> DataFrame:
    """Inserts as inclusive [frag_start, frag_end], from the leftmost base to the last of the right mate."""
    left = F.least("pos1", "pos2")
    return pairs.withColumn("frag_start", left).withColumn("frag_end", F.when(F.col("pos1") <= F.col("pos2"), F.col("pos2") + F.col("len2")).otherwise(F.col("pos1") + F.col("len1")) - 1)


#: The order of mapped pairs within a store, made total by the input's own keys.
PAIR_ORDER = ["lo", "hi", "umi", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"]


def with_order_keys(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("lo", F.least("pos1", "pos2")).withColumn("hi", F.greatest("pos1", "pos2"))


def mark_clones(pairs: DataFrame, use_umi: bool = True, scope: tuple[str, ...] = ("sample", "chr", "klass"), tile: int = 1 << 14) -> DataFrame:
    """Adds ``is_clone``: the previous row of the order has the same positions (mates may be swapped) and, with
    ``use_umi``, a UMI that differs in one base at most. The previous row counts even if it is a clone itself.

    Equal positions share a tile of ``lo``, so the window is per tile and not per contig."""
    w = Window.partitionBy(*scope, "tile").orderBy(*PAIR_ORDER)
    keyed = with_order_keys(pairs).withColumn("tile", F.expr(f"lo div {tile}"))
    same = (F.lag("lo").over(w) == F.col("lo")) & (F.lag("hi").over(w) == F.col("hi"))
    if use_umi:
        before = F.lag("umi").over(w)
        differ = F.filter(F.sequence(F.lit(1), F.greatest(F.length("umi"), F.length(before), F.lit(1))), lambda i: F.substr("umi", i, F.lit(1)) != F.substr(before, i, F.lit(1)))
        same &= F.size(differ) <= 1
    return keyed.withColumn("is_clone", F.coalesce(same, F.lit(False))).drop("tile")


def few_indels(cigar: Column, longest: int = 40, most: int = 2) -> Column:
    """No indel longer than ``longest`` and at most ``most`` of them; ``cigar`` is array<struct<n, op>>."""
    indels = F.filter(cigar, lambda x: x["op"].isin("I", "D"))
    return ~F.exists(indels, lambda x: x["n"] > longest) & (F.size(indels) <= most)


def ordinal_sample(ordinal: Column, modulus: int, remainders: list[int]) -> Column:
    """The sampling operator: rows whose ordinal modulo ``modulus`` is one of ``remainders``."""
    if not 2 <= modulus <= 65536:
        raise ValueError("modulus must be 2..65536")
    return (ordinal % modulus).isin(remainders)


def ranked(rows: DataFrame, by: list[str], tile: Column, order: list[str]) -> DataFrame:
    """Adds ``rank`` from 1 in ``order`` within ``by``. ``tile`` must not fall along ``order``: rows are numbered within a tile and the
    rows of the tiles before are added, so no window holds all rows of a group."""
    tiled = rows.withColumn("_tile", tile)
    sizes = tiled.groupBy(*by, "_tile").agg(F.count("*").alias("_n"))
    before = sizes.select(*by, "_tile", (F.sum("_n").over(Window.partitionBy(*by).orderBy("_tile")) - F.col("_n")).alias("_before"))
    number = F.row_number().over(Window.partitionBy(*by, "_tile").orderBy(*order))
    return tiled.withColumn("_k", number).join(before, [*by, "_tile"]).withColumn("rank", F.col("_before") + F.col("_k")).drop("_tile", "_k", "_before")


#: The letters that choose classes and families of a store.
CHOICES = {"p": "p", "m": "m", "n": "N", "a": "g", "u": "UM", "h": "HM", "c": "C"}


def chosen(family: Column, letters: str) -> Column:
    """Whether a pair's family is one of those that the letters choose (p perfect, m mismatches, n only N, a gaps, u unmapped, h half-mapped,
    c chimeric)."""
    return family.isin([CHOICES[x] for x in letters])
