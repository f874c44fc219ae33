"""Genotype rules of the germline and two-sample callers, as column expressions over counted alleles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ranked_bases(counts: dict[str, Column]) -> Column:
    """array<struct<n, base>> of the four bases, the largest count first, of equals the earlier letter."""
    cells = F.array(*[F.struct(n.cast("long").alias("n"), F.lit(b).alias("base")) for b, n in counts.items()])
    return F.array_sort(cells, lambda a, b: F.when(a["n"] > b["n"], -1).when(a["n"] < b["n"], 1).when(a["base"] < b["base"], -1).when(a["base"] > b["base"], 1).otherwise(0))


def passes(count: Column, total: Column, least: int, percent: int) -> Column:
    """At least ``least`` reads and ``percent`` of the total (integer division)."""
    return (count >= least) & (count >= F.floor(total * percent / 100))


def snp_call(ranked: Column, ref: Column, total: Column, least: int, percent: int) -> Column:
    """struct<gt, alt> or null: 0/1, 1/1 or 1/2 from the two best bases that pass."""
    top, second = ranked[0], ranked[1]
    ok2 = passes(second["n"], total, least, percent)
    call = lambda gt, *alt: F.struct(F.lit(gt).alias("gt"), F.concat_ws(",", *alt).alias("alt"))
    other = F.when(~ok2, call("1/1", top["base"])).when(second["base"] == ref, call("0/1", top["base"])).otherwise(call("1/2", top["base"], second["base"]))
    return F.when(passes(top["n"], total, least, percent), F.when(top["base"] != ref, other).when(ok2, call("0/1", second["base"])))


def differs(plus: Column, minus: Column, depth: Column, other_count: Column, other_depth: Column) -> Column:
    """An allele of one sample that the other lacks: on both strands or in a third of the reads, in 4 reads and 8 percent at least,
    where the other sample has depth 8 and none."""
    n = plus + minus
    spread = ((plus > 1) & (minus > 1)) | (n * 100 >= depth * 33)
    return spread & (n >= 4) & (n * 100 >= depth * 8) & (other_depth >= 8) & (other_count == 0)


def significant(count: Column, depth: Column) -> Column:
    return (depth >= 8) & (count >= 4)
