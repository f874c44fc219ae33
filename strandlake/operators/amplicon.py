"""Amplicons: islands of base coverage, their ends, and what varies inside them.

All works on depth segments and changed loci; no island is held in one place or taken apart to positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.coverage import TILE, depth_segments, merged_runs
from strandlake.operators.intervals import overlap_join, with_bins


def base_depth(spans: DataFrame, deletions: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Segments (keys, seg_start, seg_last, depth > 0) of bases: read spans (keys, s, e) without the deleted positions (keys, s, e), which must lie in them."""
    both = spans.select(*keys, "s", "e", F.lit(False).alias("_gone")).unionByName(deletions.select(*keys, "s", "e", F.lit(True).alias("_gone")))
    segments = depth_segments(both, "s", "e", keys, {"gone": F.col("_gone")})
    return segments.select(*keys, "seg_start", (F.col("seg_end") - 1).alias("seg_last"), (F.col("depth") - 2 * F.col("gone")).alias("depth")).where("depth > 0")


def amplicons(segments: DataFrame, keys: tuple[str, ...], least: int = 4, percent: int = 15) -> tuple[DataFrame, DataFrame]:
    """(islands, segments of islands). An island runs until the depth is 0, from where it reaches ``least``; its ends are cut where twice the depth is below
    its top. Islands: keys, isl, max_depth, trim_start, trim_end, min_var: ``percent`` of the depth at the end, 1 at least."""
    on = F.struct(*keys)
    runs = merged_runs(segments.select(*keys, "seg_start", (F.col("seg_last") + 1).alias("seg_end"), F.lit(1).alias("one")), keys, "one")
    held = overlap_join(segments.withColumn("_on", on), runs.select(on.alias("_on"), F.col("run_start").alias("isl"), (F.col("run_end") - 1).alias("_last")), "seg_start", "seg_last", "isl", "_last", on="_on").drop("_on", "_last")
    # what is known of an island meets its segments by tile, as an island may be as long as its contig
    held = with_bins(held, "seg_start", "seg_start", TILE, "tile")
    tops = held.groupBy(*keys, "isl").agg(F.max("seg_start").alias("_ends"), F.max("depth").alias("max_depth"), F.min(F.when(F.col("depth") >= least, F.col("seg_start"))).alias("_opened")).where("_opened is not null")
    high = held.join(with_bins(tops, "isl", "_ends", TILE, "tile"), [*keys, "isl", "tile"]).where("2 * depth >= max_depth and seg_start >= _opened")
    ends = high.groupBy(*keys, "isl").agg(F.first("max_depth").alias("max_depth"), F.min("seg_start").alias("trim_start"), F.max("seg_last").alias("trim_end"), F.max_by("depth", "seg_start").alias("_end"))
    return ends.withColumn("min_var", F.greatest(F.expr(f"_end * {percent} div 100"), F.lit(1))).drop("_end"), held


def variants(segments: DataFrame, mismatches: DataFrame, keys: tuple[str, ...], least: int = 4, percent: int = 15) -> DataFrame:
    """(keys, trim_start, trim_end, max_depth, pos, kind, depth) of the loci inside amplicons that vary; ``mismatches``: (keys, pos, allele, n).

    SNP: two bases or more have min_var reads. DEL: the depth rises by min_var at ``pos``, and somewhere before in the amplicon it has fallen by as much."""
    isles, held = amplicons(segments, keys, least, percent)
    by = [*keys, "isl", "tile"]
    inside = held.join(with_bins(isles, "trim_start", "trim_end", TILE, "tile"), by).where("seg_start <= trim_end and seg_start > trim_start")
    before = held.select(*keys, "isl", (F.col("seg_last") + 1).alias("seg_start"), F.col("depth").alias("_was"))
    steps = inside.join(before, [*keys, "isl", "seg_start"])
    falls = steps.where("depth + min_var <= _was").groupBy(*keys, "isl").agg(F.min("seg_start").alias("_fell"), F.max("trim_end").alias("_ends"))
    gaps = steps.where("depth >= _was + min_var").join(with_bins(falls, "_fell", "_ends", TILE, "tile"), by).where("seg_start > _fell").select(*keys, "trim_start", "trim_end", "max_depth", F.col("seg_start").alias("pos"), F.lit("DEL").alias("kind"), "depth")
    on = F.struct(*keys)
    loci = mismatches.groupBy(*keys, "pos").agg(F.collect_list("n").alias("_others"), F.sum("n").alias("_sum")).withColumn("_on", on)
    at = overlap_join(loci, segments.select(on.alias("_on"), "seg_start", "seg_last", "depth"), "pos", "pos", "seg_start", "seg_last", on="_on")
    at = overlap_join(at.drop("seg_start", "seg_last"), isles.select(on.alias("_on"), "trim_start", "trim_end", "max_depth", "min_var"), "pos", "pos", "trim_start", "trim_end", on="_on")
    many = F.size(F.filter("_others", lambda n: n >= F.col("min_var"))) + (F.col("depth") - F.col("_sum") >= F.col("min_var")).cast("int") > 1
    return gaps.unionByName(at.where(many).select(*keys, "trim_start", "trim_end", "max_depth", "pos", F.lit("SNP").alias("kind"), "depth"))
