"""Pile-up of alleles.

Only loci with a mismatch, deletion or insertion are kept. The reference's share comes from strand-wise depth segments that are
looked up at those loci, so reads aren't expanded to bases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.coverage import depth_segments
from strandlake.operators.intervals import overlap_join


def read_spans(pairs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, s, e, rev): mate 1 whole, mate 2 only outside mate 1."""
    e1, e2 = F.expr("pos1 + len1 - 1"), F.expr("pos2 + len2 - 1")
    piece = lambda s, e, rev: F.struct(s.cast("long").alias("s"), e.cast("long").alias("e"), F.col(rev).alias("rev"))
    parts = F.array(piece(F.col("pos1"), e1, "rev1"), piece(F.col("pos2"), F.least(e2, F.col("pos1") - 1), "rev2"), piece(F.greatest(F.col("pos2"), e1 + 1), e2, "rev2"))
    return pairs.select(*keys, F.explode(parts).alias("x")).select(*keys, "x.*").where("s <= e")


def good_runs(quality: Column, least: int) -> Column:
    """array<struct<a, b>> (0-based cycles, inclusive) of the runs of bases with a quality of ``least`` and more; '#' is 0.

    The qualities are split where good ones begin or end, so the fold has a step for a run and not for a base."""
    low = max(ord("#") + least, 33)
    every = F.regexp_extract_all(quality, F.lit(rf"[\x{low:02x}-~]+|[^\x{low:02x}-~]+"), 0)
    none = F.array().cast("array<struct<a: int, b: int>>")

    def step(state: Column, run: Column) -> Column:
        end = state["at"] + F.length(run)
        more = F.concat(state["runs"], F.array(F.struct(state["at"].alias("a"), (end - 1).alias("b"))))
        return F.struct(end.alias("at"), F.when(F.substr(run, F.lit(1), F.lit(1)).between(chr(low), "~"), more).otherwise(state["runs"]).alias("runs"))

    return F.aggregate(every, F.struct(F.lit(0).alias("at"), none.alias("runs")), step)["runs"]


def good_spans(pairs: DataFrame, least: int, keys: tuple[str, ...]) -> DataFrame:
    """(keys, s, e, rev): the bases of both mates with a quality of ``least`` and more, inside the fragment (frag_start, frag_end), of mate 2 only
    those outside mate 1. Runs of bases stay runs: reads aren't expanded to bases."""

    def runs(k: int) -> Column:
        pos, size, rev = F.col(f"pos{k}"), F.col(f"len{k}"), F.col(f"rev{k}")
        place = lambda r: F.struct(F.when(rev, pos + size - 1 - r["b"]).otherwise(pos + r["a"]).alias("s"), F.when(rev, pos + size - 1 - r["a"]).otherwise(pos + r["b"]).alias("e"), rev.alias("rev"))
        return F.transform(f"_runs{k}", place)

    # a column of its own, as the second mate's runs are used twice
    pairs = pairs.withColumns({f"_runs{k}": good_runs(F.col(f"qual{k}"), least) for k in (1, 2)})
    last1 = F.expr("pos1 + len1 - 1")
    left = F.transform(runs(2), lambda r: F.struct(r["s"].alias("s"), F.least(r["e"], F.col("pos1") - 1).alias("e"), r["rev"].alias("rev")))
    right = F.transform(runs(2), lambda r: F.struct(F.greatest(r["s"], last1 + 1).alias("s"), r["e"].alias("e"), r["rev"].alias("rev")))
    every = pairs.select(*keys, "frag_start", "frag_end", F.explode(F.concat(runs(1), left, right)).alias("x"))
    return every.select(*keys, F.greatest("x.s", "frag_start").cast("long").alias("s"), F.least("x.e", "frag_end").cast("long").alias("e"), "x.rev").where("s <= e")


def alleles(events: DataFrame, keys: tuple[str, ...] = ("sample", "chr")) -> DataFrame:
    """Counts by strand of each allele: events (keys, pos, kind M|D|I, allele, rev)."""
    return events.groupBy(*keys, "pos", "kind", "allele").agg(F.count_if(~F.col("rev")).alias("cnt_p"), F.count_if("rev").alias("cnt_m"))


def depth_at(loci: DataFrame, spans: DataFrame, keys: tuple[str, ...] = ("sample", "chr")) -> DataFrame:
    """``loci`` (keys, pos) with the depth by strand: cov_p, cov_m."""
    segments = depth_segments(spans, "s", "e", keys, {"cov_m": F.col("rev")}).withColumn("seg_last", F.col("seg_end") - 1)
    on = F.struct(*keys)
    hits = overlap_join(loci.select(*keys, "pos").distinct().withColumn("_on", on), segments.select(on.alias("_on"), "seg_start", "seg_last", "depth", "cov_m"), "pos", "pos", "seg_start", "seg_last", on="_on")
    found = hits.select(*keys, "pos", (F.col("depth") - F.col("cov_m")).alias("cov_p"), "cov_m")
    return loci.join(found, [*keys, "pos"], "left").na.fill(0, ["cov_p", "cov_m"])
