"""Depth of coverage by sweep.

Fragments are cut at tile borders; each contributes +1 where it begins and -1 behind its end. Events are summed per position before the
shuffle, so a tile's window holds at most one row per position of the tile, whatever the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 1 << 14


def depth_segments(frags: DataFrame, start: str, end: str, keys: tuple[str, ...] = ("chr",), parts: dict[str, Column] | None = None, tile: int = TILE) -> DataFrame:
    """Segments (keys, seg_start, seg_end exclusive, depth) with depth > 0 of inclusive [start, end] fragments.

    ``parts``: name -> condition on a fragment; each adds a depth column of its own. Segments don't cross tiles and
    neighbours may have equal depth."""
    parts = parts or {}
    flags = {"depth": F.lit(1), **{n: c.cast("int") for n, c in parts.items()}}
    cut = frags.where(F.col(start) <= F.col(end)).select(*keys, F.col(start).alias("_s"), (F.col(end) + 1).alias("_e"), *[c.alias(n) for n, c in flags.items()])
    cut = cut.withColumn("_tile", F.explode(F.sequence(F.expr(f"_s div {tile}"), F.expr(f"(_e - 1) div {tile}"))))
    plus = F.struct(F.greatest(F.col("_s"), F.col("_tile") * tile).alias("pos"), F.lit(1).alias("sign"))
    minus = F.struct(F.least(F.col("_e"), (F.col("_tile") + 1) * tile).alias("pos"), F.lit(-1).alias("sign"))
    events = cut.select(*keys, "_tile", F.explode(F.array(plus, minus)).alias("e"), *flags).select(*keys, "_tile", "e.pos", *[(F.col(n) * F.col("e.sign")).alias(n) for n in flags])
    summed = events.groupBy(*keys, "_tile", "pos").agg(*[F.sum(n).alias(n) for n in flags])
    w = Window.partitionBy(*keys, "_tile").orderBy("pos")
    running = [F.sum(n).over(w).alias(n) for n in flags]
    return summed.select(*keys, F.col("pos").alias("seg_start"), F.lead("pos").over(w).alias("seg_end"), *running).where("depth > 0 and seg_end is not null")


def merged_runs(segments: DataFrame, keys: tuple[str, ...] = ("chr",), value: str = "depth", tile: int = TILE) -> DataFrame:
    """Touching segments of equal ``value`` joined (run-length encoding): keys, run_start, run_end (exclusive), value.

    Runs are built inside tiles first; only the runs at tile borders, few per tile, are joined across. A run's end is that of the row before the
    next run begins, so nothing is held but the rows of a tile in order."""
    def runs(df: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("seg_start")
        marked = df.withColumn("_before", F.lag("seg_end").over(w)).withColumn("_value", F.lag(value).over(w)).withColumn("_last", F.max("seg_end").over(Window.partitionBy(*by)))
        new = F.coalesce((F.col("_before") != F.col("seg_start")) | (F.col("_value") != F.col(value)), F.lit(True))
        return marked.where(new).select(*by, "seg_start", F.coalesce(F.lead("_before").over(w), "_last").alias("seg_end"), value)

    inner = runs(segments.withColumn("_tile", F.expr(f"seg_start div {tile}")), [*keys, "_tile"])
    border = (F.col("seg_start") % tile == 0) | (F.col("seg_end") % tile == 0)
    inner = inner.withColumn("_border", border)
    across = runs(inner.where("_border").drop("_tile", "_border"), list(keys))
    done = inner.where("not _border").select(*keys, "seg_start", "seg_end", value).unionByName(across.select(*keys, "seg_start", "seg_end", value))
    return done.withColumnsRenamed({"seg_start": "run_start", "seg_end": "run_end"})


def depth_quartiles(segments: DataFrame, keys: tuple[str, ...] = ("chr",), clamp: int = 65535) -> DataFrame:
    """Covered bases and quartiles of depth by index: the first depth whose cumulative count reaches n div 4, n div 2 and
    3 n div 4 (0 where that is 0), from a histogram clamped at ``clamp``; the maximum isn't clamped."""
    histogram = segments.groupBy(*keys, F.least("depth", F.lit(clamp)).alias("depth")).agg(F.sum(F.expr("seg_end - seg_start")).alias("bases"), F.max("depth").alias("top"))
    w = Window.partitionBy(*keys)
    cum = histogram.withColumn("cum", F.sum("bases").over(w.orderBy("depth"))).withColumn("n", F.sum("bases").over(w))
    pick = lambda mark, name: F.when(F.expr(f"first(n) {mark}") == 0, 0).otherwise(F.min(F.when(F.col("cum") >= F.expr(f"n {mark}"), F.col("depth")))).alias(name)
    return cum.groupBy(*keys).agg(F.first("n").alias("covered"), pick("div 4", "q25"), pick("div 2", "median"), pick("* 3 div 4", "q75"), F.max("top").alias("max_depth"))


def windowed(segments: DataFrame, width: int, step: int, values: list[str], keys: tuple[str, ...] = ("chr",)) -> DataFrame:
    """Complete sliding windows [w, w + width) from position 1 in steps: max and integer mean of each depth column."""
    cut = segments.withColumn("win", F.explode(F.sequence(F.expr(f"greatest((seg_start - {width}) div {step}, 0)"), F.expr(f"(seg_end - 2) div {step}")))).withColumn("win", F.col("win") * step + 1)
    cut = cut.withColumn("bases", F.least("seg_end", F.col("win") + width) - F.greatest("seg_start", "win")).where("bases > 0")
    aggs = [x for v in values for x in (F.max(v).alias(f"max_{v}"), F.expr(f"sum({v} * bases) div {width}").alias(f"mean_{v}"))]
    return cut.groupBy(*keys, "win").agg(*aggs)
