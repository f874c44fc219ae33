"""Haplotypes of reads over windows: informative columns, exact groups, merging, and alleles with frequencies."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def informative(bases: DataFrame, percent: int = 10, least: int = 5) -> DataFrame:
    """Alleles of window columns that stay after cleaning: not the reference, ``least`` reads and ``percent`` of the column.

    ``bases``: win, col, read, base ('.' is the reference)."""
    counts = bases.groupBy("win", "col", "base").agg(F.count("*").alias("n"))
    depth = counts.groupBy("win", "col").agg(F.sum("n").alias("depth"))
    return counts.join(depth, ["win", "col"]).where((F.col("base") != ".") & (F.col("n") >= least) & (F.col("n") * 100 >= F.col("depth") * percent)).select("win", "col", "base")


def exact_groups(bases: DataFrame, columns: DataFrame) -> DataFrame:
    """(win, hap, n): reads of equal strings over the informative columns; ' ' where a read doesn't cover one.

    Where a read has several bases in a column the smallest letter counts."""
    kept = columns.select("win", "col").distinct()
    width = kept.groupBy("win").agg(F.array_sort(F.collect_list("col")).alias("cols"))
    single = bases.join(kept, ["win", "col"]).groupBy("win", "read", "col").agg(F.min("base").alias("base"))
    seen = single.groupBy("win", "read").agg(F.map_from_entries(F.collect_list(F.struct("col", "base"))).alias("at"))
    hap = F.array_join(F.transform("cols", lambda c: F.coalesce(F.try_element_at("at", c), F.lit(" "))), "")
    return seen.join(width, "win").groupBy("win", hap.alias("hap")).agg(F.count("*").alias("n"))


def fits(partial: str, whole: str, errors: int = 0) -> bool:
    """Whether the known symbols of ``partial`` agree with ``whole``, but for ``errors`` of them."""
    return sum(a != b and a != " " and b != " " for a, b in zip(partial, whole, strict=True)) <= errors


def merge_groups(groups: Counter, share: float = 0.1) -> Counter:
    """Partly known strings join the one larger group they fit; with more than five columns small groups may differ by one."""

    def step(found: Counter, errors: int, small: float) -> Counter:
        out = Counter(found)
        for hap, n in sorted(found.items(), key=lambda x: (x[1], x[0])):
            if n > small or hap not in out:
                continue
            larger = [h for h, c in out.items() if h != hap and c >= out[hap] and fits(hap, h, errors) and h.count(" ") <= hap.count(" ")]
            if len(larger) == 1:
                out[larger[0]] += out.pop(hap)
        return out

    total = sum(groups.values())
    out = step(groups, 0, total)
    if groups and len(next(iter(groups))) > 5:
        out = step(step(out, 1, share * total), 0, total)
    return out


def call_haplotypes(groups: DataFrame, share: float = 0.1, least: int = 4, samples: bool = False) -> DataFrame:
    """Haplotypes of each window that reach ``share`` of its reads (in any sample, with ``samples``), and what is left over.

    A window is one group: its distinct strings, at most one row per read of the window's few hundred bases."""
    by = ["win", "sample"] if samples else ["win"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        names = sorted(frame["sample"].unique()) if samples else [""]
        sums = {s: Counter(dict(zip(f["hap"], f["n"], strict=True))) for s, f in (frame.groupby("sample") if samples else [("", frame)])}
        merged = {s: merge_groups(c, share) for s, c in sums.items()}
        kept: set[str] = set()
        for s in names:
            total = sum(merged[s].values())
            kept |= {h for h, n in merged[s].items() if total >= least and n >= share * total}
        rows = []
        for s in names:
            total = sum(merged[s].values())
            alleles = sorted(kept, key=lambda h: (-sum(m[h] for m in merged.values()), h))
            own = [i for i, h in enumerate(alleles) if total and merged[s][h] >= share * total]
            trash = total - sum(merged[s][h] for h in alleles)
            rows.append((int(frame["win"].iloc[0]), s, total, ",".join(alleles), ",".join(str(int(merged[s][h])) for h in alleles), "/".join(map(str, own)) or "0", int(trash)))
        return pd.DataFrame(rows, columns=["win", "sample", "n_reads", "haps", "counts", "gt", "trash"])

    return groups.select(*by, "hap", "n").groupBy("win").applyInPandas(run, "win long, sample string, n_reads long, haps string, counts string, gt string, trash long")


def islands(columns: DataFrame) -> DataFrame:
    """(win, at, col, size): runs of neighbouring informative columns; ``at`` is the 0-based place in the window's haplotype strings."""
    order = columns.select("win", "col").distinct().groupBy("win").agg(F.array_sort(F.collect_list("col")).alias("cols"))
    each = order.select("win", F.posexplode("cols").alias("i", "col"))
    return each.groupBy("win", (F.col("col") - F.col("i")).alias("run")).agg(F.min("i").alias("at"), F.min("col").alias("col"), F.count("*").cast("int").alias("size")).drop("run")


def region_calls(called: DataFrame, columns: DataFrame) -> DataFrame:
    """The alleles of each region (a run of informative columns) of the called windows.

    ``called``: win, n_reads, haps and counts as ``call_haplotypes`` gives them. The first two haplotypes give the alleles; columns at the
    region's ends where both are the reference go; a region without any other base gives no row. ``first_col`` is its first column then, ``alleles``
    are the two as strings over its columns, gt is 0 for the reference and else counts the alleles, ad has the reads of the reference and of each
    other allele, over all kept haplotypes. ``freqs`` lists the first ten haplotype shares in hundredths, ``unexplained`` says that a
    later haplotype fits neither of the first two nor the reference."""
    haps = called.select("win", "n_reads", "trash", F.split("haps", ",").alias("h"), F.split("counts", ",").cast("array<long>").alias("n")).where("size(h) > 0 and h[0] <> ''")
    at = haps.join(islands(columns), "win").withColumn("p", F.transform("h", lambda x: F.substr(x, F.col("at") + 1, F.col("size"))))
    first, second = F.col("p")[0], F.coalesce(F.get("p", F.lit(1)), F.col("p")[0])
    letters = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.substr(x, i, F.lit(1)))
    against = lambda x, y: F.exists(F.zip_with(letters(x), letters(y), lambda a, b: (a != b) & (a != " ") & (b != " ")), lambda d: d)
    whole = F.repeat(F.lit("."), F.col("size"))
    at = at.withColumn("unexplained", F.exists(F.slice("p", F.lit(3), F.size("p")), lambda x: against(x, first) & against(x, second) & against(x, whole)))
    both = F.zip_with(letters(first), letters(second), lambda a, b: (a != ".") | (b != "."))
    lead = F.array_position(both, True)
    tail = F.array_position(F.reverse(both), True)
    cut = at.withColumns({"lead": lead, "keep": F.size(both) - lead - tail + 2}).where("lead > 0")
    cut = cut.withColumn("p", F.transform("p", lambda x: F.substr(x, F.col("lead").cast("int"), F.col("keep").cast("int"))))
    plain = F.repeat(F.lit("."), F.col("keep").cast("int"))
    pair = F.array(F.col("p")[0], F.coalesce(F.get("p", F.lit(1)), F.col("p")[0]))
    cut = cut.withColumn("plain", plain).withColumn("pair", pair).withColumn("alts", F.array_except(F.array_distinct("pair"), F.array("plain")))
    index = lambda x: F.array_position("alts", x)
    gt = F.array_join(F.array_sort(F.transform("pair", index)).cast("array<string>"), "/")
    reads = lambda allele: F.aggregate(F.filter(F.arrays_zip("p", "n"), lambda z: z["p"] == allele), F.lit(0).cast("long"), lambda s, z: s + z["n"])
    ad = F.concat(F.array(reads(F.col("plain"))), F.transform("alts", reads))
    freqs = F.array_join(F.transform(F.slice("n", 1, 10), lambda x: F.floor(x * 100 / F.col("n_reads"))).cast("array<string>"), ",")
    return cut.select("win", (F.col("col") + F.col("lead") - 1).alias("first_col"), F.array_join("pair", "/").alias("alleles"), gt.alias("gt"), F.col("n_reads").alias("dp"), F.array_join(ad.cast("array<string>"), ",").alias("ad"), F.size("h").alias("n_haps"), freqs.alias("freqs"), "trash", "unexplained")
