"""Call files of two samples, and call files held against a pile-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.pileup import depth_at


def quality_at(quality: Column, cycle: Column) -> Column:
    """Quality of a base by its 0-based cycle; '#' is 0."""
    return F.ascii(F.substr(quality, cycle + 1, F.lit(1))) - ord("#")


def genotype(cells: Column) -> Column:
    """``0/1`` of array<struct<o (count, negative), i (allele), ok>>, the largest count first: the two best if the second is called, else
    the best twice if it is called, else 0/0."""
    a, b = cells[0], cells[1]
    pair = lambda x, y: F.concat(x.cast("string"), F.lit("/"), y.cast("string"))
    return F.when(b["ok"], pair(F.least(a["i"], b["i"]), F.greatest(a["i"], b["i"]))).when(a["ok"], pair(a["i"], a["i"])).otherwise("0/0")


def two_sample_lines(rows: DataFrame, samples: tuple[str, str], percent: int) -> DataFrame:
    """(chr, pos, line): one line a locus of two samples with all alleles that either calls.

    ``rows``: chr, pos, ref, allele, and for each sample s: s (reads of the allele), s_ref, s_ok, s_ref_ok. A line is SOMATIC where the first
    sample calls anything and an allele that the second calls has at most ``percent`` of its share in the first. The alleles of a locus
    are four bases at most."""
    first, second = samples
    al = F.array_sort(F.collect_list(F.struct("allele", *[c for s in samples for c in (s, f"{s}_ok")])))
    at = rows.groupBy("chr", "pos", "ref", *[c for s in samples for c in (f"{s}_ref", f"{s}_ref_ok")]).agg(al.alias("al"))
    def total(s: str) -> Column:
        return F.col(f"{s}_ref") + F.aggregate("al", F.lit(0).cast("long"), lambda t, x: t + x[s])

    def cell(s: str) -> Column:
        own = F.transform("al", lambda x, i: F.struct((-x[s]).alias("o"), (i + 1).alias("i"), x[f"{s}_ok"].alias("ok")))
        ranked = F.array_sort(F.concat(F.array(F.struct((-F.col(f"{s}_ref")).alias("o"), F.lit(0).alias("i"), F.col(f"{s}_ref_ok").alias("ok"))), own))
        depths = F.concat_ws(",", F.col(f"{s}_ref").cast("string"), F.transform("al", lambda x: x[s].cast("string")))
        return F.concat_ws(":", genotype(ranked), F.col(f"{s}_total").cast("string"), depths)

    at = at.withColumns({f"{s}_total": total(s) for s in samples})
    anything = F.col(f"{first}_ref_ok") | F.exists("al", lambda x: x[f"{first}_ok"])
    rare = F.exists("al", lambda x: x[f"{second}_ok"] & (x[first] <= F.floor(F.floor(x[second] * F.col(f"{first}_total") / F.col(f"{second}_total")) * percent / 100)))
    cells = [cell(s) for s in samples]
    text = [F.concat(F.lit("chr"), F.col("chr").cast("string")), F.col("pos").cast("string"), F.lit("."), F.col("ref"), F.array_join(F.transform("al", lambda x: x["allele"]), ","), F.lit("."), F.lit("PASS"), F.when(anything & rare, "SOMATIC").otherwise("."), F.lit("GT:DP:AD"), *cells]
    return at.select("chr", "pos", F.concat_ws("\t", *text).alias("line"))


def validate(records: DataFrame, found: DataFrame, spans: DataFrame, sample: str, percent: int) -> DataFrame:
    """Call records held against the pile-up of ``sample``: the verdict on the genotype's alleles, the second first.

    ``records``: chr, pos, type, gt, alts (bases, or D with a length, or I with bases), locus, base (of the reference there). ``found``: alleles of
    the pile-up (sample, chr, pos, kind, allele, cnt_p, cnt_m), ``spans``: its reads. An allele's reads must reach ``percent`` of all that
    the locus has. The alleles of a locus make one map."""
    named = found.select("chr", F.col("pos").alias("locus"), F.when(F.col("kind") == "M", F.col("allele")).otherwise(F.concat("kind", "allele")).alias("name"), "kind", (F.col("cnt_p") + F.col("cnt_m")).alias("n"))
    pile = named.groupBy("chr", "locus").agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("has"), F.sum(F.when(F.col("kind") == "M", F.col("n")).otherwise(0)).alias("mm"), F.sum(F.when(F.col("kind") != "M", F.col("n")).otherwise(0)).alias("indels"))
    loci = records.select(F.lit(sample).alias("sample"), "chr", F.col("locus").alias("pos")).distinct()
    depth = depth_at(loci, spans).select("chr", F.col("pos").alias("locus"), (F.col("cov_p") + F.col("cov_m")).alias("depth"))
    rows = records.join(depth, ["chr", "locus"], "left").join(pile, ["chr", "locus"], "left").na.fill(0, ["depth", "mm", "indels"])
    rows = rows.withColumn("n_seen", F.col("depth") + F.col("indels")).withColumn("least", F.floor(F.col("n_seen") * percent / 100))
    reads = lambda name: F.when(name == F.col("base"), F.coalesce(F.try_element_at("has", name), F.lit(0)) + F.col("depth") - F.col("mm")).when(F.length(name) == 1, F.coalesce(F.try_element_at("has", name), F.lit(0))).otherwise(F.try_element_at("has", name))
    a, b = (F.split("gt", "/")[k].cast("int") for k in (0, 1))
    first, second = reads(F.when(a == 0, F.col("base")).otherwise(F.try_element_at("alts", F.greatest(a, F.lit(1))))), reads(F.try_element_at("alts", F.greatest(b, F.lit(1))))
    said = lambda n, k: F.when(n.isNull(), F.concat("type", F.lit(f"_NOT_FOUND_GT_{k}"))).when(n < F.col("least"), f"MAF_THRESHOLD_GT_{k}")
    marks = F.concat_ws(" ", said(second, 2), F.when(a != b, said(first, 1)))
    verdict = F.when(F.col("n_seen") == 0, "NO_COVERAGE").when(F.col("has").isNull(), "VARIANT_NOT_FOUND").when(marks == "", "EXTRA_VARIANT").otherwise(marks)
    return rows.select("chr", "pos", "type", "gt", F.col("alts")[0].alias("alt"), "n_seen", verdict.alias("verdict"))
