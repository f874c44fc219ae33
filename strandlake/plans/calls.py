"""Pile-up, germline and two-sample calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import amplicon
from strandlake.operators.calling import differs, passes, ranked_bases, significant, snp_call
from strandlake.operators.coverage import depth_segments
from strandlake.operators.filters import well_behaved
from strandlake.operators.intervals import overlap_join
from strandlake.operators.pileup import alleles, depth_at, read_spans
from strandlake.plans.registry import query
from strandlake.sources import views as v

LEAST, PERCENT = 2, 8
KEYS = ("sample", "chr")


def _pairs(spark: SparkSession, sf_dir: str, deep: bool = False) -> DataFrame:
    return v.aln(spark, sf_dir, duplicates=not deep, deep=deep).where(well_behaved())


def _events(pairs: DataFrame) -> DataFrame:
    """Mismatches (classes m and g), deletions and insertions (class g) of mate 1."""
    mm = pairs.where("klass in ('m', 'g')").select(*KEYS, F.expr("pos1 + mm_off").alias("pos"), F.lit("M").alias("kind"), F.col("mm_nt").alias("allele"), F.col("rev1").alias("rev")).where(F.col("allele") != v.base_at())
    gap = pairs.where("klass = 'g'").select(*KEYS, F.expr("pos1 + mm_off + 1").alias("pos"), F.expr("case when is_del then 'D' else 'I' end").alias("kind"), F.expr("case when is_del then cast(l_linenumber as string) else repeat(mm_nt, cast(l_linenumber % 3 + 1 as int)) end").alias("allele"), F.col("rev1").alias("rev"))
    return mm.unionByName(gap)


BASE = f"""with {v.ALN_DUP}, f as (select * from aln where abs(delta) < 1034 and rev1 <> rev2),
spans as (select * from (select sample, chr, pos1 as s, pos1 + len1 - 1 as e, rev1 as rev from f union all select sample, chr, pos2, least(pos2 + len2 - 1, pos1 - 1), rev2 from f union all select sample, chr, greatest(pos2, pos1 + len1), pos2 + len2 - 1, rev2 from f) where s <= e),
deep as (select sample, chr, pos, count(*) filter (not rev) as cov_p, count(*) filter (rev) as cov_m from (select sample, chr, rev, unnest(range(s, e + 1)) as pos from spans) group by 1, 2, 3),
evt as (select * from (select sample, chr, pos1 + mm_off as pos, 'M' as kind, mm_nt as allele, rev1 as rev from f where klass in ('m', 'g')) where allele <> {v.base_sql()}
  union all select sample, chr, pos1 + mm_off + 1, case when is_del then 'D' else 'I' end, case when is_del then cast(l_linenumber as varchar) else repeat(mm_nt, cast(l_linenumber % 3 + 1 as int)) end, rev1 from f where klass = 'g'),
al as (select sample, chr, pos, kind, allele, count(*) filter (not rev) as cnt_p, count(*) filter (rev) as cnt_m from evt group by all)"""
DEEP = BASE.replace(v.ALN_DUP, v.ALN_DEEP)
LOCI = """, b as (select sample, chr, pos, sum(cnt_p + cnt_m) as mm, sum(case when allele = 'A' then cnt_p + cnt_m else 0 end) as a, sum(case when allele = 'C' then cnt_p + cnt_m else 0 end) as c, sum(case when allele = 'G' then cnt_p + cnt_m else 0 end) as g, sum(case when allele = 'T' then cnt_p + cnt_m else 0 end) as t from al where kind = 'M' group by 1, 2, 3),
loc as (select b.sample, b.chr, b.pos, {base} as ref, cast(cov_p + cov_m as bigint) as total, cast(a + case when {base} = 'A' then cov_p + cov_m - mm else 0 end as bigint) as n_a, cast(c + case when {base} = 'C' then cov_p + cov_m - mm else 0 end as bigint) as n_c,
  cast(g + case when {base} = 'G' then cov_p + cov_m - mm else 0 end as bigint) as n_g, cast(t + case when {base} = 'T' then cov_p + cov_m - mm else 0 end as bigint) as n_t from b join deep using (sample, chr, pos)),
rk as (select *, list_sort([(-n_a, 'A'), (-n_c, 'C'), (-n_g, 'G'), (-n_t, 'T')]) as r from loc)""".replace("{base}", v.base_sql("b.chr", "b.pos"))


@query(BASE + " select al.*, coalesce(cov_p, 0) as cov_p, coalesce(cov_m, 0) as cov_m from al left join deep using (sample, chr, pos) where kind = 'M'")
def pileup_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mismatch alleles by strand with the depth of their locus."""
    pairs = _pairs(spark, sf_dir)
    found = alleles(_events(pairs)).where("kind = 'M'")
    return depth_at(found, read_spans(pairs, KEYS))


@query(BASE + " select * from al where kind <> 'M'")
def indel_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletions by length and insertions by inserted bases; equal insertions are pooled."""
    return alleles(_events(_pairs(spark, sf_dir))).where("kind <> 'M'")


def _loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the four bases at each locus with a mismatch."""
    found = pileup_alleles(spark, sf_dir).withColumn("n", F.col("cnt_p") + F.col("cnt_m"))
    sums = [F.sum(F.when(F.col("allele") == x, F.col("n")).otherwise(0)).alias(f"n_{x.lower()}") for x in "ACGT"]
    loci = found.groupBy(*KEYS, "pos").agg(F.first(F.col("cov_p") + F.col("cov_m")).alias("total"), F.sum("n").alias("mm"), *sums).withColumn("ref", v.base_at())
    for x in "ACGT":
        loci = loci.withColumn(f"n_{x.lower()}", F.col(f"n_{x.lower()}") + F.when(F.col("ref") == x, F.col("total") - F.col("mm")).otherwise(0))
    return loci.drop("mm").withColumn("ranked", ranked_bases({x: F.col(f"n_{x.lower()}") for x in "ACGT"}))


@query(BASE + LOCI + """ select sample, chr, pos, ref, total, r[1][2] as base1, -r[1][1] as n1, r[2][2] as base2, -r[2][1] as n2, r[3][2] as base3, r[4][2] as base4, r[1][1] = r[2][1] as tie from rk where -r[1][1] >= 2""")
def base_rank_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four bases of each locus by count, with a flag for a tie of the best two."""
    r = F.col("ranked")
    return _loci(spark, sf_dir).select("sample", "chr", "pos", "ref", "total", r[0]["base"].alias("base1"), r[0]["n"].alias("n1"), r[1]["base"].alias("base2"), r[1]["n"].alias("n2"), r[2]["base"].alias("base3"), r[3]["base"].alias("base4"), (r[0]["n"] == r[1]["n"]).alias("tie")).where("n1 >= 2")


SNPS = f"""select sample, chr, pos, ref, total, case when r[1][2] = ref then '0/1' when not ok2 then '1/1' when r[2][2] = ref then '0/1' else '1/2' end as gt,
  case when r[1][2] = ref then r[2][2] when not ok2 or r[2][2] = ref then r[1][2] else r[1][2] || ',' || r[2][2] end as alt
from (select *, -r[1][1] >= {LEAST} and -r[1][1] >= total * {PERCENT} // 100 as ok1, -r[2][1] >= {LEAST} and -r[2][1] >= total * {PERCENT} // 100 as ok2 from rk) where ok1 and (r[1][2] <> ref or ok2)"""


@query(BASE + LOCI + " " + SNPS)
def germline_snp_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-base calls: 0/1, 1/1 or 1/2."""
    return _loci(spark, sf_dir).withColumn("call", snp_call(F.col("ranked"), F.col("ref"), F.col("total"), LEAST, PERCENT)).where("call is not null").select("sample", "chr", "pos", "ref", "total", "call.gt", "call.alt")


@query(
    BASE
    + f""", w as (select al.*, cnt_p + cnt_m as n, coalesce(cov_p + cov_m, 0) as total from al left join deep using (sample, chr, pos) where kind <> 'M')
select sample, chr, pos - 1 as pos, kind, allele, n, cast(total as bigint) as total, cast(case when kind = 'I' then greatest(total - n, 0) else total end as bigint) as ref_n,
  case when kind = 'D' then case when total >= {LEAST} and total >= (total + n) * {PERCENT} // 100 then '0/1' else '1/1' end else case when greatest(total - n, 0) >= {LEAST} and greatest(total - n, 0) >= total * {PERCENT} // 100 then '0/1' else '1/1' end end as gt
from w where n >= {LEAST} and n >= total * {PERCENT} // 100"""
)
def germline_indel_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletions and insertions with genotype; the row stands at the base before, an insertion's reads don't count for the reference."""
    pairs = _pairs(spark, sf_dir)
    found = depth_at(alleles(_events(pairs)).where("kind <> 'M'"), read_spans(pairs, KEYS)).withColumn("n", F.col("cnt_p") + F.col("cnt_m")).withColumn("total", F.col("cov_p") + F.col("cov_m"))
    ref_n = F.when(F.col("kind") == "I", F.greatest(F.col("total") - F.col("n"), F.lit(0))).otherwise(F.col("total"))
    both = passes(ref_n, F.when(F.col("kind") == "D", F.col("total") + F.col("n")).otherwise(F.col("total")), LEAST, PERCENT)
    return found.where(passes(F.col("n"), F.col("total"), LEAST, PERCENT)).select("sample", "chr", (F.col("pos") - 1).alias("pos"), "kind", "allele", "n", "total", ref_n.alias("ref_n"), F.when(both, "0/1").otherwise("1/1").alias("gt"))


TWO = """, two as (select chr, pos, kind, allele, cast(sum(case when sample = 'T' then cnt_p else 0 end) as bigint) as t_p, cast(sum(case when sample = 'T' then cnt_m else 0 end) as bigint) as t_m, cast(sum(case when sample = 'N' then cnt_p else 0 end) as bigint) as n_p, cast(sum(case when sample = 'N' then cnt_m else 0 end) as bigint) as n_m from al group by 1, 2, 3, 4),
d2 as (select chr, pos, cast(sum(case when sample = 'T' then cov_p + cov_m else 0 end) as bigint) as t_depth, cast(sum(case when sample = 'N' then cov_p + cov_m else 0 end) as bigint) as n_depth from deep group by 1, 2),
j as (select two.*, coalesce(t_depth, 0) as t_depth, coalesce(n_depth, 0) as n_depth from two left join d2 using (chr, pos))"""


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alleles of both samples side by side: one grouping by locus and allele instead of a full outer join."""
    pairs = _pairs(spark, sf_dir, deep=True)
    part = lambda s, c: F.sum(F.when(F.col("sample") == s, F.col(c)).otherwise(0)).alias(f"{s.lower()}_{c[-1]}")
    both = alleles(_events(pairs)).groupBy("chr", "pos", "kind", "allele").agg(part("T", "cnt_p"), part("T", "cnt_m"), part("N", "cnt_p"), part("N", "cnt_m"))
    loci = overlap_join(both, _sample_segments(pairs), "pos", "pos", "seg_start", "seg_last").select("chr", "pos", "kind", "allele", "t_depth", "n_depth")
    return both.join(loci, ["chr", "pos", "kind", "allele"], "left").na.fill(0, ["t_depth", "n_depth"])


def _sample_segments(pairs: DataFrame) -> DataFrame:
    """Depth segments with a column per sample."""
    spans = read_spans(pairs, KEYS)
    segments = depth_segments(spans, "s", "e", ("chr",), {"t_depth": F.col("sample") == "T", "n_depth": F.col("sample") == "N"})
    return segments.withColumn("seg_last", F.col("seg_end") - 1)


DIFF = "((({a}_p > 1 and {a}_m > 1) or ({a}_p + {a}_m) * 100 >= {a}_depth * 33) and {a}_p + {a}_m >= 4 and ({a}_p + {a}_m) * 100 >= {a}_depth * 8 and {b}_depth >= 8 and {b}_p + {b}_m = 0)"


@query(DEEP + TWO + f" select *, {DIFF.format(a='t', b='n')} as only_t, {DIFF.format(a='n', b='t')} as only_n from j where {DIFF.format(a='t', b='n')} or {DIFF.format(a='n', b='t')}")
def paired_diff_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alleles that one of the two samples has and the other lacks."""
    c = F.col
    only_t = differs(c("t_p"), c("t_m"), c("t_depth"), c("n_p") + c("n_m"), c("n_depth"))
    only_n = differs(c("n_p"), c("n_m"), c("n_depth"), c("t_p") + c("t_m"), c("t_depth"))
    return _two(spark, sf_dir).withColumn("only_t", only_t).withColumn("only_n", only_n).where("only_t or only_n")


@query(
    DEEP
    + TWO
    + f""" select chr, pos, kind, t_depth, n_depth, string_agg(allele, ',' order by t_p + t_m desc, allele) as alts, string_agg(cast(t_p + t_m as varchar), ',' order by t_p + t_m desc, allele) as t_ad, string_agg(cast(n_p + n_m as varchar), ',' order by t_p + t_m desc, allele) as n_ad,
  bool_or(t_p + t_m >= {LEAST} and t_p + t_m >= t_depth * {PERCENT} // 100 and n_p + n_m <= n_depth * 1 // 100 and n_depth >= 8) as somatic
from j where (t_depth >= 8 and t_p + t_m >= 4) or (n_depth >= 8 and n_p + n_m >= 4) group by chr, pos, kind, t_depth, n_depth"""
)
def paired_somatic_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loci with an allele that is significant in a sample: allele depths of both, and whether a called allele is somatic."""
    two = _two(spark, sf_dir).withColumn("t", F.col("t_p") + F.col("t_m")).withColumn("n", F.col("n_p") + F.col("n_m"))
    two = two.where(significant(F.col("t"), F.col("t_depth")) | significant(F.col("n"), F.col("n_depth")))
    somatic = passes(F.col("t"), F.col("t_depth"), LEAST, PERCENT) & (F.col("n") <= F.floor(F.col("n_depth") / 100)) & (F.col("n_depth") >= 8)
    cells = F.array_sort(F.collect_list(F.struct((-F.col("t")).alias("o"), "allele", "t", "n")))
    text = lambda f: F.array_join(F.transform("cells", lambda x: x[f].cast("string")), ",")
    out = two.groupBy("chr", "pos", "kind", "t_depth", "n_depth").agg(cells.alias("cells"), F.bool_or(somatic).alias("somatic"))
    return out.select("chr", "pos", "kind", "t_depth", "n_depth", text("allele").alias("alts"), text("t").alias("t_ad"), text("n").alias("n_ad"), "somatic")


@query(DEEP + TWO + " select chr, count(*) as n_covered, count(*) filter (t_depth >= 8 and n_depth >= 8) as n_callable, cast(count(*) filter (t_depth >= 8 and n_depth >= 8) * 10000 // count(*) as bigint) as callable_x10000 from d2 group by chr")
def callable_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that any sample covers, and those with depth 8 in both."""
    size = F.expr("seg_end - seg_start")
    out = _sample_segments(_pairs(spark, sf_dir, deep=True)).groupBy("chr").agg(F.sum(size).alias("n_covered"), F.sum(F.when(F.expr("t_depth >= 8 and n_depth >= 8"), size).otherwise(0)).alias("n_callable"))
    return out.withColumn("callable_x10000", F.expr("n_callable * 10000 div n_covered"))


@query(
    BASE
    + LOCI
    + f""", calls as ({SNPS}), c2 as (select chr, pos from calls group by chr, pos having count(*) = 2),
w as (select c2.chr, c2.pos, o, c2.pos + o as at from c2, range(-60, 61) as x(o))
select w.chr, w.pos, w.o as shift, cast(coalesce(sum(cov_p), 0) as bigint) as cov_p, cast(coalesce(sum(cov_m), 0) as bigint) as cov_m from w left join deep on deep.chr = w.chr and deep.pos = w.at group by 1, 2, 3"""
)
def pwm_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth by strand in the 60 bases on either side of every position that is called in both samples."""
    return _windows(spark, sf_dir, _called_twice(spark, sf_dir))


def _called_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return germline_snp_calls(spark, sf_dir).groupBy("chr", "pos").agg(F.count("*").alias("n")).where("n = 2").select("chr", "pos")


def _windows(spark: SparkSession, sf_dir: str, chosen: DataFrame) -> DataFrame:
    wide = chosen.withColumn("shift", F.explode(F.sequence(F.lit(-60).cast("long"), F.lit(60).cast("long")))).withColumn("at", F.col("pos") + F.col("shift"))
    segments = depth_segments(read_spans(_pairs(spark, sf_dir), KEYS), "s", "e", ("chr",), {"cov_m": F.col("rev")}).withColumn("seg_last", F.col("seg_end") - 1)
    hits = overlap_join(wide, segments, "at", "at", "seg_start", "seg_last").select("chr", "pos", "shift", (F.col("depth") - F.col("cov_m")).alias("cov_p"), "cov_m")
    return wide.drop("at").join(hits, ["chr", "pos", "shift"], "left").na.fill(0, ["cov_p", "cov_m"])


@query(
    BASE
    + """ select e.chr, e.pos, e.kind, e.allele, count(*) as n_reads, string_agg(code, ';' order by code) as reads from (select sample, chr, pos1 + mm_off + 1 as pos, case when is_del then 'D' else 'I' end as kind, case when is_del then cast(l_linenumber as varchar) else repeat(mm_nt, cast(l_linenumber % 3 + 1 as int)) end as allele, ordinal || case when rev1 then 'r' else 'l' end as code from f where klass = 'g') e group by 1, 2, 3, 4 having count(*) >= 2"""
)
def supporting_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads that support each indel seen twice or more, as ordinal and strand code."""
    gap = _pairs(spark, sf_dir).where("klass = 'g'").select("chr", F.expr("pos1 + mm_off + 1").alias("pos"), F.expr("case when is_del then 'D' else 'I' end").alias("kind"), F.expr("case when is_del then cast(l_linenumber as string) else repeat(mm_nt, cast(l_linenumber % 3 + 1 as int)) end").alias("allele"), F.expr("concat(ordinal, case when rev1 then 'r' else 'l' end)").alias("code"))
    return gap.groupBy("chr", "pos", "kind", "allele").agg(F.count("*").alias("n_reads"), F.array_join(F.array_sort(F.collect_list("code")), ";").alias("reads")).where("n_reads >= 2")


AMPLICONS = {"pos1": "(l_partkey % 40) * 400 + 1 + l_linenumber", "pos2": "(l_partkey % 40) * 400 + 61 + l_linenumber + l_orderkey % 3 * 5", "mm_off": "10 + (l_partkey % 40) * 7 % 70 - l_linenumber"}


def _amplicon_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose starts lie in forty places of a contig, a few bases apart, with one place of changes for each."""
    return v.aln(spark, sf_dir, deep=True).withColumns({k: F.expr(x) for k, x in AMPLICONS.items()}).where("rev1 <> rev2")


@query(f"""with {v.ALN_DEEP}, f as (select * replace ({", ".join(f"{x} as {k}" for k, x in AMPLICONS.items())}) from aln where rev1 <> rev2),
spans as (select * from (select sample, chr, pos1 as s, pos1 + len1 - 1 as e from f union all select sample, chr, pos2, least(pos2 + len2 - 1, pos1 - 1) from f union all select sample, chr, greatest(pos2, pos1 + len1), pos2 + len2 - 1 from f) where s <= e),
reads as (select sample, chr, pos, count(*) as n from (select sample, chr, unnest(range(s, e + 1)) as pos from spans) group by all),
gone as (select sample, chr, pos, count(*) as g from (select sample, chr, unnest(range(pos1 + mm_off + 1, pos1 + mm_off + 1 + l_linenumber)) as pos from f where klass = 'g' and is_del) group by all),
dep as (select * from (select sample, chr, pos, n - coalesce(g, 0) as depth from reads left join gone using (sample, chr, pos)) where depth > 0),
isl as (select *, pos - row_number() over (partition by sample, chr order by pos) as island from dep),
tops as (select sample, chr, island, max(depth) as max_depth, min(pos) filter (depth >= 4) as opened from isl group by all having max(depth) >= 4),
ends as (select sample, chr, island, any_value(max_depth) as max_depth, min(pos) as trim_start, max(pos) as trim_end, greatest(arg_max(depth, pos) * 15 // 100, 1) as min_var from isl join tops using (sample, chr, island) where 2 * depth >= max_depth and pos >= opened group by all),
steps as (select *, lag(depth) over (partition by sample, chr, island order by pos) as was from isl join ends using (sample, chr, island) where pos between trim_start and trim_end),
fell as (select sample, chr, island, min(pos) as fell from steps where depth + min_var <= was group by all),
mm as (select sample, chr, pos, allele, count(*) as n from (select sample, chr, pos1 + mm_off as pos, mm_nt as allele from f where klass in ('m', 'g')) where allele <> {v.base_sql()} group by all),
nts as (select sample, chr, pos, n from mm union all select sample, chr, pos, depth - sum(n) from mm join dep using (sample, chr, pos) group by sample, chr, pos, depth),
snp as (select sample, chr, pos, any_value(trim_start) as trim_start, any_value(trim_end) as trim_end, any_value(max_depth) as max_depth, any_value(depth) as depth from nts join steps using (sample, chr, pos) where n >= min_var group by sample, chr, pos having count(*) > 1)
select sample, chr, trim_start, trim_end, max_depth, pos, 'DEL' as kind, depth from steps join fell using (sample, chr, island) where depth >= was + min_var and pos > fell
union all select sample, chr, trim_start, trim_end, max_depth, pos, 'SNP', depth from snp""")
def amplicon_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base changes and deletions inside amplicons. Counts accumulate over the four bases and the depth before is that of the base before (the evident
    intent where the original differs)."""
    pairs = _amplicon_pairs(spark, sf_dir)
    found = _events(pairs)
    deletions = found.where("kind = 'D'").select(*KEYS, F.col("pos").alias("s"), (F.col("pos") + F.col("allele").cast("long") - 1).alias("e"))
    changed = found.where("kind = 'M'").groupBy(*KEYS, "pos", "allele").agg(F.count("*").alias("n"))
    return amplicon.variants(amplicon.base_depth(read_spans(pairs, KEYS), deletions, KEYS), changed, KEYS)
