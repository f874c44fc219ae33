"""Pile-up under quality and fragment limits, realigned indel calls, two-sample call files, and call files held against a pile-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import validation as val
from strandlake.operators.calling import passes
from strandlake.operators.filters import well_behaved
from strandlake.operators.intervals import overlap_join
from strandlake.operators.pileup import alleles, depth_at, good_spans, read_spans
from strandlake.plans import calls as c
from strandlake.plans.registry import query
from strandlake.sources import views as v

LEAST_Q = 10
#: Qualities of the derived reads: low behind a base that depends on the pair, and in a dip of three bases.
LOW = "k >= 60 + ordinal % 40 or (l_partkey % 3 = 0 and k between 20 and 22)"


def _quality(length: str) -> str:
    """Spark SQL: the quality string of a mate."""
    return f"rpad(substr(concat(repeat('F', 20), case when l_partkey % 3 = 0 then '%%%' else 'FFF' end, repeat('F', cast(37 + ordinal % 40 as int))), 1, {length}), {length}, '%')"


@query(
    f"""with {v.ALN_DUP}, f as (select *, case when rev1 then pos2 else pos1 end as fs, case when rev1 then pos1 + len1 - 1 else pos2 + len2 - 1 end as fe from aln where abs(delta) < 1034 and rev1 <> rev2),
b as (select sample, chr, rev1 as rev, case when rev1 then pos1 + len1 - 1 - k else pos1 + k end as pos, fs, fe from f, range(0, 100) as x(k) where k < len1 and not ({LOW})
  union all select * from (select sample, chr, rev2 as rev, case when rev2 then pos2 + len2 - 1 - k else pos2 + k end as pos, fs, fe from f, range(0, 100) as x(k) where not ({LOW}) and not (case when rev2 then pos2 + len2 - 1 - k else pos2 + k end between pos1 and pos1 + len1 - 1))),
deep as (select sample, chr, pos, count(*) filter (not rev) as cov_p, count(*) filter (rev) as cov_m from b where pos between fs and fe group by 1, 2, 3),
e as (select sample, chr, pos1 + mm_off as pos, mm_nt as allele, rev1 as rev, fs, fe, ordinal, l_partkey, case when rev1 then len1 - 1 - mm_off else mm_off end as k from f where klass in ('m', 'g')),
al as (select sample, chr, pos, allele, count(*) filter (not rev) as cnt_p, count(*) filter (rev) as cnt_m from e where not ({LOW}) and pos between fs and fe and pos % 97 <> 0 and allele <> {v.base_sql()} group by 1, 2, 3, 4)
select al.*, coalesce(cov_p, 0) as cov_p, coalesce(cov_m, 0) as cov_m from al left join deep using (sample, chr, pos)"""
)
def pileup_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mismatch alleles and depth of bases of quality 10 and more inside the fragment; loci whose reference isn't A, C, G or T (here
    every 97th) are left out."""
    pairs = v.aln(spark, sf_dir, duplicates=True).where(well_behaved()).withColumn("qual1", F.expr(_quality("len1"))).withColumn("qual2", F.expr(_quality("len2")))
    start, end = F.when(F.col("rev1"), F.col("pos2")).otherwise(F.col("pos1")), F.when(F.col("rev1"), F.expr("pos1 + len1 - 1")).otherwise(F.expr("pos2 + len2 - 1"))
    pairs = pairs.withColumn("frag_start", start).withColumn("frag_end", end)
    cycle = F.when(F.col("rev1"), F.col("len1") - 1 - F.col("mm_off")).otherwise(F.col("mm_off"))
    events = pairs.where("klass in ('m', 'g')").withColumn("pos", F.expr("pos1 + mm_off")).where(val.quality_at(F.col("qual1"), cycle) >= LEAST_Q).where("pos between frag_start and frag_end")
    reference = F.when(F.col("pos") % 97 == 0, "N").otherwise(v.base_at())
    events = events.withColumn("ref", reference).where(F.col("ref").isin("A", "C", "G", "T") & (F.col("mm_nt") != F.col("ref"))).select(*c.KEYS, "pos", F.lit("M").alias("kind"), F.col("mm_nt").alias("allele"), F.col("rev1").alias("rev"))
    return depth_at(alleles(events).drop("kind"), good_spans(pairs, LEAST_Q, c.KEYS))


INDELS = f"""{c.BASE}, tot as (select sample, chr, pos, sum(case when kind <> 'M' then cnt_p + cnt_m else 0 end) as indels from al group by 1, 2, 3),
w as (select al.*, cnt_p + cnt_m as n, coalesce(cov_p + cov_m, 0) as depth, coalesce(cov_p + cov_m, 0) + indels as total from al join tot using (sample, chr, pos) left join deep using (sample, chr, pos) where kind <> 'M')"""


@query(INDELS + f" select sample, chr, pos - 1 as pos, kind, allele, n, cast(total as bigint) as total, cast(depth as bigint) as ref_n, case when depth >= {c.LEAST} and depth >= total * {c.PERCENT} // 100 then '0/1' else '1/1' end as gt from w where n >= {c.LEAST} and n >= total * {c.PERCENT} // 100")
def realigned_indel_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indel calls after realignment: all deletions and insertions count for the total, and the reads of an insertion for the reference too."""
    pairs = c._pairs(spark, sf_dir)
    found = alleles(c._events(pairs)).withColumn("n", F.col("cnt_p") + F.col("cnt_m"))
    indels = found.groupBy(*c.KEYS, "pos").agg(F.sum(F.when(F.col("kind") != "M", F.col("n")).otherwise(0)).alias("indels"))
    rows = depth_at(found.where("kind <> 'M'"), read_spans(pairs, c.KEYS)).join(indels, [*c.KEYS, "pos"]).withColumn("ref_n", F.col("cov_p") + F.col("cov_m")).withColumn("total", F.col("ref_n") + F.col("indels"))
    both = passes(F.col("ref_n"), F.col("total"), c.LEAST, c.PERCENT)
    return rows.where(passes(F.col("n"), F.col("total"), c.LEAST, c.PERCENT)).select("sample", "chr", (F.col("pos") - 1).alias("pos"), "kind", "allele", "n", "total", "ref_n", F.when(both, "0/1").otherwise("1/1").alias("gt"))


# Both samples at one locus: counts of the reference and of each allele, and whether a sample calls it.
SAMPLES = (
    c.DEEP
    + c.TWO
    + f""", lt as (select chr, pos, cast(sum(case when kind = 'M' then t_p + t_m else 0 end) as bigint) as t_mm, cast(sum(case when kind = 'M' then n_p + n_m else 0 end) as bigint) as n_mm, cast(sum(case when kind = 'D' then t_p + t_m else 0 end) as bigint) as t_del, cast(sum(case when kind = 'D' then n_p + n_m else 0 end) as bigint) as n_del from j group by 1, 2),
k as (select j.*, t_p + t_m as t, n_p + n_m as n, t_depth - t_mm as t_ref, n_depth - n_mm as n_ref, t_depth + t_del as t_all, n_depth + n_del as n_all from j join lt using (chr, pos) where kind = 'M'),
o as (select *, t >= {c.LEAST} and t >= t_all * {c.PERCENT} // 100 as t_ok, n >= {c.LEAST} and n >= n_all * {c.PERCENT} // 100 as n_ok, t_ref >= {c.LEAST} and t_ref >= t_all * {c.PERCENT} // 100 as t_ref_ok, n_ref >= {c.LEAST} and n_ref >= n_all * {c.PERCENT} // 100 as n_ref_ok from k),
called as (select * from o where (t_ok or n_ok) and allele <> {v.base_sql()})"""
)


@query(
    SAMPLES
    + f""", g as (select chr, pos, n_ref, t_ref, n_ref_ok, t_ref_ok, list(struct_pack(allele := allele, n := n, t := t, n_ok := n_ok, t_ok := t_ok) order by allele) as al from called group by all),
r as (select *, n_ref + list_sum(list_transform(al, lambda x: x.n)) as n_total, t_ref + list_sum(list_transform(al, lambda x: x.t)) as t_total, n_ref_ok or list_bool_or(list_transform(al, lambda x: x.n_ok)) as zero from g),
s as (select *, zero and list_bool_or(list_transform(al, lambda x: x.t_ok and x.n <= x.t * n_total // t_total * {c.PERCENT} // 100)) as somatic,
  list_sort(list_prepend([-n_ref, 0, case when n_ref_ok then 1 else 0 end], list_transform(al, lambda x, i: [-x.n, i, case when x.n_ok then 1 else 0 end]))) as nr, list_sort(list_prepend([-t_ref, 0, case when t_ref_ok then 1 else 0 end], list_transform(al, lambda x, i: [-x.t, i, case when x.t_ok then 1 else 0 end]))) as tr from r)
select chr, pos, 'chr' || contig || chr(9::int) || pos || chr(9::int) || '.' || chr(9::int) || {v.base_sql('contig')} || chr(9::int) || list_aggregate(list_transform(al, lambda x: x.allele), 'string_agg', ',') || chr(9::int) || '.' || chr(9::int) || 'PASS' || chr(9::int) || case when somatic then 'SOMATIC' else '.' end || chr(9::int) || 'GT:DP:AD'
  || chr(9::int) || case when nr[2][3] = 1 then least(nr[1][2], nr[2][2]) || '/' || greatest(nr[1][2], nr[2][2]) when nr[1][3] = 1 then nr[1][2] || '/' || nr[1][2] else '0/0' end || ':' || cast(n_total as bigint) || ':' || n_ref || ',' || list_aggregate(list_transform(al, lambda x: cast(x.n as varchar)), 'string_agg', ',')
  || chr(9::int) || case when tr[2][3] = 1 then least(tr[1][2], tr[2][2]) || '/' || greatest(tr[1][2], tr[2][2]) when tr[1][3] = 1 then tr[1][2] || '/' || tr[1][2] else '0/0' end || ':' || cast(t_total as bigint) || ':' || t_ref || ',' || list_aggregate(list_transform(al, lambda x: cast(x.t as varchar)), 'string_agg', ',') as line
from (select *, chr as contig from s)"""
)
def vcf_two_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data lines of a call file of two samples (normal, tumour): mismatch alleles that either calls."""
    two = c._two(spark, sf_dir)
    per = lambda s, kind: F.sum(F.when(F.col("kind") == kind, F.col(f"{s}_p") + F.col(f"{s}_m")).otherwise(0)).alias(f"{s}_sum{kind}")
    sums = two.groupBy("chr", "pos").agg(*[per(s, k) for s in "tn" for k in "MD"])
    rows = two.where("kind = 'M'").join(sums, ["chr", "pos"]).withColumn("ref", v.base_at()).where("allele <> ref")
    for s in "tn":
        rows = rows.withColumn(s, F.col(f"{s}_p") + F.col(f"{s}_m")).withColumn(f"{s}_ref", F.col(f"{s}_depth") - F.col(f"{s}_sumM"))
        everything = F.col(f"{s}_depth") + F.col(f"{s}_sumD")
        rows = rows.withColumn(f"{s}_ok", passes(F.col(s), everything, c.LEAST, c.PERCENT)).withColumn(f"{s}_ref_ok", passes(F.col(f"{s}_ref"), everything, c.LEAST, c.PERCENT))
    return val.two_sample_lines(rows.where("t_ok or n_ok"), ("n", "t"), c.PERCENT)


# A call file of sample N held against the pile-up of sample T.
RECORDS = f"""{c.BASE}{c.LOCI}, calls as ({c.SNPS}), rec as (select chr, pos, 'SNP' as type, ref, gt, string_split(alt, ',') as alts, pos as locus from calls where sample = 'N'
  union all select chr, pos - 1, case kind when 'D' then 'DELETION' else 'INSERTION' end, '', case when ref_n >= {c.LEAST} and ref_n >= case when kind = 'D' then total + n else total end * {c.PERCENT} // 100 then '0/1' else '1/1' end, [kind || allele], pos
    from (select al.*, cnt_p + cnt_m as n, coalesce(cov_p + cov_m, 0) as total, case when kind = 'I' then greatest(coalesce(cov_p + cov_m, 0) - cnt_p - cnt_m, 0) else coalesce(cov_p + cov_m, 0) end as ref_n from al left join deep using (sample, chr, pos) where kind <> 'M' and sample = 'N') where n >= {c.LEAST} and n >= total * {c.PERCENT} // 100)"""


@query(
    RECORDS
    + f""", pile as (select chr, pos, case when kind = 'M' then allele else kind || allele end as name, cnt_p + cnt_m as n from al where sample = 'T'), tot as (select chr, pos, sum(n) as events, sum(case when length(name) = 1 then n else 0 end) as mm from pile group by 1, 2),
dt as (select chr, pos, cov_p + cov_m as depth from deep where sample = 'T'),
x as (select rec.*, coalesce(depth, 0) as depth, coalesce(mm, 0) as mm, events, coalesce(depth, 0) + coalesce(events - mm, 0) as seen, {v.base_sql('rec.chr', 'locus')} as base from rec left join dt on dt.chr = rec.chr and dt.pos = locus left join tot on tot.chr = rec.chr and tot.pos = locus),
y as (select *, split_part(gt, '/', 1)::int as a, split_part(gt, '/', 2)::int as b from x), z as (select *, case when a = 0 then base else alts[a] end as name1, alts[b] as name2 from y),
p as (select z.*, p1.n as n1, p2.n as n2 from z left join pile p1 on p1.chr = z.chr and p1.pos = locus and p1.name = name1 left join pile p2 on p2.chr = z.chr and p2.pos = locus and p2.name = name2),
q as (select *, case when name1 = base then coalesce(n1, 0) + depth - mm when length(name1) = 1 then coalesce(n1, 0) else n1 end as c1, case when length(name2) = 1 then coalesce(n2, 0) else n2 end as c2, seen * {c.PERCENT} // 100 as least from p)
select chr, pos, type, gt, alts[1] as alt, cast(seen as bigint) as n_seen, case when seen = 0 then 'NO_COVERAGE' when events is null then 'VARIANT_NOT_FOUND' else coalesce(nullif(concat_ws(' ', case when c2 is null then type || '_NOT_FOUND_GT_2' when c2 < least then 'MAF_THRESHOLD_GT_2' end, case when a <> b then case when c1 is null then type || '_NOT_FOUND_GT_1' when c1 < least then 'MAF_THRESHOLD_GT_1' end end), ''), 'EXTRA_VARIANT') end as verdict from q"""
)
def vcf_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record of one sample's calls with what the other sample's pile-up says to its genotype."""
    snps = c.germline_snp_calls(spark, sf_dir).where("sample = 'N'").select("chr", "pos", F.lit("SNP").alias("type"), "gt", F.split("alt", ",").alias("alts"), F.col("pos").alias("locus"))
    indels = c.germline_indel_calls(spark, sf_dir).where("sample = 'N'").select("chr", "pos", F.when(F.col("kind") == "D", "DELETION").otherwise("INSERTION").alias("type"), "gt", F.array(F.concat("kind", "allele")).alias("alts"), (F.col("pos") + 1).alias("locus"))
    records = snps.unionByName(indels).withColumn("base", v.base_at("chr", "locus"))
    pairs = c._pairs(spark, sf_dir).where("sample = 'T'")
    return val.validate(records, alleles(c._events(pairs)), read_spans(pairs, c.KEYS), "T", c.PERCENT)


@query(
    c.BASE
    + """, loc as (select chr, pos from al where kind = 'M' and sample = 'N' group by 1, 2 having sum(cnt_p + cnt_m) >= 2), m as (select chr, pos1 as s, pos1 + len1 - 1 as e from f union all select chr, pos2, pos2 + len2 - 1 from f)
select loc.chr, loc.pos, loc.pos - 60 as win_start, loc.pos + 60 as win_end, count(*) as n_reads, count(*) >= 4 as enough from loc join m on m.chr = loc.chr and m.s <= loc.pos + 60 and m.e >= loc.pos - 60 group by 1, 2"""
)
def vcf_window_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads that overlap the window of 60 bases on either side of each called locus, and whether they are enough for a window call."""
    pairs = c._pairs(spark, sf_dir)
    loci = alleles(c._events(pairs)).where("kind = 'M' and sample = 'N'").groupBy("chr", "pos").agg(F.sum(F.col("cnt_p") + F.col("cnt_m")).alias("n")).where("n >= 2")
    windows = loci.select("chr", "pos", (F.col("pos") - 60).alias("win_start"), (F.col("pos") + 60).alias("win_end"))
    mates = pairs.selectExpr("chr", "inline(array(struct(pos1 as s, pos1 + len1 - 1 as e), struct(pos2 as s, pos2 + len2 - 1 as e)))")
    hits = overlap_join(windows, mates, "win_start", "win_end", "s", "e")
    return hits.groupBy("chr", "pos", "win_start", "win_end").agg(F.count("*").alias("n_reads"), (F.count("*") >= 4).alias("enough"))
