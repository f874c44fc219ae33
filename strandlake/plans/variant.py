"""Variant joins: annotation, provenance, details, region filter, depth repair, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.sequence import fixed_ad
from strandlake.operators import variants as vr
from strandlake.operators.intervals import overlap_join
from strandlake.plans.registry import query
from strandlake.sources import views as v

# Synthetic calls: every order is a call of one of three callers.
CALLS = """vcf as (select o_orderkey as rid, o_custkey % 3 as caller, cast(o_orderkey % 24 + 1 as int) as chr, (o_orderkey * 7) % 1000 + 1 as pos, substr('ACGT', cast(o_orderkey % 4 + 1 as int), 1) as ref,
  [substr('CGTA', cast(o_orderkey % 4 + 1 as int), 1), substr('GTAC', cast(o_custkey % 4 + 1 as int), 1)] as alt, case o_custkey % 3 when 0 then '0/1' when 1 then '1/1' else '1/2' end as gt, o_custkey % 40 as dp,
  case when o_custkey % 2 = 0 then [o_custkey % 7, o_custkey % 11] else [o_custkey % 5, o_custkey % 7, o_custkey % 11] end as ad from orders),
known as (select p_partkey as id, cast(p_partkey % 24 + 1 as int) as chr, (p_partkey * 7) % 1000 + 1 as pos, substr('ACGT', cast(p_partkey % 4 + 1 as int), 1) as ref, [substr('CGTA', cast(p_partkey % 4 + 1 as int), 1)] as alt from part)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as rid", "o_custkey % 3 as caller", "cast(o_orderkey % 24 + 1 as int) as chr", "(o_orderkey * 7) % 1000 + 1 as pos", "substr('ACGT', cast(o_orderkey % 4 + 1 as int), 1) as ref",
        "array(substr('CGTA', cast(o_orderkey % 4 + 1 as int), 1), substr('GTAC', cast(o_custkey % 4 + 1 as int), 1)) as alt", "case o_custkey % 3 when 0 then '0/1' when 1 then '1/1' else '1/2' end as gt", "o_custkey % 40 as dp",
        "case when o_custkey % 2 = 0 then array(o_custkey % 7, o_custkey % 11) else array(o_custkey % 5, o_custkey % 7, o_custkey % 11) end as ad")


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "part").selectExpr("p_partkey as id", "cast(p_partkey % 24 + 1 as int) as chr", "(p_partkey * 7) % 1000 + 1 as pos", "substr('ACGT', cast(p_partkey % 4 + 1 as int), 1) as ref", "array(substr('CGTA', cast(p_partkey % 4 + 1 as int), 1)) as alt")


@query(f"""with {CALLS}, k as (select * from known qualify row_number() over (partition by chr, pos order by id) = 1)
select rid, vcf.chr, vcf.pos, case when vcf.ref = k.ref and list_has_any(vcf.alt, k.alt) then 'rs' || k.id else '.' end as id from vcf left join k on vcf.chr = k.chr and vcf.pos = k.pos""")
def vcf_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with the id of a known variant that shares reference and an alternative."""
    names = known(spark, sf_dir).withColumn("id", F.concat(F.lit("rs"), F.format_string("%012d", "id")))
    out = vr.annotate(calls(spark, sf_dir), names)
    return out.select("rid", "chr", "pos", F.regexp_replace("id", "^rs0*(\\d)", "rs$1").alias("id"))


@query(f"""with {CALLS} select chr, pos, cast(bit_or(case caller when 0 then 1 when 1 then 2 else 4 end) as int) as mask from vcf group by chr, pos""")
def vcf_three_way_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of three callers hold a position, as bits."""
    c = calls(spark, sf_dir)
    return vr.provenance([c.where(F.col("caller") == i) for i in range(3)])


@query(f"""with {CALLS}, m as (select chr, pos, bit_or(case caller when 0 then 1 when 1 then 2 else 4 end) as mask from vcf group by chr, pos)
select 'all three' as part, count(*) as n from m where mask = 7 union all select 'first two', count(*) from m where mask & 3 = 3 union all select 'only first', count(*) from m where mask = 1""")
def vcf_set_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection and difference of call sets by Spark's set operations."""
    c = calls(spark, sf_dir)
    a, b, d = (c.where(F.col("caller") == i).select("chr", "pos").distinct() for i in range(3))
    count = lambda name, df: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return count("all three", a.intersect(b).intersect(d)).unionByName(count("first two", a.intersect(b))).unionByName(count("only first", a.exceptAll(b.union(d).distinct())))


@query(f"""with {CALLS}, l as (select chr, pos, min(rid) as rid, max(dp) as dp, min(gt) as gt from vcf where caller = 0 group by chr, pos), r as (select chr, pos, max(dp) as dp, min(gt) as gt from vcf where caller <> 0 group by chr, pos)
select l.rid, l.chr, l.pos, l.dp as "dpA", l.gt as "gtA", r.dp as "dpR", r.gt as "gtR", case when r.gt is null then 'SOMATIC' when l.gt = r.gt then 'GERMLINE' else 'DIFF' end as status from l left join r using (chr, pos)""")
def vcf_detail_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of a second call set beside the first, and the germline tag."""
    c = calls(spark, sf_dir)
    left = c.where("caller = 0").groupBy("chr", "pos").agg(F.min("rid").alias("rid"), F.max("dp").alias("dp"), F.min("gt").alias("gt"))
    right = c.where("caller <> 0").groupBy("chr", "pos").agg(F.max("dp").alias("dp"), F.min("gt").alias("gt"))
    merged = vr.merge_details(left, right, ["chr", "pos"], ["dp", "gt"])
    return merged.withColumn("status", F.when(F.col("gtR").isNull(), "SOMATIC").when(F.col("gtA") == F.col("gtR"), "GERMLINE").otherwise("DIFF"))


@query(f"""with {CALLS}, {v.REGIONS} select rid, chr, pos from vcf where exists (select 1 from regions r where r.chr = vcf.chr and r.start - 5 <= pos and r."end" + 5 >= pos)""")
def vcf_region_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls in a region padded by 5."""
    padded = v.regions(spark, sf_dir).selectExpr("chr", "greatest(start - 5, 0) as r_start", "end + 5 as r_end")
    return overlap_join(calls(spark, sf_dir), padded, "pos", "pos", "r_start", "r_end", how="left_semi").select("rid", "chr", "pos")


@query(f"""with {CALLS} select rid, gt, array_to_string(case when gt = '1/2' and len(ad) = 2 then list_concat([0], ad) else ad end, ',') as ad from vcf""")
def vcf_ad_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allele depths with the reference's missing 0 put in."""
    return calls(spark, sf_dir).select("rid", "gt", F.array_join(fixed_ad(F.col("gt"), F.col("ad")).cast("array<string>"), ",").alias("ad"))


@query(f"""with {CALLS} select rid, 'chr' || case chr when 23 then 'X' when 24 then 'Y' else cast(chr as varchar) end || chr(9) || pos || chr(9) || '.' || chr(9) || ref || chr(9) || array_to_string(list_distinct_sorted, ',') || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || 'DP=' || dp || chr(9) || 'GT:DP:AD' || chr(9) || gt || ':' || dp || ':' || array_to_string(ad, ',') as line
from (select *, list_sort(list_distinct(alt)) as list_distinct_sorted from vcf)""".replace("|| chr(9) ||", "|| chr(9::int) ||").replace("case chr when", "case vcf_chr when").replace("cast(chr as varchar)", "cast(vcf_chr as varchar)").replace("from (select *,", "from (select *, chr as vcf_chr,"))
def vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data lines of a single-sample VCF."""
    name = F.concat(F.lit("chr"), F.when(F.col("chr") == 23, "X").when(F.col("chr") == 24, "Y").otherwise(F.col("chr").cast("string")))
    cell = F.concat_ws(":", "gt", F.col("dp").cast("string"), F.array_join(F.col("ad").cast("array<string>"), ","))
    line = F.concat_ws("\t", name, F.col("pos").cast("string"), F.lit("."), "ref", F.array_join(F.array_sort(F.array_distinct("alt")), ","), F.lit("."), F.lit("PASS"), F.concat(F.lit("DP="), F.col("dp").cast("string")), F.lit("GT:DP:AD"), cell)
    return calls(spark, sf_dir).select("rid", line.alias("line"))


TRUTH = f"""with {CALLS}, c as (select chr, pos, alt[1] as alt, gt, dp from vcf where caller < 2 qualify row_number() over (partition by chr, pos order by rid) = 1),
t as (select rid, chr, pos, alt[1] as alt, case when rid % 5 = 0 then '1/1' else gt end as gt, dp from vcf where pos % 3 = 0),
w as (select t.*, c.alt as calt, c.gt as cgt from t left join c using (chr, pos))"""


@query(TRUTH + " select case when calt is null then case when dp < 8 then 'coverage' else 'missing' end when calt <> alt then 'allele' when cgt <> gt then 'zygosity' else 'found' end as verdict, count(*) as n from w group by 1")
def truth_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth records by verdict on a call set."""
    from pyspark.sql import Window

    c = calls(spark, sf_dir)
    first = c.where("caller < 2").withColumn("n", F.row_number().over(Window.partitionBy("chr", "pos").orderBy("rid"))).where("n = 1").select("chr", "pos", F.col("alt")[0].alias("alt"), "gt")
    truth = c.where("pos % 3 = 0").select("rid", "chr", "pos", F.col("alt")[0].alias("alt"), F.when(F.col("rid") % 5 == 0, "1/1").otherwise(F.col("gt")).alias("gt"), "dp")
    return vr.concordance(truth, first, F.col("dp")).groupBy("verdict").agg(F.count("*").alias("n"))
