"""Restriction-site contacts and region splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions.sequence import pseudo_mapq
from strandlake.operators.contacts import few_mismatches, is_contact, multiplicity, with_sites
from strandlake.operators.reads import LIGATION, ligation_tail, tiles
from strandlake.plans.registry import query
from strandlake.sources import views as v

KEY = ["ordinal", "l_partkey", "l_suppkey"]
SITED = f"""with {v.ALN}, {v.SITES}, good as (select *, case when pos1 <= pos2 then not rev1 and rev2 else rev1 and not rev2 end as facing, greatest(pos1, pos2) - (case when pos1 <= pos2 then pos1 + len1 else pos2 + len2 end) as gap from aln where klass <> 'g'),
sited as (select *, (select min(site) from sites s where s.chr = g.chr and site >= case when rev1 then pos1 + 1 else pos1 + len1 - 4 end) as site1, (select min(site) from sites s where s.chr = g.chr and site >= case when rev2 then pos2 + 1 else pos2 + len2 - 4 end) as site2 from good g)"""


def sited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs without indels, with orientation, gap and the next site of both mates."""
    pairs = v.aln(spark, sf_dir).where("klass <> 'g'")
    facing = F.when(F.col("pos1") <= F.col("pos2"), ~F.col("rev1") & F.col("rev2")).otherwise(F.col("rev1") & ~F.col("rev2"))
    gap = F.greatest("pos1", "pos2") - F.when(F.col("pos1") <= F.col("pos2"), F.col("pos1") + F.col("len1")).otherwise(F.col("pos2") + F.col("len2"))
    sites = v.sites(spark, sf_dir)
    return with_sites(with_sites(pairs.withColumn("facing", facing).withColumn("gap", gap), sites, 1), sites, 2)


@query(SITED + " select ordinal, l_partkey, l_suppkey, chr, site1, site2 from sited")
def nearest_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next restriction site of both mates (forward as-of)."""
    return sited(spark, sf_dir).select(*KEY, "chr", "site1", "site2")


@query(SITED + " select chr, count(*) as n, count(site1) as n_site1, cast(sum(site2) as bigint) as sum_site2 from sited where not (facing and gap between 0 and 2047) group by chr")
def hic_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts per contig: pairs that aren't plain inserts."""
    s = sited(spark, sf_dir).where(is_contact(F.lit(True), F.col("facing"), F.col("gap")))
    return s.groupBy("chr").agg(F.count("*").alias("n"), F.count("site1").alias("n_site1"), F.sum("site2").alias("sum_site2"))


@query(SITED + " select chr, count(*) as n, count(site1) as n_site1, cast(sum(site2) as bigint) as sum_site2 from sited where facing and gap between 0 and 2047 group by chr")
def hic_noncontacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain inserts."""
    s = sited(spark, sf_dir).where(~is_contact(F.lit(True), F.col("facing"), F.col("gap")))
    return s.groupBy("chr").agg(F.count("*").alias("n"), F.count("site1").alias("n_site1"), F.sum("site2").alias("sum_site2"))


@query(SITED + " select chr, count(*) as n, cast(sum(site1) as bigint) as sum_site1 from sited where not (facing and gap between 0 and 2047) and (254 - case when klass = 'm' then 254 * (len1 - 1) // len1 else 254 end) * len1 <= 254 group by chr")
def hic_strict_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts per contig whose first mate has one mismatch at most by its mapping quality (which rounds down)."""
    s = sited(spark, sf_dir).where(is_contact(F.lit(True), F.col("facing"), F.col("gap")))
    mapq = pseudo_mapq(F.col("len1"), F.when(F.col("klass") == "m", 1).otherwise(0))
    return s.where(few_mismatches(mapq, F.col("len1"), 1)).groupBy("chr").agg(F.count("*").alias("n"), F.sum("site1").alias("sum_site1"))


@query(SITED + ", d as (select distinct chr as chr1, pos1, site1, chr as chr2, pos2, site2 from sited where not (facing and gap between 0 and 2047)) select chr1, site1, chr2, site2, count(*) as n from d group by 1, 2, 3, 4 having count(*) > 1")
def hic_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site pairs with more than one distinct contact."""
    s = sited(spark, sf_dir).where(is_contact(F.lit(True), F.col("facing"), F.col("gap")))
    return multiplicity(s.withColumn("chr1", F.col("chr")).withColumn("chr2", F.col("chr")))


@query(f"""with {v.REGIONS}, c as (select chr, p_partkey, "end" - start + 1 as bp, sum("end" - start + 1) over (partition by chr order by start, p_partkey) as cum from regions)
select chr, cast((cum - 1) // 5000 as bigint) as split_no, count(*) as n_regions, cast(sum(bp) as bigint) as n_bases from c group by 1, 2""")
def bed_split_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of a contig dealt to splits of about 5000 bases by cumulative size."""
    w = Window.partitionBy("chr").orderBy("start", "p_partkey")
    c = v.regions(spark, sf_dir).withColumn("bp", F.expr("end - start + 1")).withColumn("cum", F.sum("bp").over(w))
    return c.groupBy("chr", F.expr("(cum - 1) div 5000").alias("split_no")).agg(F.count("*").alias("n_regions"), F.sum("bp").alias("n_bases"))


def _ligation_sql() -> str:
    chain = "substr(seq, 29)"
    for site, halves in LIGATION.items():
        chain = f"replace({chain}, '{site}', '{halves}')"
    return f"with {v.dna_sql()}, {v.tiles_sql(127, 120)}, s as (select id, off, substr(seq, 1, 28) as head, substr(split_part({chain}, ' ', 1), 1, 32) as tail from t) select id, off, head, tail, length(head) + length(tail) as n_kept from s"


def _ligation_parts(sequences: DataFrame) -> DataFrame:
    parts = tiles(sequences, 127, 120).select("id", "off", F.substring("seq", 1, 28).alias("head"), ligation_tail(F.col("seq")).alias("tail"))
    return parts.withColumn("n_kept", (F.length("head") + F.length("tail")).cast("long"))


@query(_ligation_sql())
def ligation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads (127 bases from every 120th base of whole texts): the first 28 bases, and what follows up to the first ligation junction."""
    return _ligation_parts(v.dna(spark, sf_dir))
