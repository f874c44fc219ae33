"""Coverage, window and region statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.operators.coverage import TILE, depth_quartiles, depth_segments, merged_runs, windowed
from strandlake.operators.filters import fragments, on_contig, ordinal_sample, well_behaved
from strandlake.operators.intervals import listed_overlaps, overlap_join, with_bins
from strandlake.plans.registry import query
from strandlake.sources import views as v


def good_fragments(spark: SparkSession, sf_dir: str, limit: int = 800) -> DataFrame:
    pairs = v.aln(spark, sf_dir)
    return fragments(on_contig(pairs.where(well_behaved(limit)), v.contigs(pairs)))


def frag_sql(limit: int = 800, extra: str = "") -> str:
    return f"""with {v.ALN}, {v.CONTIGS},
frag as (select aln.*, least(pos1, pos2) as frag_start, case when pos1 <= pos2 then pos2 + len2 else pos1 + len1 end - 1 as frag_end
  from aln join contigs using (chr) where abs(delta) < {limit} and rev1 <> rev2 and pos1 between 1 and contig_len and pos2 between 1 and contig_len{extra}),
ev as (select chr, frag_start as pos, 1 as d, klass from frag union all select chr, frag_end + 1, -1, klass from frag),
evs as (select chr, pos, sum(d) as d, sum(case when klass in ('p', 'N') then d else 0 end) as d0, sum(case when klass = 'm' then d else 0 end) as d1, sum(case when klass = 'g' then d else 0 end) as d2 from ev group by chr, pos),
seg as (select * from (select chr, pos as seg_start, lead(pos) over w as seg_end, cast(sum(d) over w as bigint) as depth, cast(sum(d0) over w as bigint) as cov0, cast(sum(d1) over w as bigint) as cov1, cast(sum(d2) over w as bigint) as cov2
  from evs window w as (partition by chr order by pos)) where depth > 0 and seg_end is not null)"""


QUARTILES = """hist as (select chr, least(depth, 65535) as depth, cast(sum(seg_end - seg_start) as bigint) as bases from seg group by 1, 2),
cum as (select chr, depth, sum(bases) over (partition by chr order by depth) as cum, sum(bases) over (partition by chr) as n from hist)
select chr, cast(any_value(n) as bigint) as covered, case when any_value(n) // 4 = 0 then 0 else min(case when cum >= n // 4 then depth end) end as q25,
  case when any_value(n) // 2 = 0 then 0 else min(case when cum >= n // 2 then depth end) end as median,
  case when any_value(n) * 3 // 4 = 0 then 0 else min(case when cum >= n * 3 // 4 then depth end) end as q75, max(depth) as max_depth from cum group by chr"""


@query(frag_sql() + ", " + QUARTILES)
def cov_physical_by_chr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical coverage of well-behaved pairs: covered bases and depth quartiles per contig."""
    return depth_quartiles(depth_segments(good_fragments(spark, sf_dir), "frag_start", "frag_end"))


@query(frag_sql(extra=" and ordinal % 16 in (1, 5, 9)") + " select chr, depth, cast(sum(seg_end - seg_start) as bigint) as bases from seg group by chr, depth")
def cov_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth histogram of a sample of ordinals (1, 5, 9 modulo 16)."""
    frags = good_fragments(spark, sf_dir).where(ordinal_sample(F.col("ordinal"), 16, [1, 5, 9]))
    return depth_segments(frags, "frag_start", "frag_end").groupBy("chr", "depth").agg(F.sum(F.expr("seg_end - seg_start")).alias("bases"))


@query(
    frag_sql(1034)
    + """, cut as (select *, unnest(range(greatest((seg_start - 200) // 100, 0), (seg_end - 2) // 100 + 1)) * 100 + 1 as win from seg),
inwin as (select *, least(seg_end, win + 200) - greatest(seg_start, win) as bases from cut)
select chr, win, max(depth) as max_depth, cast(sum(depth * bases) // 200 as bigint) as mean_depth, max(cov0) as max_cov0, cast(sum(cov0 * bases) // 200 as bigint) as mean_cov0,
  max(cov1) as max_cov1, cast(sum(cov1 * bases) // 200 as bigint) as mean_cov1, max(cov2) as max_cov2, cast(sum(cov2 * bases) // 200 as bigint) as mean_cov2
from inwin where bases > 0 group by chr, win"""
)
def cov_by_class_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragment coverage by class (perfect or N, mismatch, gapped) in windows of 200 that slide by 100."""
    parts = {"cov0": F.col("klass").isin("p", "N"), "cov1": F.col("klass") == "m", "cov2": F.col("klass") == "g"}
    return windowed(depth_segments(good_fragments(spark, sf_dir, 1034), "frag_start", "frag_end", parts=parts), 200, 100, ["depth", *parts])


@query(frag_sql() + f""", {v.REGIONS}, hit as (select p_partkey, sum(depth * (least(seg_end - 1, "end") - greatest(seg_start, start) + 1)) as total from regions r join seg s on r.chr = s.chr and s.seg_start <= r."end" and s.seg_end - 1 >= r.start group by p_partkey)
select r.p_partkey, r.chr, r.start, r."end", cast(coalesce(total, 0) as bigint) as total_depth, cast((coalesce(total, 0) * 100 + ("end" - start + 1) // 2) // ("end" - start + 1) as bigint) as mean_x100 from regions r left join hit using (p_partkey)""")
def cov_region_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean coverage per region, inclusive ends, in hundredths (rounded half up)."""
    regions = v.regions(spark, sf_dir)
    segments = depth_segments(good_fragments(spark, sf_dir), "frag_start", "frag_end").withColumn("seg_last", F.col("seg_end") - 1)
    pairs = overlap_join(segments, regions, "seg_start", "seg_last", "start", "end")
    total = pairs.groupBy("p_partkey").agg(F.sum(F.expr("depth * (least(seg_last, end) - greatest(seg_start, start) + 1)")).alias("total"))
    out = regions.join(total, "p_partkey", "left").withColumn("total_depth", F.coalesce("total", F.lit(0)))
    return out.select("p_partkey", "chr", "start", "end", "total_depth", F.expr("(total_depth * 100 + (end - start + 1) div 2) div (end - start + 1)").alias("mean_x100"))


RUNS = """, low as (select chr, seg_start, seg_end, depth from seg where depth >= 4),
marked as (select *, case when lag(seg_end) over w = seg_start and lag(depth) over w = depth then 0 else 1 end as fresh from low window w as (partition by chr order by seg_start)),
numbered as (select *, sum(fresh) over (partition by chr order by seg_start) as run from marked)"""


@query(frag_sql() + RUNS + " select chr, min(seg_start) - 1 as start0, max(seg_end) - 1 as end0, any_value(depth) as depth from numbered group by chr, run")
def cov_bedgraph_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-length encoded coverage of 4 and more, 0-based half-open."""
    segments = depth_segments(good_fragments(spark, sf_dir), "frag_start", "frag_end").where("depth >= 4")
    return merged_runs(segments).select("chr", (F.col("run_start") - 1).alias("start0"), (F.col("run_end") - 1).alias("end0"), "depth")


@query(
    frag_sql(512)
    + """, marked as (select *, case when lag(seg_end) over (partition by chr order by seg_start) = seg_start then 0 else 1 end as fresh from seg),
numbered as (select *, sum(fresh) over (partition by chr order by seg_start) as island from marked), tops as (select *, max(depth) over (partition by chr, island) as top from numbered)
select chr, min(seg_start) as isl_start, max(seg_end) - 1 as isl_end, any_value(top) as max_depth, min(case when 2 * depth >= top then seg_start end) as trim_start, max(case when 2 * depth >= top then seg_end end) - 1 as trim_end
from tops group by chr, island having max(depth) >= 4"""
)
def amplicon_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands of coverage that reach 4, closed where it falls to 0, with ends trimmed where twice the depth is below the top."""
    segments = depth_segments(good_fragments(spark, sf_dir, 512), "frag_start", "frag_end")
    islands = merged_runs(segments.withColumn("one", F.lit(1)), value="one").select("chr", F.col("run_start").alias("isl_start"), (F.col("run_end") - 1).alias("isl_end"))
    inside = overlap_join(segments.withColumn("seg_last", F.col("seg_end") - 1), islands, "seg_start", "seg_last", "isl_start", "isl_end")
    key = ["chr", "isl_start", "isl_end"]
    top = inside.groupBy(*key).agg(F.max("depth").alias("max_depth")).where("max_depth >= 4")
    # by island and tile, as an island may be as long as its contig
    kept = with_bins(inside, "seg_start", "seg_start", TILE).join(with_bins(top, "isl_start", "isl_end", TILE), [*key, "bin"]).where("2 * depth >= max_depth")
    return kept.groupBy(*key).agg(F.first("max_depth").alias("max_depth"), F.min("seg_start").alias("trim_start"), F.max("seg_last").alias("trim_end"))


MATES = """mates as (select chr, klass, pos1 as m_start, pos1 + len1 - 1 as m_end from aln union all select chr, klass, pos2, pos2 + len2 - 1 from aln)"""


def mates(pairs: DataFrame, *more: str) -> DataFrame:
    """One row per mate with its inclusive span."""
    one = pairs.select("chr", "klass", *more, F.col("pos1").alias("m_start"), (F.col("pos1") + F.col("len1") - 1).alias("m_end"), F.col("rev1").alias("m_rev"))
    two = pairs.select("chr", "klass", *more, F.col("pos2").alias("m_start"), (F.col("pos2") + F.col("len2") - 1).alias("m_end"), F.col("rev2").alias("m_rev"))
    return one.unionByName(two)


@query(
    f"""with {v.ALN}, {v.REGIONS}, {MATES}, tiles as (select chr, p_partkey, t as tile_start, least(t + 99, "end") as tile_end from (select *, unnest(range(start, "end" + 1, 100)) as t from regions))
select p_partkey, tile_start, any_value(tile_end) as tile_end, count(*) filter (klass in ('p', 'N')) as n_perfect, count(*) filter (klass = 'm') as n_mismatch, count(*) filter (klass = 'g') as n_gap, count(*) as n_total
from tiles t join mates m on t.chr = m.chr and m_start <= tile_end and m_end >= tile_start group by p_partkey, tile_start"""
)
def region_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mates per class that overlap each tile of 100 bases of each region; the class is that of the pair's store."""
    tiles = v.regions(spark, sf_dir).select("chr", "p_partkey", "end", F.explode(F.expr("sequence(start, end, 100L)")).alias("tile_start")).withColumn("tile_end", F.least(F.col("tile_start") + 99, "end")).drop("end")
    hits = overlap_join(mates(v.aln(spark, sf_dir)), tiles, "m_start", "m_end", "tile_start", "tile_end")
    return hits.groupBy("p_partkey", "tile_start").agg(F.first("tile_end").alias("tile_end"), F.count_if(F.col("klass").isin("p", "N")).alias("n_perfect"), F.count_if(F.col("klass") == "m").alias("n_mismatch"), F.count_if(F.col("klass") == "g").alias("n_gap"), F.count("*").alias("n_total"))


def _element_stats(elements: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """Max, integer mean and sorted[n div 2] (zeros included) of depth over the bases of each ``key``'s elements."""
    size = elements.groupBy(key).agg(F.sum(F.expr("end - start + 1")).alias("n_bases"))
    hits = overlap_join(segments.withColumn("seg_last", F.col("seg_end") - 1), elements, "seg_start", "seg_last", "start", "end")
    bins = hits.groupBy(key, "depth").agg(F.sum(F.expr("least(seg_last, end) - greatest(seg_start, start) + 1")).alias("bases"))
    bins = bins.join(size, key).withColumn("above", F.sum("bases").over(Window.partitionBy(key).orderBy(F.desc("depth"))))
    # the element at index n div 2 in ascending order is the largest depth with more than n - 1 - n div 2 bases at or above it
    median = F.coalesce(F.max(F.when(F.expr("above > n_bases - 1 - n_bases div 2"), F.col("depth"))), F.lit(0))
    stats = bins.groupBy(key).agg(F.max("depth").alias("max_depth"), F.expr("sum(depth * bases) div first(n_bases)").alias("mean_depth"), median.alias("median_depth"))
    return size.join(stats, key, "left").na.fill(0, ["max_depth", "mean_depth", "median_depth"])


def _element_sql(key: str, where: str) -> str:
    return f""", {v.FEATURES}, el as (select * from features where {where}), sz as (select {key}, cast(sum("end" - start + 1) as bigint) as n_bases from el group by {key}),
bins as (select {key}, depth, sum(least(seg_end - 1, "end") - greatest(seg_start, start) + 1) as bases from el join seg on el.chr = seg.chr and seg_start <= "end" and seg_end - 1 >= start group by {key}, depth),
ab as (select bins.*, n_bases, sum(bases) over (partition by {key} order by depth desc) as above from bins join sz using ({key})),
st as (select {key}, max(depth) as max_depth, cast(sum(depth * bases) // any_value(n_bases) as bigint) as mean_depth, coalesce(max(case when above > n_bases - 1 - n_bases // 2 then depth end), 0) as median_depth from ab group by {key})"""


@query(frag_sql() + _element_sql("feature_id", "kind = 'gene'") + " select feature_id, n_bases, coalesce(max_depth, 0) as max_depth, coalesce(mean_depth, 0) as mean_depth, coalesce(median_depth, 0) as median_depth from sz left join st using (feature_id)")
def feature_cov_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of genes: max, integer mean and median with uncovered positions counted as 0."""
    genes = v.features(spark, sf_dir).where("kind = 'gene'").select("feature_id", "chr", "start", "end")
    return _element_stats(genes, depth_segments(good_fragments(spark, sf_dir), "frag_start", "frag_end"), "feature_id")


@query(
    frag_sql()
    + _element_sql("gene_id", "kind = 'exon'")
    + f""", {MATES}, rd as (select gene_id, count(*) as n_reads from el join mates m on el.chr = m.chr and m_start <= "end" and m_end >= start group by gene_id)
select gene_id, n_bases, coalesce(max_depth, 0) as max_depth, coalesce(mean_depth, 0) as mean_depth, coalesce(median_depth, 0) as median_depth, coalesce(n_reads, 0) as n_reads from sz left join st using (gene_id) left join rd using (gene_id)"""
)
def transcript_cov_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the exons of each transcript, with the number of reads that overlap an exon."""
    exons = v.features(spark, sf_dir).where("kind = 'exon'").select("gene_id", "chr", "start", "end")
    stats = _element_stats(exons, depth_segments(good_fragments(spark, sf_dir), "frag_start", "frag_end"), "gene_id")
    reads = overlap_join(mates(v.aln(spark, sf_dir)), exons, "m_start", "m_end", "start", "end").groupBy("gene_id").agg(F.count("*").alias("n_reads"))
    return stats.join(reads, "gene_id", "left").na.fill(0, ["n_reads"])


def _exon_reads(pairs: DataFrame, exons: DataFrame) -> DataFrame:
    one = pairs.selectExpr("chr", "pos1 as m_start", "pos1 + len1 - 1 as m_end", "ordinal", "case when rev1 then 'l' else 'L' end as code")
    two = pairs.selectExpr("chr", "pos2 as m_start", "pos2 + len2 - 1 as m_end", "ordinal", "case when rev2 then 'R' else 'r' end as code")
    return listed_overlaps(one.unionByName(two), exons)


@query(
    f"""with {v.ALN}, {v.FEATURES}, el as (select * from features where kind = 'exon'),
m as (select ordinal, case when rev1 then 'l' else 'L' end as code, chr, pos1 as m_start, pos1 + len1 - 1 as m_end from aln union all select ordinal, case when rev2 then 'R' else 'r' end, chr, pos2, pos2 + len2 - 1 from aln)
select feature_id, count(*) as n_reads, string_agg(ordinal || code, ';' order by ordinal, code) as reads from el join m on el.chr = m.chr and m_start <= "end" and m_end >= start group by feature_id"""
)
def exon_read_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each exon that reads overlap, the reads of both mates: ordinal and L, l (first mate forward, reverse) or r, R (second)."""
    return _exon_reads(v.aln(spark, sf_dir), v.features(spark, sf_dir).where("kind = 'exon'").select("feature_id", "chr", "start", "end"))


@query(
    f"""with {v.ALN}, {v.REGIONS} select chr, count(*) as n_pairs, count(*) filter (exists (select 1 from regions r where r.chr = a.chr and r.start - 10 <= a.pos1 and r."end" + 10 >= a.pos1)) as n_in_regions from aln a group by chr"""
)
def position_in_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose first position lies in a region padded by 10 (range semi-join), next to all pairs."""
    pairs = v.aln(spark, sf_dir).select("chr", "pos1")
    padded = v.regions(spark, sf_dir).selectExpr("chr", "greatest(start - 10, 0) as r_start", "end + 10 as r_end")
    inside = overlap_join(pairs, padded, "pos1", "pos1", "r_start", "r_end", how="left_semi").groupBy("chr").agg(F.count("*").alias("n_in_regions"))
    return pairs.groupBy("chr").agg(F.count("*").alias("n_pairs")).join(inside, "chr", "left").na.fill(0, ["n_in_regions"])


@query(f"""with {v.ALN}, {v.REGIONS} select klass, count(*) as n_outside from aln a where not exists (select 1 from regions r where r.chr = a.chr and r.start <= a.pos1 and r."end" >= a.pos1) group by klass""")
def excluded_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs outside all regions (range anti-join, as for excluded contig parts)."""
    return overlap_join(v.aln(spark, sf_dir).select("chr", "pos1", "klass"), v.regions(spark, sf_dir).select("chr", "start", "end"), "pos1", "pos1", "start", "end", how="left_anti").groupBy("klass").agg(F.count("*").alias("n_outside"))
