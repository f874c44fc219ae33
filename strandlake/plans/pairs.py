"""Pair filters, orders, routing and mapping statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import sequence as q
from strandlake.operators.filters import PAIR_ORDER, chosen, few_indels, mark_clones, on_contig, ranked, well_behaved, with_order_keys
from strandlake.operators.mapping import chimera_bucket, mapping_statistics, route, unmapped_bucket
from strandlake.operators.reads import tiles
from strandlake.plans.registry import query
from strandlake.sources import views as v
from strandlake.sources.formats import read_store, write_store
from strandlake.sources.shared import new_folder

KEYS = "l_partkey, l_suppkey, l_orderkey, l_linenumber"


@query(f"with {v.ALN}, {v.CONTIGS} select chr, klass, count(*) as n_pairs, cast(sum(abs(delta)) as bigint) as sum_dist from aln join contigs using (chr) where abs(delta) < 1034 and rev1 <> rev2 and pos1 between 1 and contig_len and pos2 between 1 and contig_len group by chr, klass")
def pair_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well-behaved pairs inside their contig, by contig and class."""
    pairs = v.aln(spark, sf_dir)
    return on_contig(pairs.where(well_behaved()), v.contigs(pairs)).groupBy("chr", "klass").agg(F.count("*").alias("n_pairs"), F.sum(F.abs("delta")).alias("sum_dist"))


def _clone_sql(umi: bool) -> str:
    same = " and (case when substr(umi, 1, 1) <> substr(lag(umi) over w, 1, 1) then 1 else 0 end + case when substr(umi, 2, 1) <> substr(lag(umi) over w, 2, 1) then 1 else 0 end) <= 1" if umi else ""
    return f"""with {v.ALN_DUP}, k as (select *, least(pos1, pos2) as lo, greatest(pos1, pos2) as hi from aln),
m as (select *, coalesce(lag(lo) over w = lo and lag(hi) over w = hi{same}, false) as is_clone from k window w as (partition by sample, chr, klass order by lo, hi, umi, {KEYS}))
select sample, chr, klass, count(*) as n_pairs, count(*) filter (is_clone) as n_clones, cast(sum(case when is_clone then 0 else ordinal end) as bigint) as kept_ordinals from m group by sample, chr, klass"""


def _clones(spark: SparkSession, sf_dir: str, umi: bool) -> DataFrame:
    marked = mark_clones(v.aln(spark, sf_dir, duplicates=True), umi)
    return marked.groupBy("sample", "chr", "klass").agg(F.count("*").alias("n_pairs"), F.count_if("is_clone").alias("n_clones"), F.sum(F.when(F.col("is_clone"), 0).otherwise(F.col("ordinal"))).alias("kept_ordinals"))


@query(_clone_sql(False))
def clone_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PCR duplicates against the previous pair in store order."""
    return _clones(spark, sf_dir, False)


@query(_clone_sql(True))
def clone_filter_umi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where the molecular barcodes differ in one base at most."""
    return _clones(spark, sf_dir, True)


@query(f"with {v.ALN_DUP} select sample, chr, klass, {KEYS}, row_number() over (partition by sample, chr, klass order by least(pos1, pos2), greatest(pos1, pos2), umi, {KEYS}) as rank from aln")
def pair_sort_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of each pair in the order of its store: numbered inside tiles of positions, with the rows of the tiles before added."""
    keyed = with_order_keys(v.aln(spark, sf_dir, duplicates=True))
    return ranked(keyed, ["sample", "chr", "klass"], F.expr("lo div 4096"), PAIR_ORDER).select("sample", "chr", "klass", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "rank")


def _merged(pairs: DataFrame) -> DataFrame:
    pairs = with_order_keys(pairs)
    merged = pairs.where("l_orderkey % 2 = 0").unionByName(pairs.where("l_orderkey % 2 <> 0"))
    return ranked(merged, ["chr"], F.expr("lo div 4096"), PAIR_ORDER).select("chr", "rank", "ordinal")


@query(f"with {v.ALN} select chr, ordinal, row_number() over (partition by chr order by least(pos1, pos2), greatest(pos1, pos2), umi, {KEYS}) as rank from aln")
def kway_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stores (even and odd orders) united and merged in pair order: all pairs of each contig."""
    return _merged(v.aln(spark, sf_dir))


ROUTED = f"""with {v.ALN}, w as (select *, chr as chr1, cast(case when l_orderkey % 13 = 0 then (l_suppkey + l_partkey) % 24 + 1 else chr end as int) as chr2, case when l_partkey % 17 = 0 then 0 else pos1 end as p1, case when l_orderkey % 19 = 0 then 0 else pos2 end as p2, case when l_partkey % 11 = 0 then 2 else 1 end as n_matches from aln),
f as (select *, case when p1 <= 0 and p2 <= 0 then 'UM' when not (p1 > 0 and p2 > 0) then 'HM' when chr1 <> chr2 or abs(p1 - p2) > 1023 then 'C' when n_matches > 1 then 'M' else klass end as family, case when p1 > 0 and p2 > 0 then least(p1, p2) else greatest(p1, p2) end as low from w)"""


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with some unmapped mates, mates on other contigs and multiple matches."""
    pairs = v.aln(spark, sf_dir).withColumn("chr1", F.col("chr")).withColumn("chr2", F.expr("cast(case when l_orderkey % 13 = 0 then (l_suppkey + l_partkey) % 24 + 1 else chr end as int)"))
    return route(pairs.withColumn("pos1", F.expr("case when l_partkey % 17 = 0 then 0 else pos1 end")).withColumn("pos2", F.expr("case when l_orderkey % 19 = 0 then 0 else pos2 end")).withColumn("n_matches", F.expr("case when l_partkey % 11 = 0 then 2 else 1 end")))


@query(ROUTED + " select family, chr1, cast(low // 67108864 as int) as part, count(*) as n_pairs from f group by 1, 2, 3")
def class_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store family, contig and part of each pair."""
    return routed(spark, sf_dir).groupBy("family", "chr1", "part").agg(F.count("*").alias("n_pairs"))


@query(ROUTED + " select chr1, count(*) as n_all, count(*) filter (family in ('p', 'N')) as n_pn, count(*) filter (family in ('m', 'g', 'C')) as n_mac, count(*) filter (family in ('UM', 'HM')) as n_uh from f group by 1")
def class_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs per contig that three choices of classes keep."""
    count = lambda letters: F.count_if(chosen(F.col("family"), letters)).alias(f"n_{letters}")
    return routed(spark, sf_dir).groupBy("chr1").agg(F.count("*").alias("n_all"), count("pn"), count("mac"), count("uh"))


@query(ROUTED + " select case when chr1 = chr2 then chr1 else least(abs(chr1 - chr2), 8) + 24 end as bucket, count(*) as n_pairs, cast(sum(ordinal) as bigint) as ordinals from f where family = 'C' group by 1")
def chimera_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chimeric pairs by contig or by the distance of their contigs."""
    return routed(spark, sf_dir).where("family = 'C'").groupBy(chimera_bucket(F.col("chr1"), F.col("chr2")).alias("bucket")).agg(F.count("*").alias("n_pairs"), F.sum("ordinal").alias("ordinals"))


@query(f"with {v.dna_sql()}, {v.tiles_sql(200)} select substr(seq, 1, 1) || substr(seq, 101, 1) as bucket, count(*) as n_pairs from t group by 1")
def unmapped_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unmapped pairs (every 200 bases of whole texts) by the first base of both mates; a pair at a text's end may lack the second."""
    pairs = tiles(v.dna(spark, sf_dir), 200)
    return pairs.groupBy(unmapped_bucket(F.col("seq"), F.substring("seq", 101, 100)).alias("bucket")).agg(F.count("*").alias("n_pairs"))


@query(f"""with {v.ALN} select chr, case when abs(delta) > 1023 then 'TooFar' else 'Pair' end as category, count(*) filter (klass = 'p') as n_p, count(*) filter (klass = 'N') as n_only_n, count(*) filter (klass = 'm') as n_m, count(*) filter (klass = 'g') as n_g, count(*) as n_total from aln group by 1, 2""")
def mapping_stats_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters per contig and category with a column per class."""
    return mapping_statistics(v.aln(spark, sf_dir))


@query(f"with {v.ALN} select klass, chr, count(*) as n_rows, min(least(pos1, pos2)) as min_pos, max(greatest(pos1, pos2)) as max_pos, cast(sum(len1 + len2) as bigint) as n_bases from aln group by klass, chr")
def store_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row count, position range and bases per store partition."""
    return v.aln(spark, sf_dir).groupBy("klass", "chr").agg(F.count("*").alias("n_rows"), F.min(F.least("pos1", "pos2")).alias("min_pos"), F.max(F.greatest("pos1", "pos2")).alias("max_pos"), F.sum(F.col("len1") + F.col("len2")).cast("long").alias("n_bases"))


@query(f"with {v.ALN} select chr, klass, count(*) as n_in, count(*) as n_out, true as intact from aln group by chr, klass")
def store_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs are written to a store and read again: rows in and out of each partition, and whether the rows are the same."""
    pairs, path = v.aln(spark, sf_dir), new_folder(spark, "store")
    write_store(pairs, path)
    columns = [c for c in pairs.columns if c not in ("chr", "klass")]
    digest = F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))
    count = lambda df, n, h: df.groupBy(F.col("chr").cast("int").alias("chr"), "klass").agg(F.count("*").alias(n), digest.alias(h))
    both = count(pairs, "n_in", "h_in").join(count(read_store(spark, path), "n_out", "h_out"), ["chr", "klass"], "full")
    return both.select("chr", "klass", "n_in", "n_out", (F.col("n_in").eqNullSafe(F.col("n_out")) & F.col("h_in").eqNullSafe(F.col("h_out"))).alias("intact"))


CIGAR = """c as (select *, case when klass <> 'g' then cast(len1 as varchar) || 'M' when is_del then cast(mm_off + 1 as varchar) || 'M' || cast(l_linenumber * 9 as varchar) || 'D' || cast(len1 - mm_off - 1 as varchar) || 'M'
  else cast(mm_off + 1 as varchar) || 'M' || cast(l_linenumber % 3 + 1 as varchar) || 'I' || cast(len1 - mm_off - 1 - (l_linenumber % 3 + 1) as varchar) || 'M' end as cigar from aln)"""


def with_cigar(pairs: DataFrame) -> DataFrame:
    """CIGAR of mate 1: gapped pairs hold one deletion or insertion."""
    cell = lambda n, op: F.struct(F.expr(n).cast("int").alias("n"), F.lit(op).alias("op"))
    dele = F.array(cell("mm_off + 1", "M"), cell("l_linenumber * 9", "D"), cell("len1 - mm_off - 1", "M"))
    ins = F.array(cell("mm_off + 1", "M"), cell("l_linenumber % 3 + 1", "I"), cell("len1 - mm_off - 1 - (l_linenumber % 3 + 1)", "M"))
    return pairs.withColumn("cigar", F.when(F.col("klass") != "g", F.array(cell("len1", "M"))).when(F.col("is_del"), dele).otherwise(ins))


@query(f"with {v.ALN}, {CIGAR} select klass, count(*) as n_pairs, count(*) filter (klass <> 'g' or not is_del or l_linenumber * 9 <= 40) as n_kept from c group by klass")
def indel_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs without an indel above 40 and with two indels at most."""
    return with_cigar(v.aln(spark, sf_dir)).groupBy("klass").agg(F.count("*").alias("n_pairs"), F.count_if(few_indels(F.col("cigar"))).alias("n_kept"))


@query(f"""with {v.ALN}, {CIGAR} select cigar, count(*) as n_pairs, any_value(case when klass = 'g' and is_del then len1 + l_linenumber * 9 when klass = 'g' then len1 - (l_linenumber % 3 + 1) else len1 end) as span, any_value(case when klass = 'g' and is_del then len1 + l_linenumber * 9 else len1 end) as n_ops from c group by cigar, len1""")
def cigar_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CIGAR text, the reference bases it spans and its length per base."""
    c = with_cigar(v.aln(spark, sf_dir))
    parsed = q.cigar_parse(q.cigar_text(F.col("cigar")))
    out = c.select(q.cigar_text(F.col("cigar")).alias("cigar"), "len1", q.reference_span(parsed).cast("long").alias("span"), F.size(q.expand_cigar(parsed)).cast("long").alias("n_ops"))
    return out.groupBy("cigar", "len1").agg(F.count("*").alias("n_pairs"), F.first("span").alias("span"), F.first("n_ops").alias("n_ops")).drop("len1")


@query(f"with {v.ALN} select mm_off as cycle, count(*) as n_mismatches, count(*) filter (rev1) as n_reverse from aln where klass in ('m', 'g') group by 1")
def mismatch_by_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mismatches by cycle of the read."""
    return v.aln(spark, sf_dir).where("klass in ('m', 'g')").groupBy(F.col("mm_off").alias("cycle")).agg(F.count("*").alias("n_mismatches"), F.count_if("rev1").alias("n_reverse"))


SAM = f"""with {v.ALN}, m as (select ordinal, 1 as mate, 67 + case when rev1 then 16 else 0 end + case when rev2 then 32 else 0 end as flag, chr, pos1 as pos, case when klass in ('m', 'g') then 254 * (len1 - 1) // len1 else 254 end as mapq, cast(len1 as varchar) || 'M' as cigar, pos2 as pnext, case when delta >= 0 then delta + len2 else delta - len1 end as tlen from aln
union all select ordinal, 2, 131 + case when rev2 then 16 else 0 end + case when rev1 then 32 else 0 end, chr, pos2, 254, cast(len2 as varchar) || 'M', pos1, -case when delta >= 0 then delta + len2 else delta - len1 end from aln)"""


def sam_rows(pairs: DataFrame) -> DataFrame:
    """SAM columns, one row per mate."""
    mm = F.when(F.col("klass").isin("m", "g"), 1).otherwise(0)
    tlen = q.template_length(F.col("delta"), F.col("len1"), F.col("len2"))
    one = F.struct(F.lit(1).alias("mate"), q.sam_flag(1, F.lit(1), F.col("rev1"), F.col("rev2")).alias("flag"), F.col("pos1").alias("pos"), q.pseudo_mapq(F.col("len1"), mm).alias("mapq"), F.concat(F.col("len1").cast("string"), F.lit("M")).alias("cigar"), F.col("pos2").alias("pnext"), tlen.alias("tlen"))
    two = F.struct(F.lit(2).alias("mate"), q.sam_flag(2, F.lit(1), F.col("rev2"), F.col("rev1")).alias("flag"), F.col("pos2").alias("pos"), F.lit(254).alias("mapq"), F.concat(F.col("len2").cast("string"), F.lit("M")).alias("cigar"), F.col("pos1").alias("pnext"), (-tlen).alias("tlen"))
    return pairs.select("ordinal", "chr", F.explode(F.array(one, two)).alias("r")).select("ordinal", "chr", "r.*")


@query(SAM + " select ordinal, mate, flag, chr, pos, mapq, cigar, pnext, tlen from m")
def sam_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAM flags, qualities and template lengths of both mates."""
    return sam_rows(v.aln(spark, sf_dir)).select("ordinal", "mate", "flag", "chr", "pos", "mapq", "cigar", "pnext", "tlen")


def _dump(sequences: DataFrame) -> DataFrame:
    at, one = F.concat_ws(":", F.col("id").cast("string"), F.col("off").cast("string")), F.substring("seq", 1, 100)
    lines = F.array(F.concat(F.lit("000 "), at, F.lit(" fixed_len="), F.length(one).cast("string")), F.concat(F.lit("001 Head1 @"), at, F.lit("/1")), F.concat(F.lit("002 Read1 "), one), F.concat(F.lit("003 Read2 "), q.revcomp(F.substring("seq", 101, 100))))
    return tiles(sequences, 200).select("id", "off", F.posexplode(lines).alias("no", "line")).withColumn("no", F.col("no").cast("long"))


@query(f"""with {v.dna_sql()}, {v.tiles_sql(200)}, n as (select id, off, id || ':' || off as name, unnest(range(0, 4)) as no, seq from t)
select id, off, no, case no when 0 then '000 ' || name || ' fixed_len=' || length(substr(seq, 1, 100)) when 1 then '001 Head1 @' || name || '/1' when 2 then '002 Read1 ' || substr(seq, 1, 100) else '003 Read2 ' || reverse(translate(substr(seq, 101, 100), 'ACGT', 'TGCA')) end as line from n""")
def raw_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines of each pair, as in a golden dump: every 200 bases of whole texts and the rest, named by text and offset."""
    return _dump(v.dna(spark, sf_dir))


def _fastq(sequences: DataFrame) -> DataFrame:
    head = F.concat(F.lit("@"), F.col("id").cast("string"), F.lit(":"), F.col("off").cast("string"), F.lit("/1"))
    return tiles(sequences, 100).select("id", "off", F.concat_ws("\n", head, "seq", F.lit("+"), F.repeat(F.lit("I"), F.length("seq"))).alias("record"))


@query(f"""with {v.dna_sql()}, {v.tiles_sql(100)} select id, off, '@' || id || ':' || off || '/1' || chr(10) || seq || chr(10) || '+' || chr(10) || repeat('I', length(seq)) as record from t""")
def fastq_export_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTQ records of every 100 bases of whole texts and the rest, named by text and offset."""
    return _fastq(v.dna(spark, sf_dir))


def _fasta(sequences: DataFrame) -> DataFrame:
    return tiles(sequences, 136).select("id", "off", F.concat(F.lit(">"), F.col("id").cast("string"), F.lit(":"), F.col("off").cast("string"), F.lit("\n"), "seq").alias("record"))


@query(f"with {v.dna_sql()}, {v.tiles_sql(136)} select id, off, '>' || id || ':' || off || chr(10) || seq as record from t")
def fasta_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTA records of every 136 bases of whole texts and the rest, named by text and offset."""
    return _fasta(v.dna(spark, sf_dir))


@query("""with o as (select o_custkey as name, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as k from orders), p as (select name || '_' || (k + 1) // 2 as name, (k - 1) % 2 + 1 as mate, o_orderkey from o)
select name, max(case when mate = 1 then o_orderkey end) as read1, max(case when mate = 2 then o_orderkey end) as read2, count(*) = 2 as paired from p group by name""")
def mate_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interleaved reads joined by name; ``paired`` is false for a read without mate."""
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    reads = v.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", k.alias("k")).selectExpr("concat(o_custkey, '_', (k + 1) div 2) as name", "(k - 1) % 2 + 1 as mate", "o_orderkey")
    return reads.groupBy("name").agg(F.max(F.when(F.col("mate") == 1, F.col("o_orderkey"))).alias("read1"), F.max(F.when(F.col("mate") == 2, F.col("o_orderkey"))).alias("read2"), (F.count("*") == 2).alias("paired"))


@query("""with h as (select event_id, '@' || substr(translate(cast(user_id as varchar), '0123456789', 'ACGTACGTAC') || 'ACGTAC', 1, 8) || ':' || event_type || ':' || event_id || ' 1:N:0' as header, repeat('#', cast(event_id % 3 as int)) || repeat('5', cast(event_id % 7 as int)) || repeat('#', cast(event_id % 5 as int)) as qual from events)
select event_id, split_part(header, ' ', 1) as stem, regexp_extract(header, '^@?([ACGTN]{6,11}):', 1) as umi, greatest(length(regexp_replace(qual, '#+$', '')), 1) as valid_len from h""")
def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header stem, molecular barcode and valid-quality length."""
    header = F.expr("concat('@', substr(concat(translate(cast(user_id as string), '0123456789', 'ACGTACGTAC'), 'ACGTAC'), 1, 8), ':', event_type, ':', event_id, ' 1:N:0')")
    qual = F.expr("concat(repeat('#', cast(event_id % 3 as int)), repeat('5', cast(event_id % 7 as int)), repeat('#', cast(event_id % 5 as int)))")
    return v.table(spark, sf_dir, "events").select("event_id", q.header_stem(header).alias("stem"), q.header_umi(header).alias("umi"), q.valid_quality_length(qual).cast("long").alias("valid_len"))
