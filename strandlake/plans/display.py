"""Displays and exports of single reads, and the rules that gate them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import display as d
from strandlake.operators.filters import ranked
from strandlake.operators.reads import tiles
from strandlake.plans import kmer
from strandlake.plans.pairs import ROUTED, routed, with_cigar
from strandlake.plans.registry import query
from strandlake.sources import views as v

KEYS = "ordinal, l_partkey, l_suppkey"
#: Mate 1 of the derived pairs: ``n_del`` deleted or ``n_ins`` inserted bases behind its first mm_off + 1 bases, of which the last is changed.
SHAPE = "select *, case when klass = 'g' and is_del then cast(l_linenumber * 9 as int) else 0 end as n_del, case when klass = 'g' and not is_del then cast(l_linenumber % 3 + 1 as int) else 0 end as n_ins"
QUAL = "substr(repeat('FFFE:,##', 15), cast(ordinal % 8 as int) + 1, len1)"


def _bases_sql(start: str, n: str) -> str:
    return f"coalesce(list_aggregate(list_transform(range(0, {n}), lambda i: {v.base_sql('chr', f'({start} + i)')}), 'string_agg', ''), '')"


READ1 = f"""sh as ({SHAPE} from aln), rd as (select *, case when klass in ('m', 'g') then {_bases_sql('pos1', 'mm_off')} || mm_nt || repeat(mm_nt, n_ins) || {_bases_sql('(pos1 + mm_off + 1 + n_del)', '(len1 - mm_off - 1 - n_ins)')} else {_bases_sql('pos1', 'len1')} end as seq, {QUAL} as qual from sh)"""


def first_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mate 1 with its CIGAR, bases and qualities."""
    bases = v.bases_at
    pairs = with_cigar(v.aln(spark, sf_dir)).withColumn("n_del", F.expr("case when klass = 'g' and is_del then cast(l_linenumber * 9 as int) else 0 end")).withColumn("n_ins", F.expr("case when klass = 'g' and not is_del then cast(l_linenumber % 3 + 1 as int) else 0 end"))
    changed = f"concat({bases('pos1', 'mm_off')}, mm_nt, repeat(mm_nt, n_ins), {bases('(pos1 + mm_off + 1 + n_del)', '(len1 - mm_off - 1 - n_ins)')})"
    return pairs.withColumn("seq", F.expr(f"case when klass in ('m', 'g') then {changed} else {bases('pos1', 'len1')} end")).withColumn("qual", F.expr(QUAL))


SHOWN = "case when n_del > 0 then substr({x}, 1, mm_off + 1) || repeat('_', n_del) || substr({x}, mm_off + 2) when n_ins > 0 then substr({x}, 1, mm_off) || '*' || substr({x}, mm_off + n_ins + 2) else {x} end"


@query(f"with {v.ALN}, {READ1} select {KEYS}, {SHOWN.format(x='seq')} as shown, {SHOWN.format(x='qual')} as shown_qual from rd")
def display_cigar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and qualities laid out on the reference."""
    reads = first_mates(spark, sf_dir)
    return reads.select(*KEYS.split(", "), d.laid_out(F.col("seq"), F.col("cigar")).alias("shown"), d.laid_out(F.col("qual"), F.col("cigar")).alias("shown_qual"))


@query(f"with {v.ALN}, {READ1}, c as (select *, cast(ordinal % 7 as int) as n_clip from rd) select {KEYS}, case when n_clip > mm_off or klass not in ('m', 'g') then repeat('N', n_clip) || substr(seq, n_clip + 1) else repeat('N', n_clip) || substr(seq, n_clip + 1, mm_off - n_clip) || substr(seq, mm_off + 1, 1) || repeat('N', n_ins) || substr(seq, mm_off + n_ins + 2) end as rebuilt from c where n_clip <= mm_off")
def rebuild_without_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads rebuilt from the reference, with N for clipped and inserted bases."""
    reads = first_mates(spark, sf_dir).withColumn("n_clip", F.expr("cast(ordinal % 7 as int)")).where("n_clip <= mm_off")
    window = v.bases_at("pos1", "(len1 + n_del + 1)")
    first = F.struct((F.col("cigar")[0]["n"] - F.col("n_clip")).alias("n"), F.lit("M").alias("op"))
    cigar = F.concat(F.array(F.struct(F.col("n_clip").alias("n"), F.lit("S").alias("op")), first), F.slice("cigar", 2, 10))
    changes = F.when(F.col("klass").isin("m", "g"), F.array(F.struct(F.col("mm_off").alias("pos"), F.col("mm_nt").alias("nt")))).otherwise(F.array().cast("array<struct<pos: int, nt: string>>"))
    return reads.select(*KEYS.split(", "), d.without_clips(F.expr(window), cigar, changes).alias("rebuilt"))


@query(f"with {v.ALN}, {READ1} select {KEYS}, array_to_string(['r' || ordinal, {SHOWN.format(x='seq')}, {SHOWN.format(x='qual')}, seq, qual, cast(pos1 - 1 as varchar), case when rev1 then '1' else '0' end, cast(len1 + n_del - n_ins as varchar), '0', cast(ordinal as varchar)], chr(9::int)) as line from (select *, chr as contig from rd) where pos1 between 500 and 6000".replace("array_to_string([", "list_aggregate([").replace("], chr(9::int))", "], 'string_agg', chr(9::int))"))
def view_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines for a viewer: the reads that begin in a range, laid out and as they are."""
    reads = first_mates(spark, sf_dir).where("pos1 between 500 and 6000")
    text = lambda c: c.cast("string")
    cells = [F.concat(F.lit("r"), text(F.col("ordinal"))), d.laid_out(F.col("seq"), F.col("cigar")), d.laid_out(F.col("qual"), F.col("cigar")), "seq", "qual", text(F.col("pos1") - 1), F.when(F.col("rev1"), "1").otherwise("0"), text(F.col("len1") + F.col("n_del") - F.col("n_ins")), F.lit("0"), text(F.col("ordinal"))]
    return reads.select(*KEYS.split(", "), F.concat_ws("\t", *cells).alias("line"))


@query(
    f"""with {v.ALN}, {READ1}, x as (select *, chr as contig, l_partkey % 11 = 0 as twice from rd)
select {KEYS}, ordinal || chr(9::int) || contig || chr(9::int) || klass || chr(9::int) || pos1 || chr(9::int) || (pos1 + len1 - 1) || chr(9::int) || seq || case when twice then chr(9::int) || contig || chr(9::int) || klass || chr(9::int) || (pos1 + 7919) || chr(9::int) || (pos1 + 7919 + len1 - 1) else '' end as line from x"""
)
def match_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line a read with all its matches: contig, class and place, and the bases behind the first."""
    text = lambda c: F.expr(f"cast({c} as string)")
    place = lambda shift: [text("chr"), F.col("klass"), text(f"pos1 + {shift}"), text(f"pos1 + {shift} + len1 - 1")]
    more = F.when(F.expr("l_partkey % 11 = 0"), F.concat_ws("\t", *place(7919)))
    return first_mates(spark, sf_dir).select(*KEYS.split(", "), F.concat_ws("\t", text("ordinal"), *place(0), "seq", more).alias("line"))


@query(
    f"""with {v.ALN}, ends as (select chr, max(greatest(pos1, pos2)) - 50 as contig_len from aln group by chr), s as (select *, case when klass = 'g' and is_del then len1 + l_linenumber * 9 when klass = 'g' then len1 - (l_linenumber % 3 + 1) else len1 end as span1 from aln)
select klass, count(*) as n_pairs, count(*) filter (pos1 > 0 and pos1 + span1 < contig_len and pos2 > 0 and pos2 + len2 < contig_len) as n_kept from s join ends using (chr) group by klass"""
)
def sam_edge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that lie inside their contig with all the bases they span, by class."""
    from strandlake.functions.sequence import reference_span

    pairs = with_cigar(v.aln(spark, sf_dir))
    ends = pairs.groupBy("chr").agg((F.max(F.greatest("pos1", "pos2")) - 50).alias("contig_len"))
    inside = d.inside_contig(F.col("pos1"), reference_span(F.col("cigar")), F.col("pos2"), F.col("len2"), F.col("contig_len"))
    return pairs.join(ends, "chr").groupBy("klass").agg(F.count("*").alias("n_pairs"), F.count_if(inside).alias("n_kept"))


@query(f"with {v.dna_sql()}, {v.tiles_sql(100)} select id, case when length(seq) <= 17 then 'none' when length(seq) < 32 then 'direct' else 'gapped' end as gate, count(*) as n_reads, sum(length(seq))::bigint as n_bases from t group by 1, 2")
def read_length_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of whole texts by what their length allows."""
    reads = tiles(v.dna(spark, sf_dir), 100)
    return reads.groupBy("id", d.length_gate(F.length("seq")).alias("gate")).agg(F.count("*").alias("n_reads"), F.sum(F.length("seq")).alias("n_bases"))


@query(ROUTED + """, h as (select chr, p1, p2, umi, ordinal, l_partkey, l_suppkey, l_orderkey, l_linenumber, low, translate(cast(l_orderkey as varchar), '0123456789', 'ACGTACGTAC') as rest from f where family = 'HM')
select chr, ordinal, l_partkey, l_suppkey, l_orderkey, l_linenumber, row_number() over (partition by chr order by low, umi, rest, length(rest), l_partkey, l_suppkey, l_orderkey, l_linenumber) as rank from h""")
def halfmap_sort_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of half-mapped pairs: by the place of the mapped mate, then by the bases of the other."""
    half = routed(spark, sf_dir).where("family = 'HM'").withColumn("low", F.greatest("pos1", "pos2")).withColumn("rest", F.expr("translate(cast(l_orderkey as string), '0123456789', 'ACGTACGTAC')")).withColumn("n", F.length("rest"))
    order = ["low", "umi", "rest", "n", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"]
    return ranked(half, ["chr"], F.expr("low div 4096"), order).select("chr", "ordinal", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "rank")


_BINS = ", ".join(f"least(count(*) filter ({'rev1' if m == 'm' else 'not rev1'} and b = {b}), 65535) as {m}_q{b}" for m in "pm" for b in range(4))


@query(f"with {v.ALN_DUP}, q as (select *, (ordinal * 7 + mm_off * 3) % 41 as q from aln where klass in ('m', 'g')), b as (select *, case when q <= 5 then 0 when q <= 9 then 1 when q <= 19 then 2 else 3 end as b from q) select chr, pos1 + mm_off as pos, mm_nt as allele, {_BINS} from b group by all")
def allele_phred_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mismatch alleles by strand and quality."""
    events = v.aln(spark, sf_dir, duplicates=True).where("klass in ('m', 'g')").selectExpr("chr", "pos1 + mm_off as pos", "mm_nt as allele", "rev1 as rev", "(ordinal * 7 + mm_off * 3) % 41 as q")
    return d.allele_accounting(events, ["chr", "pos", "allele"])


@query(f"""with {v.dna_sql()}, {v.tiles_sql(100)}, one as (select id as id1, off as off1, row_number() over (order by id, off) as ordinal from t where off % 200 = 0), two as (select id as id2, off as off2, row_number() over (order by id, off) as ordinal from t where off % 200 = 100)
select ordinal, id1, off1, id2, off2, id1 is not null and id2 is not null as paired from one full join two using (ordinal)""")
def mate_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of reads joined by position; the longer one's last reads have no mate."""
    reads = tiles(v.dna(spark, sf_dir), 100).select("id", "off").withColumn("all", F.lit(1))
    numbered = lambda part, k: ranked(reads.where(f"off % 200 = {part}"), ["all"], F.expr("id div 64"), ["id", "off"]).select(F.col("rank").cast("long").alias("ordinal"), F.col("id").alias(f"id{k}"), F.col("off").alias(f"off{k}"))
    both = numbered(0, 1).join(numbered(100, 2), "ordinal", "full")
    return both.withColumn("paired", F.col("id1").isNotNull() & F.col("id2").isNotNull())


TRIM = "tr as (select o_orderkey * 8 + 1 as ordinal, o_custkey % 29 as c0, o_custkey % 3 as n0, o_orderkey % 31 as c1, o_orderkey % 4 as n1, o_custkey % 23 as c2, o_custkey % 5 as n2, (o_custkey + o_orderkey) % 27 as c3, o_orderkey % 2 as n3 from orders)"
VALID = "not ((c0 = 0 and n0 <> 0) or (c1 = 0 and n1 <> 0) or (c2 = 0 and n2 <> 0) or (c3 = 0 and n3 <> 0) or (c0 > 20 and c2 > 20) or (c1 > 20 and c3 > 20))"


@query(f"with {v.ALN}, {TRIM}, j as (select a.*, n0, n1, n2, n3, case when tr.ordinal is null then null else {VALID} end as valid from aln a left join tr on a.ordinal = tr.ordinal) select {KEYS}, valid, case when valid then len1 - n0 - n1 else len1 end as kept1, case when valid then len2 - n2 - n3 else len2 end as kept2 from j")
def trim_table_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with the lengths that a table of trimmed ends, by ordinal, leaves them; entries that can't be right are passed over."""
    table = v.table(spark, sf_dir, "orders").selectExpr("o_orderkey * 8 + 1 as ordinal", "o_custkey % 29 as c0", "o_custkey % 3 as n0", "o_orderkey % 31 as c1", "o_orderkey % 4 as n1", "o_custkey % 23 as c2", "o_custkey % 5 as n2", "(o_custkey + o_orderkey) % 27 as c3", "o_orderkey % 2 as n3")
    table = table.withColumn("valid", d.valid_trim([F.col(f"c{k}") for k in range(4)], [F.col(f"n{k}") for k in range(4)]))
    joined = v.aln(spark, sf_dir).join(table, "ordinal", "left")
    kept = lambda k, a, b: F.when(F.col("valid"), F.col(f"len{k}") - F.col(a) - F.col(b)).otherwise(F.col(f"len{k}")).cast("long").alias(f"kept{k}")
    return joined.select(*KEYS.split(", "), "valid", kept(1, "n0", "n1"), kept(2, "n2", "n3"))


_SHARED = "(a.pos1 = b.pos1 or a.pos2 = b.pos2 or a.pos1 = b.pos2 or a.pos2 = b.pos1) and a.chr = b.chr"


@query(f"""with pr as ({kmer.ORACLE_PAIRING}), a as (select * from pr where rank = 1), j as (select a.id, a."at", a.score, coalesce(a.score = b.score, false) as equal, coalesce({_SHARED}, false) as shared, abs(b.pos1 - b.pos2) < abs(a.pos1 - a.pos2) as shorter, a.chr as ac, a.pos1 as a1, a.pos2 as a2, b.chr as bc, b.pos1 as b1, b.pos2 as b2
  from a left join (select * from pr where rank = 2) b on a.id = b.id and a."at" = b."at")
select id, "at", case when equal and shared and shorter then bc else ac end as chr, case when equal and shared and shorter then b1 else a1 end as pos1, case when equal and shared and shorter then b2 else a2 end as pos2, score,
  case when equal and not shared then bc end as alt_chr, case when equal and not shared then b1 end as alt_pos1, case when equal and not shared then b2 end as alt_pos2, case when equal and not shared then 2 else 1 end as n_matches from j""")
def best_alternate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best pair of each read and an equally good one elsewhere."""
    return d.best_and_alternate(kmer.seed_pairing(spark, sf_dir), ["id", "at"])
