"""Read preparation, transcript coordinates, orders of unmapped pairs, further exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions.sequence import revcomp
from strandlake.operators import reads as rd
from strandlake.operators.filters import ranked
from strandlake.plans.kmer import peptide_sql
from strandlake.plans.pairs import with_cigar
from strandlake.plans.registry import query
from strandlake.sources import views as v


def _wrong(*at: int) -> str:
    return "".join(("G" if b == "T" else "T") if k in at else b for k, b in enumerate(rd.ADAPTER))


#: The adapter as derived reads hold it, by id % 6: not at all, whole, with two or three errors, with another first base.
INSERTED = f"case id % 6 when 0 then '' when 3 then '{_wrong(10, 20)}' when 4 then '{_wrong(10, 15, 20)}' when 5 then 'C{rd.ADAPTER[1:]}' else '{rd.ADAPTER}' end"
ADAPTED = f"substr(concat(substr(seq, 1, cast(30 + id % 80 as int)), {INSERTED}, substr(seq, 100, 40)), 1, 100)"
QUALITY = "substr(repeat('FFFFE::,##', 10), 1, length(seq))"


def _with_adapter(sequences: DataFrame) -> DataFrame:
    """Reads of whole sequences, one behind the other: 30 + id % 80 bases (100 at most count), the adapter in five of six, other bases."""
    spans = rd.tiles(sequences, 139, F.least(F.expr("cast(30 + id % 80 as int)"), F.lit(100)))
    return spans.select("id", "off", F.expr(ADAPTED).alias("seq")).withColumn("qual", F.expr(QUALITY))


def _trim_sql(mate: int, longest: int) -> str:
    """The rule in SQL: ``p0`` to ``p2`` are the last places of the adapter's 6-mers, ``n`` the read's length, ``m`` what is compared."""
    last = lambda k: f"case when instr(seq, '{rd.ADAPTER[k : k + 6]}') > 0 then length(seq) - instr(reverse(seq), '{rd.ADAPTER[k : k + 6][::-1]}') - 5 else -1 end - {k} as p{k}"
    tails = " ".join(f"when ends_with(seq, '{rd.ADAPTER[:k]}') then n - {k}" for k in range(5, 0, -1))
    turned = "reverse(translate(kept, 'ACGT', 'TGCA'))" if mate == 2 else "kept"
    quality = "reverse(q)" if mate == 2 else "q"
    return f"""with {v.dna_sql()}, t as (select id, off, substr(seq, off + 1, 139) as seq from (select id, seq, unnest(range(0, length(seq), least(30 + id % 80, 100))) as off from dna)),
r as (select id, off, {ADAPTED} as seq from t), a as (select *, length(seq) as n, {QUALITY} as qual, {last(0)}, {last(1)}, {last(2)} from r), b as (select *, case when p0 >= 0 then p0 when p1 >= 0 then p1 else p2 end as p from a), c as (select *, least(n - p, {len(rd.ADAPTER)}) as m from b),
d as (select *, case when p >= 40 and (m <= 6 or 6 + length(list_filter(range(6, m + 1), lambda j: substr(seq, p + j + 1, 1) = substr('{rd.ADAPTER}', j + 1, 1))) + 2 >= m) then p else case {tails} else n end end as k from c),
e as (select *, substr(seq, 1, k) as kept, case when k >= 40 and k < n then substr(qual, 1, k) else qual end as q from d)
select id, off, substr({turned}, 1, {longest}) as seq, substr({quality}, 1, {longest}) as qual, k < n as cut from e"""


@query(_trim_sql(1, 100))
def trim_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First mates (reads of whole texts) without the adapter."""
    return rd.trim_adapters(_with_adapter(v.dna(spark, sf_dir)))


@query(_trim_sql(2, 60))
def trim_adapter_mate2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second mates without the adapter, turned around and cut at 60 bases."""
    return rd.trim_adapters(_with_adapter(v.dna(spark, sf_dir)), 2, 60)


@query(
    f"""with {v.dna_sql()}, p as (select id, phase, string_split({peptide_sql()}, '*') as parts from dna, range(0, 3) as x(phase)), u as (select id, phase, unnest(parts) as part, generate_subscripts(parts, 1) as i from p),
o as (select *, coalesce(sum(length(part) + 1) over (partition by id, phase order by i rows between unbounded preceding and 1 preceding), 0) as before from u)
select id, cast(phase + 3 * (before + instr(part, 'M') - 1) as bigint) as start, substr(part, instr(part, 'M')) as peptide from o where instr(part, 'M') > 0 and length(part) - instr(part, 'M') + 1 >= 20"""
)
def open_reading_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peptides of 20 amino acids and more in whole texts."""
    return rd.open_frames(v.dna(spark, sf_dir))


EXONS = f"""{v.FEATURES}, raw as (select gene_id as tid, chr, start, "end", row_number() over (partition by gene_id order by start, feature_id) as k from features where kind = 'exon'),
ex as (select tid, (k - 1) * 20000 + start as start, (k - 1) * 20000 + "end" as "end" from raw), pl as (select *, "end" - start + 1 as bases, sum("end" - start + 1) over (partition by tid order by start) - ("end" - start + 1) as first, lead(start) over (partition by tid order by start) is null as is_last from ex),
hits as (select o_orderkey as hit, o_custkey as tid, (o_orderkey * 11) % 700 as off, 100 as len from orders)"""


@query(
    f"""with {EXONS}, j as (select hit, tid, start + greatest(off, first) - first as g, case when is_last then off + len else least(off + len, first + bases) end - greatest(off, first) as n from hits join pl using (tid) where (off < first + bases and off + len > first) or (is_last and off + len > first + bases)),
o as (select *, lag(g + n) over (partition by hit, tid order by g) as before from j where n > 0)
select hit, tid, cast(min(g) as bigint) as start, string_agg(case when before is null then '' else cast(g - before as bigint) || 'N' end || cast(n as bigint) || 'M', '' order by g) as cigar from o group by hit, tid"""
)
def transcript_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits on transcripts as genome starts and CIGARs with introns."""
    return _lifted(spark, sf_dir, v.table(spark, sf_dir, "orders"))


def _lifted(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    exons = v.features(spark, sf_dir).where("kind = 'exon'").withColumn("k", F.row_number().over(Window.partitionBy("gene_id").orderBy("start", "feature_id")))
    exons = exons.selectExpr("gene_id as tid", "(k - 1) * 20000 + start as start", "(k - 1) * 20000 + end as end")
    hits = orders.selectExpr("o_orderkey as hit", "o_custkey as tid", "(o_orderkey * 11) % 700 as off", "100 as len")
    return rd.lift(hits, exons)


def _pair_ranks(sequences: DataFrame) -> DataFrame:
    p = rd.tiles(sequences, 120).select("id", "off", F.substring("seq", 1, 60).alias("s1"), F.substring("seq", 61, 60).alias("s2"))
    p = p.select("id", "off", F.concat(F.substring("s1", 1, 1), F.substring("s2", 1, 1)).alias("bucket"), F.concat("s1", "s2").alias("s"), F.length(F.concat("s1", "s2")).alias("n"))
    return ranked(p, ["bucket"], F.substring("s", 1, 6), ["s", "n", "id", "off"]).select("id", "off", "rank")


@query(f"with {v.dna_sql()}, {v.tiles_sql(120)} select id, off, row_number() over (partition by substr(seq, 1, 1) || substr(seq, 61, 1) order by seq, length(seq), id, off) as rank from t")
def unmapped_sort_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of unmapped pairs (every 120 bases of whole texts) in their bucket: by bases, length and name."""
    return _pair_ranks(v.dna(spark, sf_dir))


@query(f"""with {v.ALN} select ordinal, l_partkey, l_suppkey, case when rev1 then '-' else '+' end || ' chr' || chr || ':' || pos1 || '..' || (pos1 + len1 - 1) || ' ' || klass as fetch_line, chr || chr(9::int) || least(pos1, pos2) || chr(9::int) || greatest(pos1, pos2) || chr(9::int) || umi as contig_line,
case when klass in ('m', 'g') then (mm_off + 1) || ':' || mm_nt else '.' end as refless_line from (select *, chr as c from aln)""".replace("' chr' || chr ||", "' chr' || c ||").replace("chr || chr(9::int) || least", "c || chr(9::int) || least"))
def export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text exports: place on the genome, contig table, and mismatches without a reference."""
    tab = F.lit("\t")
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    fetch = F.concat(F.when(F.col("rev1"), "-").otherwise("+"), F.lit(" chr"), text("chr"), F.lit(":"), text("pos1"), F.lit(".."), text(F.col("pos1") + F.col("len1") - 1), F.lit(" "), "klass")
    contig = F.concat(text("chr"), tab, text(F.least("pos1", "pos2")), tab, text(F.greatest("pos1", "pos2")), tab, "umi")
    refless = F.when(F.col("klass").isin("m", "g"), F.concat(text(F.col("mm_off") + 1), F.lit(":"), "mm_nt")).otherwise(".")
    return v.aln(spark, sf_dir).select("ordinal", "l_partkey", "l_suppkey", fetch.alias("fetch_line"), contig.alias("contig_line"), refless.alias("refless_line"))


@query(
    f"""with {v.ALN}, w as (select *, pos1 + (case when klass = 'g' and is_del then len1 + l_linenumber * 9 when klass = 'g' then len1 - (l_linenumber % 3 + 1) else len1 end) as e1, pos2 + len2 as e2 from aln)
select klass, count(*) as n, cast(sum(case when pos1 <= pos2 then e2 - pos1 else -(e1 - pos2) end) as bigint) as tlen_sum from w group by klass"""
)
def cigar_template_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template lengths from CIGAR-adjusted ends."""
    from strandlake.functions.sequence import reference_span

    c = with_cigar(v.aln(spark, sf_dir)).withColumn("e1", F.col("pos1") + reference_span(F.col("cigar"))).withColumn("e2", F.col("pos2") + F.col("len2"))
    tlen = F.when(F.col("pos1") <= F.col("pos2"), F.col("e2") - F.col("pos1")).otherwise(-(F.col("e1") - F.col("pos2")))
    return c.groupBy("klass").agg(F.count("*").alias("n"), F.sum(tlen).alias("tlen_sum"))


def _canonical_reads(sequences: DataFrame) -> DataFrame:
    return rd.tiles(sequences, 50).select("id", "off", F.col("seq").alias("fwd"), (revcomp(F.col("seq")) < F.col("seq")).alias("is_reverse"))


@query(f"with {v.dna_sql()}, {v.tiles_sql(50)} select id, off, seq as fwd, reverse(translate(seq, 'ACGT', 'TGCA')) < seq as is_reverse from t")
def canonical_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each 50 bases of whole texts belong to the forward or the reverse output of the canonical split."""
    return _canonical_reads(v.dna(spark, sf_dir))
