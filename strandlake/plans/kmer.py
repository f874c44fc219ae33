"""K-mer tables and seed lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import sequence as q
from strandlake.operators.intervals import overlap_join
from strandlake.operators.kmers import code_counts, kmer_counts, kmer_text, pair_hits, place_slots, seed_keys, seed_table, seed_text, strand_hits, unique_prefixes, uniqueness
from strandlake.operators.reads import codon_phases, tiles
from strandlake.plans.registry import query
from strandlake.sources import views as v

K = 11
COUNTS = f"""with {v.dna_sql()}, e as (select unnest(list_transform(range(1, greatest(length(seq) - {K} + 2, 1)), lambda i: substr(seq, i, {K}))) as kmer from dna),
counts as (select least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) as kmer, count(*) as cnt from e group by 1)"""


@query(f"with {v.dna_sql()} select id, reverse(translate(regexp_replace(seq, '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) as rc, length(seq) as n_bases from dna")
def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse complement of whole texts."""
    return v.dna(spark, sf_dir).select("id", q.revcomp(F.col("seq")).alias("rc"), F.length("seq").cast("long").alias("n_bases"))


def _encoded(sequences: DataFrame) -> DataFrame:
    return seed_keys(sequences)


@query(
    f"""with {v.dna_sql()}, s as (select id, off, substr(seq, off + 1, 18) as k18 from (select id, seq, unnest(range(0, greatest(length(seq) - 17, 0))) as off from dna))
select id, off, substr(k18, 17, 2) as next2, list_sum(list_transform(range(1, 17), lambda i: (instr('ACGT', substr(k18, i, 1)) - 1) * (4 ** (16 - i))::bigint))::bigint & 1073741823 as seed_key from s"""
)
def kmer16_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table address and the two following bases of every 18-mer of whole texts."""
    return _encoded(v.dna(spark, sf_dir))


@query(COUNTS + " select kmer, cnt from counts")
def kmer_canonical_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All canonical 11-mers with their counts."""
    return kmer_counts(v.dna(spark, sf_dir), K)


@query(COUNTS + " select case when cnt = 1 then 'unique' when cnt = 2 then 'dual' else 'multi' end as klass, count(*) as n_kmers, cast(sum(cnt) as bigint) as n_total from counts group by 1")
def kmer_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-mers and occurrences per uniqueness class."""
    return uniqueness(kmer_counts(v.dna(spark, sf_dir), K)).groupBy("klass").agg(F.count("*").alias("n_kmers"), F.sum("cnt").alias("n_total"))


@query(COUNTS + " select substr(kmer, 1, 9) as prefix, count(*) as n_ext from counts group by 1 having max(cnt) = 1 and count(*) <= 4")
def kmer_prefix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """9-mer prefixes with unique extensions only."""
    return unique_prefixes(kmer_counts(v.dna(spark, sf_dir), K), 9)


@query(COUNTS + " , t as (select substr(kmer, 1, 8) as p, count(*) filter (cnt = 1) as n_unique, count(*) filter (cnt = 2) as n_dual, count(*) filter (cnt > 2) as n_multi from counts group by 1) select n_unique, n_dual, n_multi, count(*) as n_prefixes from t group by 1, 2, 3")
def kmer_mappability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of (unique, dual, multi) extensions over 8-mer prefixes: one grouping instead of a three-way merge."""
    counts = kmer_counts(v.dna(spark, sf_dir), K)
    triple = counts.groupBy(F.substring("kmer", 1, 8).alias("p")).agg(F.count_if(F.col("cnt") == 1).alias("n_unique"), F.count_if(F.col("cnt") == 2).alias("n_dual"), F.count_if(F.col("cnt") > 2).alias("n_multi"))
    return triple.groupBy("n_unique", "n_dual", "n_multi").agg(F.count("*").alias("n_prefixes"))


def _both_strands(sequences: DataFrame) -> DataFrame:
    """The reverse strand's 12-mers are the reverse complements of the forward ones: counted once, before the merge."""
    forward = code_counts(sequences, 12, others=True).select(F.coalesce("other", kmer_text(F.col("code"), 12)).alias("kmer"), F.col("cnt").alias("n"))
    zero = F.lit(0).cast("long")
    sides = F.array(F.struct("kmer", F.col("n").alias("f"), zero.alias("r")), F.struct(q.revcomp(F.col("kmer")).alias("kmer"), zero.alias("f"), F.col("n").alias("r")))
    both = forward.select(F.explode(sides).alias("x")).select("x.*")
    return both.groupBy("kmer").agg(F.sum("f").alias("n_fwd"), F.sum("r").alias("n_rev"), F.sum(F.col("f") + F.col("r")).alias("n_all"))


@query(
    f"""with {v.dna_sql()}, e as (select substr(seq, off + 1, 12) as kmer from (select seq, unnest(range(0, greatest(length(seq) - 11, 0))) as off from dna)),
strands as (select kmer, 1 as f, 0 as r from e union all select reverse(translate(kmer, 'ACGT', 'TGCA')), 0, 1 from e) select kmer, cast(sum(f) as bigint) as n_fwd, cast(sum(r) as bigint) as n_rev, cast(sum(f + r) as bigint) as n_all from strands group by kmer"""
)
def kmer_merge_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward and reverse counts of all 12-mers, merged and added."""
    return _both_strands(v.dna(spark, sf_dir))


SEEDS = f"""{v.dna_sql('benchmark', 'ref')}, once as (select kmer, any_value(chr) as chr, any_value(pos) as pos from (select substr(seq, pos, 18) as kmer, chr, pos from (select id as chr, seq, unnest(range(1, greatest(length(seq) - 16, 1))) as pos from ref)) where starts_with(kmer, 'A') group by kmer having count(*) = 1),
seeds as (select substr(kmer, 1, 16) as kmer16, substr(kmer, 17, 2) as next2, chr, pos from once qualify row_number() over (partition by substr(kmer, 1, 16) order by chr, pos) <= 8)"""


PAR = "par as (select id as chr, id % 7 * 10 + 1 as par_start, id % 7 * 10 + 60 as par_end from ref)"


@query(f"with {SEEDS}, {PAR} select kmer16, next2, chr, pos from seeds s where not exists (select 1 from par p where p.chr = s.chr and s.pos between par_start and par_end)")
def seeds_outside_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seed table without the seeds that begin in excluded regions (as those that two contigs share)."""
    contigs = v.dna(spark, sf_dir, "benchmark")
    excluded = contigs.selectExpr("id as chr", "id % 7 * 10 + 1 as par_start", "id % 7 * 10 + 60 as par_end")
    return overlap_join(_passages(spark, sf_dir), excluded, "pos", "pos", "par_start", "par_end", how="left_anti").select(F.substring(seed_text(F.col("code"), F.col("other")), 1, 16).alias("kmer16"), F.substring(seed_text(F.col("code"), F.col("other")), 17, 2).alias("next2"), "chr", "pos")


def _hits_sql(reads: str, name: str) -> str:
    """Hits of ``reads`` (id, at, seq) on both strands, the first 16 of each, forward ones first."""
    return f"""{name} as (select * from (select *, row_number() over (partition by id, "at" order by rev, off, chr, pos) as hit_no from (select id, "at", rev, case when rev then n - 18 - o else o end as off, chr, pos
  from (select id, "at", rev, n, o, substr(seq, o + 1, 18) as k from (select *, length(seq) as n, unnest(range(0, greatest(length(seq) - 17, 0))) as o from (select id, "at", false as rev, seq from {reads} union all select id, "at", true, reverse(translate(seq, 'ACGT', 'TGCA')) from {reads})))
  join seeds on kmer16 = substr(k, 1, 16) and next2 = substr(k, 17, 2))) where hit_no <= 16)"""


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed_table(v.dna(spark, sf_dir, "benchmark").withColumnRenamed("id", "chr"))


@query(f"""with {v.dna_sql()}, {v.tiles_sql(100, 83)}, rd as (select id, off as "at", seq from t), {SEEDS}, {_hits_sql('rd', 'h')} select id, "at", rev, off, chr, pos, hit_no from h""")
def seed_join_top16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 seed hits, of both strands, of every read of the whole texts: 100 bases from every 83rd on, so that each 18-mer lies in one."""
    reads = tiles(v.dna(spark, sf_dir), 100, 83).withColumnRenamed("off", "at")
    return strand_hits(reads, _passages(spark, sf_dir), ("id", "at"))


def _paired(sequences: DataFrame, seeds: DataFrame) -> DataFrame:
    spans = tiles(sequences, 200).withColumnRenamed("off", "at")
    first, second = F.substring("seq", 1, 100), q.revcomp(F.substring("seq", 101, 100))
    mates = F.explode(F.array(*(F.struct(F.lit(k).alias("mate"), seq.alias("seq")) for k, seq in ((1, first), (2, second))))).alias("m")
    hits = strand_hits(spans.select("id", "at", mates).select("id", "at", "m.*"), seeds, ("id", "at", "mate")).withColumn("score", F.col("hit_no") * F.when(F.col("mate") == 1, 3).otherwise(2))
    return pair_hits(hits, by=("id", "at")).select("id", "at", "chr", "pos1", "pos2", F.col("score").cast("long").alias("score"), "rank")


ORACLE_PAIRING = f"""with {v.dna_sql()}, {v.tiles_sql(200)}, r1 as (select id, off as "at", substr(seq, 1, 100) as seq from t), r2 as (select id, off as "at", reverse(translate(substr(seq, 101, 100), 'ACGT', 'TGCA')) as seq from t), {SEEDS}, {_hits_sql('r1', 'h1')}, {_hits_sql('r2', 'h2')},
p as (select id, "at", chr, h1.pos as pos1, h2.pos as pos2, 3 * h1.hit_no + 2 * h2.hit_no as score from h1 join h2 using (id, "at", chr) where h1.rev <> h2.rev and abs(h1.pos - h2.pos) <= 1023)
select * from (select *, row_number() over (partition by id, "at" order by score desc, pos1 desc, pos2 desc) as rank from p) where rank <= 16"""


@query(ORACLE_PAIRING)
def seed_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of two mates (every 200 bases of the whole texts, the second half reversed) paired on opposite strands within 1023 bases; the 16 best sums."""
    return _paired(v.dna(spark, sf_dir), _passages(spark, sf_dir))


@query(
    f"""with {v.dna_sql()}, pat as (select list_sum(list_transform(range(2, 9), lambda i: (instr('ACGT', substr(seq, i, 1)) - 1) * (4 ** (8 - i))::bigint))::bigint as bin from dna where length(seq) >= 8),
dense as (select r as bin, coalesce(n, 0) as n from range(0, 16384) as x(r) left join (select bin, count(*) as n from pat group by bin) on r = bin),
o as (select n, row_number() over (order by n) - 1 as k from dense),
s as (select max(case when k = 8192 then n end) as med, max(case when k = 16384 * 99 // 100 then n end) as p99, max(case when k = 16384 // 100 then n end) as p1, max(n) as top from o),
cut as (select case when med + 100 * (p99 - p1) = 0 then top + 1 else med + 100 * (p99 - p1) end as cutoff, med, p99, p1, top from s)
select cutoff, med, p99, p1, top, (select count(*) from dense where n >= cutoff) as n_outliers from cut"""
)
def vector_prefix_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut-off for over-represented 7-base prefixes: median + 100 x (p99 - p1) over all 16 384 bins, by index."""
    bins = v.dna(spark, sf_dir).where("length(seq) >= 8").select(q.kmer_code(F.substring("seq", 2, 7), 7).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    dense = spark.range(0x4000).select(F.col("id").alias("bin")).join(bins, "bin", "left").na.fill(0, ["n"])
    # 16 384 bins at most, whatever the input: one sorted array
    order = dense.agg(F.array_sort(F.collect_list("n")).alias("o"))
    picks = order.select("o", F.expr("o[8192]").alias("med"), F.expr("o[16384 * 99 div 100]").alias("p99"), F.expr("o[16384 div 100]").alias("p1"), F.expr("o[16383]").alias("top"))
    cutoff = F.expr("med + 100 * (p99 - p1)")
    cut = picks.withColumn("cutoff", F.when(cutoff == 0, F.col("top") + 1).otherwise(cutoff))
    return cut.select("cutoff", "med", "p99", "p1", "top", F.size(F.filter("o", lambda x: x >= F.col("cutoff"))).cast("long").alias("n_outliers"))


@query("select p_brand, count(*) as n, arg_min(p_partkey, (p_size, p_partkey)) as p_partkey, min(p_size) as p_size from part group by p_brand")
def argmin_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The representative of each key (smallest size, then part number) with the number of rows it stands for."""
    best = F.min(F.struct("p_size", "p_partkey")).alias("m")
    return v.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), best).select("p_brand", "n", "m.p_partkey", "m.p_size")


def _slots(sequences: DataFrame) -> DataFrame:
    return place_slots(sequences, 12, 8).select("kmer", "fwd", (F.col("nth") - 1).cast("long").alias("slot"), "id", "off")


@query(f"""with {v.dna_sql()}, k as (select id, off, substr(seq, off + 1, 12) as kmer from (select id, seq, unnest(range(0, greatest(length(seq) - 11, 0))) as off from dna)), n as (select *, row_number() over (partition by kmer order by id, off) - 1 as slot from k)
select kmer, kmer < reverse(translate(kmer, 'ACGT', 'TGCA')) as fwd, slot, id, off from n where slot < 8""")
def seed_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of every 12-mer of whole texts, by text and offset, with the strand of the smaller form; eight are the table's slots for a k-mer."""
    return _slots(v.dna(spark, sf_dir))


CODONS = "[" + ", ".join(f"'{a}'" for a in q.AMINO_ACIDS) + "]"


def peptide_sql(seq: str = "seq", phase: str = "phase") -> str:
    """Amino acids of the codons of ``seq`` from base ``phase`` (0-based) on."""
    digit = lambda k: f"instr('TCAG', substr({seq}, {phase} + i * 3 + {k}, 1)) - 1"
    return f"coalesce(list_aggregate(list_transform(range(0, greatest(length({seq}) - {phase}, 0) // 3), lambda i: {CODONS}[1 + 16 * ({digit(1)}) + 4 * ({digit(2)}) + {digit(3)}]), 'string_agg', ''), '')"


@query(f"with {v.dna_sql()} select id, cast(phase as int) as phase, {peptide_sql()} as peptide from dna, range(0, 3) as x(phase)")
def codon_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amino acids of all codons of whole texts, in the three forward phases."""
    return codon_phases(v.dna(spark, sf_dir))
