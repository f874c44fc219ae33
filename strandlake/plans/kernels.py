"""Alignment and haplotype kernels on derived reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.sequence import revcomp
from strandlake.operators import align, mapper
from strandlake.operators import haplotype as hp
from strandlake.operators.reads import tiles
from strandlake.plans.registry import query
from strandlake.sources import views as v


READ = "substr(concat(substr(window, 34, 20 + cast(id % 30 as int)), substr('ACGT', cast(id % 4 + 1 as int), 1), substr(window, 34 + 21 + cast(id % 30 as int) + cast(id % 5 as int), 200)), 1, 100)"


def _reads(sequences: DataFrame) -> DataFrame:
    """Reads of 100 bases with two changes, one from every 100th base (``off``) of whole sequences, and their windows of 256 bases,
    which begin 33 bases before. N stands for bases outside a sequence; the last read of a sequence is as long as its bases go."""
    padded = sequences.select("id", F.concat(F.lit("N" * 33), "seq").alias("seq"), F.length("seq").alias("n"))
    windows = tiles(padded.where("n > 0"), 256, 100).where("length(seq) > 33").withColumnRenamed("seq", "window")
    return windows.select("id", "off", F.expr(READ).alias("read"), F.rpad("window", 256, "N").alias("window"))


def _shifts(reads: DataFrame) -> DataFrame:
    """(id, off, shift, n_mismatches) of reads that may be shorter at the end of a sequence."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, f in frame.groupby(frame["read"].str.len()):
                at, wrong = align.ungapped(align.codes(f["read"].tolist()), align.codes(f["window"].str.slice(16).tolist()))
                yield pd.DataFrame({"id": f["id"], "off": f["off"], "shift": at, "n_mismatches": wrong})

    return reads.select("id", "off", "read", "window").mapInPandas(run, "id long, off long, shift long, n_mismatches long")


@query(
    f"""with {v.dna_sql()}, padded as (select id, repeat('N', 33) || seq as seq from dna where length(seq) > 0), {v.tiles_sql(256, 100, source='padded')}, w as (select id, off, seq as part, rpad(seq, 256, 'N') as win from t where length(seq) > 33),
r as (select id, off, win, {READ.replace('window', 'part')} as read from w), s as (select id, off, sh, length(list_filter(range(1, length(read) + 1), lambda i: substr(read, i, 1) <> substr(win, 33 + sh + i - 1, 1))) as wrong from r, range(-16, 16) as x(sh))
select id, off, arg_min(sh, (wrong, sh)) as shift, min(wrong) as n_mismatches from s group by id, off"""
)
def ungapped_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best ungapped placement of the reads of whole texts within shifts of -16..15."""
    return _shifts(_reads(v.dna(spark, sf_dir)))


@query()
def gapped_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affine-gap alignment: score, CIGAR and place of each read, and whether it can be rebuilt."""
    return align.align_pairs(_reads(v.dna(spark, sf_dir)))



#: Up to ten bases may be left out at either end, where a mismatch costs more.
BORDERS = align.Borders(jump_in=10, jump_out=10, head=-4, tail=-4)


@query()
def border_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of reads with six foreign bases in front and five behind, which may be left out: score, CIGAR with clips, place and mismatches."""
    foreign = lambda part: F.translate(part, "ACGT", "GTAC")
    middle = F.substr("read", F.lit(7), F.greatest(F.length("read") - 11, F.lit(0)))
    changed = F.concat(foreign(F.substring("read", 1, 6)), middle, foreign(F.substr("read", F.greatest(F.length("read") - 4, F.lit(7)), F.lit(5))))
    return align.align_bordered(_reads(v.dna(spark, sf_dir)).withColumn("read", changed), BORDERS)

@query()
def roundtrip_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads per number of changes, and how many are rebuilt from reference, CIGAR and changes (all)."""
    return align.align_pairs(_reads(v.dna(spark, sf_dir))).groupBy("n_changes").agg(F.count("*").alias("n_reads"), F.count_if("rebuilt").alias("n_rebuilt"))


def _overlaps(sequences: DataFrame) -> DataFrame:
    """(id, off, align_len): whole sequences are cut into inserts of 60 + id % 60 bases, each with its mates."""
    size = F.expr("cast(60 + id % 60 as int)")
    insert = tiles(sequences, 199, size).select("id", "off", F.substr("seq", F.lit(1), size).alias("ins"), F.substring("seq", 150, 50).alias("tail"))
    # the insert's end is followed by other bases in both mates, as far as the sequence goes
    mates = insert.select("id", "off", F.substring(F.concat("ins", "tail"), 1, 100).alias("seq1"), F.substring(F.concat(revcomp(F.col("ins")), "tail"), 1, 100).alias("seq2"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "off": f["off"], "align_len": np.array([align.overlap(a, b) for a, b in zip(f["seq1"], f["seq2"], strict=True)], dtype=np.int64)})

    return mates.mapInPandas(run, "id long, off long, align_len long")


@query()
def overlap_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read-through overlap of mates that share an insert shorter than a read, for every insert of the whole texts."""
    return _overlaps(v.dna(spark, sf_dir))


def _clips(sequences: DataFrame) -> DataFrame:
    """(id, off, n_mismatches, kept) of reads from every 100th base; a read at the end of a sequence has no foreign end or a shorter one."""
    reads = tiles(sequences, 239, 100).select("id", "off", F.concat(F.substring("seq", 1, 60), F.substring("seq", 200, 40)).alias("read"), F.substring("seq", 1, 100).alias("ref"), F.expr("concat(repeat('I', 50 + cast(id % 40 as int)), repeat('#', 50 - cast(id % 40 as int)))").alias("qual"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            wrong = [[i for i, (a, b) in enumerate(zip(r, g, strict=False)) if a != b] for r, g in zip(f["read"], f["ref"], strict=True)]
            kept = [align.clip_end(r, q[: len(r)], w) for r, q, w in zip(f["read"], f["qual"], wrong, strict=True)]
            yield pd.DataFrame({"id": f["id"], "off": f["off"], "n_mismatches": [len(w) for w in wrong], "kept": kept})

    return reads.mapInPandas(run, "id long, off long, n_mismatches long, kept long")


@query()
def softclip_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept length of the reads of whole texts whose end doesn't match: cut at the ninth mismatch or where quality ends, not below 32."""
    return _clips(v.dna(spark, sf_dir))


def _simulated_pairs(contigs: DataFrame, step: int = 40) -> DataFrame:
    """(from_chr, at, seq1, seq2, ins_len): pairs of 70 bases from every ``step``-th base of whole contigs, inserts of 150 to 209 bases; by place the second mate
    is as it is, has three changes, lacks 2 bases, has changes all over (no seed), or comes from no contig."""
    spans = tiles(contigs.withColumnRenamed("chr", "id"), 209, step).where("length(seq) >= 150").withColumn("ins", F.expr(f"substr(seq, 1, cast(150 + off div {step} % 60 as int))"))
    tail = revcomp(F.expr("substr(ins, length(ins) - 71, 72)"))
    kind = F.expr(f"off div {step} % 5")
    spotted = lambda every: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(70)), lambda i: F.when(i % every == 0, F.translate(F.substr("tail", i, F.lit(1)), "ACGT", "CATG")).otherwise(F.substr("tail", i, F.lit(1)))), "")
    made = spans.withColumn("tail", tail)
    second = F.when(kind == 0, F.substring("tail", 1, 70)).when(kind == 1, spotted(20)).when(kind == 2, F.concat(F.substring("tail", 1, 40), F.substring("tail", 43, 30))).when(kind == 3, spotted(11)).otherwise(F.lit("AC" * 35))
    return made.select(F.col("id").alias("from_chr"), F.col("off").alias("at"), F.substring("ins", 1, 70).alias("seq1"), second.alias("seq2"), F.length("ins").alias("ins_len"))


@query()
def map_read_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated pairs from every 400th base of all documents, mapped back to them: family, places, strands and CIGARs."""
    contigs = v.dna(spark, sf_dir).withColumnRenamed("id", "chr")
    return mapper.map_pairs(_simulated_pairs(contigs, 400), contigs, ["from_chr", "at"])


# Reads over windows of 200 positions of the duplicated pairs; columns are grid positions with a base that depends on the pair.
HAP = f"""with {v.ALN_DUP}, r as (select row_number() over (order by l_partkey, l_suppkey, l_orderkey, l_linenumber) as read, sample, chr * 1000 + pos1 // 200 as win, pos1, l_orderkey, l_linenumber from aln),
bases as (select read, sample, win, c as col, case when (l_orderkey // 8 + c) % 4 = 0 then 'G' when (l_orderkey // 8 + c) % 9 = 1 and l_linenumber = 1 then 'T' else '.' end as base from r, range(0, 4) as x(c) where (pos1 + c * 13) % 5 <> 0)"""


def _bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = v.aln(spark, sf_dir, duplicates=True).withColumn("read", F.monotonically_increasing_id())
    r = pairs.select("read", "sample", F.expr("chr * 1000 + pos1 div 200").alias("win"), "pos1", "l_orderkey", "l_linenumber", F.explode(F.expr("sequence(0L, 3L)")).alias("col")).where("(pos1 + col * 13) % 5 <> 0")
    return r.select("read", "sample", "win", "col", F.expr("case when (l_orderkey div 8 + col) % 4 = 0 then 'G' when (l_orderkey div 8 + col) % 9 = 1 and l_linenumber = 1 then 'T' else '.' end").alias("base"))


@query(
    HAP
    + """, n as (select win, col, base, count(*) as n, sum(count(*)) over (partition by win, col) as depth from bases group by win, col, base), inf as (select distinct win, col from n where base <> '.' and n >= 5 and n * 100 >= depth * 10),
g as (select win, read, string_agg(coalesce(base, ' '), '' order by col) as hap, count(base) as known from (select rr.win, rr.read, inf.col, b.base from (select distinct win, read from bases) rr join inf using (win) left join bases b on b.win = rr.win and b.read = rr.read and b.col = inf.col) group by win, read)
select win, hap, count(*) as n from g where known > 0 group by win, hap"""
)
def haplotype_groups_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of equal strings over the informative columns of each window."""
    bases = _bases(spark, sf_dir)
    return hp.exact_groups(bases, hp.informative(bases))


@query()
def haplotype_caller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haplotypes per window after merging of partly known strings."""
    return hp.call_haplotypes(haplotype_groups_exact(spark, sf_dir)).drop("sample")


@query()
def paired_haplotype_caller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for two samples: an allele stays if either sample reaches the share."""
    bases = _bases(spark, sf_dir)
    columns = hp.informative(bases)
    groups = [hp.exact_groups(bases.where(F.col("sample") == s), columns).withColumn("sample", F.lit(s)) for s in ("N", "T")]
    return hp.call_haplotypes(groups[0].unionByName(groups[1]), samples=True)


@query()
def window_region_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions of each window with the alleles of its first two haplotypes."""
    bases = _bases(spark, sf_dir)
    columns = hp.informative(bases)
    return hp.region_calls(hp.call_haplotypes(hp.exact_groups(bases, columns)), columns)


@query()
def window_vcf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as lines of a call file, with what is known of the window: kept haplotypes, their shares, reads left over, and the region's warning."""
    r = window_region_calls(spark, sf_dir).withColumn("chr", F.expr("cast(win div 1000 as int)")).withColumn("pos", F.expr("win % 1000 * 200 + first_col * 13"))
    text = lambda c: F.col(c).cast("string")
    info = F.concat(F.lit("WA="), text("n_haps"), F.lit(";WAF="), "freqs", F.lit(";WTRASH="), text("trash"), F.lit(";WND="), text("win"), F.when(F.col("unexplained"), ";REGWRN").otherwise(""))
    line = F.concat_ws("\t", F.concat(F.lit("chr"), text("chr")), text("pos"), F.lit("."), F.lit("."), "alleles", F.lit("."), F.lit("PASS"), info, F.lit("GT:DP:AD"), F.concat_ws(":", "gt", text("dp"), "ad"))
    return r.select("win", "first_col", line.alias("line"))
