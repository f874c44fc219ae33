"""Genomic views derived from the driver's tables: mapped pairs, genome, regions, sites, features and DNA.

Each view has a DataFrame builder and the same definition as ANSI SQL (for the oracle). Integer arithmetic only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASES = "ACGT" * 13


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aln(spark: SparkSession, sf_dir: str, duplicates: bool = False, deep: bool = False) -> DataFrame:
    """Mapped pairs from lineitem. ``duplicates``: positions on a coarse grid, so that PCR duplicates occur. ``deep``: on a grid of 40 places, with
    one place of changes for each, where at a third of them the samples have different bases."""
    pos1 = "(l_partkey % 40) * 25 + 1" if deep else "(l_partkey % 400) * 25 + 1" if duplicates else "l_partkey * 5 + cast(floor(l_quantity) as bigint)"
    mm_off = "(l_partkey % 40) * 7 % 90" if deep else "(l_partkey * 3 + l_linenumber) % 90"
    own = "case when l_orderkey % 2 = 0 and l_partkey % 40 % 3 = 0 then 1 else 0 end" if deep else "0"
    delta = "(l_orderkey % 8) * 40" if duplicates or deep else "(l_orderkey * 37 + l_linenumber * 101) % 1200 - 100"
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 8 + l_linenumber as ordinal", "case when l_orderkey % 2 = 0 then 'T' else 'N' end as sample", "cast(l_suppkey % 24 + 1 as int) as chr",
        f"{pos1} as pos1", f"{delta} as delta", f"({pos1}) + ({delta}) as pos2", "l_returnflag = 'R' as rev1", "l_linestatus = 'O' as rev2",
        "100 - l_linenumber as len1", "100 as len2", "substr('pNmg', cast(l_linenumber % 4 + 1 as int), 1) as klass",
        "substr('ACGT', cast(l_partkey % 4 + 1 as int), 1) || substr('ACGT', cast(l_suppkey % 4 + 1 as int), 1) as umi",
        f"cast({mm_off} as int) as mm_off", f"substr('ACGT', cast((l_suppkey + {own}) % 4 + 1 as int), 1) as mm_nt", "l_suppkey % 2 = 0 as is_del",
        "l_linenumber", "l_partkey", "l_suppkey", "l_orderkey")


ALN = """aln as (select l_orderkey * 8 + l_linenumber as ordinal, case when l_orderkey % 2 = 0 then 'T' else 'N' end as sample, cast(l_suppkey % 24 + 1 as int) as chr,
  l_partkey * 5 + cast(floor(l_quantity) as bigint) as pos1, (l_orderkey * 37 + l_linenumber * 101) % 1200 - 100 as delta,
  l_partkey * 5 + cast(floor(l_quantity) as bigint) + (l_orderkey * 37 + l_linenumber * 101) % 1200 - 100 as pos2, l_returnflag = 'R' as rev1, l_linestatus = 'O' as rev2,
  100 - l_linenumber as len1, 100 as len2, substr('pNmg', cast(l_linenumber % 4 + 1 as int), 1) as klass,
  substr('ACGT', cast(l_partkey % 4 + 1 as int), 1) || substr('ACGT', cast(l_suppkey % 4 + 1 as int), 1) as umi,
  cast((l_partkey * 3 + l_linenumber) % 90 as int) as mm_off, substr('ACGT', cast(l_suppkey % 4 + 1 as int), 1) as mm_nt, l_suppkey % 2 = 0 as is_del,
  l_linenumber, l_partkey, l_suppkey, l_orderkey from lineitem)"""
ALN_DUP = ALN.replace("l_partkey * 5 + cast(floor(l_quantity) as bigint) + (l_orderkey * 37 + l_linenumber * 101) % 1200 - 100", "(l_partkey % 400) * 25 + 1 + (l_orderkey % 8) * 40").replace("l_partkey * 5 + cast(floor(l_quantity) as bigint)", "(l_partkey % 400) * 25 + 1").replace("(l_orderkey * 37 + l_linenumber * 101) % 1200 - 100", "(l_orderkey % 8) * 40")

ALN_DEEP = ALN_DUP.replace("l_partkey % 400", "l_partkey % 40").replace("(l_partkey * 3 + l_linenumber) % 90", "(l_partkey % 40) * 7 % 90").replace("cast(l_suppkey % 4 + 1 as int), 1) as mm_nt", "cast((l_suppkey + case when l_orderkey % 2 = 0 and l_partkey % 40 % 3 = 0 then 1 else 0 end) % 4 + 1 as int), 1) as mm_nt")


def base_at(chrom: str = "chr", pos: str = "pos") -> Column:
    """The reference base at a position of the synthetic genome."""
    return F.expr(f"substr('ACGT', cast(({chrom} * 7 + {pos} * 13 + {pos} div 5) % 4 + 1 as int), 1)")


def base_sql(chrom: str = "chr", pos: str = "pos") -> str:
    return f"substr('ACGT', cast(({chrom} * 7 + {pos} * 13 + {pos} // 5) % 4 + 1 as int), 1)"


def bases_at(start: str, n: str, chrom: str = "chr") -> str:
    """Spark SQL: ``n`` bases of the synthetic genome from a position (0 or more) on. It repeats every 20 positions, so they are cut from a
    repeated text instead of put together base by base."""
    texts = ", ".join("'" + "".join("ACGT"[(phase + p * 13 + p // 5) % 4] for p in range(20)) + "'" for phase in range(4))
    return f"substr(repeat(element_at(array({texts}), cast(({chrom}) * 7 % 4 + 1 as int)), cast(({n}) div 20 + 2 as int)), cast(({start}) % 20 + 1 as int), cast({n} as int))"


def contigs(pairs: DataFrame) -> DataFrame:
    """Contig lengths: the largest position plus 2000."""
    return pairs.groupBy("chr").agg((F.max(F.greatest("pos1", "pos2")) + 2000).alias("contig_len"))


CONTIGS = "contigs as (select chr, max(greatest(pos1, pos2)) + 2000 as contig_len from aln group by chr)"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("cast(p_partkey % 24 + 1 as int) as chr", "p_partkey * 5 as start", "p_partkey * 5 + p_size * 10 as end", "p_name as name", "p_partkey")


REGIONS = """regions as (select cast(p_partkey % 24 + 1 as int) as chr, p_partkey * 5 as start, p_partkey * 5 + p_size * 10 as "end", p_name as name, p_partkey from part)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restriction sites (chr, site)."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("i")).selectExpr("cast(s_suppkey % 24 + 1 as int) as chr", "s_suppkey * 97 + i * 211 as site").distinct()


SITES = "sites as (select distinct cast(s_suppkey % 24 + 1 as int) as chr, s_suppkey * 97 + i * 211 as site from supplier, range(1, 51) as r(i))"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey as feature_id", "case when o_orderkey % 5 = 0 then 'gene' else 'exon' end as kind", "cast(o_orderkey % 24 + 1 as int) as chr", "(o_orderkey * 7) % 10000 + 1 as start", "(o_orderkey * 7) % 10000 + 1 + o_custkey % 900 as end", "o_custkey as gene_id")


FEATURES = """features as (select o_orderkey as feature_id, case when o_orderkey % 5 = 0 then 'gene' else 'exon' end as kind, cast(o_orderkey % 24 + 1 as int) as chr, (o_orderkey * 7) % 10000 + 1 as start, (o_orderkey * 7) % 10000 + 1 + o_custkey % 900 as "end", o_custkey as gene_id from orders)"""


def dna(spark: SparkSession, sf_dir: str, source: str = "documents") -> DataFrame:
    """(id, seq): the ASCII letters of a text, cycled to bases."""
    key = "item_id" if source == "benchmark" else "doc_id"
    return table(spark, sf_dir, source).select(F.col(key).alias("id"), F.translate(F.regexp_replace("text", "[^A-Za-z]", ""), LETTERS, BASES).alias("seq"))


def dna_sql(source: str = "documents", name: str = "dna") -> str:
    key = "item_id" if source == "benchmark" else "doc_id"
    return f"{name} as (select {key} as id, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{LETTERS}', '{BASES}') as seq from {source})"


def tiles_sql(width: int, step: int | None = None, name: str = "t", source: str = "dna") -> str:
    """Pieces of ``width`` bases from every ``step``-th base of whole sequences, as ``operators.reads.tiles`` cuts them."""
    return f"{name} as (select id, off, substr(seq, off + 1, {width}) as seq from (select id, seq, unnest(range(0, length(seq), {step or width})) as off from {source}))"
