"""Window callers with insertions and deletions, and motif search with profiles, on derived reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.operators import align, profile, windows
from strandlake.operators.calling import passes
from strandlake.operators.filters import well_behaved
from strandlake.operators.reads import tiles
from strandlake.plans import calls as c
from strandlake.plans.registry import query
from strandlake.sources import views as v

#: Reads of the deep grid, mate 1 whole: the base at mm_off differs (classes m and g), behind it class g has a deletion, or inserted bases.
GAP = "klass = 'g'"
SIZE = "cast(case when is_del then l_linenumber else l_linenumber % 3 + 1 end as int)"


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chr, sample, pos, cigar, seq, n_mm, span of the first mates; the changes of a gapped read lie 10 bases from its ends at least."""
    pairs = v.aln(spark, sf_dir, deep=True).where(well_behaved()).withColumns({"size": F.expr(SIZE), "gap": F.expr(f"{GAP} and mm_off between 9 and 79"), "pos": F.col("pos1"), "ins": F.repeat("mm_nt", F.expr(SIZE))})
    deleted, added = F.expr("gap and is_del"), F.expr("gap and not is_del")
    span = F.col("len1") + F.when(deleted, F.col("size")).otherwise(0)
    bases = F.array_join(F.transform(F.sequence(F.col("pos1"), F.col("pos1") + span - 1), lambda p: F.substr(F.lit("ACGT"), ((F.col("chr") * 7 + p * 13 + F.floor(p / 5)) % 4 + 1).cast("int"), F.lit(1))), "")
    front, back = F.substr("whole", F.lit(1), F.col("mm_off") + 1), F.substr("whole", F.col("mm_off") + 2 + F.when(deleted, F.col("size")).otherwise(0))
    changed = F.when(F.expr("klass in ('m', 'g')"), F.concat(F.substr(front, F.lit(1), F.col("mm_off")), "mm_nt")).otherwise(front)
    head, tail = F.expr("cast(mm_off + 1 as string)"), (span - F.col("mm_off") - 1 - F.when(deleted, F.col("size")).otherwise(0)).cast("string")
    middle = F.when(deleted, F.concat(head, F.lit("M"), F.col("size").cast("string"), F.lit("D"), tail, F.lit("M"))).when(added, F.concat(head, F.lit("M"), F.col("size").cast("string"), F.lit("I"), tail, F.lit("M"))).otherwise(F.concat(span.cast("string"), F.lit("M")))
    made = pairs.withColumn("whole", bases).select("chr", "sample", "pos", middle.alias("cigar"), F.concat(changed, F.when(added, F.col("ins")).otherwise(""), back).alias("seq"), (changed != front).cast("int").alias("n_mm"), span.alias("span"))
    return made


@query()
def window_indel_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base changes, deletions and insertions of windows of 200 positions from realigned haplotypes (first mates of the deep grid)."""
    return windows.call_windows(_reads(spark, sf_dir), v.base_at("chr", "p"))


@query()
def paired_window_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haplotypes of both samples (a: normal, b: tumour) in the layout that they share, with the share of each in both."""
    return windows.call_two_samples(_reads(spark, sf_dir), v.base_at("chr", "p"), ("N", "T"))


def motif_profile(motif: str) -> profile.Profile:
    """A profile of 24 columns around a motif: its base 5, others -4; gaps open at -8 and go on at -1."""
    size = len(motif)
    match = np.full((size, 5), -4)
    match[np.arange(size), profile.base_codes([motif])[0]] = 5
    flat = lambda x: np.full(size, x)
    return profile.Profile(match, flat(-8), flat(-1), flat(0), np.zeros(size, dtype=bool), "profile", insert=-8, insert_more=-1)


def profile_hits(sequences: DataFrame, motif: str, width: int = 200) -> DataFrame:
    """(id, off, score, first, last, next_score, next_first, next_last) of the best and the next best place of a motif in each piece of ``width`` bases
    of whole sequences (0-based places in the sequence; the next best shares no base on the same column)."""
    scored = motif_profile(motif)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), 1024):
                part = frame.iloc[k : k + 1024]
                size = part["seq"].str.len().to_numpy()  # shorter pieces are filled up, and end where they end
                out = {"id": part["id"], "off": part["off"]}
                for name, (score, place) in zip(("", "next_"), _pairs(profile.best_two(scored, profile.base_codes(part["seq"].tolist()), size)), strict=True):
                    on = place >= 0
                    out |= {f"{name}score": score, f"{name}first": part["off"] + np.where(on.any(axis=1), on.argmax(axis=1), -1), f"{name}last": part["off"] + np.where(on.any(axis=1), on.shape[1] - 1 - on[:, ::-1].argmax(axis=1), -1)}
                yield pd.DataFrame(out)

    pieces = tiles(sequences, width, width).where("seq <> ''").select("id", "off", "seq")
    return pieces.mapInPandas(run, "id long, off long, score long, first long, last long, next_score long, next_first long, next_last long")


def _pairs(best: tuple) -> tuple:
    return best[:2], best[2:]


@query()
def profile_motif_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best and next best place of a motif profile in each 200 bases of the whole texts."""
    return profile_hits(v.dna(spark, sf_dir), "GATTACAGATCGATCCAGTACGAT")


def _realigned(reads: DataFrame, flank: int = 20) -> DataFrame:
    """Equal reads once (n), aligned anew against their place with ``flank`` more bases on each side; a read's old CIGAR isn't used."""
    alike = reads.groupBy("chr", "sample", "pos", "seq").agg(F.max("span").alias("span"), F.count("*").alias("n"))
    first = F.greatest(F.col("pos") - flank, F.lit(1))
    window = F.array_join(F.transform(F.sequence(first, F.col("pos") + F.col("span") - 1 + flank), lambda p: F.substr(F.lit("ACGT"), ((F.col("chr") * 7 + p * 13 + F.floor(p / 5)) % 4 + 1).cast("int"), F.lit(1))), "")
    return align.realign(alike.select("chr", "sample", "n", "seq", F.col("pos").alias("was"), first.alias("first"), window.alias("window")), ["chr", "sample", "n", "was"])


def realigned_calls(placed: DataFrame, least: int, percent: int) -> DataFrame:
    """The realigned report's indel calls (sample, chr, pos, kind, allele, n, total, ref_n, gt): all deletions and insertions count for the total, and an
    insertion's reads for the reference too. Events and depth are those of the new alignments."""
    events = placed.select("sample", "chr", "n", F.explode("changes").alias("x")).groupBy("sample", "chr", "x.pos", "x.kind", "x.allele").agg(F.sum("n").alias("n"))
    loci = events.groupBy("sample", "chr", "pos").agg(F.sum(F.when(F.col("kind") != "M", F.col("n")).otherwise(0)).alias("indels")).where("indels > 0")
    # depth as a sweep over runs of matched states: deleted bases don't count, equal reads enter with their number
    ends = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.col("n").alias("d")), F.struct((F.col("end") + 1).alias("pos"), (-F.col("n")).alias("d")))).alias("x")
    steps = state_runs(placed).where("state = 'M'").select("sample", "chr", ends).groupBy("sample", "chr", "x.pos").agg(F.sum("x.d").alias("d"))
    depth = depth_by_tiles(steps, loci)
    rows = events.where("kind <> 'M'").join(loci, ["sample", "chr", "pos"]).join(depth, ["sample", "chr", "pos"]).withColumn("total", F.col("ref_n") + F.col("indels"))
    both = passes(F.col("ref_n"), F.col("total"), least, percent)
    return rows.where(passes(F.col("n"), F.col("total"), least, percent)).select("sample", "chr", (F.col("pos") - 1).alias("pos"), "kind", "allele", "n", "total", "ref_n", F.when(both, "0/1").otherwise("1/1").alias("gt"))


def depth_by_tiles(steps: DataFrame, loci: DataFrame, width: int = 4096) -> DataFrame:
    """(sample, chr, pos, ref_n): the sum of steps d up to each locus. Summed inside tiles of positions, with the sums of the tiles before added."""
    keys = ["sample", "chr"]
    tile = F.expr(f"pos div {width}").alias("tile")
    every = steps.select(*keys, "pos", "d", F.lit(False).alias("asked"), tile).unionByName(loci.select(*keys, "pos", F.lit(0).cast("long").alias("d"), F.lit(True).alias("asked"), tile))
    before = Window.partitionBy(*keys).orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    sums = every.groupBy(*keys, "tile").agg(F.sum("d").alias("own")).select(*keys, "tile", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("carried"))
    here = F.sum("d").over(Window.partitionBy(*keys, "tile").orderBy("pos").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return every.join(sums, [*keys, "tile"]).withColumn("ref_n", F.col("carried") + here).where("asked").select(*keys, "pos", "ref_n")


@query()
def realigned_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indel calls of reads that were aligned anew (first mates of the deep grid)."""
    return realigned_calls(_realigned(_reads(spark, sf_dir)), c.LEAST, c.PERCENT)


@query()
def realigned_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of realigned reads: place, CIGAR with its changes, score, and how many equal reads there are."""
    placed = _realigned(_reads(spark, sf_dir))
    changes = F.array_join(F.transform("changes", lambda x: F.concat(x["kind"], (x["pos"] - F.col("pos")).cast("string"), F.lit(":"), x["allele"])), ",")
    line = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("chr").cast("string")), F.col("pos").cast("string"), "cigar", F.concat(F.lit("AS:i:"), F.col("score").cast("string")), F.concat(F.lit("XC:Z:"), changes))
    return placed.select("sample", "chr", "was", line.alias("line"), "n")


def state_runs(placed: DataFrame) -> DataFrame:
    """(sample, chr, state, start, end, n): the alignments' states as runs of positions (of an insertion the position behind it), equal runs summed, so
    that nothing is taken apart to bases."""
    ops = F.regexp_extract_all("cigar", F.lit(r"\d+[MID]"), 0)
    step = lambda s, x: F.struct((s["at"] + F.when(x.endswith("I"), 0).otherwise(F.regexp_extract(x, r"\d+", 0).cast("long"))).alias("at"), F.concat(s["runs"], F.array(F.struct(F.right(x, F.lit(1)).alias("state"), s["at"].alias("start"), (s["at"] + F.when(x.endswith("I"), 1).otherwise(F.regexp_extract(x, r"\d+", 0).cast("long")) - 1).alias("end")))).alias("runs"))
    none = F.array().cast("array<struct<state: string, start: bigint, end: bigint>>")
    runs = F.aggregate(ops, F.struct(F.col("pos").alias("at"), none.alias("runs")), step)["runs"]
    return placed.select("sample", "chr", "n", F.explode(runs).alias("x")).groupBy("sample", "chr", "x.state", "x.start", "x.end").agg(F.sum("n").alias("n"))


@query()
def alignment_state_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of matched, deleted and inserted states of the realigned reads, with the number of reads that have them."""
    return state_runs(_realigned(_reads(spark, sf_dir)))
