"""Read preparation and transcript coordinates: adapter trimming, open reading frames, lifting from transcripts to the genome."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.sequence import AMINO_ACIDS, revcomp

#: Fixed value: the sequencing adapter.
ADAPTER = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA"


def tiles(sequences: DataFrame, width: int, step: int | Column | None = None, seq: str = "seq") -> DataFrame:
    """(id, off, seq): pieces of ``width`` bases from every ``step``-th base (``width`` if not given) of whole sequences, with their
    0-based offset; pieces at the end are shorter, and an empty sequence has none.

    Cut as bytes, as in ``explode_kmers``: a substring of a long string costs its offset."""
    step = F.lit(width) if step is None else F.lit(step) if isinstance(step, int) else step
    n = F.floor((F.length(seq) - 1) / step).cast("int")
    cut = sequences.where(F.length(seq) > 0).select("id", F.col(seq).cast("binary").alias("_b"), step.cast("int").alias("_step"), n.alias("_n"))
    each = F.transform(F.sequence(F.lit(0), "_n"), lambda i: F.struct((i * F.col("_step")).alias("off"), F.substr("_b", i * F.col("_step") + 1, F.lit(width)).alias("b")))
    return cut.select("id", F.explode(each).alias("x")).select("id", F.col("x.off").cast("long").alias("off"), F.col("x.b").cast("string").alias("seq"))


def adapter_cut(seq: Column, adapter: str = ADAPTER, least: int = 40, errors: int = 2) -> Column:
    """How many bases of a read stay before the adapter (its length, if there is none).

    The adapter begins at the last place of its first 6-mer, else of the one at its second or third base. That place counts from base ``least``
    on, with ``errors`` differences at most in what follows of read and adapter; otherwise 5 to 1 bases of the adapter at the read's end go."""

    def last(k: int) -> Column:
        six = adapter[k : k + 6]
        return F.when(F.contains(seq, F.lit(six)), F.length(seq) - F.length(F.substring_index(seq, six, -1)) - 6).otherwise(-1) - k

    place = F.when(last(0) >= 0, last(0)).when(last(1) >= 0, last(1)).otherwise(last(2))
    most = F.least(F.length(seq) - place, F.lit(len(adapter)))
    same = F.filter(F.sequence(F.lit(6), most), lambda j: F.substr(seq, place + j + 1, F.lit(1)) == F.substr(F.lit(adapter), j + 1, F.lit(1)))
    found = (place >= least) & ((most <= 6) | (F.size(F.when(most > 6, same)) + 6 + errors >= most))
    at_end = F.coalesce(*[F.when(F.endswith(seq, F.lit(adapter[:n])), F.length(seq) - n) for n in range(5, 0, -1)], F.length(seq))
    return F.when(found, place).otherwise(at_end)


def trim_adapters(reads: DataFrame, mate: int = 1, longest: int = 100, adapter: str = ADAPTER, least: int = 40) -> DataFrame:
    """Reads (seq, qual, other columns) without the adapter, cut at ``longest`` bases; the second mate is turned around first.

    Adds ``cut``. Qualities are cut only where ``least`` bases stay, as the bases of shorter reads are of no use."""
    turn = (lambda c: revcomp(c), lambda c: F.reverse(c)) if mate == 2 else (lambda c: c, lambda c: c)
    at = F.col("_at")
    rows = reads.withColumn("_at", adapter_cut(F.col("seq"), adapter, least))
    quality = F.when((at >= least) & (at < F.length("seq")), F.substr("qual", F.lit(1), at)).otherwise(F.col("qual"))
    seq, qual = F.substr(turn[0](F.substr("seq", F.lit(1), at)), F.lit(1), F.lit(longest)), F.substr(turn[1](quality), F.lit(1), F.lit(longest))
    return rows.select(*[c for c in reads.columns if c not in ("seq", "qual")], seq.alias("seq"), qual.alias("qual"), (at < F.length("seq")).alias("cut"))


#: Ligation junctions, and the halves that belong to either fragment.
LIGATION = {"GATCGATC": "GATC GATC", "TTATAA": "TTAA TTAA", "GATCTAA": "GATC TTAA", "TTAGATC": "TTAA GATC"}


def ligation_tail(seq: Column, head: int = 28, longest: int = 32) -> Column:
    """What follows the first ``head`` bases of a read up to the first ligation junction, with the four bases of it that belong to the
    fragment, ``longest`` bases at most. Junctions within the head aren't looked for."""
    out = F.substr(seq, F.lit(head + 1))
    for site, halves in LIGATION.items():
        out = F.replace(out, F.lit(site), F.lit(halves))
    return F.substr(F.substring_index(out, " ", 1), F.lit(1), F.lit(longest))


#: Amino acid by codon number (T, C, A, G are 0 to 3); X for codons with other letters.
_AMINO = np.frombuffer((AMINO_ACIDS + "X").encode(), dtype=np.uint8)
_DIGIT = np.full(256, 64, dtype=np.int64)
_DIGIT[np.frombuffer(b"TCAG", dtype=np.uint8)] = range(4)


def phases(seq: str) -> list[str]:
    """Amino acids of the codons from base 0, 1 and 2 on, in time linear in the sequence."""
    digits = _DIGIT[np.frombuffer(seq.encode("ascii", "replace"), dtype=np.uint8)]
    return [_AMINO[np.minimum(digits[p : p + max(len(seq) - p, 0) // 3 * 3].reshape(-1, 3) @ (16, 4, 1), 64)].tobytes().decode() for p in range(3)]


def codon_phases(sequences: DataFrame) -> DataFrame:
    """(id, phase, peptide): amino acids of all codons of whole sequences, in each of the three forward phases."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, p, peptide) for i, s in zip(f["id"], f["seq"], strict=True) for p, peptide in enumerate(phases(s))]
            yield pd.DataFrame(rows, columns=["id", "phase", "peptide"])

    return sequences.select("id", "seq").mapInPandas(run, "id long, phase int, peptide string")


def open_frames(sequences: DataFrame, least: int = 20) -> DataFrame:
    """(id, start, peptide) of open reading frames: from an ATG (0-based) to the first stop or the end, ``least`` amino acids at least;
    of frames that end alike only the longest stays.

    Between two stops of a phase that is the frame of the first ATG (the only codon of M)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, s in zip(f["id"], f["seq"], strict=True):
                for p, peptide in enumerate(phases(s)):
                    at = 0
                    for part in peptide.split("*"):
                        if (m := part.find("M")) >= 0 and len(part) - m >= least:
                            rows.append((i, p + 3 * (at + m), part[m:]))
                        at += len(part) + 1
            yield pd.DataFrame(rows, columns=["id", "start", "peptide"])

    return sequences.select("id", "seq").mapInPandas(run, "id long, start long, peptide string")


def lift(hits: DataFrame, exons: DataFrame) -> DataFrame:
    """Hits (hit, tid, off 0-based, len) on transcripts -> genome start and a CIGAR with N for introns.

    ``exons``: tid, start, end (inclusive). The last exon takes what hangs over."""
    w = Window.partitionBy("tid").orderBy("start")
    sized = exons.withColumn("bases", F.expr("end - start + 1")).withColumn("first", F.sum("bases").over(w) - F.col("bases"))
    placed = sized.withColumn("is_last", F.lead("start").over(w).isNull())
    joined = hits.join(placed, "tid").where((F.col("off") < F.col("first") + F.col("bases")) & (F.col("off") + F.col("len") > F.col("first")) | (F.col("is_last") & (F.col("off") + F.col("len") > F.col("first") + F.col("bases"))))
    a = F.greatest("off", "first")
    b = F.when(F.col("is_last"), F.col("off") + F.col("len")).otherwise(F.least(F.col("off") + F.col("len"), F.col("first") + F.col("bases")))
    parts = joined.withColumn("g", F.col("start") + a - F.col("first")).withColumn("n", b - a).where("n > 0")
    order = F.array_sort(F.collect_list(F.struct("g", "n")))
    grouped = parts.groupBy("hit", "tid").agg(order.alias("p"))
    text = F.transform("p", lambda x, i: F.concat(F.when(i > 0, F.concat((x["g"] - F.get("p", i - 1)["g"] - F.get("p", i - 1)["n"]).cast("string"), F.lit("N"))).otherwise(""), x["n"].cast("string"), F.lit("M")))
    return grouped.select("hit", "tid", F.col("p")[0]["g"].alias("start"), F.array_join(text, "").alias("cigar"))
