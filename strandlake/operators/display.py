"""Reads as they are shown and exported: laid out on the reference by their CIGAR, rebuilt without their clips, trimmed, and filtered.

CIGARs are array<struct<n, op>>; each function is a fold over their few cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def laid_out(text: Column, cigar: Column) -> Column:
    """A read, or its qualities, on the reference: ``_`` for deleted bases; inserted bases go, and ``*`` stands in the place before them
    (in a place of its own, where nothing is before)."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state: Column, cell: Column) -> Column:
        n, out, at = cell["n"], state["out"], state["at"]
        star = F.concat(F.substr(out, F.lit(1), F.greatest(F.length(out) - 1, F.lit(0))), F.lit("*"))
        shown = F.when(cell["op"] == "D", F.concat(out, F.repeat(F.lit("_"), n))).when(cell["op"] == "I", star).otherwise(F.concat(out, F.substr(text, at + 1, n)))
        return F.struct(shown.alias("out"), F.when(cell["op"] == "D", at).otherwise(at + n).alias("at"))

    return F.aggregate(cigar, start, step)["out"]


def without_clips(reference: Column, cigar: Column, changes: Column) -> Column:
    """A read rebuilt from the reference that begins where its alignment does, with N for clipped and inserted bases, and then the changes
    array<struct<pos (0-based), nt>> in place."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state: Column, cell: Column) -> Column:
        n, out, at = cell["n"], state["out"], state["at"]
        blank = F.concat(out, F.repeat(F.lit("N"), n))
        shown = F.when(cell["op"].isin("S", "I"), blank).when(cell["op"] == "M", F.concat(out, F.substr(reference, at + 1, n))).otherwise(out)
        return F.struct(shown.alias("out"), F.when(cell["op"] == "I", at).otherwise(at + n).alias("at"))

    return F.aggregate(changes, F.aggregate(cigar, start, step)["out"], lambda s, m: F.overlay(s, m["nt"], m["pos"] + 1))


def inside_contig(pos1: Column, span1: Column, pos2: Column, span2: Column, contig_len: Column) -> Column:
    """Both mates begin at 1 or later and end before the contig's last base."""
    return (pos1 > 0) & (pos1 + span1 < contig_len) & (pos2 > 0) & (pos2 + span2 < contig_len)


def valid_trim(cnt: list[Column], length: list[Column], most: int = 20) -> Column:
    """Whether a pair's trim entry can be used: no length without a count, on either end (left and right of mate 1, then of mate 2), and
    not more than ``most`` on the same end of both mates."""
    alone = F.lit(False)
    for c, n in zip(cnt, length, strict=True):
        alone |= (c == 0) & (n != 0)
    return ~(alone | ((cnt[0] > most) & (cnt[2] > most)) | ((cnt[1] > most) & (cnt[3] > most)))


def length_gate(length: Column, seed: int = 17, gapped: int = 32) -> Column:
    """What may be done with a read of this length: nothing (``none``), seeds and direct hits, or gapped alignment too."""
    return F.when(length <= seed, "none").when(length < gapped, "direct").otherwise("gapped")


def phred_bin(quality: Column) -> Column:
    return F.when(quality <= 5, 0).when(quality <= 9, 1).when(quality <= 19, 2).otherwise(3)


def allele_accounting(events: DataFrame, by: list[str], most: int = 65_535) -> DataFrame:
    """Counts of each allele by strand and by quality (0-5, 6-9, 10-19, 20 and above), none above ``most``.

    ``events``: by, rev, q."""
    cells = [F.least(F.count_if((F.col("rev") if rev else ~F.col("rev")) & (phred_bin(F.col("q")) == b)), F.lit(most)).alias(f"{'m' if rev else 'p'}_q{b}") for rev in (False, True) for b in range(4)]
    return events.groupBy(*by).agg(*cells)


def best_and_alternate(pairs: DataFrame, by: list[str]) -> DataFrame:
    """The best pair of each read and, if there is one, an equally good pair elsewhere.

    ``pairs``: by, chr, pos1, pos2, score, rank. Where the second has the same score and shares an end with the first, it is the same place, and
    the pair with the shorter span counts; where it shares none, it is an alternate and the read has two matches."""
    place = F.struct("chr", "pos1", "pos2", "score")
    two = pairs.where("rank <= 2").groupBy(*by).agg(F.max(F.when(F.col("rank") == 1, place)).alias("a"), F.max(F.when(F.col("rank") == 2, place)).alias("b"))
    a, b = F.col("a"), F.col("b")
    equal = F.coalesce(a["score"] == b["score"], F.lit(False))
    shared = (a["chr"] == b["chr"]) & ((a["pos1"] == b["pos1"]) | (a["pos2"] == b["pos2"]) | (a["pos1"] == b["pos2"]) | (a["pos2"] == b["pos1"]))
    shorter = F.abs(b["pos1"] - b["pos2"]) < F.abs(a["pos1"] - a["pos2"])
    best = F.when(equal & shared & shorter, b).otherwise(a)
    alternate = F.when(equal & ~shared, b)
    return two.select(*by, best.alias("best"), alternate.alias("alt")).select(*by, "best.chr", "best.pos1", "best.pos2", "best.score", F.col("alt.chr").alias("alt_chr"), F.col("alt.pos1").alias("alt_pos1"), F.col("alt.pos2").alias("alt_pos2"), F.when(F.col("alt").isNull(), 1).otherwise(2).alias("n_matches"))
