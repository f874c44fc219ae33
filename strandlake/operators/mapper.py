"""Mapping of read pairs: seeds, extension, pairing, mate rescue, and the fallback for mates that map alone.

Joins and groupings are Spark's; numpy aligns the rows of a batch. The genome is a table of overlapping chunks, so a place is read with one
equi-join on (contig, chunk) whatever the genome's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions.sequence import revcomp
from strandlake.operators import align
from strandlake.operators.kmers import contig_hits

NEAR, FLANK, WIDTH = 1023, 32, 4096
#: Mismatches and CIGAR cells of an accepted alignment; bases of a read that may be aligned with gaps.
MOST, CELLS, SHORTEST = 8, 7, 32
FOUND = [T.StructField("pos", T.LongType()), T.StructField("score", T.IntegerType()), T.StructField("cigar", T.StringType()), T.StructField("n_mm", T.IntegerType())]


def genome_chunks(contigs: DataFrame, longest: int = 256) -> DataFrame:
    """(chr, chunk, begin, low, high, bases): chunks of ``WIDTH`` bases with what a mate may need on either side, as far as the contig goes, dealt by chunk.
    ``begin`` is the 1-based place of the first base; from ``low`` to ``high`` places may be asked for."""
    pad = NEAR + longest + FLANK
    last = F.floor((F.length("seq") - 1) / WIDTH)
    cut = contigs.where(F.length("seq") > 0).select("chr", F.col("seq").cast("binary").alias("_b"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    from_ = F.greatest(F.col("chunk") * WIDTH - pad, F.lit(0))
    bases = F.substr("_b", (from_ + 1).cast("int"), (F.col("chunk") * WIDTH + WIDTH + pad - from_).cast("int")).cast("string")
    chunks = cut.select("chr", "chunk", (from_ + 1).alias("begin"), F.expr(f"chunk * {WIDTH} - {pad - 1}").alias("low"), F.expr(f"chunk * {WIDTH} + {WIDTH + pad}").alias("high"), bases.alias("bases"))
    return chunks.repartition(int(contigs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chr", "chunk")


def _window(places: DataFrame, chunks: DataFrame, start: Column, before: int, after: int, read: str) -> DataFrame:
    """``places`` with ``window`` (``before`` bases, those of the read, ``after`` bases; N outside the contig) around the 1-based ``start``, and its first
    place. Rows without a place stay, with a null.

    Both sides are dealt to the session's number of partitions, which Spark then leaves as it is: places are small, but aligning them is not."""
    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows without a place are dealt out by a number of their own
    chunk = F.coalesce(F.floor(F.greatest(start - 1, F.lit(0)) / WIDTH).cast("long"), F.monotonically_increasing_id())
    met = places.withColumn("first", start - before).withColumn("chunk", chunk).repartition(n, "chr", "chunk").join(chunks, ["chr", "chunk"], "left")
    size, skip = F.length(read) + before + after, F.col("first") - F.col("begin")
    outside = F.greatest(-skip, F.lit(0)).cast("int")
    text = F.rpad(F.concat(F.repeat(F.lit("N"), outside), F.substr("bases", (F.greatest(skip, F.lit(0)) + 1).cast("int"), F.greatest(size - outside, F.lit(0)))), size, F.lit("N"))
    inside = (F.col("first") >= F.col("low")) & (F.col("first") + size - 1 <= F.col("high"))
    return met.withColumn("window", F.when(inside, text)).drop("chunk", "begin", "low", "high", "bases")


def align_rows(rows: DataFrame, before: int | None, keep: bool = False) -> DataFrame:
    """``rows`` (read, window, first, others) with pos, score, cigar and n_mm instead of these three; rows that can't be accepted go, or with ``keep`` have
    nulls there, as rows without a read or a window have.

    With ``before``, a read that lies ``before`` bases into its window with one mismatch at most is taken as it lies. Else it is aligned with gaps,
    if it isn't too short. Accepted are alignments with ``MOST`` mismatches and ``CELLS`` CIGAR cells at most, and without N on the reference."""
    keys = [f for f in rows.schema.fields if f.name not in ("read", "window", "first")]

    def found(read: list[str], window: list[str], size: int) -> dict[int, tuple[int, int, str, int]]:
        reads, windows = align.codes(read), align.codes(window)
        out: dict[int, tuple[int, int, str, int]] = {}
        if before is not None:
            here = windows[:, before : before + size]
            wrong = ((reads != here) & (reads != ord("N"))).sum(axis=1)
            for i in np.flatnonzero((wrong <= 1) & ~(here == ord("N")).any(axis=1)).tolist():
                out[i] = (before, align.MATCH * size + (align.MISMATCH - align.MATCH) * int(wrong[i]), f"{size}M", int(wrong[i]))
        rest = [i for i in range(len(read)) if i not in out] if size >= SHORTEST else []
        if rest:
            for i, s, c, a in zip(rest, *align.gapped(reads[rest], windows[rest], most=CELLS), strict=True):
                if sum(x.isalpha() for x in c) <= CELLS:
                    bad, gone = align.count_changes(read[i], window[i], c, int(a))
                    if bad <= MOST and not gone:
                        out[i] = (int(a), int(s), c, bad)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read, window, first = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("read", "window", "first"))
            alike: dict[tuple[int, int], list[int]] = {}
            for i, (a, b) in enumerate(zip(read, window, strict=True)):
                if a and b and len(b) > len(a):
                    alike.setdefault((len(a), len(b)), []).append(i)
            got: dict[int, tuple[int, int, str, int]] = {}
            for (size, _), at in alike.items():
                got |= {at[i]: x for i, x in found([read[i] for i in at], [window[i] for i in at], size).items()}
            rows_ = list(range(batch.num_rows)) if keep else sorted(got)
            values = [got.get(i, (None,) * 4) for i in rows_]
            made = [pa.array([None if v[0] is None else first[i] + v[0] for i, v in zip(rows_, values, strict=True)], pa.int64()), *(pa.array([v[j] for v in values], t) for j, t in ((1, pa.int32()), (2, pa.string()), (3, pa.int32())))]
            kept = [batch.column(batch.schema.get_field_index(f.name)).take(pa.array(rows_, pa.int64())) for f in keys]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[f.name for f in [*keys, *FOUND]])

    return rows.mapInArrow(run, T.StructType([*keys, *FOUND]))


def anchored(pairs: DataFrame, contigs: DataFrame, chunks: DataFrame, by: list[str]) -> DataFrame:
    """``pairs`` (by, seq1, seq2) with ``anchors``: the places of both mates that their seeds lead to, in order (none: an empty array): array of mate, chr,
    rev, pos, o (the score below 0), cigar, n_mm."""
    mates = pairs.select(*by, F.explode(F.array(*(F.struct(F.lit(k).alias("mate"), F.col(f"seq{k}").alias("seq")) for k in (1, 2)))).alias("m")).select(*by, "m.mate", "m.seq").withColumn("size", F.length("seq"))
    hits = contig_hits(mates, contigs, (*by, "mate", "size"))
    start = F.col("pos") - F.when(F.col("rev"), F.col("size") - 18 - F.col("off")).otherwise(F.col("off"))
    led = hits.groupBy(*by).agg(F.collect_set(F.struct("mate", "rev", "chr", start.alias("start"))).alias("led"))
    places = pairs.join(led, by, "left").withColumn("base", F.explode_outer("led")).drop("led").withColumn("chr", F.col("base.chr"))
    seq = F.when(F.col("base.mate") == 1, F.col("seq1")).when(F.col("base.mate") == 2, F.col("seq2"))
    places = places.withColumn("read", F.when(F.col("base.rev"), revcomp(seq)).otherwise(seq))
    found = align_rows(_window(places, chunks, F.col("base.start"), FLANK, FLANK, "read"), FLANK, keep=True)
    anchor = F.struct("base.mate", "base.chr", "base.rev", "pos", (-F.col("score")).alias("o"), "cigar", "n_mm")
    whole = found.groupBy(*by).agg(F.first("seq1").alias("seq1"), F.first("seq2").alias("seq2"), F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), anchor))).alias("e"))
    place = lambda x: F.struct(x["mate"], x["chr"], x["rev"], x["pos"])
    # of several alignments at one place the best stays
    return whole.select(*by, "seq1", "seq2", F.filter("e", lambda x, i: (i == 0) | (place(x) != place(F.col("e")[F.greatest(i - 1, F.lit(0))]))).alias("anchors"))


def _pair(one: Column, two: Column) -> Column:
    """A pair of places, the better one first in order."""
    both = {f"{c}{k}": x[c] for k, x in ((1, one), (2, two)) for c in ("pos", "rev", "cigar", "n_mm")}
    names = ["pos1", "pos2", "rev1", "cigar1", "cigar2", "rev2", "n_mm1", "n_mm2"]
    return F.struct((one["o"] + two["o"]).alias("o"), one["chr"].alias("chr"), *[both[n].alias(n) for n in names])


def paired(anchors: Column) -> Column:
    """Pairs of places of both mates on one contig, on opposite strands and near each other."""
    near = lambda x, y: (y["mate"] == 2) & (x["chr"] == y["chr"]) & (x["rev"] != y["rev"]) & (F.abs(x["pos"] - y["pos"]) <= NEAR)
    return F.flatten(F.transform(F.filter(anchors, lambda x: x["mate"] == 1), lambda x: F.transform(F.filter(anchors, lambda y: near(x, y)), lambda y: _pair(x, y))))


def rescued(grouped: DataFrame, chunks: DataFrame, by: list[str]) -> DataFrame:
    """(by, anchors, both): ``grouped`` (by, seq1, seq2, anchors, both) where pairs without ``both`` get those made of an anchor and the other mate, aligned
    on the opposite strand within ``NEAR`` bases of it."""
    rows = grouped.withColumn("base", F.explode_outer(F.when(F.size("both") == 0, F.col("anchors"))))
    seq = F.when(F.col("base.mate") == 1, F.col("seq2")).when(F.col("base.mate") == 2, F.col("seq1"))
    rows = rows.withColumn("read", F.when(F.col("base.rev"), seq).otherwise(revcomp(seq))).withColumn("chr", F.col("base.chr")).withColumn("start", F.col("base.pos")).drop("seq1", "seq2")
    found = align_rows(_window(rows, chunks, F.col("start"), NEAR, NEAR, "read").drop("chr"), None, keep=True)
    other = F.struct(F.col("base.chr").alias("chr"), (~F.col("base.rev")).alias("rev"), "pos", (-F.col("score")).alias("o"), "cigar", "n_mm")
    made = F.when(F.abs(F.col("pos") - F.col("start")) <= NEAR, F.when(F.col("base.mate") == 1, _pair(F.col("base"), other)).otherwise(_pair(other, F.col("base"))))
    return found.groupBy(*by).agg(F.first("anchors").alias("anchors"), F.concat(F.first("both"), F.collect_list(made)).alias("both"))


def map_pairs(pairs: DataFrame, contigs: DataFrame, by: list[str], longest: int = 256) -> DataFrame:
    """One row a pair: family (a mapped pair's class p, m or g; HM one mate, C both mates apart, UM none), contig, place, strand and CIGAR of both mates
    (null where unmapped), score, and n_matches (2 where an equally good pair lies elsewhere).

    ``pairs``: by, seq1, seq2; ``contigs``: chr, seq. In turn: pairs of seeded places; where there are none, the other mate is looked for near
    each place of either; where that fails too, each mate counts alone if it has one mismatch at most and no gap.

    A pair's places stay in its row, so each place is aligned once; what all steps read of pairs and contigs is dealt out once."""
    chunks = genome_chunks(contigs, longest)
    pairs = pairs.select(*by, "seq1", "seq2").repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    grouped = anchored(pairs, contigs, chunks, by).withColumn("both", paired(F.col("anchors")))
    known = rescued(grouped, chunks, by).withColumn("both", F.array_sort("both")).withColumn("a", F.get("both", F.lit(0)))
    place = lambda x: F.struct(x["chr"], x["pos1"], x["pos2"], x["rev1"])
    known = known.withColumn("b", F.get(F.filter("both", lambda x: place(x) != place(F.col("a"))), F.lit(0)))
    a, b = F.col("a"), F.col("b")
    shared = (a["chr"] == b["chr"]) & ((a["pos1"] == b["pos1"]) | (a["pos2"] == b["pos2"]) | (a["pos1"] == b["pos2"]) | (a["pos2"] == b["pos1"]))
    equal, shorter = F.coalesce(a["o"] == b["o"], F.lit(False)), F.abs(b["pos1"] - b["pos2"]) < F.abs(a["pos1"] - a["pos2"])
    alone = lambda k: F.get(F.array_sort(F.transform(F.filter("anchors", lambda x: (x["mate"] == k) & (x["n_mm"] <= 1) & ~x["cigar"].rlike("[ID]")), lambda x: F.struct(x["o"], x["chr"], x["pos"], x["rev"], x["cigar"]))), F.lit(0))
    known = known.select(*by, F.when(equal & shared & shorter, b).otherwise(a).alias("x"), F.when(a.isNull(), alone(1)).alias("t1"), F.when(a.isNull(), alone(2)).alias("t2"), F.when(equal & ~shared, 2).otherwise(1).alias("n"))
    x, t1, t2 = F.col("x"), F.col("t1"), F.col("t2")
    family = F.when(x.isNull() & t1.isNotNull() & t2.isNotNull(), "C").when(x.isNull() & (t1.isNotNull() | t2.isNotNull()), "HM").when(x.isNull(), "UM").when(F.concat("x.cigar1", "x.cigar2").rlike("[ID]"), "g").when(F.col("x.n_mm1") + F.col("x.n_mm2") > 0, "m").otherwise("p")
    cells = [F.coalesce(F.col("x.chr" if n[:3] == "chr" else f"x.{n}"), F.col(f"t{n[-1]}.{n[:-1]}")).alias(n) for n in ("chr1", "pos1", "rev1", "cigar1", "chr2", "pos2", "rev2", "cigar2")]
    score = F.coalesce(-F.col("x.o"), -F.coalesce("t1.o", F.lit(0)) - F.coalesce("t2.o", F.lit(0)))
    return known.select(*by, family.alias("family"), *cells, score.alias("score"), F.when(x.isNotNull(), F.col("n")).when(t1.isNotNull() | t2.isNotNull(), 1).otherwise(0).alias("n_matches"))
