"""Window callers with insertions and deletions: a column layout for each window, reads realigned to it, haplotypes, and alleles of regions.

Equal reads of a window are one tag with a count, and everything that depends on depth is summed by Spark with partial aggregation. A layout has
a column for each reference position that the window's tags cover and as many slots before it as the longest insertion there, so its size follows
from the width of the window and the lengths of reads and insertions. Each tag meets its window's layout in a join (which adaptive execution
splits where a window is deep) and is aligned alone. One pandas group remains, the merging of haplotypes: its strings hold informative columns
only, whose symbols have passed a share of the depth, so their number follows from the alleles and the places where reads begin and end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.haplotype import call_haplotypes, islands
from strandlake.operators.profile import Profile, align, base_codes
from strandlake.sources.shared import stored

#: Fixed values of the window profile: a base of the reference, another base, an inserted base that some tag has; entering a deletion where
#: some tag has one or where none has, going on in it, leaving it; a short and rare deletion lets any base pass instead.
MATCH, MISMATCH, INSERTED, ANY = 3, -1, 5, 4
ENTER_KNOWN, ENTER, INSIDE, LEAVE, RARE = 2, -12, -1, -3, 8
NEVER = -10_000
#: A deletion counts in tags with one mismatch at most, or if it is below 20 bases and at least 10 from both ends of its tag.
LONG_DELETION, BORDER, PAD = 20, 10, 2


def tags_of(reads: DataFrame, width: int) -> DataFrame:
    """``reads``: chr, sample, pos (of the first base), cigar, seq, n_mm, span (reference bases) -> tags of windows of ``width`` positions: win, chr,
    start, end, sample, pos, cigar, seq, n_mm, n."""
    at = F.explode(F.sequence(F.expr(f"pos div {width}"), F.expr(f"(pos + span - 1) div {width}"))).alias("tile")
    tags = reads.select("chr", at, "sample", "pos", "cigar", "seq", "n_mm").groupBy("chr", "tile", "sample", "pos", "cigar", "seq", "n_mm").agg(F.count("*").alias("n"))
    return tags.select(F.expr("chr * 1000000000L + tile").alias("win"), "chr", (F.col("tile") * width).alias("start"), (F.col("tile") * width + width - 1).alias("end"), "sample", "pos", "cigar", "seq", "n_mm", "n")


def _operations(cigar: str) -> list[tuple[int, str]]:
    return [(int(n), op) for n, op in re.findall(r"(\d+)([MIDS])", cigar)]


def _changes(tags: DataFrame) -> DataFrame:
    """(win, kind, pos, size, base, n): the tags' deletions (first position, length) and inserted bases (position behind them, slot)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for win, pos, cigar, seq, n_mm, n in zip(f["win"], f["pos"], f["cigar"], f["seq"], f["n_mm"], f["n"], strict=True):
                at, i = pos, 0
                for size, op in _operations(cigar):
                    if op == "D":
                        if n_mm <= 1 or size < LONG_DELETION and i >= BORDER and i + size <= len(seq) - BORDER:
                            rows.append((win, "D", at, size, "", n))
                        at += size
                    elif op == "I":
                        rows += [(win, "I", at, k + 1, seq[i + k], n) for k in range(size)]
                        i += size
                    else:
                        at, i = at + size, i + size
            yield pd.DataFrame(rows, columns=["win", "kind", "pos", "size", "base", "n"])

    found = tags.where("instr(cigar, 'I') > 0 or instr(cigar, 'D') > 0").select("win", "pos", "cigar", "seq", "n_mm", "n")
    return found.mapInPandas(run, "win long, kind string, pos long, size long, base string, n long").groupBy("win", "kind", "pos", "size", "base").agg(F.sum("n").alias("n"))


def layouts(tags: DataFrame, reference: Column, least_tags: int = 4) -> DataFrame:
    """One row per window of ``least_tags`` reads and more: win, chr, start, end, lo, hi (positions that tags cover), ref (bases lo to hi, by the
    expression ``reference`` of chr and p) and changes (kind, pos, size, base, n)."""
    span = F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDS]"), 1), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    spans = tags.groupBy("win", "chr", "start", "end").agg(F.min("pos").alias("lo"), F.max(F.col("pos") + span - 1).alias("hi"), F.sum("n").alias("n")).where(F.col("n") >= least_tags).drop("n")
    bases = spans.select("win", "chr", F.explode(F.sequence("lo", "hi")).alias("p")).select("win", F.struct("p", reference.alias("b")).alias("x"))
    ref = bases.groupBy("win").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "").alias("ref"))
    lists = _changes(tags).groupBy("win").agg(F.collect_list(F.struct("kind", "pos", "size", "base", "n")).alias("changes"))
    return spans.join(ref, "win").join(lists, "win", "left")


class Layout:
    """The columns of a window: ``pos`` (of a slot: the position behind it), ``slot`` (0: reference), ``letter``; ``first`` and ``last`` of the window, two
    positions wider and further on while the border column is a slot or lies in a deletion."""

    def __init__(self, start: int, end: int, lo: int, ref: str, changes) -> None:
        longest: dict[int, int] = {}
        seen: dict[tuple[int, int], set[str]] = {}
        deletions: dict[int, dict[int, int]] = {}
        for c in changes if changes is not None else ():
            if c["kind"] == "I":
                longest[c["pos"]] = max(longest.get(c["pos"], 0), c["size"])
                seen.setdefault((c["pos"], c["size"]), set()).add(c["base"])
            else:
                deletions.setdefault(c["pos"], {})[c["size"]] = c["n"]
        columns = [(p, k, "+" if k else ref[p - lo]) for p in range(lo, lo + len(ref)) for k in (*range(1, longest.get(p, 0) + 1), 0)]
        self.pos, self.slot = np.array([c[0] for c in columns]), np.array([c[1] for c in columns])
        self.letter = "".join(c[2] for c in columns)
        self.indels = bool(longest or deletions)
        size = len(columns)
        self.column = {p: i for i, (p, k, _) in enumerate(columns) if not k}
        match = np.full((size, 5), MISMATCH)
        match[np.arange(size), base_codes([self.letter])[0]] = MATCH
        match[:, 4] = MATCH
        enter, leave, inside = np.full(size, ENTER), np.full(size, LEAVE), np.full(size, INSIDE)
        from_end = enter.copy(), leave.copy()
        keep = self.slot > 0
        for p, sizes in deletions.items():
            if (a := self.column.get(p)) is None:
                continue
            for length in sizes:  # a deletion ends where some tag's does
                b = self.column.get(min(p + length, lo + len(ref)) - 1)
                enter[a], from_end[0][b], inside[a : b + 1], keep[a : b + 1] = ENTER_KNOWN, ENTER_KNOWN, 0, True
                if p + length in self.column:
                    leave[self.column[p + length]] = 0
            if p - 1 in self.column:
                from_end[1][self.column[p - 1]] = 0
            if max(sizes) == 1 and sizes[1] < RARE:
                match[a] = [ANY, ANY, ANY, ANY, MATCH]
        for (p, k), found in seen.items():
            i = self.column[p] - longest[p] + k - 1
            match[i] = [INSERTED if b in found else NEVER for b in "ACGT"] + [NEVER]
        self.profile = Profile(match, enter, inside, leave, self.slot > 0)
        self.backward = self.profile.reversed(*from_end)
        inner = np.flatnonzero((self.pos >= start - PAD) & (self.pos <= end + PAD))
        self.first, self.last = (int(inner[0]), int(inner[-1])) if len(inner) else (0, -1)
        while len(inner) and self.last + 1 < size and keep[self.last + 1]:
            self.last += 1
        while self.first > 0 and keep[self.first - 1]:
            self.first -= 1


def _places(layout: Layout, pos: int, cigar: str) -> np.ndarray:
    """Where a read without realignment lies."""
    out, at = [], pos
    for n, op in _operations(cigar):
        if op in "MS":
            out += range(at, at + n)
        at += n * (op in "MSD")
    return np.array([layout.column[p] for p in out])


def _realigned(layout: Layout, seqs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(places of the bases, whether the read fits). Ends at which the alignments from the front and from the end part are blank."""
    size = np.array([len(s) for s in seqs])
    codes, back_codes = base_codes(seqs), base_codes([s[::-1] for s in seqs])
    score, place = align(layout.profile, codes, lengths=size)
    _, back = align(layout.backward, back_codes, lengths=size)
    k = np.arange(codes.shape[1])
    back = np.take_along_axis(back, np.maximum(size[:, None] - 1 - k, 0), axis=1)
    back = np.where(back >= 0, len(layout.slot) - 1 - back, -1)
    apart = (place != back) & (k < size[:, None])
    early = apart & (k < size[:, None] // 2)
    left = np.where(early, k + 1, 0).max(axis=1)
    right = np.where(apart & ~early, k, size[:, None]).min(axis=1)
    inside = (k >= left[:, None]) & (k < right[:, None])
    return np.where(inside, place, -1), (2 * score >= MATCH * size) & (right > left)


def _symbols(layout: Layout, seq: str, place: np.ndarray) -> str:
    """A symbol for each column: '.' reference (or no insertion), a base, '-' deleted, ' ' not covered."""
    on = np.flatnonzero(place >= 0)
    out = [" "] * len(layout.letter)
    if len(on):
        for c in range(int(place[on[0]]), int(place[on[-1]]) + 1):
            out[c] = "." if layout.slot[c] else "-"
        for i in on.tolist():
            c = int(place[i])
            out[c] = "." if seq[i] == layout.letter[c] else seq[i] if seq[i] in "ACGT" else " "
    return "".join(out)


def realign_tags(tags: DataFrame, layout: DataFrame, batch: int = 64) -> DataFrame:
    """Tags over their window's layout: win, sample, n, first (column), symbols (of the window's columns), kept (false: the read fits nowhere)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, f in frame.groupby("win", sort=False):
                head = f.iloc[0]
                own = Layout(head["start"], head["end"], head["lo"], head["ref"], head["changes"])
                rows = []
                for k in range(0, len(f), batch):
                    part = f.iloc[k : k + batch]
                    seqs = part["seq"].tolist()
                    places, kept = _realigned(own, seqs) if own.indels else ([_places(own, p, c) for p, c in zip(part["pos"], part["cigar"], strict=True)], [True] * len(part))
                    rows += [(s, n, _symbols(own, seq, p)[own.first : own.last + 1], bool(ok)) for s, n, seq, p, ok in zip(part["sample"], part["n"], seqs, places, kept, strict=True)]
                out = pd.DataFrame(rows, columns=["sample", "n", "symbols", "kept"])
                yield out.assign(win=head["win"], first=own.first)[["win", "sample", "n", "first", "symbols", "kept"]]

    joined = tags.select("win", "sample", "pos", "cigar", "seq", "n").join(layout.select("win", "start", "end", "lo", "ref", "changes"), "win")
    # dealt by window and place, as aligning costs far more than sending: a deep window is the work of several tasks
    dealt = joined.repartition(int(tags.sparkSession.conf.get("spark.sql.shuffle.partitions")), "win", F.expr("pos div 16"))
    return dealt.sortWithinPartitions("win", "pos").mapInPandas(run, "win long, sample string, n long, first int, symbols string, kept boolean")


def layout_letters(layout: DataFrame) -> DataFrame:
    """(win, letters): the reference along the layout, '+' in slots."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"win": f["win"], "letters": [Layout(s, e, lo, r, c).letter for s, e, lo, r, c in zip(f["start"], f["end"], f["lo"], f["ref"], f["changes"], strict=True)]})

    return layout.select("win", "start", "end", "lo", "ref", "changes").mapInPandas(run, "win long, letters string")


def informative_symbols(placed: DataFrame, percent: int = 10, least: int = 5) -> DataFrame:
    """(win, col, syms): columns where a symbol besides '.' has ``least`` reads and ``percent`` of its sample's depth in any sample."""
    cells = placed.where("kept").select("win", "sample", "n", "first", F.posexplode(F.split("symbols", "")).alias("i", "sym")).where("sym not in (' ', '')")
    counts = cells.groupBy("win", "sample", (F.col("first") + F.col("i")).alias("col"), "sym").agg(F.sum("n").alias("n"))
    depth = counts.groupBy("win", "sample", "col").agg(F.sum("n").alias("depth"))
    good = counts.join(depth, ["win", "sample", "col"]).where((F.col("sym") != ".") & (F.col("n") >= least) & (F.col("n") * 100 >= F.col("depth") * percent))
    return good.groupBy("win", "col").agg(F.array_join(F.array_sort(F.collect_set("sym")), "").alias("syms"))


def haplotype_strings(placed: DataFrame, columns: DataFrame) -> DataFrame:
    """(win, sample, hap, n): reads of equal strings over the informative columns; symbols that were cleaned away and columns not covered are ' '."""
    own = columns.groupBy("win").agg(F.array_sort(F.collect_list(F.struct("col", "syms"))).alias("cols"))
    symbol = lambda c: F.substr("symbols", c["col"] - F.col("first") + 1, F.lit(1))
    seen = F.transform("cols", lambda c: F.when((symbol(c) == ".") | (F.instr(c["syms"], symbol(c)) > 0), symbol(c)).otherwise(" "))
    return placed.where("kept").join(own, "win").select("win", "sample", "n", F.array_join(seen, "").alias("hap")).where("trim(hap) <> ''").groupBy("win", "sample", "hap").agg(F.sum("n").alias("n"))


def _regions(called: DataFrame, columns: DataFrame, share: float) -> DataFrame:
    """Regions (runs of informative columns) of called windows: win, first_col, alleles (the one or two most frequent strings there that reach
    ``share``, without the columns at the ends where all are the reference), their reads, all reads that cover the region, and whether a further
    allele is left. Haplotypes that don't cover a region whole don't count there."""
    each = called.select("win", F.explode(F.arrays_zip(F.split("haps", ",").alias("hap"), F.split("counts", ",").cast("array<long>").alias("n"))).alias("x"))
    at = each.join(islands(columns), "win").select("win", "col", "size", F.substr("x.hap", F.col("at") + 1, F.col("size")).alias("part"), "x.n").where("instr(part, ' ') = 0 and part <> ''")
    sums = at.groupBy("win", "col", "size", "part").agg(F.sum("n").alias("n")).groupBy("win", "col", "size").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "part"))).alias("all"), F.sum("n").alias("dp"))
    enough = F.filter("all", lambda x: -x["n"] >= F.lit(share) * F.col("dp"))
    two = sums.withColumn("enough", enough).select("*", F.slice("enough", 1, 2).alias("two"), F.repeat(F.lit("."), F.col("size")).alias("plain"))
    other = F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: F.exists("two", lambda x: F.substr(x["part"], i, F.lit(1)) != "."))
    two = two.withColumn("other", other).withColumn("lead", F.array_position("other", True).cast("int")).where("lead > 0")
    size = (F.col("size") - F.array_position(F.reverse("other"), True) + 2 - F.col("lead")).cast("int")
    cut = F.transform("two", lambda x: F.struct(F.substr(x["part"], F.col("lead"), size).alias("part"), (-x["n"]).alias("n")))
    more = F.exists(F.array_except(F.transform("enough", lambda x: x["part"]), F.transform("two", lambda x: x["part"])), lambda x: x != F.col("plain"))
    return two.select("win", (F.col("col") + F.col("lead") - 1).alias("first_col"), size.alias("size"), cut.alias("alleles"), "dp", more.alias("unexplained"))


def _alleles(called: DataFrame, columns: DataFrame, layout: DataFrame, share: float) -> DataFrame:
    """Regions of called windows as alleles of the reference: pos, ref, alt; where lengths differ with the base before. A row counts where its position
    lies in its window. gt: 0 is the reference, a region with one allele has it twice; ad: reads of the reference and of each other allele."""
    known = called.select("win", F.size(F.split("haps", ",")).alias("n_haps"), F.array_join(F.transform(F.slice(F.split("counts", ","), 1, 10), lambda x: F.floor(x.cast("long") * 100 / F.col("n_reads"))).cast("array<string>"), ",").alias("freqs"), "trash")
    rows = _regions(called.where("haps <> ''"), columns, share).join(known, "win").join(layout_letters(layout), "win").join(layout.select("win", "chr", "start", "end", "lo"), "win")
    real = lambda c: F.replace(c, F.lit("+"), F.lit(""))

    def bases(allele: Column) -> Column:
        letter = lambda i: F.substr(allele, i, F.lit(1))
        each = F.transform(F.sequence(F.lit(1), F.length(allele)), lambda i: F.when(letter(i) == ".", real(F.substr("part", i, F.lit(1)))).when(letter(i) == "-", "").otherwise(letter(i)))
        return F.array_join(each, "")

    rows = rows.withColumn("part", F.substr("letters", F.col("first_col") + 1, F.col("size"))).withColumn("before", real(F.substr("letters", F.lit(1), F.col("first_col")))).withColumn("ref", real(F.col("part")))
    # alleles that spell the reference are the reference, also where a slot is passed over
    rows = rows.withColumn("spelled", F.transform("alleles", lambda x: F.struct(bases(x["part"]).alias("s"), x["n"].alias("n"))))
    rows = rows.withColumn("alts", F.array_distinct(F.transform(F.filter("spelled", lambda x: x["s"] != F.col("ref")), lambda x: x["s"]))).where("size(alts) > 0")
    shift = F.exists("alts", lambda a: F.length(a) != F.length("ref")) & (F.length("before") > 0)
    base = F.when(shift, F.right("before", F.lit(1))).otherwise("")
    pos = F.col("lo") + F.length("before") - F.when(shift, 1).otherwise(0)
    index = F.transform("spelled", lambda x: F.array_position("alts", x["s"]))
    gt = F.array_join(F.array_sort(F.concat(index, F.when(F.size(index) == 1, index).otherwise(F.array().cast("array<long>")))).cast("array<string>"), "/")
    reads = lambda allele: F.aggregate(F.filter("spelled", lambda x: x["s"] == allele), F.lit(0).cast("long"), lambda t, x: t + x["n"])
    ad = F.array_join(F.concat(F.array(reads(F.col("ref"))), F.transform("alts", reads)).cast("array<string>"), ",")
    rows = rows.withColumns({"gt": gt, "ad": ad, "pos": pos, "base": base})
    out = rows.select("win", "chr", "pos", F.concat("base", "ref").alias("ref"), F.array_join(F.transform("alts", lambda a: F.concat("base", a)), ",").alias("alt"), "gt", "dp", "ad", "n_haps", "freqs", "trash", "unexplained", "start", "end")
    return out.where("pos between start and end").drop("start", "end")


def _laid_out(reads: DataFrame, reference: Column, width: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(layouts, placed tags) of all windows, stored as they are read several times."""
    tags = stored(tags_of(reads, width), "window-tags")
    layout = stored(layouts(tags, reference, least), "window-layouts")
    return layout, stored(realign_tags(tags, layout), "window-placed")


def call_windows(reads: DataFrame, reference: Column, width: int = 200, share: float = 0.1, least: int = 4) -> DataFrame:
    """Alleles of the regions of each window (all reads are one sample): win, chr, pos, ref, alt, gt, dp, ad, n_haps, freqs, trash, unexplained."""
    layout, placed = _laid_out(reads.withColumn("sample", F.lit("")), reference, width, least)
    columns = informative_symbols(placed)
    called = call_haplotypes(haplotype_strings(placed, columns), share, least)
    return _alleles(called, columns, layout, share)


def call_two_samples(reads: DataFrame, reference: Column, samples: tuple[str, str], width: int = 200, share: float = 0.1, least: int = 4) -> DataFrame:
    """Haplotypes of windows in a layout that two samples share: win, chr, start, allele (its number, the most frequent first), hap, and for each sample
    (a, b) its reads and share in hundredths, all alleles that reach ``share`` there (gt; 0 if none) and reads. An allele stays if either has it."""
    layout, placed = _laid_out(reads, reference, width, least)
    called = call_haplotypes(haplotype_strings(placed, informative_symbols(placed)), share, least, samples=True).where("haps <> ''")
    each = called.select("win", "sample", "gt", "n_reads", F.posexplode(F.arrays_zip(F.split("haps", ",").alias("hap"), F.split("counts", ",").cast("array<long>").alias("n"))).alias("allele", "x"))
    of = lambda s, c: F.max(F.when(F.col("sample") == s, F.col(c)))
    both = each.groupBy("win", "allele", F.col("x.hap").alias("hap")).agg(*[of(s, c).alias(f"{c.split('.')[-1]}_{k}") for k, s in zip("ab", samples, strict=True) for c in ("x.n", "n_reads", "gt")])
    both = both.na.fill(0, ["n_a", "n_b", "n_reads_a", "n_reads_b"]).na.fill("0", ["gt_a", "gt_b"])
    hundredths = lambda k: F.when(F.col(f"n_reads_{k}") > 0, F.expr(f"n_{k} * 100 div n_reads_{k}")).otherwise(0).alias(f"share_{k}")
    return both.join(layout.select("win", "chr", "start"), "win").select("win", "chr", "start", "allele", "hap", *[c for k in "ab" for c in (f"n_{k}", hundredths(k), f"n_reads_{k}", f"gt_{k}")])
