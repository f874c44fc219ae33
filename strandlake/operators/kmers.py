"""K-mer tables: counting, uniqueness, prefix groups, seed lookup and pairing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explode_kmers(sequences: DataFrame, seq: str, k: int, keep: tuple[str, ...] = (), step: int = 1) -> DataFrame:
    """(keep, off, kmer): every ``step``-th k-mer with its 0-based offset; sequences are ASCII.

    A sequence is first cut, as bytes, into overlapping pieces of about 256 bases: a substring of a long string costs its offset."""
    width = 256 // step * step
    last = (F.length(seq) - k).cast("long")
    cut = sequences.where(F.length(seq) >= k).select(*keep, F.col(seq).cast("binary").alias("_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / width))).alias("_c"))
    pieces = cut.select(*keep, (F.col("_c") * width).alias("_base"), F.substr("_b", (F.col("_c") * width + 1).cast("int"), F.lit(width + k - 1)).cast("string").alias("_piece"))
    at = F.sequence(F.lit(0), F.least(F.lit(width - step), F.length("_piece") - k), F.lit(step))
    each = F.transform(at, lambda i: F.struct(i.alias("i"), F.substr("_piece", i + 1, F.lit(k)).alias("kmer")))
    return pieces.where(F.length("_piece") >= k).select(*keep, "_base", F.explode(each).alias("x")).select(*keep, (F.col("_base") + F.col("x.i")).alias("off"), "x.kmer")


_DIGIT = np.full(256, 4, dtype=np.uint8)
_DIGIT[np.frombuffer(b"ACGT", dtype=np.uint8)] = range(4)
#: Bases that are packed at once, and rows that a task gathers before it sends them on.
STEP, HELD = 1 << 20, 1 << 22


def packed(digits: np.ndarray, k: int, reverse: bool = False) -> np.ndarray:
    """The code of each window of ``k`` digits (two bits each, the first highest; with ``reverse`` the first lowest), from those of half the length."""
    join = (lambda a, b, w, v: a + (b << 2 * w)) if reverse else (lambda a, b, w, v: (a << 2 * v) + b)
    out, width, half, size = None, 0, digits.astype(np.int64), 1
    while True:
        if k & 1:
            out = half if out is None else join(out[: len(half) - width], half[width:], width, size)[: max(len(half) - width, 0)]
            width += size
        k >>= 1
        if not k:
            return out
        half, size = join(half[:-size], half[size:], size, size), 2 * size


def windows(seqs: list[str], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, offset, digits, at, clean) of all k-mers of ASCII sequences, ``STEP`` bases at a time: ``at`` is where a k-mer begins in ``digits`` (4: not a
    base, clean: none of them)."""
    sizes = np.array([len(x) for x in seqs], dtype=np.int64)
    text = np.frombuffer("".join(seqs).encode("ascii", "replace"), dtype=np.uint8)
    ends = np.cumsum(sizes)
    begin = ends - sizes
    for a in range(0, len(text) - k + 1, STEP):
        part = text[a : a + STEP + k - 1]
        digits = _DIGIT[part]
        b = a + len(part) - k + 1
        r = np.repeat(np.arange(len(seqs)), np.maximum(np.minimum(ends, b) - np.maximum(begin, a), 0))
        off = np.arange(a, a + len(r)) - begin[r]
        at = np.flatnonzero(off + k <= sizes[r])
        other = np.concatenate([[0], np.cumsum(digits > 3)])
        yield r[at], off[at], part, at, other[at + k] == other[at]


def kmer_text(code: Column, k: int) -> Column:
    """The k-mer of a code."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def code_counts(sequences: DataFrame, k: int, canonical: bool = False, others: bool = False) -> DataFrame:
    """(code, other, cnt) of the k-mers (31 bases at most) of whole sequences, with ``canonical`` of the smaller one of both strands. Those with other
    letters have their text in ``other``, or are left out.

    Tasks count packed k-mers in pieces, so that Spark gets a row for each different k-mer of a piece."""

    def counts(held: list[np.ndarray]) -> pd.DataFrame:
        code, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"code": pd.array(code, dtype="Int64"), "other": pd.Series([None] * len(code), dtype=object), "n": n})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for frame in frames:
            for _, _, part, at, clean in windows(frame["seq"].tolist(), k):
                digits = _DIGIT[part] & 3
                code = packed(digits, k)[at[clean]]
                held.append(np.minimum(code, packed(3 - digits, k, reverse=True)[at[clean]]) if canonical else code)
                rows += len(code)
                if others and not clean.all():
                    odd = pd.Series([part[i : i + k].tobytes().decode() for i in at[~clean]]).value_counts()
                    yield pd.DataFrame({"code": pd.array([None] * len(odd), dtype="Int64"), "other": odd.index, "n": odd.to_numpy()})
                if rows >= HELD:
                    yield counts(held)
                    held, rows = [], 0
        if held:
            yield counts(held)

    found = sequences.where(F.length("seq") >= k).select("seq").mapInPandas(run, "code long, other string, n long")
    return found.groupBy("code", "other").agg(F.sum("n").alias("cnt"))


#: Longest k-mers whose table of counts (a byte each) a task holds; groups that codes are merged in; places that a task gathers before it sends them on.
TABLED, BUCKETS, PLACES = 12, 1024, 1 << 20
#: Share of the sequences, the first by id, in which k-mers are counted beforehand, and how many sequences make that worth while.
AHEAD, MANY = 16, 1 << 15


def _earliest(code: np.ndarray, ids: np.ndarray, off: np.ndarray, most: int, ordered: bool = False) -> np.ndarray:
    """Where the first ``most`` of each code stand, by id and offset, sorted by code. ``ordered``: ids and offsets are so already (codes below 2^36)."""
    if ordered:
        key = np.sort((code.astype(np.int64) << 27) | np.arange(len(code)))
        order, code = key & 0x7FFFFFF, key >> 27
    else:
        order = np.lexsort((off, ids, code))
        code = code[order]
    stays = np.ones(len(code), dtype=bool)
    stays[most:] = code[most:] != code[:-most]
    return order[stays]


def _heads(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each run of a sorted array begins, its length)."""
    new = np.flatnonzero(np.diff(code, prepend=-1))
    return new, np.diff(new, append=len(code))


class _Seen:
    """How often a task has met each code, up to ``most``: places of codes that were met so often aren't among the first ones. That holds as long as ids
    rise; counts begin anew where they don't. Behind the id ``cut`` codes of ``settled`` (bits) count as met."""

    def __init__(self, k: int, most: int, cut: int | None = None, settled: np.ndarray | None = None) -> None:
        self.k, self.most, self.cut, self.settled = k, most, cut, settled
        self.counts, self.last, self.behind = np.zeros(4**k, dtype=np.uint8), None, False

    def parts(self, ids: np.ndarray, seqs: list[str]) -> Iterator[tuple[np.ndarray, list[str], bool]]:
        """A batch in order of ids, about ``STEP`` bases at a time: (ids, sequences, whether these ids rise)."""
        order = np.argsort(ids, kind="stable")
        ids, seqs = ids[order], [seqs[i] for i in order.tolist()]
        rise = bool((np.diff(ids) > 0).all())
        if not rise or (self.last is not None and len(ids) and ids[0] <= self.last):
            self.counts[:], self.behind = 0, False
        self.last = ids[-1] if len(ids) else self.last
        step = np.cumsum([len(x) for x in seqs]) // STEP * 2 + (0 if self.cut is None else ids > self.cut)
        at = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(ids)]
        for a, b in zip(at, at[1:], strict=False):
            if b > a and self.cut is not None and not self.behind and ids[a] > self.cut:
                np.maximum(self.counts, np.unpackbits(self.settled, count=4**self.k) * np.uint8(self.most), out=self.counts)
                self.behind = True
            yield ids[a:b], seqs[a:b], rise

    def first(self, code: np.ndarray, ids: np.ndarray, off: np.ndarray, rise: bool) -> np.ndarray:
        """Which of these places may be among the first of their code."""
        open_ = np.flatnonzero(self.counts[code] < self.most)
        found = open_[_earliest(code[open_], ids[open_], off[open_], self.most, ordered=rise)]
        new, n = _heads(code[found])
        which = code[found[new]]
        stays = np.arange(len(found)) - np.repeat(new, n) < np.repeat(self.most - self.counts[which].astype(np.int64), n)
        if rise:  # else a later part may hold an earlier place
            self.counts[which] = np.minimum(self.counts[which] + n, self.most)
        return found[stays]


def _settled(sequences: DataFrame, k: int, most: int) -> tuple[int, np.ndarray] | None:
    """(id, bits): the k-mers that have ``most`` places in the first sixteenth of the sequences, up to that id. None where there are few sequences."""
    n, cut = sequences.agg(F.count("*"), F.percentile_approx("id", 1 / AHEAD, F.lit(1000))).first()
    if n < MANY:
        return None
    parts = 64 if k > 5 else 1
    size = 4**k // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen(k, most)
        for batch in batches:
            for row, _, part, at, clean in windows(batch.column(0).to_pylist(), k):
                code, n = np.unique(packed(_DIGIT[part] & 3, k)[at[clean]], return_counts=True)
                seen.counts[code] = np.minimum(seen.counts[code] + n, most)
        yield pa.record_batch([pa.array(range(parts), pa.int32()), pa.array([x.tobytes() for x in seen.counts.reshape(parts, size)])], names=["part", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(size, dtype=np.uint8), None
        for batch in batches:
            for part, n in zip(batch.column(0), batch.column(1), strict=True):
                np.minimum(total + np.frombuffer(n.as_buffer(), dtype=np.uint8), most, out=total)
        yield pa.record_batch([pa.array([part.as_py()], pa.int32()), pa.array([np.packbits(total >= most).tobytes()])], names=["part", "bits"])

    counted = sequences.where(F.col("id") <= cut).select("seq").mapInArrow(run, "part int, n binary")
    bits = sorted(counted.groupBy("part").applyInArrow(add, "part int, bits binary").collect())
    return cut, np.frombuffer(b"".join(r["bits"] for r in bits), dtype=np.uint8)


#: Columns of places that travel: a bucket of codes with the codes' places in it, or k-mers with other letters as they are; ids (behind ``base``) and
#: offsets as unsigned numbers of one width, the smallest that will do.
SENT = "bucket int, base long, code binary, other binary, ids binary, off binary"


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max())))


def _wide(blob: pa.Scalar, n: int) -> np.ndarray:
    return np.frombuffer(blob.as_buffer(), dtype=f"u{len(blob.as_buffer()) // n}").astype(np.int64)


def _batch(bucket: np.ndarray, base: int, edges: np.ndarray, code: np.ndarray, other: np.ndarray, ids: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket, of the places between its edges; ``code`` or ``other`` is empty."""
    blob = lambda x: pa.Array.from_buffers(pa.binary(), len(bucket), [None, pa.py_buffer((edges * x.itemsize * (len(x) > 0)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
    columns = [pa.array(bucket.astype(np.int32)), pa.array(np.full(len(bucket), base)), blob(code), blob(other), blob(ids), blob(off)]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "base", "code", "other", "ids", "off"])


def _sent(k: int, code: np.ndarray, ids: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
    """Places as a row for each bucket of codes."""
    order, each, base = np.argsort(code), max(4**k // BUCKETS, 1), int(ids.min())
    code = code[order]
    at = np.append(np.searchsorted(code, np.arange(BUCKETS) * each), len(code))
    full = np.flatnonzero(np.diff(at))
    return _batch(full, base, np.append(at[full], len(code)), (code % each).astype(np.uint16), np.zeros(0, dtype="S1"), _narrow(ids[order] - base), _narrow(off[order]))


def _sent_others(texts: np.ndarray, ids: np.ndarray, off: np.ndarray, most: int) -> pa.RecordBatch:
    """The same of k-mers with other letters: a row for each different one."""
    every, code = np.unique(texts, return_inverse=True)
    at = _earliest(code, ids, off, most)
    new, _ = _heads(code[at])
    bucket = np.array([BUCKETS + zlib.crc32(x) % BUCKETS for x in every.tolist()])
    base = int(ids.min())
    return _batch(bucket, base, np.append(new, len(at)), np.zeros(0, dtype=np.uint16), texts[at], _narrow(ids[at] - base), _narrow(off[at]))


def place_slots(sequences: DataFrame, k: int, most: int) -> DataFrame:
    """(kmer, fwd, nth, id, off): the first ``most`` places, by id and offset, of each k-mer (12 bases at most) of whole sequences, numbered from 1;
    ``fwd``: it is smaller than its reverse complement.

    A task sends on no more than ``most`` places of a k-mer while ids rise, and none of k-mers that have as many in sequences before; these are counted at
    once, when the query is built. Places travel as numbers, a row for each bucket of k-mers, and a bucket's places are merged by numpy. A task holds a
    byte for each possible k-mer and ``PLACES`` places; a bucket holds at most ``most`` places of each of its k-mers from each time that a task sends."""
    if k > TABLED or most > 255:
        raise ValueError(f"k-mers of {TABLED} bases and 255 places at most")
    sequences = sequences.select(F.col("id").cast("long"), "seq")
    cut, settled = _settled(sequences, k, most) or (None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, rows = _Seen(k, most, cut, settled), [], 0
        for batch in batches:
            for ids, seqs, rise in seen.parts(batch.column(0).to_numpy(), batch.column(1).to_pylist()):
                for row, off, part, at, clean in windows(seqs, k):
                    code, row_, off_ = packed(_DIGIT[part] & 3, k)[at[clean]], row[clean], off[clean]
                    stay = seen.first(code, row_ if rise else ids[row_], off_, rise)
                    held.append((code[stay], ids[row_[stay]], off_[stay]))
                    rows += len(stay)
                    if not clean.all():
                        odd = np.frombuffer(b"".join(part[i : i + k].tobytes() for i in at[~clean]), dtype=f"S{k}")
                        yield _sent_others(odd, ids[row[~clean]], off[~clean], most)
                    if rows >= PLACES:
                        yield _sent(k, *map(np.concatenate, zip(*held, strict=True)))
                        held, rows = [], 0
        if rows:
            yield _sent(k, *map(np.concatenate, zip(*held, strict=True)))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for bucket, base, code, other, ids, off in zip(*batch.columns, strict=True):
                codes, texts = np.frombuffer(code.as_buffer(), dtype=np.uint16), np.frombuffer(other.as_buffer(), dtype=f"S{k}")
                n = max(len(codes), len(texts))
                held.append((texts, codes.astype(np.int32) + bucket.as_py() * max(4**k // BUCKETS, 1), _wide(ids, n) + base.as_py(), _wide(off, n)))
                size += n
                if size >= PLACES:
                    held, size = [first(held)], 0
        other, code, ids, off = first(held)
        new, n = _heads(np.unique(other, return_inverse=True)[1] if len(other) else code)
        nth = np.arange(len(ids)) - np.repeat(new, n) + 1
        texts, fwd = _texts(other[new] if len(other) else other, code[new] if len(code) else code, k)
        number = np.repeat(np.arange(len(new)), n)
        whole = pa.RecordBatch.from_arrays([texts.take(pa.array(number)), pa.array(fwd[number]), pa.array(nth.astype(np.int32)), pa.array(ids), pa.array(off)], names=["kmer", "fwd", "nth", "id", "off"])
        yield from (whole.slice(a, 1 << 14) for a in range(0, len(ids), 1 << 14))

    def first(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        other, code, ids, off = map(np.concatenate, zip(*held, strict=True))
        at = _earliest(np.unique(other, return_inverse=True)[1] if len(other) else code, ids, off, most)
        return other[at] if len(other) else other, code[at] if len(code) else code, ids[at], off[at]

    return sequences.where(F.length("seq") >= k).mapInArrow(run, SENT).groupBy("bucket").applyInArrow(merged, "kmer string, fwd boolean, nth int, id long, off long")


def _texts(other: np.ndarray, code: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
    """(text, whether it is smaller than its reverse complement) of k-mers: of ``other`` where there are any, else of codes."""
    if len(other):
        every = other.tolist()
        return pa.array([x.decode() for x in every]), np.array([x < x[::-1].translate(_OTHER_STRAND) for x in every])
    digits = code[:, None] >> np.arange(2 * k - 2, -1, -2, dtype=np.int32) & 3
    letters = np.frombuffer(b"ACGT", dtype=np.uint8)[digits]
    back = (3 - digits.astype(np.int64)) @ (1 << np.arange(0, 2 * k, 2))
    return pa.StringArray.from_buffers(len(code), pa.py_buffer(np.arange(0, k * len(code) + 1, k, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(letters))), code < back


def first_places(sequences: DataFrame, k: int, most: int) -> DataFrame:
    """(kmer, nth, id, off): ``place_slots`` without the strand."""
    return place_slots(sequences, k, most).select("kmer", "nth", "id", "off")


def seed_keys(sequences: DataFrame) -> DataFrame:
    """(id, off, next2, seed_key) of every 18-mer of whole sequences: the code of its first 16 bases with the first base masked out (30 bits; null if
    another letter occurs there), and the two bases behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, off, part, at, _ in windows(batch.column(1).to_pylist(), 18):
                other = np.concatenate([[0], np.cumsum(_DIGIT[part] > 3)])
                key = packed(_DIGIT[part] & 3, 16)[at] & 0x3FFFFFFF
                two = np.stack([part[at + 16], part[at + 17]], axis=1)
                text = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.arange(0, 2 * len(at) + 1, 2, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(two)))
                columns = [pa.array(ids[row]), pa.array(off), text, pa.array(key, mask=other[at + 16] != other[at])]
                whole = pa.RecordBatch.from_arrays(columns, names=["id", "off", "next2", "seed_key"])
                yield from (whole.slice(k, 1 << 16) for k in range(0, len(at), 1 << 16))

    return sequences.where(F.length("seq") >= 18).select(F.col("id").cast("long"), "seq").mapInArrow(run, "id long, off long, next2 string, seed_key long")


def kmer_counts(sequences: DataFrame, k: int) -> DataFrame:
    """(kmer, cnt) of canonical k-mers (31 bases at most) without ambiguous bases."""
    return code_counts(sequences, k, canonical=True).select(kmer_text(F.col("code"), k).alias("kmer"), "cnt")


def uniqueness(counts: DataFrame) -> DataFrame:
    """Class of each k-mer: unique, dual or multi."""
    return counts.withColumn("klass", F.when(F.col("cnt") == 1, "unique").when(F.col("cnt") == 2, "dual").otherwise("multi"))


def unique_prefixes(counts: DataFrame, length: int, most: int = 4) -> DataFrame:
    """Prefixes all of whose extensions are unique, with ``most`` extensions at most."""
    grouped = counts.groupBy(F.substring("kmer", 1, length).alias("prefix")).agg(F.max("cnt").alias("top"), F.count("*").alias("n_ext"))
    return grouped.where((F.col("top") == 1) & (F.col("n_ext") <= most)).select("prefix", "n_ext")


SEED = 18
#: Slots of the filter that tasks pass seeds through before the lookup: 1 MB, whatever the number of seeds.
SLOTS = 1 << 23


def _seed_codes(part: np.ndarray, at: np.ndarray, clean: np.ndarray, reverse: bool) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    """(which of ``at`` begin with A, their codes, their texts where another letter occurs: code -1) of 18-mers of the given or the other strand."""
    digits = _DIGIT[part] & 3
    chosen = np.flatnonzero(part[at + SEED - 1] == ord("T") if reverse else part[at] == ord("A"))
    at, clean = at[chosen], clean[chosen]
    code = np.where(clean, (packed(3 - digits, SEED, reverse=True) if reverse else packed(digits, SEED))[at], -1)
    other: list[str | None] = [None] * len(at)
    for k in np.flatnonzero(~clean):
        text = part[at[k] : at[k] + SEED].tobytes()
        other[k] = (text[::-1].translate(_OTHER_STRAND) if reverse else text).decode()
    return chosen, code, other


_OTHER_STRAND = bytes(dict(zip(b"ACGT", b"TGCA", strict=True)).get(c, ord("N")) for c in range(256))


def _slot(code: np.ndarray) -> np.ndarray:
    """The filter's slot of a code."""
    mixed = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(SLOTS)).astype(np.int64)


def _in(words: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return words[slot >> 6] >> (slot & 63) & 1 == 1


def _places(batches: Iterator[pa.RecordBatch], strands: tuple[bool, ...], passed: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Columns kept ..., seq -> kept ..., rev, off, code, other: 18-mers that begin with A on a strand; ``off`` is where they begin in the sequence as
    given. Codes whose slot isn't in ``passed`` can't be seeds and stay out."""
    for batch in batches:
        kept = batch.columns[:-1]
        for row, off, part, at, clean in windows(batch.column(batch.num_columns - 1).to_pylist(), SEED):
            for rev in strands:
                chosen, code, other = _seed_codes(part, at, clean, rev)
                texts = pa.array(other, pa.string())
                if passed is not None:
                    stay = np.flatnonzero((code < 0) | _in(passed, _slot(np.maximum(code, 0))))
                    chosen, code, texts = chosen[stay], code[stay], texts.take(pa.array(stay))
                rows = pa.array(row[chosen])
                out = [*(c.take(rows) for c in kept), pa.array(np.full(len(chosen), rev)), pa.array(off[chosen]), pa.array(code), texts.fill_null("")]
                whole = pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[:-1], "rev", "off", "code", "other"])
                yield from (whole.slice(k, 1 << 16) for k in range(0, len(chosen), 1 << 16))


def _placed(sequences: DataFrame, by: tuple[str, ...], strands: tuple[bool, ...], passed: np.ndarray | None = None) -> DataFrame:
    rows = sequences.where(F.length("seq") >= SEED).select(*by, "seq")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lambda batches: _places(batches, strands, passed), f"{kept}, rev boolean, off long, code long, other string")


def contig_hits(reads: DataFrame, contigs: DataFrame, by: tuple[str, ...], most: int = 16) -> DataFrame:
    """``strand_hits`` of reads on the seeds of contigs (chr, seq) that have so many that a filter leaves little out; ``by`` are whole numbers. The reads'
    18-mers travel to the buckets in which the seeds are found, and are looked up there."""
    return _numbered(seed_table(contigs, reads=reads, by=by), by, most)


def seed_table(contigs: DataFrame, most: int = 8, reads: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(code, other, chr, pos): the 18-mers of (chr, seq) that begin with A and occur once, packed (or as a text, with code -1, where they hold
    other letters); a 16-mer has ``most`` slots at most. With ``reads`` (by, seq), instead all hits (by, rev, off, chr, pos) of both of their strands.

    Places travel as in ``place_slots``, no more than two of an 18-mer from each time that a task sends, to buckets of 16-mers that follow the number of
    shuffle partitions."""
    bits = min(max(int(np.ceil(np.log2(8 * int(contigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))), 10), 16)
    low, looked_up = 2 * SEED - 2 - bits, reads is not None  # A is 0: the first two bits don't tell

    def sent(code: np.ndarray, ids: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        at = _earliest(code, ids, off, 2, ordered=True)
        code, base = code[at], int(ids.min())
        edges = np.append(np.searchsorted(code, np.arange(1 << bits) << low), len(code))
        full = np.flatnonzero(np.diff(edges))
        return _batch(full, base, np.append(edges[full], len(code)), (code & (1 << low) - 1).astype(np.uint32), np.zeros(0, dtype="S1"), _narrow(ids[at] - base), _narrow(off[at]))

    def sent_others(texts: np.ndarray, ids: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        at = np.argsort(texts, kind="stable")
        texts, ids, off, base = texts[at], ids[at], off[at], int(ids.min())
        key = _sixteen(texts)
        bucket = np.where(key >= 0, key >> low - 4, [zlib.crc32(x[: SEED - 2]) % (1 << bits) for x in texts.tolist()])
        return _batch(bucket, base, np.arange(len(at) + 1), np.zeros(0, dtype=np.uint32), texts, _narrow(ids - base), _narrow(off))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, off, part, at, clean in windows(batch.column(1).to_pylist(), SEED):
                chosen, code, other = _seed_codes(part, at, clean, False)
                packed_, odd = np.flatnonzero(code >= 0), np.flatnonzero(code < 0)
                held.append((code[packed_], ids[row[chosen[packed_]]], off[chosen[packed_]]))
                rows += len(packed_)
                if len(odd):
                    yield sent_others(np.array([other[k].encode() for k in odd.tolist()], dtype=f"S{SEED}"), ids[row[chosen[odd]]], off[chosen[odd]])
                if rows >= PLACES:
                    yield sent(*map(np.concatenate, zip(*held, strict=True)))
                    held, rows = [], 0
        if rows:
            yield sent(*map(np.concatenate, zip(*held, strict=True)))

    def asked(code: np.ndarray, off: np.ndarray, *keys: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(code)
        code, off, keys = code[order], _narrow(off[order]), [x[order] for x in keys]
        edges = np.append(np.searchsorted(code, np.arange(1 << bits) << low), len(code))
        full = np.flatnonzero(np.diff(edges))
        sent_ = _batch(full, 0, np.append(edges[full], len(code)), (code & (1 << low) - 1).astype(np.uint32), np.zeros(0, dtype="S1"), off, off)
        return sent_.set_column(4, "ids", _columns(keys, edges[full], edges[full + 1]))

    def asked_others(texts: np.ndarray, off: np.ndarray, *keys: np.ndarray) -> pa.RecordBatch:
        key, each = _sixteen(texts), np.arange(len(texts) + 1)
        bucket = np.where(key >= 0, key >> low - 4, [zlib.crc32(x[: SEED - 2]) % (1 << bits) for x in texts.tolist()])
        off = _narrow(off)
        return _batch(bucket, 0, each, np.zeros(0, dtype=np.uint32), texts, off, off).set_column(4, "ids", _columns(list(keys), each[:-1], each[1:]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in range(len(by))]
            for row, off, part, at, clean in windows(batch.column(len(by)).to_pylist(), SEED):
                for rev in (False, True):
                    chosen, code, other = _seed_codes(part, at, clean, rev)
                    packed_, odd = np.flatnonzero(code >= 0), np.flatnonzero(code < 0)
                    place = lambda x: (off[chosen[x]], np.full(len(x), int(rev)), *(c[row[chosen[x]]] for c in keys))  # noqa: B023, E731
                    held.append((code[packed_], *place(packed_)))
                    rows += len(packed_)
                    if len(odd):
                        yield asked_others(np.array([other[k].encode() for k in odd.tolist()], dtype=f"S{SEED}"), *place(odd))
                if rows >= PLACES:
                    yield asked(*map(np.concatenate, zip(*held, strict=True)))
                    held, rows = [], 0
        if rows:
            yield asked(*map(np.concatenate, zip(*held, strict=True)))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, others = [(np.zeros(0, dtype=np.int64),) * 3], [(np.zeros(0, dtype=f"S{SEED}"), *(np.zeros(0, dtype=np.int64),) * 2)]
        wanted = []
        for batch in batches:
            for bucket, base, code, other, ids, off, from_read in zip(*batch.columns, strict=True):
                codes, texts = np.frombuffer(code.as_buffer(), dtype=np.uint32), np.frombuffer(other.as_buffer(), dtype=f"S{SEED}")
                n = max(len(codes), len(texts))
                if from_read.as_py():
                    wanted.append((codes.astype(np.int64) + (bucket.as_py() << low), texts, _wide(off, n), _split(ids.as_buffer(), n, len(by) + 1)))
                    continue
                place = _wide(ids, n) + base.as_py(), _wide(off, n)
                if len(texts):
                    others.append((texts, *place))
                else:
                    held.append((codes.astype(np.int64) + (bucket.as_py() << low), *place))
        code, ids, off = map(np.concatenate, zip(*held, strict=True))
        order = np.argsort(code)
        new, n = _heads(code[order])
        at = order[new[n == 1]]
        texts, more_ids, more_off = map(np.concatenate, zip(*others, strict=True))
        texts, first, n = np.unique(texts, return_index=True, return_counts=True)
        texts, first = texts[n == 1], first[n == 1]
        # the 16-mer, as one with two other letters behind it shares its slots with packed ones; those with other letters are numbered below 0
        key = _sixteen(texts)
        key = np.where(key >= 0, key, -1 - np.unique(texts.astype(f"S{SEED - 2}"), return_inverse=True)[1])
        key = np.concatenate([code[at] >> 4, key])
        code, ids, off = np.concatenate([code[at], np.full(len(texts), -1)]), np.concatenate([ids[at], more_ids[first]]), np.concatenate([off[at], more_off[first]])
        stay = np.sort(_earliest(key, ids, off, most))
        if looked_up:
            few = stay[stay >= len(at)]
            tables = (code[stay[: len(stay) - len(few)]], ids[stay], off[stay]), (texts[few - len(at)], ids[few], off[few])
            for codes, odd, where, keys in wanted:
                asked_, (there, chr_, pos) = (odd, tables[1]) if len(odd) else (codes, tables[0])
                k = np.searchsorted(there, asked_)
                hit = np.flatnonzero(k < len(there))
                hit = hit[there[k[hit]] == asked_[hit]]
                rev, *keys = (x[hit] for x in keys)
                columns = [*keys, rev == 1, where[hit], chr_[k[hit]], pos[k[hit]] + 1]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[*by, "rev", "off", "chr", "pos"])
            return
        other = pa.array([""] * int((stay < len(at)).sum()) + [x.decode() for x in texts[stay[stay >= len(at)] - len(at)].tolist()], pa.string())
        whole = pa.RecordBatch.from_arrays([pa.array(code[stay]), other, pa.array(ids[stay]), pa.array(off[stay] + 1)], names=["code", "other", "chr", "pos"])
        yield from (whole.slice(a, 1 << 14) for a in range(0, len(stay), 1 << 14))

    places = contigs.where(F.length("seq") >= SEED).select(F.col("chr").cast("long"), "seq").mapInArrow(run, SENT).withColumn("from_read", F.lit(False))
    if reads is None:
        return places.groupBy("bucket").applyInArrow(once, "code long, other string, chr long, pos long")
    rows = reads.where(F.length("seq") >= SEED).select(*(F.col(c).cast("long") for c in by), "seq").mapInArrow(read, SENT).withColumn("from_read", F.lit(True))
    return places.unionByName(rows).groupBy("bucket").applyInArrow(once, "".join(f"`{c}` long, " for c in by) + "rev boolean, off long, chr long, pos long")


def _columns(keys: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> pa.Array:
    """Whole numbers of places as one value for each stretch: their widths, their smallest values, and the numbers behind these column by column."""
    base = np.array([x.min() for x in keys], dtype=np.int64)
    cut = [_narrow(x - b) for x, b in zip(keys, base, strict=True)]
    head = bytes(x.itemsize for x in cut) + base.tobytes()
    return pa.array([head + b"".join(x[a:b].tobytes() for x in cut) for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.binary())


def _split(blob: pa.Buffer, n: int, columns: int) -> list[np.ndarray]:
    """The numbers of a value of ``_columns``."""
    data, at, out = blob.to_pybytes(), 9 * columns, []
    base = np.frombuffer(data, dtype=np.int64, count=columns, offset=columns)
    for c in range(columns):
        out.append(np.frombuffer(data, dtype=f"u{data[c]}", count=n, offset=at).astype(np.int64) + base[c])
        at += n * data[c]
    return out


def _sixteen(texts: np.ndarray) -> np.ndarray:
    """The codes of the first 16 bases of texts of 18, -1 where another letter occurs there."""
    digits = _DIGIT[np.frombuffer(texts.tobytes(), dtype=np.uint8).reshape(-1, SEED)[:, : SEED - 2]].astype(np.int64)
    return np.where((digits > 3).any(axis=1), -1, (digits & 3) @ (1 << np.arange(2 * SEED - 6, -1, -2)))


def seed_text(code: Column, other: Column) -> Column:
    """The 18-mer of a row of ``seed_table``."""
    return F.when(code < 0, other).otherwise(kmer_text(code, SEED))


def _filled(seeds: DataFrame) -> np.ndarray:
    """Which slots of the filter hold a seed: as words of 64 slots from Spark, 131 072 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.unique(_slot(batch.column(0).to_numpy()))
            yield pa.record_batch([pa.array(slot >> 6), pa.array(np.uint64(1) << (slot & 63).astype(np.uint64)).view(pa.int64())], names=["word", "bits"])

    words = seeds.where("code >= 0").select("code").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    held = np.zeros(SLOTS // 64, dtype=np.int64)
    held[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return held


def strand_hits(reads: DataFrame, seeds: DataFrame, by: tuple[str, ...] = ("id",), most: int = 16) -> DataFrame:
    """(by, rev, off, chr, pos, hit_no) of both strands of reads (by, seq) on ``seed_table``: 18-mers that begin with A, and those of the
    reverse complement. ``off`` is where the 18 bases begin in the read as given; the first ``most`` hits of a read stay, forward ones first.

    Tasks pack the 18-mers and leave out most that are no seeds by a filter of fixed size; the join decides. The filter is filled at once."""
    return _numbered(_placed(reads, by, (False, True), _filled(seeds)).join(seeds, ["code", "other"]), by, most)


def _numbered(hits: DataFrame, by: tuple[str, ...], most: int) -> DataFrame:
    number = F.row_number().over(Window.partitionBy(*by).orderBy("rev", "off", "chr", "pos"))
    return hits.withColumn("hit_no", number).where(F.col("hit_no") <= most).select(*by, "rev", "off", "chr", "pos", "hit_no")


def pair_hits(hits: DataFrame, limit: int = 1023, most: int = 16, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """Anchors of both mates on one contig and opposite strands within ``limit``, ranked by score sum (of equal sums the later pair first).

    ``hits``: by, mate (1 or 2), rev, chr, pos, score, a few of each mate: they meet inside the row of their read."""
    mate = lambda k: F.collect_list(F.when(F.col("mate") == k, F.struct("chr", "pos", "rev", "score")))
    both = hits.groupBy(*by).agg(mate(1).alias("_1"), mate(2).alias("_2")).where("size(_1) > 0 and size(_2) > 0").select(*by, F.explode("_1").alias("a"), "_2").select(*by, "a", F.explode("_2").alias("b"))
    near = "a.chr = b.chr and a.rev <> b.rev and abs(a.pos - b.pos) <= " + str(limit)
    pairs = both.where(near).select(*by, "a.chr", F.col("a.pos").alias("pos1"), F.col("b.pos").alias("pos2"), (F.col("a.score") + F.col("b.score")).alias("score"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("pos1"), F.desc("pos2")))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= most)
