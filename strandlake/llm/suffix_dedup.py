"""Removal of repeated byte strings with suffix arrays.

Every byte covered by a string of ``span`` bytes that also starts anywhere else is removed. Four steps:

1. Anchors. Among the ``gram``-byte windows inside a string of ``span`` bytes the one with the smallest hash is its anchor, so equal
   strings have equal anchors at the same place in them. Each start belongs to one anchor; an anchor that occurs once in the
   corpus needs no further look.
2. Shards. The starts of a repeated anchor go, with the bytes behind them, to the shard of that anchor; equal segments
   of a shard are held once. A hot anchor is dealt over several shards.
3. A shard's suffix array is built by Larsson-Sadakane refinement in numpy and its common prefixes by Kasai's method (in
   passes over all positions of the permuted array). A start whose neighbour shares ``span`` bytes repeats.
4. Cross-shard merging, for hot anchors alone: the shards exchange their sorted distinct strings, as 128-bit digests cut
   in ranges, and look them up in each other by binary search. The digests' tables are drawn anew for each run, so no text can be
   made to meet another one; that two strings of n meet by chance has a probability of about n * n / 2**129.

Runs of starts with one anchor that lie next to each other go as one segment (cut every ``span`` starts), so a periodic text of n bytes sends
about 2n bytes. A document's list of runs or ranges is one row and grows with its text alone.

Defined cases: a null text counts as empty; texts shorter than ``span`` lose nothing; matches never cross documents; exact copies of a
text are one text to the search and all lose every byte; rows are told apart by a key of their own (``common.keyed``), so null and
repeated doc_ids are rows like others and give one row each; very long texts are hashed in overlapping blocks; an
empty table gives no rows; other columns stay out of the search, whatever their names.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import arrow_map, by_groups, drop_path, fresh_name, group_number, keyed, stage, text_bytes

SPAN, GRAM = 400, 64
REPEATED = np.iinfo(np.int64).min  # no document's key: a string that repeats inside its piece
BLOCK = 1 << 20  # bytes that are hashed together


def _tables(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, 256, dtype=np.uint64), rng.integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def window_hashes(data: np.ndarray, width: int, seed: int = 7) -> np.ndarray:
    """A 64-bit hash of each window of ``width`` bytes (or items that are hashes themselves), by doubling (and one overlap where width is no
    power of two)."""
    letters, factors = _tables(seed)
    h, size, k = letters[data] if data.dtype == np.uint8 else data, 1, 0
    while size < width:
        step = min(size, width - size)
        mixed = h[:-step] if step else h
        h = (mixed ^ (mixed >> np.uint64(29))) * factors[k] + h[step:]
        size, k = size + step, k + 1
    return h


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size < width:
        step = min(size, width - size)
        keys = np.minimum(keys[:-step], keys[step:])
        size += step
    return keys


def anchors(data: np.ndarray, ends: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start, last start, anchor hash, places of that anchor) of each run of at most ``span`` starts that share an anchor; starts
    count from their text.

    ``data``: bytes of several texts behind each other, bounded by ``ends``."""
    out = []
    begin = 0
    while begin < len(ends) - 1:
        # texts of about BLOCK bytes together; a longer text alone, in overlapping blocks
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + BLOCK, side="right")) - 1)
        a, b = int(ends[begin]), int(ends[end])
        for low in range(a, max(b - span + 1, a), 4 * BLOCK):
            high = min(low + 4 * BLOCK, b - span + 1)  # starts low..high - 1
            h = window_hashes(data[low : high + span - 1], gram)
            keys = (h & ~np.uint64(0x7FFFFF)) | np.arange(len(h), dtype=np.uint64)
            at = (_sliding_min(keys, span - gram + 1) & np.uint64(0x7FFFFF)).astype(np.int64)
            start = np.arange(low, high)
            text = np.searchsorted(ends, start, side="right") - 1
            fits = start + span <= ends[text + 1]
            start, text, at = start[fits], text[fits], at[fits]
            if not len(start):
                continue
            anchor = h[at].view(np.int64)
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
            begun = np.flatnonzero(new)
            new |= (np.arange(len(start)) - np.repeat(begun, np.diff(np.append(begun, len(start))))) % span == 0
            new = np.flatnonzero(new)
            last = np.append(new[1:], len(start)) - 1
            moved = np.cumsum(np.concatenate([[0], at[1:] != at[:-1]]))
            out.append((text[new], start[new] - ends[text[new]], start[last] - ends[text[new]], anchor[new], moved[last] - moved[new] + 1))
        begin = end
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


END = 0xFF  # closes a segment; never a byte of UTF-8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of bytes by Larsson-Sadakane refinement: only groups that are still unsorted are sorted again, by the rank
    ``h`` bytes on, and h doubles until every suffix is alone (Kasai's method needs the exact order)."""
    n = len(text)
    bits = np.uint64(max(n, 1).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    h = int(min(6, (64 - int(bits)) // 8))
    padded = np.concatenate([text, np.zeros(h, dtype=np.uint8)])
    key = np.zeros(n, dtype=np.uint64)
    for k in range(h):
        key = key << np.uint64(8) | padded[k : n + k]
    packed = np.sort(key << bits | np.arange(n, dtype=np.uint64))
    sa, key = (packed & low).astype(np.int64), packed >> bits
    new = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.zeros(n + 1, dtype=np.int64)  # the first place of a suffix's group, plus 1; 0 beyond the end
    rank[sa] = np.flatnonzero(new)[np.cumsum(new) - 1] + 1
    while True:
        place = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(place):
            break
        members = sa[place]
        group, behind = rank[members], rank[np.minimum(members + h, n)]
        if 3 * int(bits) <= 64:
            packed = np.sort((group << int(bits) | behind).astype(np.uint64) << bits | members.astype(np.uint64))
            members, both = (packed & low).astype(np.int64), packed >> bits
        else:
            order = np.lexsort((behind, group))
            members, both = members[order], group[order] << 32 | behind[order]
        split = np.concatenate([[True], both[1:] != both[:-1]])
        sa[place] = members
        new[place] |= split
        rank[members] = place[np.flatnonzero(split)[np.cumsum(split) - 1]] + 1
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, depth: int, stride: int = 64) -> np.ndarray:
    """For each place of the suffix array the prefix shared with the place before, at most ``depth`` (Kasai).

    Kasai walks the text: a position shares at least one byte less than the position on its left (true of the exact order only). Here every
    ``stride``-th position starts a walk and all walks go on together, comparing eight bytes at a time."""
    n = len(sa)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([text, np.zeros(depth + 16, dtype=np.uint8)])
    words = np.ascontiguousarray(np.ndarray(n + depth + 8, dtype="<u8", buffer=padded.data, strides=(1,)))
    prefix = np.zeros(n, dtype=np.int64)
    for phase in range(stride):
        at = np.arange(phase, n, stride)
        got = np.maximum(prefix[at - 1] - 1, 0) if phase else np.zeros(len(at), dtype=np.int64)
        live = np.flatnonzero(before[at] >= 0)
        while len(live):
            have = got[live]
            differ = words[at[live] + have] ^ words[before[at[live]] + have]
            same = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3)
            got[live] = have + same
            live = live[(same == 8) & (have + 8 < depth)]
        prefix[at] = np.minimum(got, depth)
    return prefix[sa]


def repeated_starts(segments: list[bytes], span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array's answer for distinct segments that lie behind each other, each closed by END: (all bytes, first
    byte of each segment, which bytes start a string of ``span`` bytes that also starts elsewhere, one of each such set)."""
    text = np.frombuffer(b"\xff".join(segments) + b"\xff", dtype=np.uint8)
    sizes = np.array([len(s) + 1 for s in segments])
    sa = suffix_array(text)
    shared = common_prefixes(text, sa, span) >= span
    hit, lead = np.zeros(len(text), dtype=bool), np.zeros(len(text), dtype=bool)
    hit[sa[1:][shared[1:]]] = True
    begins = np.flatnonzero(shared[1:] & ~shared[:-1])
    hit[sa[begins]] = lead[sa[begins]] = True
    return text, np.cumsum(sizes) - sizes, hit, lead


def _survey(texts: DataFrame, span: int, gram: int) -> DataFrame:
    """One row per document: key, doc_id, n_bytes, sha256 and its runs of starts by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_bytes(batch.column(2))
            of, first, last, anchor, places = anchors(data, ends, span, gram)
            order = np.argsort(of, kind="stable")
            bounds = pa.array(np.searchsorted(of[order], np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x[order].astype(t))) for x, t in ((first, np.int32), (last, np.int32), (anchor, np.int64), (places, np.int32))]
            sha = [hashlib.sha256(data[a:b]).digest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.diff(ends)), pa.array(sha, pa.binary()), *lists], names=["key", "doc_id", "n_bytes", "sha", "first", "last", "anchor", "places"])

    return arrow_map(texts, run, "key long, doc_id long, n_bytes long, sha binary, first array<int>, last array<int>, anchor array<long>, places array<int>")


def _segments(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Columns key, text, runs -> one row per run with the bytes behind its starts."""
    for batch in batches:
        data, ends = text_bytes(batch.column(1))
        runs = batch.column(2)
        runs = runs.slice(0)
        flat = runs.flatten()
        of = np.repeat(np.arange(batch.num_rows), np.diff(runs.offsets.to_numpy()))
        first, last = flat.field("first").to_numpy(), flat.field("last").to_numpy()
        base = ends[of]
        step = 20_000
        for k in range(0, len(of), step):
            part = slice(k, k + step)
            cut = [data[a:b].tobytes() for a, b in zip(base[part] + first[part], base[part] + last[part] + span, strict=True)]
            keys = [flat.field(x).slice(k, step) for x in ("shard", "hot", "piece", "pieces", "first")]
            yield pa.record_batch([*keys, batch.column(0).take(pa.array(of[part])), pa.array(cut, pa.binary())], names=["shard", "hot", "piece", "pieces", "first", "key", "bytes"])


_FOUND = "key long, a long, b long, hot long, range int, piece int, digests binary, docs binary, starts binary"


def _shard(span: int, seeds: tuple[int, int]):
    """Repeats within a shard as byte ranges (key, a, b); for a piece of a hot anchor also its sorted distinct strings."""

    def run(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        docs, first = table["key"].to_numpy(), table["first"].to_numpy().astype(np.int64)
        hot, piece, pieces = (table[x].to_numpy() for x in ("hot", "piece", "pieces"))
        texts = table["bytes"]
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            places: dict[bytes, list[int]] = {}
            for i, text in enumerate(texts.slice(low, high - low).to_pylist(), int(low)):
                places.setdefault(text, []).append(i)
            segments = list(places)
            text, begins, hit, lead = repeated_starts(segments, span)
            found, rest = [], []
            for segment, begin in zip(segments, begins, strict=True):
                rows, starts = places[segment], len(segment) - span + 1
                own = hit[begin : begin + starts]
                if len(rows) > 1:
                    low_at, high_at = 0, starts - 1
                elif own.any():
                    at = np.flatnonzero(own)
                    low_at, high_at = int(at[0]), int(at[-1])
                else:
                    low_at = -1
                if low_at >= 0:  # starts of a segment lie closer than span, so they cover one range
                    found += [(docs[i], first[i] + low_at, first[i] + high_at + span) for i in rows]
                if pieces[low] > 1:
                    at = np.arange(starts)
                    if len(rows) > 1:
                        rest.append((begin + at, np.full(starts, REPEATED), first[rows[0]] + at))
                    else:
                        keep = ~own | lead[begin : begin + starts]
                        rest.append((begin + at[keep], np.where(own, REPEATED, docs[rows[0]])[keep], (first[rows[0]] + at)[keep]))
            if found:
                d, a, b = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True))
                yield _found(d, a, b)
            if rest:
                yield _export(text, *(np.concatenate(x) for x in zip(*rest, strict=True)), span, seeds, int(hot[low]), int(piece[low]), int(pieces[low]))

    return run


def _found(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = [pa.nulls(len(d), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())]
    return pa.record_batch([pa.array(d), pa.array(a), pa.array(b), *none], names=[x.split()[0] for x in _FOUND.split(", ")])


def _export(text: np.ndarray, at: np.ndarray, docs: np.ndarray, starts: np.ndarray, span: int, seeds: tuple[int, int], hot: int, piece: int, pieces: int) -> pa.RecordBatch:
    """The distinct strings of a piece in digest order, cut in ranges by binary search; docs is REPEATED where a string repeats in the piece."""
    digest = np.stack([window_hashes(text, span, seed)[at] for seed in seeds], axis=1).byteswap()
    digest = np.ascontiguousarray(digest).view("S16").ravel()
    # equal strings of one piece that were found as copies of a segment and as starts of another one count once
    order = np.lexsort((docs, digest))
    digest, docs, starts = digest[order], docs[order], starts[order]
    once = np.concatenate([[True], digest[1:] != digest[:-1]])
    digest, docs, starts = digest[once], docs[once], starts[once]
    lead = np.ascontiguousarray(digest).view(">u8")[::2].astype(np.uint64)
    cuts = np.searchsorted(lead, np.array([(k << 64) // pieces for k in range(1, pieces)], dtype=np.uint64))
    edges = [0, *cuts.tolist(), len(digest)]
    rows = [(hot, k, piece, digest[a:b].tobytes(), docs[a:b].astype(np.int64).tobytes(), starts[a:b].astype(np.int64).tobytes()) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)]
    return pa.record_batch([*[pa.nulls(len(rows), pa.int64())] * 3, *cols], names=[x.split()[0] for x in _FOUND.split(", ")])


def _merge(span: int):
    """Strings of a hot anchor that lie in several pieces, by binary search of each sorted list in all of a range."""

    def run(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            digests, docs, starts = ([np.frombuffer(x, t) for x in table[name].slice(low, high - low).to_pylist()] for name, t in (("digests", "S16"), ("docs", np.int64), ("starts", np.int64)))
            merged = np.sort(np.concatenate(digests))
            for own, doc, start in zip(digests, docs, starts, strict=True):
                twice = np.searchsorted(merged, own, side="right") - np.searchsorted(merged, own, side="left") > 1
                if (twice := twice & (doc != REPEATED)).any():
                    d, s = doc[twice], start[twice]
                    order = np.lexsort((s, d))
                    d, s = d[order], s[order]
                    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] > s[:-1] + span)]))
                    last = np.append(new[1:], len(d)) - 1
                    yield pa.record_batch([pa.array(d[new]), pa.array(s[new]), pa.array(s[last] + span)], names=["key", "a", "b"])

    return run


def _cut(text: bytes, ranges: list[dict], words: int = 0) -> tuple[bytes, int]:
    """(what stays of a text, maximal runs that go); runs of fewer than ``words`` words (or parts of them) stay."""
    spans: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in ranges):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    if words:
        spans = [x for x in spans if len(text[x[0] : x[1]].split()) >= words]
    return b"".join(text[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(text)], strict=True)), len(spans)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns key, text, ranges -> what is gone of each text."""
    names, types = ["cut_key", "n_removed", "n_spans", "kept_sha"], (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    for batch in batches:
        data, ends = text_bytes(batch.column(1))
        rows = []
        for i, (key, ranges) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            stays, n = _cut(data[ends[i] : ends[i + 1]].tobytes(), ranges)
            rows.append((key, int(ends[i + 1] - ends[i]) - len(stays), n, hashlib.sha256(stays).digest()))
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def _piece(pieces: Column) -> Column:
    """The piece of a hot anchor's run: by document and block of 1024 bytes, as a periodic text has a run every few hundred bytes."""
    return F.pmod(F.xxhash64("key", F.expr("first div 1024")), pieces).cast("int")


def find_repeats(docs: DataFrame, key: str, span: int = SPAN, gram: int | None = None, shard_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(survey, ranges) of ``docs``, whose column ``key`` is unique. survey: key, doc_id, n_bytes, sha, whole (all bytes go: the text has
    an exact copy). ranges: cut_key, ranges (array of a, b) of each other document that loses some bytes. ``gram``: 64 bytes for a span of 400."""
    spark, made = docs.sparkSession, []
    gram = gram or max(1, span * GRAM // SPAN)
    texts = docs.select(F.col(key).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = stage(_survey(texts, span, gram), "suffix-survey", made)
    copies = seen.where(f"n_bytes >= {span}").groupBy("sha").agg(F.min("key").alias("rep"), F.count("*").alias("copies")).select("rep", "copies")
    known = stage(seen.join(copies, F.col("key") == F.col("rep"), "left").select("*", (F.col("rep").isNull() & (F.col("n_bytes") >= span) | (F.col("copies") > 1)).alias("same")), "suffix-known", made)
    survey = stage(known.select("key", "doc_id", "n_bytes", "sha", F.coalesce("same", F.lit(False)).alias("whole")), "suffix-docs")
    runs = known.where("rep is not null").select("key", F.explode(F.arrays_zip("first", "last", "anchor", "places")).alias("r")).select("key", "r.*")
    repeated = stage(runs.groupBy("anchor").agg(F.sum("places").alias("n"), F.sum(F.expr(f"last - first + {span}")).alias("size")).where("n > 1"), "suffix-repeated", made)
    total = repeated.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    pieces = F.ceil(F.col("size") / shard_bytes).cast("int")
    dealt = runs.join(repeated, "anchor").select(
        "key", "first", "last", F.when(pieces > 1, F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards))).alias("shard"),
        F.when(pieces > 1, F.col("anchor")).otherwise(F.lit(0)).alias("hot"), F.when(pieces > 1, _piece(pieces)).otherwise(F.lit(0)).alias("piece"), pieces.alias("pieces"))
    by_doc = stage(dealt.groupBy("key").agg(F.collect_list(F.struct("first", "last", "shard", "hot", "piece", "pieces")).alias("runs")), "suffix-runs")
    for path in made:  # only ``survey`` and ``by_doc`` are read from here on
        drop_path(spark, path)
    chosen = texts.join(by_doc, "key").select("key", "text", "runs")
    segments = arrow_map(chosen, lambda batches: _segments(batches, span), "shard long, hot long, piece int, pieces int, first int, key long, bytes binary")
    number = F.when(F.col("shard") >= 0, F.col("shard")).otherwise(group_number(F.col("piece"), "hot"))
    found = stage(by_groups(segments, ["shard", "hot", "piece"], _shard(span, (secrets.randbits(63), secrets.randbits(63))), _FOUND, number), "suffix-found")
    exchanged = found.where("digests is not null").select("hot", "range", "piece", "digests", "docs", "starts")
    merged = by_groups(exchanged, ["hot", "range"], _merge(span), "key long, a long, b long", group_number(F.col("range"), "hot"))
    ranges = found.where("key is not null").select("key", "a", "b").unionByName(merged).join(survey.where("whole").select("key"), "key", "left_anti")
    return survey, stage(ranges.groupBy(F.col("key").alias("cut_key")).agg(F.collect_list(F.struct("a", "b")).alias("ranges")), "suffix-ranges")


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """The result of the query: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows, key = keyed(docs.select("doc_id", "text"))
    survey, ranges = find_repeats(rows, key, **options)
    cuts = arrow_map(rows.join(ranges, F.col(key) == F.col("cut_key")).select("cut_key", "text", "ranges"), _sizes, "cut_key long, n_removed long, n_spans long, kept_sha binary")
    empty = F.unhex(F.sha2(F.lit(b""), 256))
    pick = lambda whole, cut, none: F.when(F.col("whole"), whole).otherwise(F.coalesce(F.col(cut), none))
    return survey.join(cuts, F.col("key") == F.col("cut_key"), "left").select(
        "doc_id", "n_bytes", pick(F.col("n_bytes"), "n_removed", F.lit(0)).alias("n_removed"), pick(F.lit(1), "n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.lower(F.hex(pick(empty, "kept_sha", F.col("sha")))).alias("kept_sha256"))


def without_repeats(docs: DataFrame, words: int = 0, **options) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text`` (a character cut in half goes as a whole); all rows and columns stay, and ``n_chars``,
    where there, follows the text. A null text stays null. Maximal repeated runs of fewer than ``words`` words stay; exact copies of ``span`` bytes
    or more go whole."""
    rows, key = keyed(docs)
    survey, ranges = find_repeats(rows, key, **options)
    mark, cut_key, gone = (fresh_name(rows, x) for x in ("cut_whole", "cut_key", "cut_ranges"))
    known = survey.where("whole").select(F.col("key").alias(cut_key), F.lit(True).alias(mark), F.lit(None).cast("array<struct<a: bigint, b: bigint>>").alias(gone))
    known = known.unionByName(ranges.select(F.col("cut_key").alias(cut_key), F.lit(False).alias(mark), F.col("ranges").alias(gone)))
    joined = rows.join(known, rows[key] == known[cut_key], "left").select(*docs.columns, mark, gone)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, (whole, ranges) in enumerate(zip(batch.column(-2).to_pylist(), batch.column(-1).to_pylist(), strict=True)):
                if whole:
                    texts[i] = ""
                elif ranges:
                    texts[i] = _cut(texts[i].encode("utf-8"), ranges, words)[0].decode("utf-8", "ignore")
            columns = [*batch.columns[:at], pa.array(texts, batch.column(at).type), *batch.columns[at + 1 : -2]]
            yield pa.record_batch(columns, names=batch.schema.names[:-2])

    out = arrow_map(joined, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
