"""Removal of word sequences that occurred before, with prefix-partitioned suffix trees.

Every word that is covered by a window of ``span`` words whose sequence also starts earlier (in a document before, or before in the same one)
is removed; the first occurrence stays.

1. Anchors. Among the ``gram``-word windows inside a window of ``span`` words the one with the smallest hash is its anchor, so equal windows have
   equal anchors. Suffixes whose anchor occurs once in the corpus start no repeat and stay at home. Of documents with equal words only the first
   is searched: all of its copies' windows start earlier. Neighbouring suffixes with one anchor travel as one segment, cut where no window
   of ``span`` words begins any more.
2. Prefixes. Segments are split by the first word at their anchor; a prefix with more than ``group_size`` segments is lengthened to 2, 4, 8 words,
   so each group fits in memory.
3. Trees. Each group's suffixes are sorted to ``span`` words (what is deeper changes nothing); the words that neighbours share give the tree's
   internal nodes. A topmost node that is ``span`` words deep is a repeat, and all its leaves but the earliest are starts to remove. Maximal
   repeats are runs of such starts.
4. Frequent anchors. Of equal segments the first stays (found by partial aggregation; all windows of the others start earlier). What is left is cut
   in single suffixes, which are split by prefixes of their own, up to ``span`` words, and meet in trees likewise. Only a whole window that is
   frequent can't be split by prefix: its earliest start is found by partial aggregation, and its suffixes are joined with that.

Order: documents by doc_id, those without one last; rows of equal (or no) id by a key of their own (``common.keyed``).
Defined cases: a null text has no words; documents of fewer than ``span`` words lose nothing; repeated rows are documents of their own, of which the
first stays; texts of any length are read whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import arrow_map, by_groups, drop_path, keyed, stage
from strandlake.llm.suffix_dedup import _tables, anchors, window_hashes

SPAN, GRAM = 20, 8
BLOCK = 4 << 20  # bytes that are hashed together


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs without space, tab, line feed, vertical tab, form feed or carriage return."""
    return (text or "").encode().split()


def word_hashes(joined: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text whose words are joined by one space."""
    if not joined:
        return np.zeros(0, dtype=np.uint64)
    data = np.frombuffer(joined, dtype=np.uint8)
    starts = np.append(0, np.flatnonzero(data == 0x20) + 1)
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    powers = np.cumprod(np.concatenate([[1], np.full(int(place.max()), 0x9E3779B97F4A7C15)]).astype(np.uint64))
    letters = _tables(17)[0].copy()
    letters[0x20] = 0
    h = np.add.reduceat(letters[data] * powers[place], starts)
    return (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def _parts(column: pa.Array) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """(first row, normalised texts, bounds of their words) of texts of about BLOCK bytes together."""
    held, sizes, size, begin = [], [0], 0, 0
    for i, text in enumerate(column):
        words = words_of(text.as_py())
        held.append(b" ".join(words))
        sizes.append(len(words))
        size += len(held[-1])
        if size >= BLOCK:
            yield begin, held, np.cumsum(sizes)
            held, sizes, size, begin = [], [0], 0, i + 1
    if held:
        yield begin, held, np.cumsum(sizes)


def _hashes(texts: list[bytes]) -> np.ndarray:
    return word_hashes(b" ".join(t for t in texts if t))


def _survey(span: int, gram: int):
    """One row per document: key, doc_id, n_words, sha of its words and its runs of starts by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts, ends in _parts(batch.column(2)):
                of, first, last, anchor, places = anchors(_hashes(texts), ends, span, gram)
                bounds = pa.array(np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(t))) for x, t in ((first, np.int32), (last, np.int32), (anchor, np.int64), (places, np.int32))]
                sha = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
                yield pa.record_batch([batch.column(0).slice(begin, len(texts)), batch.column(1).slice(begin, len(texts)), pa.array(np.diff(ends)), sha, *lists], names=["key", "doc_id", "n_words", "sha", "first", "last", "anchor", "places"])

    return run


def _segments(span: int, gram: int):
    """Columns key, doc_id, text, runs -> a row per run: key, doc_id, first, hot, the hash of the prefix of each depth at its anchor, its words."""
    depths = _depths(gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            for begin, texts, ends in _parts(batch.column(2)):
                h = _hashes(texts)
                prefix = [window_hashes(h, d).view(np.int64) for d in depths]
                for i, text in enumerate(texts):
                    runs = lists[begin + i].values
                    first, last, anchor = (runs.field(x).to_numpy() for x in ("first", "last", "anchor"))
                    gaps = np.concatenate([[-1], np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 0x20), [len(text)]])
                    at = _anchor_places(prefix[-1][ends[i] : ends[i + 1]], anchor, last) + ends[i]
                    for k in range(0, len(first), 20_000):
                        part = slice(k, k + 20_000)
                        words = [text[x:y] for x, y in zip((gaps[first[part]] + 1).tolist(), gaps[last[part] + span].tolist(), strict=True)]
                        same = [batch.column(c).take(pa.array(np.full(len(words), begin + i))) for c in (0, 1)]
                        yield pa.record_batch([*same, pa.array(first[part], pa.int64()), runs.field("hot").slice(k, 20_000), *[pa.array(p[at[part]]) for p in prefix], pa.array(words, pa.binary())], names=["key", "doc_id", "start", "hot", *[f"p{d}" for d in depths], "words"])

    return run


def _anchor_places(h: np.ndarray, anchor: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Where the anchor of each run lies: its first place at or behind the last start, as it lies in every window of the run."""
    by_hash = np.argsort(h, kind="stable")
    first = np.searchsorted(h[by_hash], h[by_hash])
    place = np.searchsorted(first * len(h) + by_hash, np.searchsorted(h[by_hash], anchor) * len(h) + last)
    return by_hash[place]


def _suffixes(span: int):
    """Segments -> their single suffixes, each with the hash of its prefix of each depth."""
    depths = _depths(span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, start, words, prefix = [], [], [], [[] for _ in depths]
            for i, (first, segment) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                own, h = segment.split(), word_hashes(segment)
                n = len(own) - span + 1
                of += [i] * n
                start += range(first, first + n)
                words += [b" ".join(own[k : k + span]) for k in range(n)]
                for d, values in zip(depths, prefix, strict=True):
                    values.append(window_hashes(h, d).view(np.int64)[:n])
            if of:
                yield pa.record_batch([*[batch.column(c).take(pa.array(of)) for c in (0, 1)], pa.array(start, pa.int64()), *[pa.array(np.concatenate(p)) for p in prefix], pa.array(words, pa.binary())], names=["key", "doc_id", "start", *[f"p{d}" for d in depths], "words"])

    return run


def _depths(most: int) -> tuple[int, ...]:
    return (*(1 << k for k in range(most.bit_length()) if 1 << k < most), most)


def sorted_suffixes(segments: pa.Array, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start in it, words shared with the one before) of all suffixes of at least ``depth`` words, sorted by group and words to that depth;
    suffixes of different groups share none."""
    words = [s.split() for s in segments.to_pylist()]
    size = np.array([len(w) for w in words], dtype=np.int64)
    code = pa.array([w for s in words for w in s], pa.binary()).dictionary_encode().indices.to_numpy().astype(">u4")
    starts = np.maximum(size - depth + 1, 0)
    of = np.repeat(np.arange(len(size)), starts)
    at = np.arange(len(of)) - np.repeat(np.cumsum(starts) - starts, starts)
    rows = np.empty((len(of), depth + 1), dtype=">u4")
    rows[:, 0] = group[of]
    rows[:, 1:] = np.lib.stride_tricks.sliding_window_view(code, depth)[(np.cumsum(size) - size)[of] + at] if len(of) else 0
    order = np.argsort(rows.view(f"V{4 * depth + 4}").ravel(), kind="stable")
    rows = rows[order]
    shared = np.zeros(len(of), dtype=np.int64)
    same = np.logical_and.accumulate(rows[1:] == rows[:-1], axis=1)
    shared[1:] = np.maximum(same.sum(axis=1) - 1, 0)
    return of[order], at[order], shared


def deep_nodes(shared: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(first leaf, last leaf) of each topmost internal node of at least ``depth`` words; ``shared[i]`` lies between the leaves i - 1 and i."""
    deep = np.append(shared >= depth, False)
    return np.flatnonzero(deep[1:] & ~deep[:-1]), np.flatnonzero(deep[:-1] & ~deep[1:])


def _subtrees(depth: int):
    """Groups of segments -> ranges of starts that are no earliest leaf of a deep node."""

    def run(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        of, at, shared = sorted_suffixes(table["words"].combine_chunks(), group, depth)
        first, last = deep_nodes(shared, depth)
        if not len(first):
            return
        size = last - first + 1
        node = np.repeat(np.arange(len(first)), size)
        leaf = np.repeat(first - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(len(node))
        ids = table["doc_id"].combine_chunks()
        none, number = np.asarray(ids.is_null())[of[leaf]], ids.fill_null(0).to_numpy()[of[leaf]]
        key, start = table["key"].to_numpy()[of[leaf]], table["start"].to_numpy()[of[leaf]] + at[leaf]
        order = np.lexsort((start, key, number, none, node))
        late = order[np.append(False, node[order][1:] == node[order][:-1])]
        key, start = key[late], start[late]
        order = np.lexsort((start, key))
        key, start = key[order], start[order]
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (start[1:] > start[:-1] + 1)]))
        if len(key):
            yield pa.record_batch([pa.array(key[new]), pa.array(start[new]), pa.array(start[np.append(new[1:], len(key)) - 1])], names=["key", "a", "b"])

    return run


_COLUMNS = ["key", "doc_id", "start", "words"]


def _grouped(rows: DataFrame, depths: tuple[int, ...], most: int, made: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with the ``group`` of the shortest prefix that ``most`` of them or fewer have, rows whose longest prefix more have). The tables of
    longer prefixes hold at most a ``most``-th of the rows."""
    depth, columns = F.lit(None).cast("int"), [f"p{d}" for d in depths]
    marked = rows
    for d in depths:
        frequent = rows.groupBy(f"p{d}").count().where(F.col("count") > most).select(F.col(f"p{d}").alias(f"frequent{d}"))
        marked = marked.join(stage(frequent, "tree-prefixes", made), F.col(f"p{d}") == F.col(f"frequent{d}"), "left")
        depth = F.coalesce(depth, F.when(F.col(f"frequent{d}").isNull(), F.lit(d)))
    group = F.xxhash64("depth", F.element_at(F.array(*columns), F.array_position(F.array(*map(F.lit, depths)), F.col("depth")).cast("int"))).alias("group")
    marked = marked.withColumn("depth", depth)
    return marked.where("depth is not null").select(group, *_COLUMNS), marked.where("depth is null").select(F.xxhash64(columns[-1]).alias("group"), *_COLUMNS)


def _trees(groups: DataFrame, span: int) -> DataFrame:
    return by_groups(groups, ["group"], _subtrees(span), "key long, a long, b long", F.pmod("group", F.lit(1 << 40)))


def _leads(rows: DataFrame, made: list[str]) -> DataFrame:
    """Rows with the mark whether they are the first of those with equal words."""
    first = stage(rows.groupBy("words").agg(F.min(F.struct(*_order(), "start")).alias("lead")).select(F.col("words").alias("lead_words"), F.col("lead.key").alias("lead_key"), F.col("lead.start").alias("lead_start")), "tree-leads", made)
    return stage(rows.join(first, F.col("words") == F.col("lead_words")).select(*_COLUMNS, ((F.col("key") == F.col("lead_key")) & (F.col("start") == F.col("lead_start"))).alias("lead")), "tree-marked", made)


def _late_words(rows: DataFrame, span: int) -> DataFrame:
    return rows.select("key", F.col("start").alias("a"), (F.col("start") + F.size(F.split(F.col("words").cast("string"), " ")) - span).alias("b"))


def _frequent(segments: DataFrame, span: int, group_size: int, made: list[str]) -> DataFrame:
    """Late starts of segments with frequent anchors."""
    marked = _leads(segments, made)
    depths = _depths(span)
    schema = f"key long, doc_id long, start long, {', '.join(f'p{d} long' for d in depths)}, words binary"
    suffixes = stage(arrow_map(marked.where("lead").select(*_COLUMNS), _suffixes(span), schema), "tree-suffixes", made)
    groups, hot = _grouped(suffixes, depths, group_size, made)
    late = _late_words(marked.where("not lead"), span).unionByName(_trees(groups, span))
    return late.unionByName(_late_words(_leads(hot, made).where("not lead"), span))


def _order(key: str = "key") -> list:
    return [F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col(key).alias("key")]


def earlier_starts(docs: DataFrame, key: str, span: int = SPAN, gram: int = GRAM, group_size: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(survey, starts) of ``docs``, whose column ``key`` is unique. survey: key, doc_id, n_words, sha, whole (a document before has the same words).
    starts: late_key, ranges (a to b: starts of windows that also start earlier) of each other document that has some."""
    spark, made = docs.sparkSession, []
    gram = min(gram, span)
    texts = docs.select(F.col(key).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = stage(arrow_map(texts, _survey(span, gram), "key long, doc_id long, n_words long, sha binary, first array<int>, last array<int>, anchor array<long>, places array<int>"), "tree-survey", made)
    leads = stage(seen.where(F.col("n_words") >= span).groupBy("sha").agg(F.min(F.struct(*_order())).alias("lead")).select(F.col("lead.key").alias("lead")), "tree-leads", made)
    known = stage(seen.join(leads, F.col("key") == F.col("lead"), "left"), "tree-known", made)
    survey = stage(known.select("key", "doc_id", "n_words", "sha", (F.col("lead").isNull() & (F.col("n_words") >= span)).alias("whole")), "tree-docs")
    runs = known.where("lead is not null").select("key", F.explode(F.arrays_zip("first", "last", "anchor", "places")).alias("r")).select("key", "r.*")
    repeated = stage(runs.groupBy("anchor").agg(F.sum("places").alias("n")).where("n > 1").select("anchor", (F.col("n") > group_size).alias("hot")), "tree-anchors", made)
    by_doc = runs.join(repeated, "anchor").groupBy("key").agg(F.collect_list(F.struct("first", "last", "anchor", "hot")).alias("runs"))
    chosen = texts.join(stage(by_doc, "tree-runs", made), "key").select("key", "doc_id", "text", "runs")
    depths = _depths(gram)
    schema = f"key long, doc_id long, start long, hot boolean, {', '.join(f'p{d} long' for d in depths)}, words binary"
    segments = stage(arrow_map(chosen, _segments(span, gram), schema), "tree-segments", made)
    groups, rest = _grouped(segments.where("not hot"), depths, group_size, made)
    late = _trees(groups.unionByName(rest), span)  # anchors that aren't hot: none has more than group_size segments
    if repeated.where("hot").limit(1).count():
        late = late.unionByName(_frequent(segments.where("hot"), span, group_size, made))
    starts = stage(late.groupBy(F.col("key").alias("late_key")).agg(F.collect_list(F.struct("a", "b")).alias("ranges")), "tree-starts")
    for path in made:
        drop_path(spark, path)
    return survey, starts


def _kept(span: int):
    """Columns key, text, ranges -> what stays of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, ranges in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words = words_of(text.as_py())
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, ranges.values.field("a").to_numpy(), 1)
                np.add.at(edge, ranges.values.field("b").to_numpy() + span, -1)
                gone = np.cumsum(edge)[:-1] > 0
                stays = b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x])
                rows.append((key, int(gone.sum()), hashlib.sha256(stays).digest()))
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["cut_key", "n_removed", "kept_sha"])

    return run


def remove_earlier(docs: DataFrame, span: int = SPAN, **options) -> DataFrame:
    """The result of the query: doc_id, n_words, n_removed, kept_sha256."""
    rows, key = keyed(docs.select("doc_id", "text"))
    survey, starts = earlier_starts(rows, key, span, **options)
    cuts = arrow_map(rows.join(starts, F.col(key) == F.col("late_key")).select(key, "text", "ranges"), _kept(span), "cut_key long, n_removed long, kept_sha binary")
    empty = F.unhex(F.sha2(F.lit(b""), 256))
    pick = lambda whole, cut, none: F.when(F.col("whole"), whole).otherwise(F.coalesce(F.col(cut), none))
    return survey.join(cuts, F.col("key") == F.col("cut_key"), "left").select(
        "doc_id", "n_words", pick(F.col("n_words"), "n_removed", F.lit(0)).alias("n_removed"), F.lower(F.hex(pick(empty, "kept_sha", F.col("sha")))).alias("kept_sha256"))


ORACLE = """
WITH words AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS s FROM words),
windows AS (SELECT doc_id, s, row_number() OVER (PARTITION BY w[s + 1 : s + 20] ORDER BY doc_id, s) AS r FROM starts),
late AS (SELECT doc_id, list(s) AS late FROM windows WHERE r > 1 GROUP BY doc_id),
gone AS (SELECT doc_id, list_distinct(flatten(list_transform(late, lambda s: range(s + 1, s + 21)))) AS gone FROM late),
spread AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
lost AS (SELECT doc_id, unnest(gone) AS i FROM gone),
kept AS (SELECT s.doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM spread AS s ANTI JOIN lost AS l ON s.doc_id = l.doc_id AND s.i = l.i GROUP BY s.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM words AS w LEFT JOIN kept AS k ON w.doc_id = k.doc_id
"""
