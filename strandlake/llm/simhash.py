"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through BK-trees.

Fingerprints within ``radius`` bits agree in all but ``radius`` of any number of bit blocks, so each shard is one (choice of that many
blocks, value): its distinct fingerprints build one BK-tree and query it, following only the edges whose
integer distance to the parent lies within the radius. The more fingerprints there are, the more blocks are cut, so that shards stay small. The trees grow with the corpus, so they aren't sent by a Spark
broadcast; a shard above ``shard_size`` fingerprints is cut, and each piece's tree is built beside the queries of each
other piece of that shard (all pairs of pieces, so no link is lost).

Defined cases: null or blank text has no words and gets fingerprint zero, linked like any other; fewer words than a
shingle hash as one sequence; texts of any length are hashed whole; equal fingerprints are one class before any search, so repeated
rows cost nothing more; classes are known by their fingerprint, so null and repeated doc_ids are rows like others (a
component without any doc_id has a null component_id); an empty table gives no rows; other columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import arrow_map, by_groups, group_number, stage, text_bytes
from strandlake.llm.components import connected_components

SEED = 42


def fingerprint(text: bytes, width: int = 4) -> int:
    """The SimHash of one text (UTF-8 bytes): words split at ASCII white space, A-Z lower-cased, XXH64 of each shingle."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, SEED)
    gaps = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - width] + 1).tolist()]
    ends = [*gaps[width - 1 :].tolist(), len(line)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)], dtype=np.uint64)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4, key: str | None = None) -> DataFrame:
    """(doc_id, row_key, fp long) of each row's whole text; fp holds the 64 bits as a signed long, row_key the column ``key`` or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_bytes(batch.column(2))
            fps = np.fromiter((fingerprint(data[a:b].tobytes(), width) for a, b in zip(ends[:-1], ends[1:], strict=True)), dtype=np.uint64, count=batch.num_rows)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "row_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(key) if key else F.lit(None)).cast("long").alias("row_key"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, row_key long, fp long")


class BKTree:
    """A Burkhard-Keller tree over distinct 64-bit words, kept as arrays: the children of a node lie together, each with
    the integer Hamming distance to its parent."""

    def __init__(self, points: np.ndarray):
        self.points = points
        n = len(points)
        parent, edge = np.full(n, -1), np.zeros(n, dtype=np.int64)
        at, wait = np.zeros(n, dtype=np.int64), np.arange(1, n)
        while len(wait):  # one level a round: the first point at a free edge stays there, later ones go down
            far = np.bitwise_count(points[wait] ^ points[at[wait]]).astype(np.int64)
            _, first, of = np.unique(at[wait] * 65 + far, return_index=True, return_inverse=True)
            placed = wait[first]
            parent[placed], edge[placed] = at[placed], far[first]
            at[wait] = placed[of]
            stay = np.ones(len(wait), dtype=bool)
            stay[first] = False
            wait = wait[stay]
        order = np.argsort(parent, kind="stable")[1:] if n else np.zeros(0, dtype=np.int64)
        self.child, self.edge = order, edge[order]
        self.first = np.searchsorted(parent[order], np.arange(n + 1))

    def within(self, queries: np.ndarray, radius: int, at_once: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query index, point index) of all pairs within the radius, a block of queries at a time."""
        for begin in range(0, len(queries), at_once):
            q = np.arange(begin, min(begin + at_once, len(queries)))
            node = np.zeros(len(q), dtype=np.int64)
            while len(q):
                far = np.bitwise_count(queries[q] ^ self.points[node]).astype(np.int64)
                hit = far <= radius
                if hit.any():
                    yield q[hit], node[hit]
                count = self.first[node + 1] - self.first[node]
                slot = np.repeat(self.first[node] - np.cumsum(count) + count, count) + np.arange(count.sum())
                q, far = np.repeat(q, count), np.repeat(far, count)
                follow = np.abs(self.edge[slot] - far) <= radius
                q, node = q[follow], self.child[slot[follow]]


def smallest_labels(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Component of each of n points, as the smallest index in it; pairs come in blocks."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            low = np.minimum(label[a], label[b])
            if (low == label[a]).all() and (low == label[b]).all():
                break
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while (label[label] != label).any():
                label = label[label]
    return label


def _search(radius: int):
    def run(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        fps, nodes, sides = table["fp"].to_numpy().view(np.uint64), table["node"].to_numpy(), table["side"].to_numpy()
        us, vs = [], []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a < 2:
                continue
            order = np.argsort(nodes[a:b], kind="stable")  # so the smallest index is the smallest node
            f, n, s = fps[a:b][order], nodes[a:b][order], sides[a:b][order]
            left, right = np.flatnonzero(s <= 0), np.flatnonzero(s >= 0)
            if not len(left) or not len(right):
                continue
            found = ((right[q], left[p]) for q, p in BKTree(f[left]).within(f[right], radius))
            label = smallest_labels(len(f), found)
            moved = label != np.arange(len(f))
            us.append(n[moved])
            vs.append(n[label[moved]])
        if us:
            yield pa.record_batch([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return run


def block_plan(n: int, radius: int = 4, shard_size: int = 512) -> tuple[list[int], list[tuple[int, ...]]]:
    """(borders of the bit blocks, choices of blocks of which every linked pair agrees in one) for ``n`` fingerprints.

    The fewest blocks, from ``radius + 1`` on, at which an even shard holds at most ``shard_size``."""
    blocks = radius + 1
    while n >> 64 * (blocks - radius) // blocks > shard_size and blocks < radius + 5:
        blocks += 1
    return [64 * i // blocks for i in range(blocks + 1)], list(combinations(range(blocks), blocks - radius))


def link_fingerprints(classes: DataFrame, radius: int = 4, shard_size: int = 512) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints within ``radius`` bits.

    ``classes``: one row per distinct fp. Shards above ``shard_size`` are cut in pieces that are all compared with each other.
    """
    cuts, choices = block_plan(classes.count(), radius, shard_size)

    def value(choice: tuple[int, ...]) -> Column:
        out = F.lit(0).cast("long")
        for i in choice:
            width = cuts[i + 1] - cuts[i]
            out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned("fp", cuts[i]).bitwiseAND((1 << width) - 1))
        return out

    values = F.array(*[F.struct(F.lit(i).alias("block"), value(choice).alias("value")) for i, choice in enumerate(choices)])
    keyed = classes.select("fp", F.explode(values).alias("k")).select(F.col("fp").alias("node"), "fp", "k.block", "k.value")
    sizes = stage(keyed.groupBy("block", "value").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
    cut = keyed.join(sizes, ["block", "value"]).withColumn("pieces", F.ceil(F.col("n") / shard_size).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    cut = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    # side -1: its tree; 1: queries against it; 0: both (a piece with itself)
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = cut.select("block", "value", low.alias("a"), high.alias("b"), (low * F.col("pieces") + high).cast("long").alias("pair"), "node", "fp", F.signum(F.col("own") - F.col("other")).cast("int").alias("side"))
    return by_groups(dealt, ["block", "value", "a", "b"], _search(radius), "u long, v long", group_number(F.col("pair"), "block", "value"))


def simhash_groups(docs: DataFrame, width: int = 4, radius: int = 4, shard_size: int = 512, key: str | None = None) -> DataFrame:
    """(doc_id, row_key, fp, component_id, kept) per row: component_id is the smallest doc_id reachable by links of <= radius bits.

    With ``key``, a column that tells all rows apart, kept marks one row of each component: the smallest doc_id (any before
    none), of rows that tie the smallest key. Without it row_key and kept are null."""
    own = stage(fingerprints(docs, width, key), "simhash-fps")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    classes = stage(own.groupBy("fp").agg(first.alias("first")), "simhash-classes")
    parts = stage(connected_components(link_fingerprints(classes, radius, shard_size)), "simhash-parts")
    named = classes.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("part"))
    lows = named.groupBy("part").agg(F.min("first").alias("low"))
    named = stage(named.join(lows, "part").select("fp", F.col("low.doc_id").alias("component_id"), F.col("low.row_key").alias("keep_key")), "simhash-named")
    return own.join(named, "fp").select("doc_id", "row_key", "fp", "component_id", (F.col("row_key") == F.col("keep_key")).alias("kept"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The result of the query: doc_id, fingerprint (16 hex digits), component_id."""
    return simhash_groups(docs, **options).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
