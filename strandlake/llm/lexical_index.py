"""Ranked lexical search in a tiered inverted index.

Building. Documents are cut in shards of bounded size; a shard's postings are lists (term, documents, impacts), where an impact is a term's
saturated frequency in a document. A posting's tier follows from weight * impact: the first tier holds what can raise a score most. Weights
of frequent terms (in one of ``rare_below`` documents or more, so their number and length are bounded by those of so many average documents) are
sent to the tasks; other terms count with the least weight they can have. Tiers only steer the work: bounds are measured.

Searching goes tier by tier. After tier k a document's score is known from below (its postings up to k) and from above (for each other term of
the item, the greatest impact that the term has in a lower tier). Each task keeps the documents with the highest upper bounds and the greatest
bound among all it left out. Where that is below the tenth best lower bound, no other document can come in: the item is proven. All other
items fall through to the next tier. At the end whole scores are taken: of proven items in the shards that hold what was kept, of others everywhere.

Items are taken in blocks of about ``block_items``, whose terms and weights go to every task.

Defined cases: a null or empty text has no terms, and such a document isn't counted; an item without terms or without a match gives no
rows; repeated rows are documents or items of their own; documents without an id come after others of equal score; texts of any length are
read whole (one makes a shard of its own); an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm.common import arrow_map, by_groups, drop_path, new_path, stage

#: In UTF-8: digits, Latin letters (lower-cased by then) and all bytes of other characters.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
CUTS = (1_200_000_000, 400_000_000)
_LISTS = "shard long, term string, top int, at binary, tf binary, ids array<long>, sizes array<int>"


def terms_of(text: pa.Scalar) -> list[bytes]:
    return TERM.findall(text.as_py().encode().lower())


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class TieredIndex:
    """``lists``: shard, term, top (greatest impact), at (places in the shard, 16 bits), tf (32 bits), tier; a row without a term (tier -1) has the ids and
    sizes of the shard's documents. ``terms``: term, df."""

    lists: DataFrame
    terms: DataFrame
    n_docs: int
    n_terms: int
    tiers: int


def impacts(tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Of ``tf`` occurrences in a document of ``size`` terms."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * (100 - 75 + 75 * size * n_docs // n_terms))


def _frequencies(held: int):
    """(term, documents, occurrences), summed over a bounded number of terms; the empty term stands for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, total, df = 0, 0, Counter()

        def rows() -> pa.RecordBatch:
            return pa.record_batch([pa.array([b"", *df], pa.binary()).cast(pa.string()), pa.array([docs, *df.values()], pa.int64()), pa.array([total, *[0] * len(df)], pa.int64())], names=["term", "df", "n"])

        for batch in batches:
            for text in batch.column(0):
                if words := terms_of(text):
                    docs, total = docs + 1, total + len(words)
                    df.update(set(words))
                if len(df) > held:
                    yield rows()
                    docs, total, df = 0, 0, Counter()
        yield rows()

    return run


class _Shard:
    """Postings of some documents on their way to lists."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.term, self.tf, self.size, self.distinct, self.ids = [], [], [], [], []

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        counts, number = Counter(words), self.number
        self.term += [number.setdefault(w, len(number)) for w in counts]
        self.tf += counts.values()
        self.size.append(len(words))
        self.distinct.append(len(counts))
        self.ids.append(doc_id)

    def rows(self, shard: int, n_docs: int, n_terms: int, weights: dict[bytes, int], least: int, cuts: tuple[int, ...], most: int = 20_000) -> Iterator[pa.RecordBatch]:
        term, tf, size = (np.array(x, dtype=np.int64) for x in (self.term, self.tf, self.size))
        at = np.repeat(np.arange(len(size)), self.distinct)
        impact = impacts(tf, size[at], n_docs, n_terms)
        names = list(self.number)
        own = np.array([weights.get(w, least) for w in names], dtype=np.int64)
        tier = np.searchsorted(-np.array(cuts, dtype=np.int64), -own[term] * impact, side="left")
        order = np.lexsort((term, tier))
        new = np.flatnonzero(np.diff(term[order], prepend=-1) | np.diff(tier[order], prepend=-1))
        ends = np.append(new, len(order))
        first = order[new]
        top = np.maximum.reduceat(impact[order], new)
        yield _rows(shard, [b""], [-1], [0], None, None, self.ids, self.size)
        for a in range(0, len(new), most):
            b = min(a + most, len(new))
            part, cut = order[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
            yield _rows(shard, [names[t] for t in term[first[a:b]].tolist()], tier[first[a:b]], top[a:b], _packed(at[part], "<u2", cut), _packed(tf[part], "<u4", cut))


def _packed(values: np.ndarray, kind: str, ends: np.ndarray) -> pa.Array:
    """The values as the bytes of one binary value for each list."""
    data = values.astype(kind)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


def _rows(shard: int, names: list[bytes], tier, top, at: pa.Array | None, tf: pa.Array | None, ids: list[int | None] | None = None, sizes: list[int] | None = None) -> pa.RecordBatch:
    n = len(names)
    head = pa.array([ids] * n, pa.list_(pa.int64())), pa.array([sizes] * n, pa.list_(pa.int32()))
    return pa.record_batch([pa.array(np.full(n, shard)), pa.array(names, pa.binary()).cast(pa.string()), pa.array(top, pa.int32()), at or pa.nulls(n, pa.binary()), tf or pa.nulls(n, pa.binary()), *head, pa.array(tier, pa.int32())], names=["shard", "term", "top", "at", "tf", "ids", "sizes", "tier"])


def _postings(shard_docs: int, shard_bytes: int, *how):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, number = _Shard(), 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if words := terms_of(text):
                    shard.add(doc_id, words)
                    held += text.as_buffer().size
                if held >= shard_bytes or len(shard.ids) >= shard_docs:
                    yield from shard.rows(number, *how)
                    shard, held, number = _Shard(), 0, number + 1
        if shard.ids:
            yield from shard.rows(number, *how)

    return run


def build(docs: DataFrame, cuts: tuple[int, ...] = CUTS, shard_docs: int = 4096, shard_bytes: int = 8 << 20, rare_below: int = 1000) -> TieredIndex:
    """Index all ``docs`` (doc_id, text). ``cuts``: falling bounds of weight * impact between the tiers; ``shard_docs``: at most 65536."""
    spark = docs.sparkSession
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    terms = stage(arrow_map(texts.select("text"), _frequencies(200_000), "term string, df long, n long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n")), "lexical-terms")
    sizes = terms.where("term = ''").first()
    n_docs, n_terms = (sizes["df"], max(sizes["n"], 1)) if sizes else (0, 1)
    terms = terms.where("term <> ''").select("term", "df")
    # Terms in one of ``rare_below`` documents or more: at most as many (and as long) as those of ``rare_below`` average documents.
    frequent = {r["term"].encode(): weight(n_docs, r["df"]) for r in terms.where(F.col("df") * rare_below >= n_docs).toLocalIterator()}
    lists = arrow_map(texts, _postings(shard_docs, shard_bytes, n_docs, n_terms, frequent, weight(n_docs, n_docs // rare_below), cuts), _LISTS + ", tier int")
    path = new_path(spark, "lexical-index")
    lists.write.partitionBy("tier").option("compression", "zstd").parquet(path)
    return TieredIndex(spark.read.schema(_LISTS + ", tier int").parquet(path), terms, n_docs, n_terms, len(cuts) + 1)


class _Scorer:
    """Scores of a task's documents for a block of items; shards come one by one, the best documents so far are kept.

    ``entries``: term -> (items, their number of it times its weight, greatest impact in the tiers not read). Exact scores are kept by score and id,
    others by their upper bounds."""

    def __init__(self, entries: dict[str, tuple[np.ndarray, np.ndarray, int]], items: int, totals: tuple[int, int], most: int, exact: bool):
        self.entries, self.totals, self.most, self.exact = entries, totals, most, exact
        self.unseen = np.zeros(items, dtype=np.int64)
        for of, value, left in entries.values():
            self.unseen[of] += value * left
        self.best: list[np.ndarray] | None = None  # score, upper, id, no id, shard
        self.rest = np.full(items, -1, dtype=np.int64)

    def __call__(self, table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        terms, shards = table["term"].to_pylist(), table["shard"].to_numpy()
        at, tf, ids, sizes = (table[x].combine_chunks() for x in ("at", "tf", "ids", "sizes"))
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own, size = ids[low].values, sizes[low].values.to_numpy().astype(np.int64)  # a shard's row without a term comes first
            score = np.zeros((len(self.unseen), len(own)), dtype=np.int64)
            upper = np.repeat(self.unseen[:, None], len(own), axis=1)
            for i in range(low + 1, high):
                of, value, left = self.entries[terms[i]]
                place = np.frombuffer(at[i].as_buffer(), "<u2")
                gain = impacts(np.frombuffer(tf[i].as_buffer(), "<u4").astype(np.int64), size[place], *self.totals)
                cells = np.ix_(of, place)
                score[cells] += value[:, None] * gain
                upper[cells] += value[:, None] * (gain - left)
            self._keep(score, upper, own, int(shards[low]))
        return iter(())

    def _keep(self, score: np.ndarray, upper: np.ndarray, own: pa.Array, shard: int) -> None:
        none = np.asarray(own.is_null())
        number = own.fill_null(0).to_numpy()
        order = np.lexsort((number, none))
        key = (score if self.exact else upper)[:, order]
        if key.shape[1] > self.most:
            if not self.exact:
                self.rest = np.maximum(self.rest, -np.partition(-key, self.most, axis=1)[:, self.most])
                top = np.argpartition(-key, self.most, axis=1)[:, : self.most]
            else:
                top = np.argsort(-key, axis=1, kind="stable")[:, : self.most]
            pick = order[top]
        else:
            pick = np.repeat(order[None, :], len(key), axis=0)
        new = [np.take_along_axis(score, pick, 1), np.take_along_axis(upper, pick, 1), number[pick], none[pick], np.full(pick.shape, shard)]
        if self.best is not None:
            new = [np.concatenate([a, b], axis=1) for a, b in zip(self.best, new, strict=True)]
        order = np.lexsort((new[2], new[3], -new[0 if self.exact else 1]), axis=1)
        if order.shape[1] > self.most and not self.exact:
            self.rest = np.maximum(self.rest, np.take_along_axis(new[1], order[:, self.most : self.most + 1], 1)[:, 0])
        self.best = [np.take_along_axis(x, order[:, : self.most], 1) for x in new]

    def finish(self) -> Iterator[pa.RecordBatch]:
        """The documents that were kept, and for each item a row without a shard whose upper bound holds for all others."""
        if self.best is None:
            return
        score, upper, number, none, shard = (x.ravel() for x in self.best)
        item = np.repeat(np.arange(len(self.unseen), dtype=np.int32), self.best[0].shape[1])
        some = score > 0 if self.exact else upper > 0
        yield _scored(item[some], pa.array(shard[some]), pa.array(number[some], mask=none[some]), score[some], upper[some])
        if not self.exact:
            n = len(self.unseen)
            yield _scored(np.arange(n, dtype=np.int32), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), np.zeros(n, dtype=np.int64), self.rest)


def _scored(item: np.ndarray, shard: pa.Array, number: pa.Array, score: np.ndarray, upper: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(item), shard, number, pa.array(score), pa.array(upper)], names=["item", "shard", "doc_id", "score", "upper"])


_SCORED = "item int, shard long, doc_id long, score long, upper long"


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts = Counter(w.decode() for w in terms_of(text))
            yield pa.record_batch([pa.array([number] * len(counts), pa.int64()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["number", "term", "q"])


@dataclass
class _Block:
    """A block of items: (item, term, times its weight) and, of each term, the greatest impact by tier."""

    numbers: list[int]
    uses: dict[str, list[tuple[int, int]]]
    tops: dict[str, list[int]]

    def entries(self, items: set[int], tier: int) -> dict[str, tuple[np.ndarray, np.ndarray, int]]:
        out = {}
        for term, uses in self.uses.items():
            if uses := [(i, v) for i, v in uses if i in items]:
                of, value = zip(*uses, strict=True)
                out[term] = np.array(of), np.array(value, dtype=np.int64), max(self.tops[term][tier + 1 :], default=0)
        return out


def _block(index: TieredIndex, items: DataFrame) -> _Block:
    spark = items.sparkSession
    found = arrow_map(items.select("number", "text"), _item_terms, "number long, term string, q long").collect()
    vocabulary = _terms(spark, sorted({r["term"] for r in found}))
    weights = {r["term"]: weight(index.n_docs, r["df"]) for r in index.terms.join(vocabulary, "term").collect()}
    tops = {t: [0] * index.tiers for t in weights}
    for r in index.lists.where("tier >= 0").join(vocabulary, "term", "left_semi").groupBy("term", "tier").agg(F.max("top").alias("top")).collect():
        tops[r["term"]][r["tier"]] = r["top"]
    numbers = sorted({r["number"] for r in found})
    place = {n: i for i, n in enumerate(numbers)}
    uses: dict[str, list[tuple[int, int]]] = {}
    for r in found:
        if r["term"] in weights:
            uses.setdefault(r["term"], []).append((place[r["number"]], r["q"] * weights[r["term"]]))
    return _Block(numbers, uses, tops)


def _terms(spark: SparkSession, terms) -> DataFrame:
    """Terms of a block of items, so bounded by these; sent to the tasks lest lists are shuffled to meet them."""
    return F.broadcast(spark.createDataFrame([(t,) for t in terms], "term string"))


def _score(index: TieredIndex, block: _Block, items: set[int], tier: int, most: int, exact: bool, kept: list[DataFrame] = ()) -> DataFrame:
    """Scores of ``items`` by the tiers up to ``tier``. ``kept``, for whole scores: (item, shard) that may hold a proven item's best documents; of other
    shards such an item's lists aren't read but for terms of ``items``, so what its documents get there is too low, and they don't come in."""
    spark = index.lists.sparkSession
    entries = block.entries(items, tier)
    every = index.lists.where((F.col("tier") >= 0) & (F.col("tier") <= tier))
    lists, heads = every.join(_terms(spark, entries), "term", "left_semi"), index.lists.where("tier = -1")
    if kept:
        pairs = kept[0]
        for more in kept[1:]:
            pairs = pairs.unionByName(more)
        uses = spark.createDataFrame([(i, t) for t, u in block.uses.items() if t not in entries for i, _ in u], "item int, term string")
        only = pairs.join(F.broadcast(uses), "item").select("shard", "term").distinct()
        lists = lists.unionByName(every.join(_terms(spark, block.uses.keys() - entries.keys()), "term", "left_semi").join(only, ["shard", "term"], "left_semi").select(lists.columns))
        heads = heads if items else heads.join(pairs.select("shard").distinct(), "shard", "left_semi")
        entries = block.entries(set(range(len(block.numbers))), tier)
    columns = ["shard", "term", "at", "tf", "ids", "sizes"]
    scorer = _Scorer(entries, len(block.numbers), (index.n_docs, index.n_terms), most, exact)
    return by_groups(heads.select(columns).unionByName(lists.select(columns)), ["shard"], scorer, _SCORED, F.xxhash64("shard"), ("term",))


def _proven(found: DataFrame, items: set[int], k: int) -> dict[int, int]:
    """Items whose best ``k`` are all among the documents that were kept -> the ``k``-th best lower bound."""
    best = Window.partitionBy("item").orderBy(F.desc("score"))
    kth = {r["item"]: r["score"] for r in found.where("shard is not null").select("item", "score", F.row_number().over(best).alias("r")).where(F.col("r") <= k).where(F.col("r") == k).collect()}
    rest = {r["item"]: r["upper"] for r in found.where("shard is null").groupBy("item").agg(F.max("upper").alias("upper")).collect()}
    floor = {i: max(kth.get(i, 0), 1) for i in items}
    return {i: floor[i] for i in items if rest.get(i, -1) < floor[i]}


def search(index: TieredIndex, items: DataFrame, k: int = 10, block_items: int = 256, kept: int = 64) -> DataFrame:
    """The ``k`` best documents of each item (item_id, text): item_id, rank, doc_id, score, tier (the last one that was needed to prove them)."""
    spark = items.sparkSession
    blocks = max(1, -(-items.count() // block_items))
    numbered = items.select("item_id", F.col("text").cast("string").alias("text")).repartition(blocks)
    numbered = stage(numbered.select(F.monotonically_increasing_id().alias("number"), F.spark_partition_id().alias("block"), "item_id", "text"), "lexical-items")
    every = spark.createDataFrame([], "number long, doc_id long, score long, tier int")
    for number in range(blocks):
        block = _block(index, numbered.where(F.col("block") == number).where("text is not null"))
        open_ = {i for uses in block.uses.values() for i, _ in uses}
        kept_pairs, made, last = [], [], dict.fromkeys(open_, index.tiers - 1)
        for tier in range(index.tiers - 1):
            if open_:
                found = stage(_score(index, block, open_, tier, kept, False), "lexical-bounds", made)
                if floor := _proven(found, open_, k):
                    floors = spark.createDataFrame(list(floor.items()), "item int, floor long")
                    kept_pairs.append(found.where("shard is not null").join(F.broadcast(floors), "item").where("upper >= floor").select("item", "shard").distinct())
                    last |= dict.fromkeys(floor, tier)
                    open_ = open_ - set(floor)
        if last:
            best = _score(index, block, open_, index.tiers - 1, k, True, kept_pairs)
            names = spark.createDataFrame([(i, block.numbers[i], t) for i, t in last.items()], "item int, number long, tier int")
            every = every.unionByName(stage(best.join(F.broadcast(names), "item").select("number", "doc_id", "score", "tier"), "lexical-best"))
        for path in made:
            drop_path(spark, path)
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).join(numbered.select("number", "item_id"), "number").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score", "tier")


ORACLE = """
WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
docs AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY 1),
stats AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
df AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, stats GROUP BY term, n_docs),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS q FROM asked GROUP BY ALL),
scores AS (
  SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN docs USING (doc_id), stats GROUP BY ALL HAVING score > 0),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores)
SELECT * FROM ranked WHERE rank <= 10
"""
