"""Groups of spelling variants by forward and reversed sorted dictionaries.

1. Dictionary. Words are counted per task (a bounded table that is emptied when full) and summed by Spark.
2. Blocks. Two words that differ by one inserted, deleted or replaced code point, the shorter of length ``l``, share a prefix of ``p`` and a
   suffix of ``s`` code points with p + s >= l - 1: one half is intact. So each word enters, as the shorter and as the longer one, a
   block of the forward dictionary (words with an equal first half) and a block of the reversed dictionary (an equal last half).
3. Skew. What is left of a block of more than ``block_words`` words is halved in the same way, again and again: the edit lies in
   one of the halves, so the words share a longer prefix or, beside the prefix, a longer suffix. A block that cannot be halved further has one
   free place, so the alphabet bounds it.
4. Scan. Blocks are ranges of their sorted dictionary. Each word of length ``l`` is compared with the words behind it in the range; a
   pair counts in the one block whose prefix range holds its common prefix, so none comes twice and none is lost.

Defined cases: a null or empty text has no words; a null doc_id is written as an empty string before the colon; repeated rows count
again; words of any length are compared whole; ties between near words of equal count go to the smallest in code-point order; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import arrow_map, by_groups, drop_path, stage, text_bytes

SHORTEST, RAREST, NOISE = 5, 3, 97
#: Runs of Latin letters. Runs below SHORTEST cannot grow, and all code points of a run are Latin-1: a word is as many bytes as letters there.
RUNS = re.compile(f"[A-Za-zÀ-ÿ]{{{SHORTEST},}}")


def _counts(doc_id: str, text: str, shortest: int, noise: int) -> Counter:
    """The words of a text with their occurrences in it; every ``noise``-th (document, run) loses a letter."""
    found: Counter = Counter()
    crc = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(w.translate(_LOWER) for w in RUNS.findall(text)).items():
        h = zlib.crc32(run.encode(), crc)
        if h % noise == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < shortest:
                continue
        found[run] += n
    return found


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def dictionary(docs: DataFrame, rarest: int = RAREST, noise: int = NOISE, held: int = 200_000) -> DataFrame:
    """(word, n) of all words of at least ``SHORTEST`` code points that occur ``rarest`` times. A task holds at most about ``held`` distinct words
    and those of one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                total.update(_counts(doc_id.as_py(), text.as_py(), SHORTEST, noise))
                if len(total) > held:
                    yield from _emit(total)
                    total.clear()
        yield from _emit(total)

    texts = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text").cast("string"))
    return arrow_map(texts, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rarest)


def _emit(total: Counter, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    words, counts = list(total), np.fromiter(total.values(), dtype=np.int64, count=len(total))
    for k in range(0, len(words), rows):
        yield pa.record_batch([pa.array(words[k : k + rows], pa.string()), pa.array(counts[k : k + rows])], names=["word", "n"])


def _block() -> Column:
    """The block of a word: equal ``a`` letters at the start and ``b`` at the end (a meeting of hashes merges blocks, which the scan tells apart)."""
    return F.xxhash64("l", "a", "b", "below", F.left("word", F.col("a")), F.right("word", F.col("b")))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row in the two blocks of which one holds a pair that shares ``a <= p < below`` first letters: p of a half more, or fewer and so more last
    letters."""
    rest = F.expr("l - 1 - a - b")
    half = F.expr("(l - a - b) div 2").cast("int")
    forward = F.struct((F.col("a") + half).alias("a"), F.col("b"), F.col("below"), F.lit(True).alias("forward"))
    reverse = F.struct(F.col("a"), (F.col("b") + rest + 1 - half).alias("b"), (F.col("a") + half).alias("below"), F.lit(False).alias("forward"))
    split = rows.select("word", "n", "l", F.explode(F.array(forward, reverse)).alias("x")).select("word", "n", "l", "x.*")
    return split.withColumn("block", _block())


def _blocks(words: DataFrame, block_words: int, made: list[str]) -> DataFrame:
    length = F.length("word")
    whole = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("l")).where("l >= 1")
    rows = stage(_halves(whole.withColumns({"a": F.lit(0), "b": F.lit(0), "below": F.col("l") + 2})), "spelling-blocks", made)
    found = None
    while True:
        large = stage(rows.where("a + b < l - 1").groupBy("block").count().where(F.col("count") > block_words).select("block"), "spelling-large", made)
        if not large.limit(1).count():
            return rows if found is None else found.unionByName(rows)
        fits = rows.join(large, "block", "left_anti").select(rows.columns)
        found = fits if found is None else found.unionByName(fits)
        # a block with one free place stays as it is, also where its hash meets that of a large one
        leaves = F.col("a") + F.col("b") >= F.col("l") - 1
        split = rows.join(large, "block", "left_semi")
        found = found.unionByName(split.where(leaves).select(rows.columns))
        rows = stage(_halves(split.where(~leaves)), "spelling-blocks", made)


def _words(data: np.ndarray, width: int = 8) -> np.ndarray:
    padded = np.concatenate([data, np.zeros(2 * width, dtype=np.uint8)])
    return np.ndarray(len(data) + width, dtype="<u8", buffer=padded.data, strides=(1,))


def _shared(words: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Equal bytes from places ``x`` and ``y`` on, at most ``most``, eight at a time."""
    got = np.zeros(len(x), dtype=np.int64)
    live = np.arange(len(x))
    while len(live):
        differ = words[x[live] + got[live]] ^ words[y[live] + got[live]]
        same = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3)
        got[live] += same
        live = live[(same == 8) & (got[live] < most[live])]
    return np.minimum(got, most)


def _scan(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Range scan of blocks: pairs of near words, in both directions."""
    data, ends = text_bytes(table["latin"])
    size = np.diff(ends)
    first, last = _words(data), _words(np.ascontiguousarray(data[::-1]))
    back = len(data) - ends[1:]
    l, a, below = (table[x].to_numpy().astype(np.int64) for x in ("l", "a", "below"))  # noqa: E741
    until = np.repeat(bounds[1:], np.diff(bounds))
    words, n = table["word"].combine_chunks(), table["n"].combine_chunks()
    live, step = np.flatnonzero(size == l), 0
    while len(live := live[live + (step := step + 1) < until[live]]):
        for part in np.array_split(live, -(-len(live) // 200_000)):
            other = part + step
            fits = (l[other] == l[part]) & (a[other] == a[part]) & (below[other] == below[part])
            i, j = part[fits], other[fits]
            p = _shared(first, ends[i], ends[j], size[i])
            ok = (p >= a[i]) & (p < below[i])
            i, j, p = i[ok], j[ok], p[ok]
            ok = p + _shared(last, back[i], back[j], size[i]) >= size[j] - 1
            i, j = pa.array(i[ok]), pa.array(j[ok])
            if len(i):
                yield pa.record_batch([words.take(i), words.take(j), n.take(j)], names=["word", "near", "near_n"])
                yield pa.record_batch([words.take(j), words.take(i), n.take(i)], names=["word", "near", "near_n"])


def near_words(words: DataFrame, block_words: int = 64, made: list[str] | None = None) -> DataFrame:
    """(word, near, near_n) of all pairs of ``words`` (word, n; distinct, letters of Latin-1) that one edit tells apart, in both directions."""
    blocks = _blocks(words, block_words, made if made is not None else [])
    # the sorted dictionary of a block: by length (the shorter words first) and spelling from the front, or from the end
    rows = blocks.select("block", "a", "below", "l", "word", "n", F.encode("word", "ISO-8859-1").alias("latin"), F.length("word").alias("size"), F.when(F.col("forward"), F.col("word")).otherwise(F.reverse("word")).alias("spelling"))
    return by_groups(rows, ["block"], _scan, "word string, near string, near_n long", F.pmod(F.col("block"), F.lit(1 << 40)), ("size", "spelling"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) are followed to the last, twice as far in each round. Counts at least double from a word to its form, so there
    are no cycles, and a table of 10**15 occurrences needs six rounds."""
    spark, made = forms.sparkSession, []
    now = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots", made)
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("beyond"))
        then = stage(now.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots", made)
        now = then.select("word", "root")
        for path in made[:-1]:
            drop_path(spark, path)
        del made[:-1]
        if not then.where("moved").limit(1).count():
            return now


def variants(docs: DataFrame, block_words: int = 64) -> DataFrame:
    """The result of the query: word, form, root, n, n_near, form_n."""
    spark, made = docs.sparkSession, []
    words = stage(dictionary(docs), "spelling-words")
    best = near_words(words, block_words, made).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    known = words.join(best, "word", "left")
    better = -F.col("best.n") >= 2 * F.col("n")
    known = stage(known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(better, F.col("best.near")).alias("form"), F.when(better, -F.col("best.n")).alias("form_n")), "spelling-forms")
    for path in made:
        drop_path(spark, path)
    roots = _roots(known.where("form is not null").select("word", "form")).withColumnRenamed("word", "rooted")
    return known.join(roots, known["word"] == roots["rooted"], "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = """
WITH RECURSIVE
crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{5,}')) AS run FROM documents),
counted AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c FROM runs GROUP BY ALL),
bytes AS (SELECT run, c, list_transform(range(octet_length(encode(id || ':' || run))), lambda i: (instr('123456789ABCDEF', substr(hex(encode(id || ':' || run)), (2 * i + 1)::INT, 1)) * 16 + instr('123456789ABCDEF', substr(hex(encode(id || ':' || run)), (2 * i + 2)::INT, 1)))::UBIGINT) AS b FROM counted),
hashed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda s, x: xor(s >> 8, t[(xor(s, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT) AS h FROM bytes, crc),
words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(c)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND n >= 3),
cuts AS (SELECT word, n, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT x.word AS word, y.word AS near, y.n AS near_n FROM cuts AS x JOIN cuts AS y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cuts AS x JOIN words AS y ON x.rest = y.word
  UNION SELECT y.word, x.word, x.n FROM cuts AS x JOIN words AS y ON x.rest = y.word),
ranked AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS r FROM pairs),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words AS w LEFT JOIN (SELECT * FROM ranked WHERE r = 1) AS b ON w.word = b.word),
chain AS (
  SELECT word, word AS root, 0 AS step FROM forms
  UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain AS c JOIN forms AS f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms AS f JOIN (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word) AS c ON f.word = c.word
"""
