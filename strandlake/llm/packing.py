"""Hierarchical multi-length packing of token sequences.

Documents are routed to context-size tiers (powers of two) by what is left after their full windows. Tiers are packed from the
longest: an item opens a window, its gap is filled by the largest items of shorter tiers that fit, and a last item is
cut to close it; what is left of a shard goes into shorter and shorter full windows. So no window is padded.
Sequences of a tier are dealt to step groups of equal token budget, balanced by the attention cost of their pieces.

Each partition packs its own documents in shards of bounded tokens while it tokenises them: nothing is shuffled.

Defined cases: a null text counts as empty; an empty text is the end id alone; repeated rows are packed each, and a null doc_id is returned
as it is; a very long text is tokenised whole and cut into full windows; of documents of equal length the order of the partition decides; an
empty table gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import arrow_map, text_bytes
from strandlake.llm.tokens import ChunkCache

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def route(length: int, tiers: tuple[int, ...]) -> int:
    """The shortest tier that holds ``length`` tokens; ``tiers`` descend."""
    return next((t for t in reversed(tiers) if length <= t), tiers[0])


def pack(lengths: list[int], tiers: tuple[int, ...] = (2048, 1024, 512, 256)) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length). All sequences are as long as a tier, but for the last few of the shard,
    which are powers of two below the shortest tier."""
    top = tiers[0]
    full: list[list[tuple[int, int, int]]] = []
    left: list[tuple[int, int, int]] = []  # (length, document, start), ascending
    for d, n in enumerate(lengths):
        full += [[(d, s, top)] for s in range(0, n - top + 1, top)]
        if rest := n % top:
            left.append((rest, d, n - rest))
    left.sort()
    total = sum(x[0] for x in left)
    while left:
        # the longest item opens a window of its tier; near the end of the shard, of the longest size that can still be filled
        window = min(route(left[-1][0], tiers), 1 << (total.bit_length() - 1))
        total -= window
        pieces, gap = [], window
        while gap:
            k = bisect_right(left, (gap, len(lengths), 0)) - 1
            if k >= 0:
                n, d, s = left.pop(k)
            else:
                # nothing fits: the first part of the shortest item closes the window
                n, d, s = left.pop(0)
                insort(left, (n - gap, d, s + gap))
                n = gap
            pieces.append((d, s, n))
            gap -= n
        full.append(pieces)
    return full


def step_groups(sequences: list[list[tuple[int, int, int]]], budget: int) -> list[int]:
    """A group number per sequence: groups hold one sequence length and about ``budget`` tokens, dealt to and fro by cost."""
    by_size: dict[int, list[int]] = {}
    for i, pieces in enumerate(sequences):
        by_size.setdefault(sum(p[2] for p in pieces), []).append(i)
    group, first = [0] * len(sequences), 0
    for size in sorted(by_size, reverse=True):
        members = sorted(by_size[size], key=lambda i: -sum(p[2] ** 2 for p in sequences[i]))
        n = -(-len(members) * size // budget)
        for rank, i in enumerate(members):
            turn, at = divmod(rank, n)
            group[i] = first + (at if turn % 2 == 0 else n - 1 - at)
        first += n
    return group


def word_encoder(path: str):
    """Encoder of single chunks for the word-end tokenizer file, whose pre-tokeniser never crosses white space."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda chunks: [e.ids for e in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]


#: Fixed value: the pre-tokeniser pattern of the word-end vocabulary, for ASCII and the letters of Latin-1 in lower case.
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
WORDS_ASCII = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
VISIBLE = bytes(range(0x21, 0x7F))


def word_parts(chunk: bytes) -> list[bytes]:
    """A chunk as the pre-tokeniser cuts it, if it holds nothing but visible ASCII and Latin-1 letters (on which its normaliser lower-cases
    only) and no special token; else the chunk whole."""
    if chunk.isalpha():  # of bytes: ASCII letters only
        return [chunk.lower()]
    if b"<|" in chunk:
        return [chunk]
    if not chunk.translate(None, VISIBLE):
        return WORDS_ASCII.findall(chunk.lower())
    text = chunk.decode("utf-8")
    if not PLAIN.fullmatch(text):
        return [chunk]
    text = text.lower()
    return [text.encode("utf-8")] if text.isalpha() else [p.encode("utf-8") for p in WORDS.findall(text)]


def word_cache(path: str, chunks: int) -> ChunkCache:
    return ChunkCache(word_encoder(path), word_parts, chunks)


@lru_cache(maxsize=1)
def kept_cache(path: str, chunks: int) -> ChunkCache:
    """The cache of a Python worker, for all tasks that it runs."""
    return word_cache(path, chunks)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, tiers: tuple[int, ...] = (2048, 1024, 512, 256), shard_tokens: int = 2 << 20, budget: int = 1 << 17, cache_chunks: int = 400_000, keep_cache: bool = False) -> DataFrame:
    """One row per piece (see SCHEMA). ``tokenizer_path`` must exist on every executor.

    ``cache_chunks`` bounds the chunks whose ids a task remembers (about 0.4 kB each); with ``keep_cache`` a worker remembers them from task
    to task. Memory against time, with no effect on rows."""

    def emit(shard: list[tuple[int | None, np.ndarray]], part: int, base: list[int]) -> pa.RecordBatch:
        sequences = pack([len(ids) for _, ids in shard], tiers)
        groups = step_groups(sequences, budget)
        rows = []
        for i, pieces in enumerate(sequences):
            offset, size = 0, sum(p[2] for p in pieces)
            for d, s, n in pieces:
                doc, ids = shard[d]
                rows.append((doc, s, n, zlib.crc32(ids[s : s + n]), len(ids), part << 32 | base[0] + i, offset, size, part << 32 | base[1] + groups[i]))
                offset += n
        base[0] += len(sequences)
        base[1] += max(groups, default=-1) + 1
        types = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, base = (kept_cache if keep_cache else word_cache)(tokenizer_path, cache_chunks), TaskContext.get().partitionId(), [0, 0]
        shard, held = [], 0
        for batch in batches:
            data, ends = text_bytes(batch.column(1))
            docs, begin = batch.column(0).to_pylist(), 0
            while begin < len(docs):
                end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + (2 << 20), side="right")) - 1)
                ids, bounds = cache([data[ends[i] : ends[i + 1]].tobytes().split() for i in range(begin, end)])
                for i in range(end - begin):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], end_id).astype("<u4")
                    shard.append((docs[begin + i], own))
                    held += len(own)
                begin = end
                if held >= shard_tokens:
                    yield emit(shard, part, base)
                    shard, held = [], 0
        if shard:
            yield emit(shard, part, base)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)
