"""Token ids of whole texts through a cache of chunks.

A chunk is a run without ASCII white space. Where the tokenizer never joins characters across white space, the ids of a text are
the ids of its chunks in order; each distinct chunk is encoded once by the library and then copied by numpy. Where the
caller can also cut a chunk as the tokenizer's own pre-tokeniser does, chunks that differ in case or punctuation share their parts.
"""

from __future__ import annotations

import gc
from array import array
from collections.abc import Callable
from itertools import chain, repeat

import numpy as np


class ChunkCache:
    """``encode``: list of chunks -> list of id lists. Above ``limit`` entries its tables are thinned to what was met more than once (which bounds
    memory, not what is encoded)."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], split: Callable[[bytes], list[bytes]] | None = None, limit: int = 400_000):
        self.encode, self.split, self.limit = encode, split, limit
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.parts: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.first, self.size, self.ids, self.used = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64), np.zeros(4096, dtype=np.int32), 0
        self.met = np.zeros(1024, dtype=np.int64)

    def _thin(self) -> None:
        """Keep the chunks that were met more than once since the last time, more than twice ..., until half the limit is free."""
        n, least = len(self.index), 2
        while (kept := np.flatnonzero(self.met[:n] >= least)).size > self.limit // 2:
            least *= 2
        names, size = list(self.index), self.size[kept]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.first[kept] - ends[:-1], size) + np.arange(ends[-1])]
        self.index = {names[i]: k for k, i in enumerate(kept.tolist())}
        self.first[: len(kept)], self.size[: len(kept)], self.met[:] = ends[:-1], size, 0
        self.ids[: len(ids)], self.used = ids, len(ids)

    def _encoded(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each chunk as the bytes of 32-bit integers."""
        if not self.split:
            return [array("i", x).tobytes() for x in self.encode([c.decode("utf-8") for c in chunks])]
        if len(self.parts) > self.limit // 2:
            self.parts, self.older = {}, self.parts
        cut = [self.split(c) for c in chunks]
        new = {p for own in cut for p in own if p not in self.parts}
        known = new & self.older.keys()
        self.parts.update((p, self.older[p]) for p in known)
        new = list(new - known)
        self.parts.update((p, array("i", x).tobytes()) for p, x in zip(new, self.encode([p.decode("utf-8") for p in new]), strict=True))
        return [b"".join(map(self.parts.__getitem__, own)) for own in cut]

    def _learn(self, chunks: list[bytes]) -> None:
        gc.disable()  # the many small objects made here hold no cycles, and scanning them again and again is slow
        try:
            new = self._encoded(chunks)
        finally:
            gc.enable()
        sizes = np.fromiter(map(len, new), dtype=np.int64, count=len(new)) // 4
        n, total = len(self.index), int(sizes.sum())
        while n + len(chunks) > len(self.first):
            self.first, self.size, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size, self.met))
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.size[n : n + len(chunks)] = sizes
        self.first[n : n + len(chunks)] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + total] = np.frombuffer(b"".join(new), dtype=np.int32)
        self.used += total
        self.index.update(zip(chunks, range(n, n + len(chunks)), strict=True))

    def __call__(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their n + 1 bounds); each text is given as its chunks."""
        if len(self.index) > self.limit:
            self._thin()
        flat = list(chain.from_iterable(texts))
        at = np.fromiter(map(self.index.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
        if len(missed := np.flatnonzero(at < 0)):
            new = [flat[i] for i in missed.tolist()]
            self._learn(list(dict.fromkeys(new)))
            at[missed] = np.fromiter(map(self.index.__getitem__, new), dtype=np.int64, count=len(new))
        self.met += np.bincount(at, minlength=len(self.met))
        size = self.size[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.first[at] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[np.cumsum([0, *map(len, texts)])]
