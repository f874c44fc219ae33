"""Licence scans: normalised text compared with licence templates by the Dice coefficient over word bigrams.

A text region of ``r`` bigrams and a template of ``m`` have a Dice coefficient of 2 x common / (r + m), bigrams counted with
repeats. Compared are the whole text, where the size bounds t / (2 - t) <= r / m <= (2 - t) / t leave a template a chance, and
every region of a text that is as long as the template. Regions with fewer than t x m bigrams of a template, counted with
running sums, can't reach t and are pruned before any exact comparison. Templates are a fixed, small table.

Relatives share most of their words, so a region is claimed once: of all regions that reach t, those with the largest product of
common bigrams and coefficient come first, and one of which more than half is claimed already is left out.

Defined cases: words are runs of ASCII letters and digits after lower-casing A-Z; null, empty and one-word texts match nothing; of
equal claims the licence first in name order, then the first region wins; texts of any length are scanned whole; other columns are ignored,
whatever their names; repeated rows are scanned each and null ids are returned as they are; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import arrow_map, text_bytes
from strandlake.llm.licence_templates import TEMPLATES

WORD = re.compile(rb"[a-z0-9]+")


def words(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class Scanner:
    """Templates prepared for scanning; bigrams are coded by the numbers of their words (0: not in any template)."""

    def __init__(self, templates: dict[str, list[str]], threshold: float = 0.8):
        self.threshold = threshold
        cut = [(name, words(t.encode())) for name in sorted(templates) for t in templates[name]]
        self.number = {w: i for i, w in enumerate(sorted({w for _, ws in cut for w in ws}), 1)}
        self.base = len(self.number) + 1
        self.templates = [(name, self._bigrams(ws)) for name, ws in cut if len(ws) > 1]
        self.counts = [Counter(b.tolist()) for _, b in self.templates]
        self.known = np.unique(np.concatenate([b for _, b in self.templates]))
        self.holds = np.array([np.isin(self.known, b) for _, b in self.templates])

    def _bigrams(self, ws: list[bytes]) -> np.ndarray:
        ids = np.fromiter((self.number.get(w, 0) for w in ws), dtype=np.int64, count=len(ws))
        return np.where((ids[:-1] > 0) & (ids[1:] > 0), ids[:-1] * self.base + ids[1:], 0)

    def candidates(self, grams: np.ndarray) -> Iterator[tuple[int, float, str, int, int]]:
        """(common bigrams, Dice coefficient, licence, first bigram, one after the last) of regions that reach the threshold: the
        whole text, and of each template the best regions of its length that overlap by half at most."""
        n, t = len(grams), self.threshold
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        hits = np.flatnonzero((self.known[at] == grams) & (grams > 0))
        for k, (name, template) in enumerate(self.templates):
            m = len(template)
            if len(hits) < t / (2 - t) * m:
                continue
            own = hits[self.holds[k][at[hits]]]
            if len(own) < t / (2 - t) * m:  # even the shortest region within the bounds needs that many
                continue
            if t / (2 - t) * m <= n <= (2 - t) / t * m:
                common = sum((Counter(grams.tolist()) & self.counts[k]).values())
                if 2 * common >= t * (n + m):
                    yield common, 2 * common / (n + m), name, 0, n
            if n >= m:
                sums = np.zeros(n + 1, dtype=np.int64)
                sums[own + 1] = 1
                sums = np.cumsum(sums)
                start = np.flatnonzero(sums[m:] - sums[:-m] >= t * m).tolist()
                common = list(self._common(grams, start, m, self.counts[k]))
                taken: list[int] = []
                for c, s in sorted(((c, s) for c, s in zip(common, start, strict=True) if c >= t * m), key=lambda x: (-x[0], x[1])):
                    i = bisect_left(taken, s)
                    if all(abs(s - o) * 2 >= m for o in taken[max(i - 1, 0) : i + 1]):
                        taken.insert(i, s)
                        yield c, c / m, name, s, s + m

    def scan(self, text: bytes) -> dict[str, float]:
        """The Dice coefficient of each licence that claims a region of the text, the best of its regions."""
        best: dict[str, float] = {}
        grams = self._bigrams(words(text))
        claimed = np.zeros(len(grams), dtype=bool)
        for common, dice, name, a, b in sorted(self.candidates(grams), key=lambda x: (-x[0] * x[1], x[2], x[3])):
            if claimed[a:b].sum() * 2 <= b - a:
                claimed[a:b] = True
                best[name] = max(dice, best.get(name, 0.0))
        return best

    @staticmethod
    def _common(grams: np.ndarray, starts: list[int], m: int, template: Counter) -> Iterator[int]:
        """Bigrams, with repeats, that the template shares with each region of m bigrams; neighbouring regions share the work."""
        last, left, common = -2, Counter(), 0
        for s in starts:
            if s != last + 1:
                have = Counter(grams[s : s + m].tolist())
                common = sum((have & template).values())
                left = have
            else:
                old, new = int(grams[s - 1]), int(grams[s + m - 1])
                common -= left[old] <= template[old]
                left[old] -= 1
                left[new] += 1
                common += left[new] <= template[new]
            last = s
            yield common


def scan_documents(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = 0.8) -> DataFrame:
    """One row per document: doc_id, licence (the best, or null), dice (or null), licences (all found, in name order)."""
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, threshold)
        for batch in batches:
            data, ends = text_bytes(batch.column(1))
            found = [scanner.scan(data[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            best = [min(f, key=lambda x: (-f[x], x)) if f else None for f in found]
            yield pa.record_batch(
                [batch.column(0), pa.array(best, pa.string()), pa.array([f[b] if f else None for f, b in zip(found, best, strict=True)], pa.float64()), pa.array([sorted(f) for f in found], pa.list_(pa.string()))],
                names=["doc_id", "licence", "dice", "licences"],
            )

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, licence string, dice double, licences array<string>")
