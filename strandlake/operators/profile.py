"""Alignment of sequences against position-specific profiles, in numpy, all sequences of a batch at once.

A profile has columns with a score for each base, costs to enter, continue and leave a run of skipped columns (a deletion), and slots: columns that
hold inserted bases and may be passed over freely. Two uses: ``whole="sequence"`` places every base of a sequence on columns (window caller),
``whole="profile"`` finds the best stretch of a sequence for all columns (motif search), where bases may also be inserted between columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

LOW = -(1 << 28)
BASES = "ACGTN"
_CODE = np.full(256, 4, dtype=np.int64)
_CODE[[ord(b) for b in BASES]] = np.arange(5)


def base_codes(seqs: list[str]) -> np.ndarray:
    """Sequences as numbers 0 to 4 (A, C, G, T, other); shorter ones are filled up with 4."""
    size = max(map(len, seqs))
    return _CODE[np.frombuffer("".join(s.ljust(size) for s in seqs).encode(), dtype=np.uint8)].reshape(len(seqs), size)


@dataclass
class Profile:
    match: np.ndarray  # (columns, 5)
    enter: np.ndarray  # a deletion begins with this column
    inside: np.ndarray  # a deletion goes on over this column
    leave: np.ndarray  # a deletion ended before this column, which has a base
    slot: np.ndarray  # inserted bases only
    whole: str = "sequence"
    insert: int = LOW  # first base between columns
    insert_more: int = 0
    alphabet: str = field(default=BASES)

    def reversed(self, enter: np.ndarray, leave: np.ndarray) -> Profile:
        """The profile from its end; ``enter`` and ``leave`` as seen from there, but in the order of the columns."""
        return Profile(self.match[::-1], enter[::-1], self.inside[::-1], leave[::-1], self.slot[::-1], self.whole, self.insert, self.insert_more)


@lru_cache(maxsize=1)
def _room(shape: tuple[int, ...], kind: type) -> tuple[np.ndarray, ...]:
    """Matrices that one batch after the other fills anew; new memory for each would cost as much as the filling."""
    return tuple(np.empty(shape, dtype=kind) for _ in range(4))


def align(profile: Profile, bases: np.ndarray, banned: np.ndarray | None = None, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(score, column of each base or -1) of each sequence (of its first ``lengths`` bases). Of equal ends the first one wins; the trace prefers a base on a column, then a slot
    passed over or a deletion, then an inserted base. ``banned`` (sequences, bases): the column that a base may not lie on, or -1.

    Matrices are (columns + 1, bases + 1, sequences), so that a step goes over all sequences next to each other."""
    rows, n = bases.shape
    columns = len(profile.slot)
    by_sequence = profile.whole == "sequence"
    shape = (columns + 1, n + 1, rows)
    # with a whole profile the path that deletes all columns bounds scores from below: half the width will do where they are small
    inserts, costs = profile.insert > LOW, (profile.enter, profile.inside, profile.leave)
    most = sum(int(np.abs(c).max(initial=0)) for c in (profile.match, *costs)) * columns + (abs(profile.insert) + abs(profile.insert_more) * n if inserts else 0)
    kind, low = (np.int16, -(1 << 13)) if not by_sequence and most < 1 << 12 else (np.int32, LOW)
    m, x, d, ins = _room(shape, kind)
    ins = ins if inserts else x
    m[0], m[:, 0], d[0], ins[0], ins[:, 0] = (low,) * 5
    x[0] = low if by_sequence else 0
    x[0, 0] = 0
    step = (np.arange(n + 1) * (profile.insert_more if inserts else 0)).astype(kind)[:, None]
    enter, inside, leave = (c.astype(kind) for c in costs)
    turned, gains = np.ascontiguousarray(bases.T), {}
    if banned is not None:
        at, of = np.nonzero(banned.T >= 0)
        order = np.argsort(column := banned.T[at, of], kind="stable")
        at, of, cuts = at[order], of[order], np.searchsorted(column[order], np.arange(columns + 1))
    for j in range(columns):
        if (key := profile.match[j].tobytes()) not in gains:  # columns alike share their scores of all bases
            gains[key] = profile.match[j].astype(kind)[turned]
        came = d[j, :-1] + leave[j]
        np.maximum(x[j, :-1], came, out=came)
        np.add(came, gains[key], out=m[j + 1, 1:])
        if banned is not None:
            m[j + 1, at[cuts[j] : cuts[j + 1]] + 1, of[cuts[j] : cuts[j + 1]]] = low
        if profile.slot[j]:
            np.maximum(m[j + 1], x[j], out=x[j + 1])
            d[j + 1] = d[j]
        else:
            x[j + 1] = m[j + 1]
            np.add(d[j], inside[j], out=d[j + 1])
            np.maximum(x[j] + enter[j], d[j + 1], out=d[j + 1])
        if inserts:
            best = ins[j + 1, 1:]
            np.maximum(x[j + 1, :-1], d[j + 1, :-1], out=best)
            best += kind(profile.insert) - step[:-1]
            for i in range(1, n):
                np.maximum(best[i], best[i - 1], out=best[i])
            best += step[:-1]
            np.maximum(x[j + 1], ins[j + 1], out=x[j + 1])
        if by_sequence:
            x[j + 1, 0], d[j + 1, 0] = 0, low
        np.maximum(x[j + 1], low, out=x[j + 1])
        np.maximum(d[j + 1], low, out=d[j + 1])
    each = np.arange(rows)
    if by_sequence:
        i = np.full(rows, n) if lengths is None else lengths.copy()
        j = x[:, i, each].argmax(axis=0)
        score = x[j, i, each]
        deleted = np.zeros(rows, dtype=bool)
    else:
        last = np.maximum(x[columns], d[columns])
        if lengths is not None:
            last[np.arange(n + 1)[:, None] > lengths] = 2 * low
        i = last.argmax(axis=0)
        score, j = last[i, each], np.full(rows, columns)
        deleted = x[columns, i, each] < score
    return score, _trace(profile, bases, (m, x, d, ins), i, j, deleted, by_sequence)


def _trace(profile: Profile, bases: np.ndarray, matrices: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray, deleted: np.ndarray, by_sequence: bool) -> np.ndarray:
    """The column of each base, of all rows together: a step takes every row one cell back. State: 0 no deletion, 1 deletion, 2 inserted base."""
    m, x, d, ins = matrices
    rows, n = bases.shape
    place = np.full((rows, n), -1, dtype=np.int64)
    state = deleted.astype(np.int64)
    live = np.flatnonzero((i > 0) if by_sequence else (j > 0))
    while len(live):
        r, a, b, s = live, i[live], j[live], state[live]
        value = np.select([s == 0, s == 1], [x[b, a, r], d[b, a, r]], ins[b, a, r])
        on = (s == 0) & (value == m[b, a, r]) & (a > 0)
        over = (s == 0) & ~on & profile.slot[b - 1] & (value == x[b - 1, a, r])
        gone = s == 1
        put = (s == 2) | ((s == 0) & ~on & ~over)
        # a base on a column
        k = np.flatnonzero(on)
        place[r[k], a[k] - 1] = b[k] - 1
        gain = profile.match[b[k] - 1, bases[r[k], a[k] - 1]]
        state[r[k]] = np.where(value[k] - gain == x[b[k] - 1, a[k] - 1, r[k]], 0, 1)
        i[r[k]] -= 1
        j[r[k]] -= 1
        j[r[over]] -= 1
        # a column that is deleted: entered here, or gone on
        k = np.flatnonzero(gone)
        fresh = ~profile.slot[b[k] - 1] & (value[k] == x[b[k] - 1, a[k], r[k]] + profile.enter[b[k] - 1])
        state[r[k]] = np.where(fresh, 0, 1)
        j[r[k]] -= 1
        # an inserted base: the first of its run, or one more
        k = np.flatnonzero(put)
        own = ins[b[k], a[k], r[k]]
        before = own - profile.insert
        opened_x, opened_d = m[b[k], a[k] - 1, r[k]] == before, d[b[k], a[k] - 1, r[k]] == before
        state[r[k]] = np.where(opened_x, 0, np.where(opened_d, 1, 2))
        i[r[k]] -= 1
        live = live[(i[live] > 0) & (j[live] > 0) if by_sequence else (j[live] > 0)]
    return place


def best_two(profile: Profile, bases: np.ndarray, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(score, places) of the best alignment and of the best one that shares no base on the same column with it."""
    score, place = align(profile, bases, lengths=lengths)
    return score, place, *align(profile, bases, place, lengths)
