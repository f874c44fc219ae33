"""Word sequences, lexical search and spelling variants against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and
clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strandlake.llm import lexical_index, spelling, suffix_trees

RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choices("abcdeé", k=RNG.randint(2, 7))) for _ in range(150)]


def prose(n, rng):
    return rng.choice(" \t\n").join(rng.choices(VOCABULARY, k=n))


def texts(seed=1):
    rng = random.Random(seed)
    passage, other = prose(60, rng), prose(31, rng)
    rows = [prose(rng.randint(0, 90), rng) for _ in range(40)]
    rows += [prose(10, rng) + " " + passage + "\x0b" + prose(8, rng) for _ in range(9)] + [passage, other + " " + passage, passage + " " + passage + " x " + passage]
    rows += [rows[3], rows[3], rows[3].upper(), None, None, "", " \n", "\x00", "word", "x " * 70, "x y " * 40 + "z", "a " * 19, "a " * 20, prose(3000, rng) + " " + other, "un broken   " * 15]
    near = prose(120, rng).split()
    for k in range(12):
        rows.append(" ".join(near[: k * 9] + ["changed"] + near[k * 9 + 1 :]))
    return rows


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, "y") for i, t in rows], "doc_id long, text string, key long, words string, start long, n long, word string")


def slow_earlier(rows, span):
    """rows in order: what each loses."""
    seen, out = set(), []
    for _, t in rows:
        words = re.findall("[^\x20\x09-\x0d]+", t or "")
        gone = [False] * len(words)
        for s in range(len(words) - span + 1):
            window = tuple(words[s : s + span])
            if window in seen:
                gone[s : s + span] = [True] * span
            seen.add(window)
        out.append((len(words), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(words, gone, strict=True) if not g).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("group_size", [1024, 2])
def test_earlier_word_sequences(spark, group_size):
    rows = list(enumerate(texts()))
    want = {i: w for (i, _), w in zip(rows, slow_earlier(rows, 20), strict=True)}
    random.Random(3).shuffle(rows)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_trees.remove_earlier(frame(spark, rows), group_size=group_size).collect()}
    assert got == want
    assert sum(w[1] for w in want.values()) > 1000
    assert suffix_trees.remove_earlier(frame(spark, [])).count() == 0


@pytest.mark.parametrize("span", [8, 5])
def test_earlier_word_sequences_of_other_lengths(spark, span):
    rows = list(enumerate(texts(2)))
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_trees.remove_earlier(frame(spark, rows), span, group_size=50).collect()}
    assert got == {i: w for (i, _), w in zip(rows, slow_earlier(rows, span), strict=True)}


def test_earlier_word_sequences_of_odd_rows(spark):
    """Repeated ids stay at their place in the order, rows without an id come last; of rows that tie, either may be first."""
    rng = random.Random(9)
    long, other = prose(50, rng), prose(40, rng)
    rows = [(3, long), (7, "a " + long), (7, "b " + other), (5, other), (None, long), (None, other + " end"), (-2, other + " start"), (9, "only here " + prose(30, rng))]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    got = Counter((r["doc_id"], *tuple(r)[1:]) for r in suffix_trees.remove_earlier(frame(spark, rows)).collect())
    assert got == Counter((i, *w) for (i, _), w in zip(order, slow_earlier(order, 20), strict=True))
    same = [tuple(r)[2] for r in suffix_trees.remove_earlier(frame(spark, [(1, long), (1, long), (None, long)])).collect()]
    assert sorted(same) == [0, 50, 50]


def test_nodes_of_a_group():
    import pyarrow as pa

    of, at, shared = suffix_trees.sorted_suffixes(pa.array([b"a b c d", b"x a b c", b"a b c e"]), np.array([0, 0, 1]), 3)
    found = {(int(i), int(k)) for i, k in zip(of, at, strict=True)}
    assert found == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1)} and (shared >= 3).sum() == 1
    first, last = suffix_trees.deep_nodes(shared, 3)
    assert [(int(of[k]), int(at[k])) for k in range(first[0], last[0] + 1)] == [(0, 0), (1, 1)] and len(first) == 1
    assert suffix_trees.deep_nodes(np.zeros(0, dtype=np.int64), 3)[0].size == 0


def slow_search(docs, items, k=10):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, b in bags:
            m = 100 - 75 + 75 * sum(b.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 8 * m)) for t in terms(text) if b[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("options", [{}, {"cuts": (2_500_000_000, 1_500_000_000, 500_000_000), "shard_docs": 7, "rare_below": 3}, {"cuts": (400_000_000,), "shard_bytes": 200}])
def test_search(spark, options):
    rng = random.Random(4)
    docs = [(1000 - i, t) for i, t in enumerate(texts(6))] + [(None, "word abc"), (None, "word abc"), (8, "word abc"), (8, "word abc"), (7, "Word! ABC 12 1234"), (6, "é É 12a")]
    items = [(k, prose(rng.randint(1, 30), rng)) for k in range(25)] + [(90, docs[45][1]), (91, None), (92, ""), (93, "nowhere known"), (94, "word"), (94, "word"), (None, "ABC abc 12"), (95, "é"), (96, "x " * 30)]
    index = lexical_index.build(frame(spark, docs), **options)
    found = lexical_index.search(index, spark.createDataFrame(items, "item_id long, text string"), block_items=20, kept=12)
    rows = found.collect()
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows) == slow_search(docs, items)
    if len(options.get("cuts", ())) > 1:
        assert len({r["tier"] for r in rows}) > 1  # some items are proven before the last tier
    empty = lexical_index.build(frame(spark, []), **options)
    assert lexical_index.search(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert lexical_index.search(index, spark.createDataFrame([], "item_id long, text string")).count() == 0


def slow_variants(docs):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    form, count = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        count[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("block_words", [64, 1])
def test_spelling_variants(spark, block_words):
    rng = random.Random(2)
    stems = ["".join(rng.choices("abcé", k=rng.randint(4, 9))) for _ in range(25)] + ["aaaaa", "aaaaaa", "aaaaaaa", "aaaab", "baaaa", "zürich", "Zürich", "ÀÉÎÕÜ", "ÀÉÎÕÜx", "l" * 3000]
    words = [s for s in stems for _ in range(rng.randint(3, 60))]
    for s in stems:
        for _ in range(6):
            k, c = rng.randrange(len(s)), rng.choice("abcéÀ")
            words += [rng.choice([s[:k] + c + s[k:], s[:k] + s[k + 1 :], s[:k] + c + s[k + 1 :]])] * rng.randint(1, 9)
    rng.shuffle(words)
    docs = [(i % 97 if i % 11 else None, " ".join(words[i : i + 20])) for i in range(0, len(words), 20)] + [(5, None), (6, ""), (7, "1234 _ ñ")]
    docs += [docs[0], docs[0]]
    got = spelling.variants(frame(spark, docs), block_words=block_words)
    want = slow_variants(docs)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 60
    assert any(f and r != f for _, f, r, *_ in want)  # chains of more than one step
    assert spelling.variants(frame(spark, [])).count() == 0


def test_bounded_counting_keeps_all_words(spark):
    docs = [(i, " ".join(VOCABULARY[i : i + 40] * 2)) for i in range(100)]
    few = spelling.dictionary(frame(spark, docs), held=10)
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in spelling.dictionary(frame(spark, docs)).collect()}
