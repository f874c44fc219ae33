"""De-duplicating operators against brute force, with nulls, empty and long texts, ties, empty tables and clashing names."""

import hashlib
import random
import re
import uuid
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash

from strandlake.llm import embedding_dedup, exact_dedup, simhash, suffix_dedup
from strandlake.llm.components import connected_components

SCHEMA = "doc_id long, text string, kept boolean, n long, digest string, u long, component_id long"
RNG = random.Random(7)
VOCABULARY = ["".join(RNG.choices("abcdefghé", k=RNG.randint(2, 8))) for _ in range(400)]


def prose(n, rng):
    return " ".join(rng.choices(VOCABULARY, k=n))


def corpus():
    rng = random.Random(3)
    passage = prose(120, rng)
    texts = [prose(rng.randint(1, 200), rng) for _ in range(40)]
    texts += [texts[3], texts[3].upper(), texts[3], None, None, "", " ", "\x00", "word", "Word", passage]
    texts += [prose(30, rng) + " " + passage + " " + prose(30, rng) for _ in range(6)]
    near = prose(150, rng).split()
    for k in range(8):
        copy = list(near)
        copy[k * 7] = "changed"
        texts.append(" ".join(copy))
    texts += [prose(20_000, rng), "ab" * 700, "ab" * 700 + "c"]
    return list(enumerate(texts))


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, True, 5, "x", 1, 2) for i, t in rows], SCHEMA)


def groups_of(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact_dedup(spark):
    rows = corpus()
    got = {r["doc_id"]: r for r in exact_dedup.deduplicate(frame(spark, rows), f"ix_{uuid.uuid4().hex[:8]}", 4).collect()}
    same = {}
    for i, t in rows:
        same.setdefault(fold(t), []).append(i)
    assert len(got) == len(rows)
    for i, t in rows:
        members = same[fold(t)]
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(members), len(members), i == max(members))
        assert r["text_sha256"] == hashlib.sha256(fold(t).encode()).hexdigest()


def test_exact_dedup_is_incremental_and_native(spark):
    index = exact_dedup.DigestIndex(spark, f"ix_{uuid.uuid4().hex[:8]}", 4)
    first = index.ingest(frame(spark, [(1, "a"), (2, "A"), (3, None)]), "one").collect()
    assert {r["doc_id"] for r in first if r["kept"]} == {2, 3}
    second = {r["doc_id"]: r for r in index.ingest(frame(spark, [(4, "a"), (5, "b"), (6, "")]), "two").collect()}
    assert [second[i]["kept"] for i in (4, 5, 6)] == [False, True, False] and second[4]["keep_id"] is None
    assert spark.table(index.name).count() == 3
    assert index.ingest(frame(spark, []), "three").count() == 0
    plan = exact_dedup.digests(frame(spark, []))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_exact_dedup_of_a_batch_that_runs_again(spark, monkeypatch):
    """The run fails between the append and its result; the next one keeps the same rows, and the index has each digest once."""
    index = exact_dedup.DigestIndex(spark, f"ix_{uuid.uuid4().hex[:8]}", 4)
    index.ingest(frame(spark, [(1, "a"), (2, "b")]), "one")
    batch = frame(spark, [(3, "b"), (4, "c"), (5, "C"), (6, "d")])

    def fail(self):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(exact_dedup.DigestIndex, "compact", fail)
        with pytest.raises(RuntimeError):
            index.ingest(batch, "two")
    assert spark.table(index.name).count() == 4
    for _ in range(2):
        got = {r["doc_id"]: r["kept"] for r in index.ingest(batch, "two").collect()}
        assert got == {3: False, 4: False, 5: True, 6: True} and spark.table(index.name).count() == 4
    assert not any(r["kept"] for r in index.ingest(batch, "three").collect()) and not any(r["kept"] for r in index.ingest(batch).collect())
    index.drop()
    assert not index.exists()


def test_digest_index_grows_its_buckets(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "ROWS_PER_BUCKET", 5)
    index = exact_dedup.DigestIndex(spark, f"ix_{uuid.uuid4().hex[:8]}", 2)
    index.ingest(frame(spark, [(i, f"text {i}") for i in range(8)]), "one")
    assert index.bucket_count() == 2
    index.ingest(frame(spark, [(i, f"text {i}") for i in range(4, 40)]), "two")
    assert index.bucket_count() == 8 and spark.table(index.name).count() == 40 and spark.table(index.name).select("digest").distinct().count() == 40
    assert not any(r["kept"] for r in index.ingest(frame(spark, [(90, "text 7"), (91, "TEXT 39")]), "three").collect())
    monkeypatch.setattr(exact_dedup, "ROWS_PER_BUCKET", 4_000_000)
    for k in range(3):
        index.ingest(frame(spark, [(200 + k, f"more {k}")]), f"four {k}")
    files = len(spark.table(index.name).inputFiles())
    assert index.compact(appends=1) and len(spark.table(index.name).inputFiles()) < files and spark.table(index.name).count() == 43
    spark.sql(f"ALTER TABLE {index.name} RENAME TO {index.name}_next")  # a compaction that stopped halfway
    assert index.exists() and spark.table(index.name).count() == 43


def slow_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", fold(text)) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("shard_size", [512, 2])
def test_simhash_groups(spark, shard_size):
    rows = corpus()
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, rows), shard_size=shard_size).collect()}
    fps = {i: slow_fingerprint(t) for i, t in rows}
    links = [(i, j) for i in fps for j in fps if i < j and (fps[i] ^ fps[j]).bit_count() <= 4]
    want = groups_of(links, fps)
    assert {i: (int(r["fingerprint"], 16), r["component_id"]) for i, r in got.items()} == {i: (fps[i], want[i]) for i in fps}
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_bk_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    points = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) for _ in range(12)]]))
    for radius in (0, 3, 4, 9):
        found = {(int(a), int(b)) for q, p in simhash.BKTree(points).within(points, radius, 50) for a, b in zip(q, p, strict=True)}
        assert found == {(i, j) for i in range(len(points)) for j in range(len(points)) if int(points[i] ^ points[j]).bit_count() <= radius}
    assert not list(simhash.BKTree(points[:0]).within(points[:0], 4))


def slow_repeats(rows, span):
    seen = {}
    for i, t in rows:
        data = (t or "").encode()
        for k in range(len(data) - span + 1):
            seen[data[k : k + span]] = seen.get(data[k : k + span], 0) + 1
    out = {}
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data) + 2, dtype=bool)
        for k in range(len(data) - span + 1):
            if seen[data[k : k + span]] > 1:
                gone[k + 1 : k + span + 1] = True
        stays = bytes(np.frombuffer(data, dtype=np.uint8)[~gone[1:-1]])
        out[i] = (len(data), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(stays).hexdigest())
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 20, 3000])
def test_suffix_dedup(spark, shard_bytes):
    rows = corpus()
    want = slow_repeats(rows, 400)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(frame(spark, rows), shard_bytes=shard_bytes).collect()}
    assert got == want
    assert sum(w[1] for w in want.values()) > 5000
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_suffix_dedup_keeps_columns_and_texts(spark):
    rows = corpus()
    docs = frame(spark, rows).withColumn("n_chars", __import__("pyspark").sql.functions.lit(1).cast("long"))
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    want = slow_repeats(rows, 400)
    for i, t in rows:
        if not want[i][1]:
            assert texts[i] == t
        else:
            assert len(texts[i].encode()) <= want[i][0] - want[i][1]


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for letters in (1, 2, 20):
        text = rng.integers(97, 97 + letters, 700).astype(np.uint8)
        data = text.tobytes()
        sa = suffix_dedup.suffix_array(text)
        assert sa.tolist() == sorted(range(700), key=lambda i: data[i:])
        shared = suffix_dedup.common_prefixes(text, sa, 60, stride=7)
        for k in range(1, 700):
            a, b = data[sa[k - 1] : sa[k - 1] + 60], data[sa[k] : sa[k] + 60]
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert shared[k] == n


def test_prefixes_of_texts_that_share_more_than_the_depth():
    """Copies longer than the depth and its next powers of two, in several orders: every prefix against a slow one, every hit against a count."""
    rng = random.Random(5)
    shared = [prose(n, rng).encode() for n in (150, 260, 400)]
    pieces = [prose(3, rng).encode() + s[k:] + prose(4, rng).encode() + s[: -k or None] for s in shared for k in (0, 1, 37, 300)]
    for order in range(4):
        random.Random(order).shuffle(pieces)
        segments = list(dict.fromkeys(p[a : a + 799] for p in pieces for a in range(0, max(1, len(p) - 398), 400)))
        text, begins, hit, _ = suffix_dedup.repeated_starts(segments, 400)
        data = text.tobytes()
        sa = suffix_dedup.suffix_array(text)
        assert sa.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        shared_bytes = suffix_dedup.common_prefixes(text, sa, 400)
        for k in range(1, len(sa)):
            a, b = data[sa[k - 1] : sa[k - 1] + 400], data[sa[k] : sa[k] + 400]
            assert shared_bytes[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        counts = Counter(s[k : k + 400] for s in segments for k in range(len(s) - 399))
        for s, begin in zip(segments, begins, strict=True):
            assert hit[begin : begin + len(s) - 399].tolist() == [counts[s[k : k + 400]] > 1 for k in range(len(s) - 399)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, k) for k in range(2, 60)] + [(5, 5), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = groups_of(real, {x for e in real for x in e})
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("bucket_size", [1024, 3])
def test_embedding_dedup(spark, bucket_size):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((6, 16))
    rows = [(i, [float(x) for x in base[i % 6] + 0.12 * rng.standard_normal(16)], i % 2) for i in range(60)]
    rows += [(100, rows[0][1], 0), (101, [2 * x for x in rows[0][1]], 0), (102, rows[0][1], 1), (103, None, 0), (104, [0.0] * 16, 0), (105, [float("nan")] * 16, 0), (106, [None] * 16, 0), (107, rows[0][1], None), (108, [1.0, 2.0], 0), (109, [], 0), (110, rows[0][1], 0)]
    df = spark.createDataFrame([(i, e, lab, 3, 4) for i, e, lab in rows], "vec_id long, embedding array<float>, label int, node long, size long")
    ok = {i: np.float32(e).astype(float) for i, e, lab in rows if lab is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)}
    label = {i: lab for i, _, lab in rows}
    links = [(i, j) for i in ok for j in ok if i != j and label[i] == label[j] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= 0.93]
    want = groups_of(links, label)
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.near_duplicates(df, bucket_size=bucket_size).collect()}
    assert got == {i: (sum(a == i for a, _ in links), want[i], want[i] == i) for i in label}
    assert len(links) > 100
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_table_plan_keeps_the_recall():
    for n in (10, 10_000, 10_000_000):
        bits, tables = embedding_dedup.table_plan(n, 0.93)
        same = 1 - np.arccos(0.93) / np.pi
        assert (1 - same**bits) ** tables <= 1e-5


def test_runs_of_one_document_are_dealt_over_the_pieces(spark):
    from pyspark.sql import functions as F

    runs = spark.range(40_000).select(F.lit(7).cast("long").alias("key"), F.col("id").cast("int").alias("first"))
    sizes = [r["count"] for r in runs.groupBy(suffix_dedup._piece(F.lit(8).cast("long"))).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 20_000


def odd_rows():
    """Null ids, repeated ids with equal and with other texts, negative ids, fully repeated rows."""
    rng = random.Random(11)
    long, other = prose(150, rng), prose(150, rng)
    rows = [(1, long), (1, long), (1, other), (2, "x " + long), (None, long), (None, None), (None, "alone without an id"), (None, other + " end"), (3, prose(90, rng)), (3, prose(90, rng)), (-5, "y " + other)]
    return rows + [(4, "short"), (4, "short"), (4, "Short"), (None, "no id twice"), (None, "No Id Twice")]


def with_tag(spark, rows):
    """The rows with a number of their own, in columns that the operators name as well."""
    return spark.createDataFrame([(i, t, k, "z", -1, -2) for k, (i, t) in enumerate(rows)], "doc_id long, text string, tag long, kept string, row_key long, key long")


def test_keyed_tells_all_rows_apart(spark):
    from strandlake.llm.common import keyed

    rows, key = keyed(with_tag(spark, odd_rows()))
    got = rows.collect()
    assert key not in ("row_key", "key") and len({r[key] for r in got}) == len(got) == len(odd_rows())
    assert {r["tag"] for r in got} == set(range(len(got))) and {r[key] for r in got if r["doc_id"] in (2, -5)} == {2, -5}
    assert len({r[keyed(with_tag(spark, odd_rows()[3:4]))[1]] for r in keyed(with_tag(spark, odd_rows()[3:4]))[0].collect()}) == 1


def test_exact_dedup_keeps_one_row_of_each_text(spark):
    rows = odd_rows()
    got = exact_dedup.deduplicate(with_tag(spark, rows), f"ix_{uuid.uuid4().hex[:8]}", 4).collect()
    texts = Counter(fold(t) for _, t in rows)
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in texts}
    assert len(got) == len(rows) and Counter(sha[r["text_sha256"]] for r in got if r["kept"]) == Counter(dict.fromkeys(texts, 1))
    for r in got:
        ids = [i for i, t in rows if fold(t) == sha[r["text_sha256"]] and i is not None]
        assert r["keep_id"] == max(ids, default=None) and r["group_size"] == texts[sha[r["text_sha256"]]]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]


def test_suffix_dedup_of_odd_rows(spark):
    rows = odd_rows()
    want = slow_repeats(list(enumerate(t for _, t in rows)), 400)
    got = Counter(tuple(r) for r in suffix_dedup.remove_repeats(with_tag(spark, rows)).collect())
    assert got == Counter((i, *want[k]) for k, (i, _) in enumerate(rows))
    out = suffix_dedup.without_repeats(with_tag(spark, rows))
    texts = {r["tag"]: r["text"] for r in out.collect()}
    assert out.columns == with_tag(spark, rows).columns and len(texts) == len(rows)
    assert all(texts[k] == t for k, (_, t) in enumerate(rows) if not want[k][1])
    assert all(hashlib.sha256(texts[k].encode()).hexdigest() == want[k][3] for k in want if rows[k][1] is not None)


@pytest.mark.parametrize("period", [1, 3, 7])
def test_periodic_texts_send_few_bytes(period):
    data = np.frombuffer((b"abcdefg"[:period] * 20_000)[:20_000], dtype=np.uint8)
    _, first, last, _, places = suffix_dedup.anchors(data, np.array([0, len(data)]))
    assert first[0] == 0 and last[-1] == 20_000 - 400 and (first[1:] == last[:-1] + 1).all() and (last - first < 400).all()
    assert places.sum() > 20_000 // period - 400 and (last - first + 400).sum() < 3 * len(data) * max(1, period / 2)


@pytest.mark.parametrize("period", [1, 2, 300])
def test_periodic_documents_against_brute_force(spark, period):
    rng = random.Random(period)
    unit = "".join(rng.choices("abcdefgh", k=period))
    rows = [(1, unit * (5000 // period)), (2, "q" + unit * (700 // period)), (3, unit * 2 + prose(100, rng)), (4, prose(80, rng))]
    for shard_bytes in (1 << 20, 2000):
        got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(frame(spark, rows), shard_bytes=shard_bytes).collect()}
        assert got == slow_repeats(rows, 400)


def test_repeats_inside_one_run_of_an_anchor(spark):
    """Periodic stretches of one document only, as tables hold them: all their repeats lie in neighbouring starts."""
    rng = random.Random(8)
    text = "".join(w * rng.randint(30, 200) for w in ("Nd, ", "ed, ", "of the ", "x", "abc", "Nd, ed, "))
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(frame(spark, [(1, text), (2, "else")]), span=200).collect()}
    assert got == slow_repeats([(1, text), (2, "else")], 200)


@pytest.mark.parametrize("span", [120, 200])
def test_suffix_dedup_at_other_spans(spark, span):
    rows = corpus()[:60]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(frame(spark, rows), span=span).collect()}
    assert got == slow_repeats(rows, span)


def test_simhash_of_odd_rows(spark):
    rows = odd_rows()
    got = {r["row_key"]: r for r in simhash.simhash_groups(with_tag(spark, rows), key="tag").collect()}
    fps = {k: slow_fingerprint(t) for k, (_, t) in enumerate(rows)}
    want = groups_of([(i, j) for i in fps for j in fps if i < j and (fps[i] ^ fps[j]).bit_count() <= 4], fps)
    for part in set(want.values()):
        members = [k for k in want if want[k] == part]
        lowest = min(members, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
        for k in members:
            assert got[k]["component_id"] == rows[lowest][0] and got[k]["kept"] == (k == lowest)
    assert simhash.near_duplicates(with_tag(spark, rows)).count() == len(rows)


def test_blocks_never_miss_a_pair():
    for n in (10, 5_000_000, 2 << 30, 1 << 38):
        cuts, choices = simhash.block_plan(n)
        assert cuts[0] == 0 and cuts[-1] == 64
        for flipped in combinations(range(len(cuts) - 1), 4):
            assert any(not set(c) & set(flipped) for c in choices)
        if n < 1 << 36:
            assert n >> sum(cuts[i + 1] - cuts[i] for i in choices[0]) <= 1024


def test_simhash_with_more_blocks(spark, monkeypatch):
    plan = simhash.block_plan
    rows = corpus()
    classes = simhash.fingerprints(frame(spark, rows)).select("fp").distinct()
    fps = sorted(r["fp"] for r in classes.collect())
    want = groups_of([(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4], fps)
    assert len(simhash.block_plan(1 << 30)[1]) == 15
    monkeypatch.setattr(simhash, "block_plan", lambda *_: plan(1 << 30))
    edges = [tuple(r) for r in simhash.link_fingerprints(classes).collect()]
    assert groups_of(edges, fps) == want


def test_embedding_rows_without_ids(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.0]
    rows = [(None, v, 1), (None, v, 1), (7, v, 1), (7, w, 1), (None, w, 2), (None, w, 2), (9, [1.0, 2.0, 3.1], 1), (None, None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = Counter(tuple(r) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == Counter([(None, 3, 7, False)] * 2 + [(7, 3, 7, True), (9, 3, 7, False), (7, 0, 7, True)] + [(None, 1, None, True)] * 2 + [(None, 0, None, True)])
