"""Profile alignment, window callers and realignment against slow recursions and planted changes."""

import random
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandlake.operators import align, windows
from strandlake.operators.profile import LOW, Profile, align as place_on, base_codes, best_two
from strandlake.plans import windows as plans

RNG = random.Random(1)
GENOME = "".join(RNG.choices("ACGT", k=1200))  # position p is GENOME[p - 1]
OTHER = {"A": "C", "C": "G", "G": "T", "T": "A"}
def reference():
    return F.substr(F.lit(GENOME), F.col("p").cast("int"), F.lit(1))



def slow_score(p, b, banned=frozenset()):
    columns, n, by_sequence = len(p.slot), len(b), p.whole == "sequence"

    @lru_cache(None)
    def x(j, i):
        if j == 0:
            return 0 if i == 0 or not by_sequence else LOW
        if by_sequence and i == 0:
            return 0
        return max(m(j, i), x(j - 1, i) if p.slot[j - 1] else LOW, ins(j, i) if p.insert > LOW else LOW)

    @lru_cache(None)
    def m(j, i):
        if i == 0 or j == 0 or (i - 1, j - 1) in banned:
            return LOW
        return max(LOW, max(x(j - 1, i - 1), d(j - 1, i - 1) + p.leave[j - 1]) + p.match[j - 1][b[i - 1]])

    @lru_cache(None)
    def d(j, i):
        if j == 0 or (by_sequence and i == 0):
            return LOW
        return d(j - 1, i) if p.slot[j - 1] else max(LOW, x(j - 1, i) + p.enter[j - 1], d(j - 1, i) + p.inside[j - 1])

    @lru_cache(None)
    def ins(j, i):
        return LOW if i == 0 or j == 0 else max(LOW, max(m(j, i - 1), d(j, i - 1)) + p.insert, ins(j, i - 1) + p.insert_more)

    return max(x(j, n) for j in range(columns + 1)) if by_sequence else max(max(x(columns, i), d(columns, i)) for i in range(n + 1))


def path_score(p, b, place):
    """Of a whole sequence's places."""
    total, at = 0, None
    for i, c in enumerate(place):
        skipped = [] if at is None else [q for q in range(at + 1, c) if not p.slot[q]]
        total += sum(p.enter[q] if k == 0 else p.inside[q] for k, q in enumerate(skipped)) + (p.leave[c] if skipped else 0) + p.match[c][b[i]]
        at = c
    return total


@pytest.mark.parametrize("whole", ["sequence", "profile"])
def test_profile_alignment_scores_and_paths(whole):
    rng = np.random.default_rng(1)
    for _ in range(150):
        columns, n = int(rng.integers(3, 12)), int(rng.integers(2, 9))
        slot = rng.random(columns) < 0.2 if whole == "sequence" else np.zeros(columns, dtype=bool)
        match = rng.integers(-3, 5, (columns, 5))
        match[slot] = np.where(rng.random((slot.sum(), 5)) < 0.5, 5, -100)
        p = Profile(match, rng.integers(-6, 2, columns), rng.integers(-2, 1, columns), rng.integers(-3, 1, columns), slot, whole, LOW if whole == "sequence" else -3, -1)
        b = rng.integers(0, 4, (3, n))
        score, place, next_score, _ = best_two(p, b)
        for r in range(3):
            assert score[r] == slow_score(p, tuple(b[r]))
            used = frozenset((i, int(c)) for i, c in enumerate(place[r]) if c >= 0)
            again = slow_score(p, tuple(b[r]), used)
            assert next_score[r] == again or max(next_score[r], again) < LOW // 2
            if whole == "sequence" and score[r] > LOW // 2:
                assert path_score(p, b[r], place[r]) == score[r]


def test_profile_alignment_of_shorter_sequences():
    rng = np.random.default_rng(2)
    p = Profile(rng.integers(-3, 5, (9, 5)), np.full(9, -2), np.full(9, -1), np.full(9, -1), np.zeros(9, dtype=bool))
    seqs = ["ACGTA", "AC", "GGT"]
    together = place_on(p, base_codes(seqs), lengths=np.array([5, 2, 3]))
    for r, s in enumerate(seqs):
        score, place = place_on(p, base_codes([s]))
        assert score[0] == together[0][r] and place[0].tolist() == together[1][r][: len(s)].tolist() and (together[1][r][len(s) :] == -1).all()


def read(events, a, b):
    """(cigar, seq, mismatches) of a haplotype of the genome from position a to b; events: position -> S base, D length, I bases before it."""
    seq, ops, wrong, p = "", [], 0, a

    def add(op, n=1):
        if ops and ops[-1][1] == op:
            ops[-1][0] += n
        else:
            ops.append([n, op])

    while p <= b:
        kind, value = events.get(p, ("", ""))
        if kind == "D" and seq and p + value <= b:
            add("D", value)
            p += value
            continue
        if kind == "I" and seq:
            seq += value
            add("I", len(value))
        seq += value if kind == "S" else GENOME[p - 1]
        wrong += kind == "S"
        add("M")
        p += 1
    return "".join(f"{n}{op}" for n, op in ops), seq, wrong


def reads(spark, haplotypes, step=3, times=1):
    rows = []
    for a in range(330, 600, step):
        for k, events in enumerate(haplotypes):
            cigar, seq, wrong = read(events, a, a + 90)
            rows += [(1, "TN"[k % 2], a, cigar, seq, wrong, 91)] * times
    return spark.createDataFrame(rows, "chr int, sample string, pos long, cigar string, seq string, n_mm int, span long")


CHANGED = {450: ("S", OTHER[GENOME[449]]), 480: ("D", 4), 520: ("I", "ACT")}


def expected(events, gt):
    out = set()
    for p, (kind, value) in events.items():
        if kind == "S":
            out.add((p, GENOME[p - 1], value, gt))
        elif kind == "D":
            while GENOME[p - 2] == GENOME[p + value - 2]:  # the same deletion further left
                p -= 1
            out.add((p - 1, GENOME[p - 2 : p + value - 1], GENOME[p - 2], gt))
        else:
            out.add((p - 1, GENOME[p - 2], GENOME[p - 2] + value, gt))
    return out


@pytest.mark.parametrize("times", [1, 7])
def test_window_calls_find_planted_changes(spark, times):
    got = windows.call_windows(reads(spark, [{}, CHANGED], times=times), reference()).collect()
    assert {(r["pos"], r["ref"], r["alt"], r["gt"]) for r in got} == expected(CHANGED, "0/1")
    both = windows.call_windows(reads(spark, [CHANGED, CHANGED], times=times), reference()).collect()
    assert {(r["pos"], r["ref"], r["alt"], r["gt"]) for r in both} == expected(CHANGED, "1/1")
    assert all(r["ad"].split(",")[0] == "0" and int(r["ad"].split(",")[1]) == r["dp"] for r in both)
    assert windows.call_windows(reads(spark, [{}, {}]), reference()).count() == 0
    assert windows.call_windows(reads(spark, [CHANGED]).limit(0), reference()).count() == 0


def test_reads_with_misplaced_gaps_are_realigned(spark):
    """Half of the reads state no gap where the haplotype lacks bases: they are laid on the layout that the other half gives."""
    p = next(p for p in range(470, 500) if GENOME[p - 2] != GENOME[p + 4] and GENOME[p - 1] != GENOME[p + 5])  # a gap with one place only
    events = {p: ("D", 6)}
    stated = reads(spark, [events], 6)
    plain = reads(spark, [events], 6).withColumn("cigar", F.concat(F.length("seq").cast("string"), F.lit("M"))).withColumn("span", F.length("seq").cast("long")).withColumn("n_mm", F.lit(9))
    tags = windows.tags_of(stated.unionByName(plain).withColumn("sample", F.lit("")), 200)
    placed = windows.realign_tags(tags, windows.layouts(tags, reference())).where("win % 1000 = 2").collect()
    over = [r for r in placed if "------" in r["symbols"] or "-----" in r["symbols"]]
    assert len(over) > 15 and all(set(r["symbols"]) <= set(".- ") for r in placed if r["kept"])
    got = {(r["pos"], r["ref"], r["alt"], r["gt"]) for r in windows.call_windows(stated.unionByName(plain), reference()).collect()}
    assert got == expected(events, "1/1")


def test_windows_grow_over_indels_at_their_border():
    changes = [{"kind": "D", "pos": 599, "size": 8, "base": "", "n": 9}, {"kind": "I", "pos": 398, "size": 1, "base": "G", "n": 9}, {"kind": "I", "pos": 398, "size": 2, "base": "T", "n": 9}]
    own = windows.Layout(400, 599, 350, GENOME[349:650], changes)
    assert own.pos[own.last] == 606 and own.pos[own.first] == 398 and own.slot[own.first] == 1 and own.letter[own.first : own.first + 2] == "++"
    assert own.letter.replace("+", "") == GENOME[349:650]
    plain = windows.Layout(400, 599, 350, GENOME[349:650], None)
    assert (plain.pos[plain.first], plain.pos[plain.last], plain.indels) == (398, 601, False)


def test_two_samples_share_a_layout(spark):
    got = windows.call_two_samples(reads(spark, [CHANGED, {}]), reference(), ("N", "T")).collect()
    assert got and all((r["share_a"] == 0) != (r["share_b"] == 0) for r in got)
    for r in got:
        assert ("-" in r["hap"] or "ACT" in r["hap"] or OTHER[GENOME[449]] in r["hap"].replace("ACT", "")) == (r["share_b"] > 0)
        assert str(r["allele"]) in (r["gt_b"] if r["share_b"] else r["gt_a"]).split("/")


def test_realignment(spark):
    events = {450: ("S", OTHER[GENOME[449]]), 480: ("D", 4)}
    given = reads(spark, [{}, events], 2).withColumn("first", F.col("pos") - 20)
    given = given.withColumn("window", F.substr(F.lit(GENOME), F.col("first").cast("int"), F.lit(135))).withColumn("n", F.lit(2).cast("long"))
    placed = align.realign(given.select("chr", "sample", "n", F.col("pos").alias("was"), "seq", "window", "first"), ["chr", "sample", "n", "was", "seq"])
    rows = placed.collect()
    assert len(rows) == given.count()
    for r in rows:  # the new alignment spells the read
        out, p, marks = "", r["pos"], {(c["kind"], c["pos"]): c["allele"] for c in r["changes"]}
        while p < r["pos"] + r["span"]:
            out += marks.get(("I", p), "")
            if ("D", p) in marks:
                p += int(marks["D", p])
                continue
            out += marks.get(("M", p), GENOME[p - 1])
            p += 1
        assert out == r["seq"]
    found, matched = Counter(), Counter()
    for r in rows:
        found.update({(r["sample"], c["pos"], c["kind"], c["allele"]): 2 for c in r["changes"] if c["kind"] != "M"})
        at = r["pos"]
        for size, op in align._parse(r["cigar"]):
            if op == "M":
                matched.update({(r["sample"], q): 2 for q in range(at, at + size)})
            at += 0 if op == "I" else size
    want = set()
    for (s, q, kind, allele), n in found.items():
        total = matched[s, q] + sum(m for (t, p, *_), m in found.items() if (t, p) == (s, q))
        enough = lambda x, total=total: x >= 2 and x >= total * 8 // 100
        if enough(n):
            want.add((s, 1, q - 1, kind, allele, n, total, matched[s, q], "0/1" if enough(matched[s, q]) else "1/1"))
    assert {tuple(r) for r in plans.realigned_calls(placed, 2, 8).collect()} == want and any(w[3:5] == ("D", "4") for w in want)
    # depth at the loci and state runs against counts by base
    depth, states = Counter(), Counter()
    for r in rows:
        depth.update({(r["sample"], q): 2 for q in range(r["pos"], r["pos"] + r["span"])})
        at = r["pos"]
        for size, op in align._parse(r["cigar"]):
            states[r["sample"], op, at, at + (1 if op == "I" else size) - 1] += 2
            at += 0 if op == "I" else size
    loci = spark.createDataFrame([(s, 1, q) for s in "NT" for q in range(300, 750, 7)], "sample string, chr int, pos long")
    steps = placed.select("sample", "chr", F.explode(F.array(F.struct(F.col("pos"), F.col("n").alias("d")), F.struct((F.col("pos") + F.col("span")).alias("pos"), (-F.col("n")).alias("d")))).alias("x")).select("sample", "chr", "x.pos", "x.d")
    assert {(r["sample"], r["pos"]): r["ref_n"] for r in plans.depth_by_tiles(steps, loci, 64).collect()} == {(s, q): depth[s, q] for s in "NT" for q in range(300, 750, 7)}
    assert {(r["sample"], r["state"], r["start"], r["end"]): r["n"] for r in plans.state_runs(placed).collect()} == states


def test_motif_hits(spark):
    motif = "GATTACAGATCGATCCAGTACGAT"
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choices("ACGT", k=n))
    rows = [(1, noise(30) + motif + noise(200) + motif[:10] + "A" + motif[10:] + noise(20)), (2, noise(5)), (3, ""), (4, noise(50) + motif[:9] + motif[11:] + noise(9) + motif + noise(60))]
    got = {(r["id"], r["off"]): r for r in plans.profile_hits(spark.createDataFrame(rows, "id long, seq string"), motif).collect()}
    assert set(got) == {(1, 0), (1, 200), (2, 0), (4, 0)}
    assert (got[1, 0]["score"], got[1, 0]["first"], got[1, 0]["last"]) == (5 * 24, 30, 53)
    assert (got[1, 200]["score"], got[1, 200]["first"]) == (5 * 24 - 8, 254)
    assert (got[4, 0]["score"], got[4, 0]["first"]) == (5 * 24, 81) and (got[4, 0]["next_score"], got[4, 0]["next_first"]) == (5 * 22 - 9, 50)


def slow_border(read, window, b):
    """The best score of an alignment with borders, cell by cell."""
    n, low = len(read), -(1 << 14)

    def alike(i, j):
        return read[i - 1] in (window[j - 1], "N") or (b.reference_n and window[j - 1] == "N")

    @lru_cache(None)
    def m(i, j):
        return low if i == 0 or j == 0 else top(i - 1, j - 1) + (3 if alike(i, j) else b.mismatch(i, n))

    @lru_cache(None)
    def ins(i, j):
        return low if i < 2 else max(m(i - 1, j) - 15, ins(i - 1, j))

    @lru_cache(None)
    def dele(i, j):
        return low if i == 0 or j == 0 else max(m(i, j - 1) - 3, ins(i, j - 1) - 3, dele(i, j - 1))

    @lru_cache(None)
    def top(i, j):
        best = max(m(i, j), ins(i, j), dele(i, j)) if i else 0
        return max(best, 0) if i <= b.jump_in else best

    return max(max(m(i, j), ins(i, j)) for i in range(n - b.jump_out, n + 1) for j in range(len(window) + 1))


def border_path(read, window, cigar, start, b):
    """The score of a CIGAR, whose clips must lie inside the border ranges."""
    i, j, total = 0, start, 0
    for k, op in align._parse(cigar):
        if op == "M":
            total += sum(3 if read[i + x] in (window[j + x], "N") or (b.reference_n and window[j + x] == "N") else b.mismatch(i + x + 1, len(read)) for x in range(k))
        elif op == "S":
            assert (i == 0 and k <= b.jump_in) or (i + k == len(read) and k <= b.jump_out)
        else:
            total += {"I": -15, "D": -3}[op]
        i, j = i + k * (op in "MIS"), j + k * (op in "MD")
    assert i == len(read)
    return total


def test_border_alignment_equals_a_slow_matrix():
    rng = random.Random(5)
    for _ in range(300):
        window = "".join(rng.choices("ACGTN", [5, 5, 5, 5, 1], k=rng.randint(8, 40)))
        at = rng.randint(0, len(window) - 6)
        read = list(window[at : at + rng.randint(8, 20)].ljust(8, "A"))
        for _ in range(rng.randint(0, 5)):
            read[rng.randrange(len(read))] = rng.choice("ACGTN")
        if rng.random() < 0.5:
            k = rng.randrange(len(read))
            read[k : k + rng.randint(0, 2)] = rng.choices("ACGT", k=rng.randint(0, 3))
        read = "".join(read)
        b = align.Borders(rng.randint(0, 5), rng.randint(0, 5), rng.choice([-1, -4, -9]), rng.choice([-1, -4, -9]), rng.random() < 0.5)
        score, cigar, start = align.bordered(align.codes([read, read]), align.codes([window, window]), b)
        assert score[0] == score[1] == slow_border(read, window, b) == border_path(read, window, cigar[0], int(start[0]), b)
        # without borders it is the plain alignment, place and path included
        plain, gap = align.bordered(align.codes([read]), align.codes([window]), align.Borders()), align.gapped(align.codes([read]), align.codes([window]))
        assert [list(x) for x in plain] == [list(x) for x in gap]


def test_foreign_ends_are_left_out(spark):
    inner = GENOME[300:390]
    window = "N" * 50 + inner + "N" * 60
    reads = [(1, 0, "TTTTTT" + inner + "GGGGG", window), (2, 0, inner, window), (3, 0, "ACGTA", window)]
    got = {r["id"]: r for r in align.align_bordered(spark.createDataFrame(reads, "id long, off long, read string, window string"), align.Borders(10, 10, -4, -4)).collect()}
    assert (got[1]["cigar"], got[1]["start"], got[1]["score"], got[1]["n_mismatches"]) == ("6S90M5S", 50, 270, 0)
    assert (got[2]["cigar"], got[2]["start"]) == ("90M", 50)
    assert got[3]["score"] == align.gapped(align.codes(["ACGTA"]), align.codes([window]))[0][0]


def test_many_reads_are_aligned_encoded_and_rebuilt_as_one_by_one():
    rng = random.Random(5)
    base = lambda n: "".join(rng.choice("ACGTN" if rng.random() < 0.05 else "ACGT") for _ in range(n))
    windows = [base(90) for _ in range(300)]
    reads = [(w[20:34] + base(rng.randint(0, 3)) + w[34 + rng.randint(0, 4) :])[:40] for w in windows]
    read, window, borders = align.codes(reads), align.codes(windows), align.Borders(6, 5, -4, -3)
    score, cigar, start = align.gapped(read, window)
    row, at, letter = align.encode_rows(read, window, cigar, start)
    assert (align.decode_rows(window, cigar, start, 40, (row, at, letter)) == read).all()
    clipped, clips, place = align.bordered(read, window, borders)
    wrong = align.mismatches(read, window, clips, place)
    for k, (r, w) in enumerate(zip(reads, windows, strict=True)):
        one = align.gapped(read[k : k + 1], window[k : k + 1])
        assert (one[0][0], one[1][0], one[2][0]) == (score[k], cigar[k], start[k])
        assert align.encode(r, w, cigar[k], int(start[k])) == [(int(a), chr(b)) for a, b in zip(at[row == k], letter[row == k], strict=True)]
        assert clipped[k] == slow_border(r, w, borders) == border_path(r, w, clips[k], int(place[k]), borders)
        left, middle = align.unclipped(clips[k])
        assert wrong[k] == align.count_changes(r[left:], w, middle, int(place[k]))[0]
    # reads of several lengths together: what is behind a read's end doesn't count
    sizes = np.array([rng.randint(7, 40) for _ in reads])
    for of, together in ((lambda a, b: align.gapped(a, b), align.gapped(read, window, sizes)), (lambda a, b: align.bordered(a, b, borders), align.bordered(read, window, borders, sizes))):
        for k, n in enumerate(sizes):
            one = of(read[k : k + 1, :n], window[k : k + 1])
            assert (one[0][0], one[1][0], one[2][0]) == (together[0][k], together[1][k], together[2][k])


@pytest.mark.parametrize("seed", range(3))
def test_sequences_of_any_length_share_a_batch(seed):
    """Shorter sequences are filled up: best and next best place of each are those it has alone, in numbers of either width."""
    rng = np.random.default_rng(seed)
    factor = (1, 1, 2000)[seed]  # scores that need the wide numbers
    for _ in range(20):
        columns = int(rng.integers(3, 12))
        p = Profile(factor * rng.integers(-3, 5, (columns, 5)), factor * rng.integers(-6, 0, columns), factor * rng.integers(-2, 1, columns), factor * rng.integers(-3, 1, columns), np.zeros(columns, dtype=bool), "profile", -3 * factor, -factor)
        seqs = ["".join(rng.choice(list("ACGTN"), int(rng.integers(1, 14)))) for _ in range(9)]
        score, place, next_score, next_place = best_two(p, base_codes(seqs), np.array([len(s) for s in seqs]))
        for r, s in enumerate(seqs):
            own = best_two(p, base_codes([s]))
            used = frozenset((i, int(c)) for i, c in enumerate(place[r]) if c >= 0)
            assert (score[r], next_score[r]) == (own[0][0], own[2][0]) == (slow_score(p, tuple(base_codes([s])[0])), slow_score(p, tuple(base_codes([s])[0]), used))
            assert place[r][: len(s)].tolist() == own[1][0].tolist() and next_place[r][: len(s)].tolist() == own[3][0].tolist() and (place[r][len(s) :] == -1).all()


def test_motif_hits_go_in_whole_batches(spark, monkeypatch):
    """The last pieces of texts differ in length; they don't get a batch for each length."""
    seen = []
    inner = plans.profile.best_two
    monkeypatch.setattr(plans.profile, "best_two", lambda p, b, *more: (seen.append(len(b)), inner(p, b, *more))[1])
    monkeypatch.setattr(plans, "tiles", lambda *_: type("Held", (), {"where": lambda s, _: s, "select": lambda s, *_: s, "mapInPandas": lambda s, run, _: list(run(iter([pd.DataFrame({"id": range(199), "off": 0, "seq": ["A" * k for k in range(1, 200)]})])))})())
    assert sum(len(f) for f in plans.profile_hits(None, "GATTACA")) == 199 and seen == [199]
