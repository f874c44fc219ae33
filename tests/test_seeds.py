"""Seed lookup of both strands and pairing of mates against brute force."""

import random
from collections import Counter

import numpy as np

from strandlake.operators import kmers
from strandlake.plans import kmer


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def looked_up(read, table):
    hits = [(False, k, *table[x]) for k in range(len(read) - 17) if (x := read[k : k + 18]) in table]
    hits += [(True, k, *table[x]) for k in range(len(read) - 17) if (x := rc(read[k : k + 18])) in table]
    return [(*h, n) for n, h in enumerate(sorted(hits)[:16], 1)]


def test_seeds_of_both_strands_and_pairs_on_opposite_ones(spark):
    rng = random.Random(21)
    contigs = [(c, "".join(rng.choices("ACGT", k=900))) for c in (1, 2)]
    contigs[1] = (2, contigs[1][1] + contigs[0][1][:60])
    seen = Counter(s[k : k + 18] for _, s in contigs for k in range(len(s) - 17))
    table = {s[k : k + 18]: (c, k + 1) for c, s in contigs for k in range(len(s) - 17) if s[k] == "A" and seen[s[k : k + 18]] == 1}
    texts = [(1, contigs[0][1][50:700]), (2, rc(contigs[1][1][100:600])), (3, contigs[0][1][:90] + rc(contigs[1][1][300:420])), (4, "")]
    # the residual bases differ: no hit
    first = next(x for x in table if x[:16] + "TT" not in table and x[:16] + "TT" not in seen)
    texts.append((5, first[:16] + "TT"))
    seeds = kmers.seed_table(spark.createDataFrame(contigs, "chr long, seq string"))
    sequences = spark.createDataFrame(texts, "id long, seq string")
    got = sorted(tuple(r) for r in kmers.strand_hits(sequences, seeds).collect())
    assert got == sorted((i, *h) for i, s in texts for h in looked_up(s, table))
    assert {i for i, rev, *_ in got if rev} >= {2}
    want = []
    for i, s in texts:
        for at in range(0, len(s), 200):
            one, two = looked_up(s[at : at + 100], table), looked_up(rc(s[at + 100 : at + 200]), table)
            pairs = [(3 * n1 + 2 * n2, p1, p2, c1) for r1, _, c1, p1, n1 in one for r2, _, c2, p2, n2 in two if c1 == c2 and r1 != r2 and abs(p1 - p2) <= 1023]
            want += [(i, at, c, p1, p2, x, k) for k, (x, p1, p2, c) in enumerate(sorted(pairs, reverse=True)[:16], 1)]
    assert want and sorted(tuple(r) for r in kmer._paired(sequences, seeds).collect()) == sorted(want)


def test_pairs_are_mapped_back(spark):
    """Simulated pairs come back to where they are from: by seeds, by rescue of the second mate, or alone."""
    from strandlake.operators import mapper
    from strandlake.plans import kernels

    rng = random.Random(21)
    contigs = spark.createDataFrame([(c, "".join(rng.choices("ACGT", k=n))) for c, n in ((1, 900), (2, 5200), (3, 160))], "chr long, seq string")
    pairs = kernels._simulated_pairs(contigs).cache()
    cases = {(r["from_chr"], r["at"]): r for r in pairs.collect()}
    got = {(r["from_chr"], r["at"]): r for r in mapper.map_pairs(pairs, contigs, ["from_chr", "at"]).collect()}
    assert got.keys() == cases.keys()
    seen = set()
    for key, r in got.items():
        kind, chrom, at = key[1] // 40 % 5, key[0], key[1] + 1
        if kind == 4:
            assert r["family"] in ("HM", "UM") and (r["family"] == "UM" or (r["chr1"], r["pos1"], r["rev1"], r["chr2"]) == (chrom, at, False, None))
        elif r["chr1"] is not None:
            last = at + cases[key]["ins_len"] - 1
            assert (r["chr1"], r["pos1"], r["rev1"], r["cigar1"], r["chr2"], r["rev2"]) == (chrom, at, False, "70M", chrom, True), (key, r)
            better = kind == 3 and "D" in r["cigar2"] and r["score"] >= 2 * 210 - 4 * 6  # a long deletion that saves a change near the end
            assert better or r["cigar2"] == "70M" and r["pos2"] == last - 69 or kind == 2 and "D" in r["cigar2"] and abs(r["pos2"] - (last - 71)) <= 2, (key, r)
            assert better or r["family"] == {0: "p", 1: "m", 2: "g", 3: "m"}[kind] and r["n_matches"] == 1
        seen.add((kind, r["family"]))
    assert {(0, "p"), (1, "m"), (2, "g"), (3, "m"), (4, "HM")} <= seen
    assert sum(r["family"] == "UM" for r in got.values()) < 0.1 * len(got)


def test_mates_apart_and_equal_places(spark):
    from strandlake.functions.sequence import revcomp  # noqa: F401
    from strandlake.operators import mapper

    rng = random.Random(22)
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    one, two = ("".join(rng.choices("ACGT", k=6000)) for _ in range(2))
    contigs = spark.createDataFrame([(1, one), (2, two)], "chr long, seq string")
    rows = [(1, one[100:170], turn(one[4000:4070])), (2, one[200:270], turn(two[300:370])), (3, one[500:570], one[600:670]), (4, "AC" * 35, "GT" * 35), (5, one[50:60], one[70:80]), (6, one[1000:1070], turn(one[1100:1170]))]
    got = {r["id"]: r for r in mapper.map_pairs(spark.createDataFrame(rows, "id long, seq1 string, seq2 string"), contigs, ["id"]).collect()}
    assert [got[i]["family"] for i in range(1, 7)] == ["C", "C", "C", "UM", "UM", "p"]
    assert (got[2]["chr1"], got[2]["pos1"], got[2]["chr2"], got[2]["pos2"], got[2]["rev2"]) == (1, 201, 2, 301, True)


def test_few_rows_reach_the_lookup_and_none_is_lost(spark):
    """Tasks keep the 18-mers that may be seeds; other letters match as they are, and N on the other strand."""
    rng = random.Random(23)
    other = lambda s: "".join({"A": "T", "C": "G", "G": "C", "T": "A"}.get(x, "N") for x in reversed(s))
    contig = "".join(rng.choices("ACGT", k=3000)) + "AC" + "N" * 3 + "".join(rng.choices("ACGT", k=30)) + "ARG" + "".join(rng.choices("ACGT", k=40))
    seen = Counter(contig[k : k + 18] for k in range(len(contig) - 17))
    table = {contig[k : k + 18]: (1, k + 1) for k in range(len(contig) - 17) if contig[k] == "A" and seen[contig[k : k + 18]] == 1}
    assert any("N" in x for x in table) and any("R" in x for x in table)
    seeds = kmers.seed_table(spark.createDataFrame([(1, contig)], "chr long, seq string")).cache()
    assert {(r["kmer"], r["chr"], r["pos"]) for r in seeds.select(kmers.seed_text(seeds["code"], seeds["other"]).alias("kmer"), "chr", "pos").collect()} == {(x, *p) for x, p in table.items()}
    texts = [(k, "".join(rng.choices("ACGT", k=100))) for k in range(300)] + [(300, contig[-90:]), (301, other(contig[-90:])), (302, contig[500:560]), (303, "A" * 17), (304, contig[2990:3030])]
    reads = spark.createDataFrame(texts, "id long, seq string")
    want = []
    for i, s in texts:
        hits = [(False, k, *table[x]) for k in range(len(s) - 17) if (x := s[k : k + 18]) in table] + [(True, k, *table[x]) for k in range(len(s) - 17) if (x := other(s[k : k + 18])) in table]
        want += [(i, *h, n) for n, h in enumerate(sorted(hits)[:16], 1)]
    assert {i for i, *_ in want} >= {300, 301, 302, 304}
    assert sorted(tuple(r) for r in kmers.strand_hits(reads, seeds).collect()) == sorted(want)
    passed = kmers._placed(reads, ("id",), (False, True), kmers._filled(seeds)).where("code >= 0").count()
    assert passed <= len(want) + 120 < kmers._placed(reads, ("id",), (False, True)).count() / 10


def test_first_places_of_repeated_ids_and_of_settled_kmers(spark, monkeypatch):
    """Places of sequences with one id are told by offset; k-mers that the first sequences settle aren't sent on, and nothing is lost."""
    rng = random.Random(24)
    rows = [(rng.randrange(60) if k % 9 == 0 else 100 + k, "".join(rng.choices("ACGT" if k % 5 else "ACGTNR", k=rng.choice((0, 2, 40, 300))))) for k in range(200)]
    rows += [(5, "TTTTT" + "ACG" * 9), (5, "ACG" * 9)]
    found = {}
    for i, s in rows:
        for k in range(len(s) - 2):
            found.setdefault(s[k : k + 3], []).append((i, k))
    want = sorted((x, x < "".join({"A": "T", "C": "G", "G": "C", "T": "A"}.get(b, "N") for b in x[::-1]), n, i, k) for x, at in found.items() for n, (i, k) in enumerate(sorted(at)[:4], 1))
    tables = [spark.createDataFrame(r, "id long, seq string").coalesce(n) for r, n in ((sorted(rows), 1), (sorted(rows), 3), (rows, 3))]
    for many, step in ((1 << 15, 1 << 20), (10, 1 << 20), (10, 256)):
        for table in tables:
            monkeypatch.setattr(kmers, "MANY", many, raising=False)
            monkeypatch.setattr(kmers, "STEP", step)
            assert sorted(tuple(r) for r in kmers.first_places(table, 3, 4).collect()) == [(x, n, i, k) for x, _, n, i, k in want]
            assert sorted(tuple(r) for r in kmers.place_slots(table, 3, 4).collect()) == want
    cut, bits = kmers._settled(tables[0], 3, 4)
    settled = {"".join("ACGT"[c >> s & 3] for s in (4, 2, 0)) for c, b in enumerate(np.unpackbits(bits)) if b}
    assert settled == {x for x, at in found.items() if set(x) <= set("ACGT") and sum(i <= cut for i, _ in at) >= 4} and settled


def test_contig_hits_are_the_hits_on_the_seed_table(spark):
    rng = random.Random(25)
    contigs = [(c, "".join(rng.choices("ACGT" if c % 2 else "ACGTR", (9, 9, 9, 9) if c % 2 else (30, 30, 30, 30, 1), k=1500))) for c in range(1, 7)]
    contigs.append((7, contigs[0][1][100:400] + "".join(contigs[1][1][5:22] + x for x in "ACGTNRACGTK") + "A" * 60))
    reads = [(-c, k, s[k : k + 90] if k % 3 else s[k : k + 90][::-1].translate(str.maketrans("ACGT", "TGCA"))) for c, s in contigs for k in range(0, len(s), 70)] + [(9, 0, ""), (9, 1, "A" * 17)]
    table, texts = spark.createDataFrame(contigs, "chr long, seq string"), spark.createDataFrame(reads, "id long, at int, seq string").repartition(3)
    want = sorted(map(tuple, kmers.strand_hits(texts, kmers.seed_table(table), ("id", "at")).collect()))
    assert len(want) > 500 and sorted(map(tuple, kmers.contig_hits(texts, table, ("id", "at")).collect())) == want


def test_places_are_aligned_once(spark):
    """Aligning is most of the work: the plan has it once for seeded places and once for rescued mates."""
    from strandlake.operators import mapper

    contigs = spark.createDataFrame([(1, "ACGT" * 60)], "chr long, seq string")
    plan = mapper.map_pairs(spark.createDataFrame([(1, "ACGT" * 9, "ACGT" * 9)], "id long, seq1 string, seq2 string"), contigs, ["id"])._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") + plan.count("MapInPandas") <= 4
