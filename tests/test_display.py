"""Displays, gates, validation and window regions against rules written out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.sources import views as v
from strandlake.operators import display, haplotype, pileup, validation


def cells(text):
    out, n = [], ""
    for x in text:
        if x.isdigit():
            n += x
        else:
            out.append((int(n), x))
            n = ""
    return out


def test_reads_on_the_reference(spark):
    rows = [("ACGTACGTAC", "10M"), ("ACGTACGTAC", "4M2D6M"), ("ACGTACGTAC", "4M3I3M"), ("ACGTACGTAC", "2I8M"), ("ACGTACGTAC", "3S7M"), ("", "")]
    want = ["ACGTACGTAC", "ACGT__ACGTAC", "ACG*TAC", "*GTACGTAC", "ACGTACGTAC", ""]
    df = spark.createDataFrame([(i, s, cells(c)) for i, (s, c) in enumerate(rows)], "i int, seq string, cigar array<struct<n: int, op: string>>")
    assert [r["x"] for r in df.select("i", display.laid_out(F.col("seq"), F.col("cigar")).alias("x")).orderBy("i").collect()] == want


def test_reads_without_clips(spark):
    rows = [("ACGTACGTAC", "2S4M1I3M", [(4, "T")]), ("ACGTACGTAC", "3M2D5M", []), ("ACGT", "4M", [(0, "T"), (3, "C")])]
    df = spark.createDataFrame([(i, s, cells(c), m) for i, (s, c, m) in enumerate(rows)], "i int, ref string, cigar array<struct<n: int, op: string>>, mm array<struct<pos: int, nt: string>>")
    assert [r["x"] for r in df.select("i", display.without_clips(F.col("ref"), F.col("cigar"), F.col("mm")).alias("x")).orderBy("i").collect()] == ["NNGTTCNGTA", "ACGCGTAC", "TCGC"]


def test_trim_entries_and_lengths(spark):
    rng = random.Random(2)
    rows = [(i, *[rng.choice([0, 1, 20, 21, 30]) for _ in range(4)], *[rng.choice([0, 0, 3]) for _ in range(4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, c0 int, c1 int, c2 int, c3 int, n0 int, n1 int, n2 int, n3 int")
    got = {r["i"]: r["v"] for r in df.select("i", display.valid_trim([F.col(f"c{k}") for k in range(4)], [F.col(f"n{k}") for k in range(4)]).alias("v")).collect()}
    for i, *x in rows:
        c, n = x[:4], x[4:]
        assert got[i] == (not any(a == 0 and b for a, b in zip(c, n, strict=True)) and not (c[0] > 20 and c[2] > 20) and not (c[1] > 20 and c[3] > 20))
    gates = spark.createDataFrame([(n,) for n in (0, 17, 18, 31, 32, 100)], "n int").select("n", display.length_gate(F.col("n")).alias("g")).orderBy("n").collect()
    assert [r["g"] for r in gates] == ["none", "none", "direct", "direct", "gapped", "gapped"]


def test_best_and_alternate(spark):
    kind = "id int, chr int, pos1 long, pos2 long, score int, rank int"
    rows = [(1, 1, 100, 300, 9, 1), (1, 1, 100, 200, 9, 2), (2, 1, 100, 300, 9, 1), (2, 2, 100, 300, 9, 2), (3, 1, 100, 300, 9, 1), (3, 1, 500, 700, 8, 2), (4, 1, 5, 6, 1, 1), (5, 1, 100, 200, 9, 1), (5, 1, 200, 500, 9, 2)]
    got = {r["id"]: (r["chr"], r["pos1"], r["pos2"], r["alt_chr"], r["n_matches"]) for r in display.best_and_alternate(spark.createDataFrame(rows, kind), ["id"]).collect()}
    assert got == {1: (1, 100, 200, None, 1), 2: (1, 100, 300, 2, 2), 3: (1, 100, 300, None, 1), 4: (1, 5, 6, None, 1), 5: (1, 100, 200, None, 1)}


def test_runs_of_good_bases(spark):
    rng = random.Random(3)
    quals = ["", "#", "I", "".join(rng.choices("#$,5FI", k=60)), "I" * 30, "#" * 5 + "I" * 5 + "#" + "I"]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(quals)], "i int, q string")
    for least in (0, 2, 10, 40):
        got = {r["i"]: [tuple(x) for x in r["r"]] for r in df.select("i", pileup.good_runs(F.col("q"), least).alias("r")).collect()}
        for i, q in enumerate(quals):
            good = [ord(x) - 35 >= least for x in q]
            want = [(a, b) for a in range(len(q)) for b in range(a, len(q)) if all(good[a : b + 1]) and (a == 0 or not good[a - 1]) and (b == len(q) - 1 or not good[b + 1])]
            assert got[i] == want


@pytest.mark.parametrize("least", [0, 12])
def test_spans_of_good_bases_in_the_fragment(spark, least):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        p1, d, n1, n2 = rng.randint(50, 90), rng.randint(-30, 60), rng.randint(10, 30), rng.randint(10, 30)
        rev = rng.random() < 0.5
        a, b = (p1 + d, p1 + n1 - 1) if rev else (p1, p1 + d + n2 - 1)
        rows.append((i, p1, n1, rev, "".join(rng.choices("#,5F", k=n1)), p1 + d, n2, not rev, "".join(rng.choices("#,5F", k=n2)), a, b))
    df = spark.createDataFrame(rows, "i int, pos1 long, len1 int, rev1 boolean, qual1 string, pos2 long, len2 int, rev2 boolean, qual2 string, frag_start long, frag_end long")
    got = sorted((r["i"], p, r["rev"]) for r in pileup.good_spans(df, least, ("i",)).collect() for p in range(r["s"], r["e"] + 1))
    want = []
    for i, p1, n1, r1, q1, p2, n2, r2, q2, a, b in rows:
        for p, n, rev, q, second in ((p1, n1, r1, q1, False), (p2, n2, r2, q2, True)):
            for k in range(n):
                at = p + n - 1 - k if rev else p + k
                if ord(q[k]) - 35 >= least and a <= at <= b and not (second and p1 <= at < p1 + n1):
                    want.append((i, at, rev))
    assert got == sorted(want)


def test_genotypes_of_two_samples(spark):
    rows = [(1, 10, "A", "C", 5, 30, True, True, 12, 3, True, False), (1, 10, "A", "G", 0, 30, False, True, 9, 3, True, False), (1, 20, "T", "C", 0, 20, False, True, 15, 0, True, False)]
    df = spark.createDataFrame(rows, "chr int, pos long, ref string, allele string, n long, n_ref long, n_ok boolean, n_ref_ok boolean, t long, t_ref long, t_ok boolean, t_ref_ok boolean")
    got = {r["pos"]: r["line"].split("\t") for r in validation.two_sample_lines(df, ("n", "t"), 8).collect()}
    assert got[10][3:5] == ["A", "C,G"] and got[10][7] == "SOMATIC" and got[10][9:] == ["0/1:35:30,5,0", "1/2:24:3,12,9"]
    assert got[20][7] == "SOMATIC" and got[20][9:] == ["0/0:20:20,0", "1/1:15:0,15"]


def test_regions_of_windows(spark):
    columns = spark.createDataFrame([(1, c) for c in (3, 4, 9)] + [(2, 0)], "win long, col long")
    called = spark.createDataFrame([(1, 20, ".G.,.GA,T..", "9,6,3", 2), (2, 8, ".,C", "5,3", 0)], "win long, n_reads long, haps string, counts string, trash long")
    got = {(r["win"], r["first_col"]): r for r in haplotype.region_calls(called, columns).collect()}
    assert got.keys() == {(1, 4), (1, 9), (2, 0)}
    a, b, c = got[1, 4], got[1, 9], got[2, 0]
    assert (a["alleles"], a["gt"], a["ad"], a["unexplained"]) == ("G/G", "1/1", "3,15", True)
    assert (b["alleles"], b["gt"], b["ad"], b["dp"], b["freqs"], b["unexplained"]) == ("./A", "0/1", "12,6", 20, "45,30,15", False)
    assert (c["alleles"], c["gt"], c["ad"], c["n_haps"]) == ("./C", "0/1", "5,3", 2)


def test_bases_of_the_genome_are_those_base_by_base(spark):
    rows = spark.range(0, 3000).selectExpr("cast(id % 24 + 1 as int) as chr", "id * 7 as pos", "cast(id % 130 as int) as n")
    got = rows.selectExpr("chr", "pos", "n", f"{v.bases_at('pos', 'n')} as seq").collect()
    assert all(r["seq"] == "".join("ACGT"[(r["chr"] * 7 + p * 13 + p // 5) % 4] for p in range(r["pos"], r["pos"] + r["n"])) for r in got)
    assert "transform" not in v.bases_at("pos", "n")
