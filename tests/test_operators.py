"""Operators and kernels against brute force on small inputs, plans, and the package's independence."""

import importlib
import os
import random
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import sequence as q
from strandlake.operators import align, coverage, haplotype, intervals, kmers
from strandlake.operators.filters import few_indels, mark_clones, on_contig, ordinal_sample
from strandlake.sources.views import contigs

ROOT = Path(__file__).resolve().parents[1]


def test_overlap_join_finds_each_pair_once(spark):
    rng = random.Random(1)
    left = [(i, rng.randint(1, 2), s, s + rng.randint(0, 90)) for i in range(60) for s in [rng.randint(0, 400)]]
    right = [(i, rng.randint(1, 2), s, s + rng.randint(0, 300)) for i in range(60) for s in [rng.randint(0, 400)]]
    a, b = spark.createDataFrame(left, "i long, chr int, s long, e long"), spark.createDataFrame(right, "j long, chr int, s2 long, e2 long")
    want = Counter((x[0], y[0]) for x in left for y in right if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    for width in (7, 1024):
        got = Counter((r["i"], r["j"]) for r in intervals.overlap_join(a, b, "s", "e", "s2", "e2", width=width).collect())
        assert got == want
    hit = {i for i, _ in want}
    assert {r["i"] for r in intervals.overlap_join(a, b, "s", "e", "s2", "e2", how="left_semi").collect()} == hit
    assert {r["i"] for r in intervals.overlap_join(a, b, "s", "e", "s2", "e2", how="left_anti").collect()} == {x[0] for x in left} - hit


def test_interval_join_is_an_equi_join(spark):
    a, b = spark.range(10).selectExpr("cast(1 as int) as chr", "id as s", "id + 5 as e"), spark.range(10).selectExpr("cast(1 as int) as chr", "id as s2", "id + 5 as e2")
    plan = intervals.overlap_join(a, b, "s", "e", "s2", "e2")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_depth_segments(spark):
    rng = random.Random(2)
    frags = [(rng.randint(1, 2), s, s + rng.randint(0, 60), rng.random() < 0.5) for s in (rng.randint(0, 300) for _ in range(80))]
    df = spark.createDataFrame(frags, "chr int, s long, e long, odd boolean")
    for tile in (16, 1 << 14):
        got = {(r["chr"], p): (r["depth"], r["part"]) for r in coverage.depth_segments(df, "s", "e", parts={"part": F.col("odd")}, tile=tile).collect() for p in range(r["seg_start"], r["seg_end"])}
        want = {}
        for c, s, e, odd in frags:
            for p in range(s, e + 1):
                d, k = want.get((c, p), (0, 0))
                want[c, p] = (d + 1, k + odd)
        assert got == want
        runs = coverage.merged_runs(coverage.depth_segments(df, "s", "e", tile=tile), tile=tile).orderBy("chr", "run_start").collect()
        assert all((a["chr"], a["run_end"], a["depth"]) != (b["chr"], b["run_start"], b["depth"]) for a, b in zip(runs, runs[1:], strict=False))
        assert sum(r["run_end"] - r["run_start"] for r in runs) == len(want)


def test_pairs_are_not_dealt_out_by_contig(spark):
    """Whatever is known of sizes, the contigs' lengths go to the pairs: by contig, a contig would be one task."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = spark.range(40).selectExpr("cast(id % 2 as int) as chr", "id as pos1", "id * 3 - 20 as pos2")
        kept = on_contig(pairs, contigs(pairs))
        assert "SortMergeJoin" not in kept._jdf.queryExecution().toString()
        assert sorted(r["pos1"] for r in kept.collect()) == list(range(7, 40))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_merged_runs_over_tiles(spark):
    rng = random.Random(8)
    segments, at = [], 1
    for _ in range(200):
        size = rng.choice([1, 3, 16, 40])
        while size:  # segments end at tiles of 16
            part = min(size, 16 - at % 16)
            segments.append((1, at, at + part, rng.choice([1, 2]) if part == size else segments[-1][3] if segments and rng.random() < 0.8 else 1))
            at, size = at + part, size - part
        at += rng.choice([0, 0, 1, 20])
    want = []
    for c, a, b, d in segments:
        if want and want[-1][2:] == (a, d):
            want[-1] = (c, want[-1][1], b, d)
        else:
            want.append((c, a, b, d))
    df = spark.createDataFrame(segments, "chr int, seg_start long, seg_end long, depth int").repartition(5)
    runs = coverage.merged_runs(df, tile=16)
    assert sorted(tuple(r) for r in runs.select("chr", "run_start", "run_end", "depth").collect()) == want
    # rows of a tile in order, and no table of its runs
    assert "HashAggregate" not in runs._jdf.queryExecution().toString()


def test_next_site_looks_across_tiles(spark):
    rng = random.Random(3)
    sites, asked = sorted({(rng.randint(1, 2), rng.randint(0, 900)) for _ in range(25)}), [(i, rng.randint(1, 3), rng.randint(0, 1000)) for i in range(80)]
    got = intervals.next_site(spark.createDataFrame(asked, "i long, chr int, at long"), spark.createDataFrame(sites, "chr int, site long"), "at", "site", "found", width=64).collect()
    assert {r["i"]: r["found"] for r in got} == {i: min((s for c2, s in sites if c2 == c and s >= p), default=None) for i, c, p in asked}


def test_clones_compare_with_the_previous_row_even_if_dropped(spark):
    rows = [("s", 1, "p", 10, 50, u, i, 0, 0, 0) for i, u in enumerate(["AAAA", "AAAC", "AACC", "GGGG"])] + [("s", 1, "p", 50, 10, "GGGG", 9, 0, 0, 0)]
    df = spark.createDataFrame(rows, "sample string, chr int, klass string, pos1 long, pos2 long, umi string, l_partkey long, l_suppkey long, l_orderkey long, l_linenumber long")
    got = {r["l_partkey"]: r["is_clone"] for r in mark_clones(df).collect()}
    assert got == {0: False, 1: True, 2: True, 3: False, 9: True}
    assert [r["is_clone"] for r in mark_clones(df, use_umi=False).orderBy("l_partkey").collect()] == [False, True, True, True, True]


def test_sequence_functions(spark):
    row = lambda *cols: spark.range(1).select(*cols).first()
    assert row(q.revcomp(F.lit("ACGTNx")), q.revcomp_iupac(F.lit("ACGTRnz")), q.canonical(F.lit("TTA")), q.kmer_code(F.lit("ACGT"), 4), q.kmer_code(F.lit("ACNT"), 4)) == ("NNACGT", "NnYACGT", "TAA", 27, None)
    assert row(q.header_ordinal(F.lit("@12@x")), q.header_umi(F.lit("@ACGTAC:x")), q.header_umi(F.lit("@ACG:x")), q.shared_header(F.lit("a/1"), F.lit("a/2")), q.shared_header(F.lit("a/1"), F.lit("b/2"))) == (12, "ACGTAC", None, "a/", None)
    assert row(q.valid_quality_length(F.lit("II##")), q.valid_quality_length(F.lit("###")), q.rebased_quality(F.lit("CBD")), q.compact_header(F.lit("@a:b:c:d:e:f:g"))) == (2, 1, "$#%", "c:d:e:f:g")
    cigar = q.cigar_parse(F.lit("10M2D3I5S"))
    assert row(q.cigar_text(cigar), q.reference_span(cigar), F.size(q.expand_cigar(cigar)), few_indels(cigar), few_indels(q.cigar_parse(F.lit("9M41D9M")))) == ("10M2D3I5S", 17, 20, True, False)
    assert row(q.chromosome_number(F.lit("chrX")), q.chromosome_number(F.lit("MT")), q.chromosome_number(F.lit("7")), q.chromosome_number(F.lit("GL1"))) == (23, 25, 7, None)
    assert row(q.translate_codons(F.lit("ATGGCCTAAG")), q.translate_codons(F.lit("AT")), q.translate_codons(F.lit("NNNATG"))) == ("MA*", "", "XM")
    assert row(q.apply_mismatches(F.lit("AAAA"), F.array(F.struct(F.lit(1).alias("pos"), F.lit("C").alias("nt")))), q.sam_flag(2, F.lit(2), F.lit(True), F.lit(False))) == ("ACAA", 0x83 + 0x100 + 0x10)
    with pytest.raises(ValueError):
        ordinal_sample(F.col("x"), 1, [0])


def test_exploded_kmers(spark):
    rng = random.Random(5)
    seqs = [(i, "".join(rng.choices("ACGT", k=n))) for i, n in enumerate([0, 3, 11, 256, 266, 267, 1000, 3000])]
    for step in (1, 12):
        got = sorted(tuple(r) for r in kmers.explode_kmers(spark.createDataFrame(seqs, "id int, seq string"), "seq", 11, ("id",), step).collect())
        assert got == sorted((i, k, s[k : k + 11]) for i, s in seqs for k in range(0, len(s) - 10, step))


def test_packed_kmers_of_pieces_and_other_letters(spark, monkeypatch):
    rng = random.Random(6)
    seqs = [(i, "".join(rng.choices("ACGTN", (9, 9, 9, 9, 0.2), k=n))) for i, n in enumerate([0, 3, 11, 12, 13, 300, 40, 900])]
    every = [(i, k, s[k : k + 12]) for i, s in seqs for k in range(len(s) - 11)]
    monkeypatch.setattr(kmers, "STEP", 100)
    got = [(int(r), int(o), part[a : a + 12].tobytes().decode(), bool(c)) for rows, offs, part, at, clean in kmers.windows([s for _, s in seqs], 12) for r, o, a, c in zip(rows, offs, at, clean, strict=True)]
    assert got == [(i, k, x, "N" not in x) for i, k, x in every]
    digits = np.array([rng.randrange(4) for _ in range(60)])
    for k in (1, 2, 7, 11, 16, 31):
        assert kmers.packed(digits, k).tolist() == [sum(int(d) * 4 ** (k - 1 - n) for n, d in enumerate(digits[i : i + k])) for i in range(61 - k)]
        assert kmers.packed(digits, k, reverse=True).tolist() == [sum(int(d) * 4**n for n, d in enumerate(digits[i : i + k])) for i in range(61 - k)]
    table = spark.createDataFrame(seqs[::-1] + seqs[3:], "id long, seq string")
    counted = kmers.code_counts(table, 12, others=True).select(F.coalesce("other", kmers.kmer_text(F.col("code"), 12)), "cnt").collect()
    want = {}
    for i, _, x in every:
        want[x] = want.get(x, 0) + (2 if i >= 3 else 1)
    assert {tuple(r) for r in counted} == set(want.items())
    short = {}
    for i, s in seqs:
        for k in range(len(s) - 2):
            short.setdefault(s[k : k + 3], []).append((i, k))
    found = kmers.first_places(spark.createDataFrame(seqs[::-1], "id long, seq string"), 3, 4).collect()
    assert sorted(tuple(r) for r in found) == sorted((x, n, i, k) for x, at in short.items() for n, (i, k) in enumerate(sorted(at)[:4], 1))


def slow_score(read, window):
    """Affine semi-global score, cell by cell."""
    low = -(1 << 20)
    n, w = len(read), len(window)
    m, a, d = ([[low] * (w + 1) for _ in range(n + 1)] for _ in range(3))
    m[0] = [0] * (w + 1)
    for j in range(1, w + 1):
        d[0][j] = max(m[0][j - 1] + align.DELETE, d[0][j - 1])
    for i in range(1, n + 1):
        for j in range(w + 1):
            if j:
                m[i][j] = max(m[i - 1][j - 1], a[i - 1][j - 1], d[i - 1][j - 1]) + (align.MATCH if read[i - 1] == window[j - 1] else align.MISMATCH)
            if i > 1:
                a[i][j] = max(m[i - 1][j] + align.INSERT, a[i - 1][j])
            if j:
                d[i][j] = max(m[i][j - 1] + align.DELETE, a[i][j - 1] + align.DELETE, d[i][j - 1])
    return max(max(m[n]), max(a[n]))


def test_gapped_alignment():
    rng = random.Random(6)
    for _ in range(25):
        window = "".join(rng.choices("ACGT", k=60))
        read = list(window[10:45])
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(5, len(read) - 5)
            if rng.random() < 0.4:
                del read[k : k + rng.randint(1, 4)]
            elif rng.random() < 0.5:
                read[k:k] = rng.choices("ACGT", k=rng.randint(1, 3))
            else:
                read[k] = rng.choice("ACGT")
        read = "".join(read)
        score, cigar, start = align.gapped(align.codes([read]), align.codes([window]))
        assert score[0] == slow_score(read, window)
        changes = align.encode(read, window, cigar[0], int(start[0]))
        assert align.decode(window, cigar[0], int(start[0]), changes) == read


def test_ungapped_takes_the_first_of_equal_shifts():
    at, wrong = align.ungapped(align.codes(["AAAA"]), align.codes(["A" * 35]))
    assert (at[0], wrong[0]) == (-16, 0)
    at, wrong = align.ungapped(align.codes(["CNGT"]), align.codes(["A" * 18 + "CAGT" + "A" * 13]))
    assert (at[0], wrong[0]) == (2, 0)


def test_overlap_and_clipping():
    rng = random.Random(8)
    insert = "".join(rng.choices("ACGT", k=70))
    other = insert[::-1].translate(str.maketrans("ACGT", "TGCA"))
    tail = "".join(rng.choices("ACGT", k=30))
    assert align.overlap(insert + tail, other + tail) == 70
    assert align.overlap("".join(rng.choices("ACGT", k=100)), "".join(rng.choices("ACGT", k=100))) == 0
    assert align.clip_end("A" * 100, "I" * 60 + "#" * 40, list(range(50, 70))) == 58
    assert align.clip_end("A" * 100, "I" * 100, [1, 2]) == 100 and align.clip_end("A" * 100, "#" * 100, list(range(20))) == 32


def test_haplotype_merging():
    assert haplotype.merge_groups(Counter({"GT": 10, "G ": 2, "AT": 3, " T": 1})) == Counter({"GT": 12, "AT": 3, " T": 1})
    big = Counter({"AAAAAA": 50, "AAAAAC": 1, "CCCCCC": 30})
    assert haplotype.merge_groups(big) == Counter({"AAAAAA": 51, "CCCCCC": 30})


def test_flagship_plan_prunes_and_pushes_down(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_extendedprice" not in plan and "Python" not in plan


def test_nothing_outside_imports_the_llm_subpackage(tmp_path):
    for path in (ROOT / "strandlake").rglob("*.py"):
        if "llm" not in path.parts:
            assert "strandlake.llm" not in path.read_text(), path
    bare = tmp_path / "bare"  # the repository as it is without those folders
    shutil.copytree(ROOT, bare, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k[:2] == 'op' and k[2].isdigit() or k == 'pipeline' for k in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=bare, capture_output=True, text=True, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}).stdout.split()
    assert int(out[0]) > 50 and out[1] == "False"
    assert importlib.import_module("__spark_entry__").oracle_sql().keys() <= importlib.import_module("__spark_entry__").queries().keys()


def test_codes_need_equal_lengths():
    with pytest.raises(ValueError):
        align.codes(["AC", "ACG"])
    assert align.codes(["AC", "GT"]).shape == (2, 2) and np.issubdtype(align.codes(["AC"]).dtype, np.uint8)


def test_alike_reads_are_cut_once_and_exons_never_meet_sites(spark):
    """The 48-mers of reads and the exons of sites are those of brute force, and no plan makes the bases or the exons of a site one by one."""
    from strandlake.plans import peptides

    rng = random.Random(31)
    base = lambda c, p: "ACGT"[(c * 7 + p * 13 + p // 5) % 4]
    reads = [(rng.choice("NT"), rng.randint(1, 3), rng.choice((1, 26, 51)), rng.choice((40, 60, 95)), k := rng.choice("pmN"), rng.randrange(40), rng.choice("ACGT")) for _ in range(300)]
    want = {}
    for sample, chrom, pos, n, k, off, nt in reads:
        s = "".join(nt if k == "m" and i == off else base(chrom, pos + i) for i in range(n))
        for i in range(n - 47):
            want[sample, s[i : i + 48]] = want.get((sample, s[i : i + 48]), 0) + 1
    table = spark.createDataFrame(reads, "sample string, chr int, pos1 long, len1 long, klass string, mm_off int, mm_nt string")
    counted = peptides.read_kmers(table)
    assert sorted(map(tuple, counted.collect())) == sorted((*k, n) for k, n in want.items() if n >= 2)
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "repeat(" not in plan[plan.rindex("Aggregate") :]  # under the counting no bases are made
    exons = [(i, rng.randint(1, 2), a, a + rng.randint(-1, 300)) for i in range(200) for a in [rng.randint(1, 3000)]]
    sites = [(c, p, "A") for c in (1, 2, 3) for p in range(5, 3300, 61)]
    found = peptides.exon_counts(spark.createDataFrame(sites, "chr int, pos long, alt string"), spark.createDataFrame(exons, "feature_id long, chr int, start long, end long"))
    inside = {(c, p, x): sum(d == c and a <= p <= b for _, d, a, b in exons) for c, p, x in sites}
    assert sorted(map(tuple, found.collect())) == sorted((*k, n) for k, n in inside.items() if n)
