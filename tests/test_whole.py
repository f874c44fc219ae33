"""Plans over whole texts against brute force: nothing behind a prefix, a cap or a stride is left out."""

import random
import re
from collections import Counter

import pytest

from strandlake.functions.sequence import AMINO_ACIDS
from strandlake.operators import align, kmers
from strandlake.operators import reads as rd
from strandlake.plans import calls, coverage, hic, kernels, kmer, pairs
from strandlake.plans import reads as plan_reads
from strandlake.sources import views as v

FOLDER = "/root/testdata/sf0.001"


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    return [(i, "".join(rng.choices("ACGT", k=n))) for i, n in enumerate([0, 1, 33, 60, 100, 101, 199, 256, 257, 700, 1531])]


@pytest.fixture(scope="module")
def seqs(spark, texts):
    return spark.createDataFrame(texts, "id long, seq string")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def simulated(texts):
    """(id, off, read, window) of reads from every 100th base."""
    for i, s in texts:
        for off in range(0, len(s), 100):
            here = s[off : off + 223]
            k = 20 + i % 30
            window = (("N" * 33 + s)[off : off + 256]).ljust(256, "N")
            yield i, off, (here[:k] + "ACGT"[i % 4] + here[k + 1 + i % 5 :][:200])[:100], window


def test_reads_cover_whole_texts(seqs, texts):
    assert rows(kernels._reads(seqs), "id", "off", "read", "window") == sorted(simulated(texts))


def test_alignments_of_whole_texts(seqs, texts):
    got = {(r["id"], r["off"]): r for r in align.align_pairs(kernels._reads(seqs)).collect()}
    placed = {(r["id"], r["off"]): (r["shift"], r["n_mismatches"]) for r in kernels._shifts(kernels._reads(seqs)).collect()}
    want = list(simulated(texts))
    assert got.keys() == placed.keys() == {(i, off) for i, off, _, _ in want}
    for i, off, read, window in want:
        score, cigar, start = align.gapped(align.codes([read]), align.codes([window]))
        r = got[i, off]
        assert (r["score"], r["cigar"], r["start"], r["rebuilt"]) == (score[0], cigar[0], start[0], True)
        wrong = {s: sum(a != b for a, b in zip(read, window[32 + s :], strict=False)) for s in range(-16, 16)}
        best = min(wrong.values())
        assert placed[i, off] == (min(s for s, w in wrong.items() if w == best), best)


def test_overlaps_and_clips_of_whole_texts(seqs, texts):
    overlaps, clips = [], []
    for i, s in texts:
        size = 60 + i % 60
        for off in range(0, len(s), size):
            ins, tail = s[off : off + size], s[off + 149 : off + 199]
            overlaps.append((i, off, align.overlap((ins + tail)[:100], (rc(ins) + tail)[:100])))
        for off in range(0, len(s), 100):
            read, ref, qual = s[off : off + 60] + s[off + 199 : off + 239], s[off : off + 100], "I" * (50 + i % 40) + "#" * (50 - i % 40)
            wrong = [k for k, (a, b) in enumerate(zip(read, ref, strict=False)) if a != b]
            clips.append((i, off, len(wrong), align.clip_end(read, qual[: len(read)], wrong)))
    assert rows(kernels._overlaps(seqs), "id", "off", "align_len") == sorted(overlaps)
    assert rows(kernels._clips(seqs), "id", "off", "n_mismatches", "kept") == sorted(clips)
    assert any(n for _, _, n in overlaps) and any(n > 8 for _, _, n, _ in clips)


def translated(s):
    return "".join(AMINO_ACIDS[16 * "TCAG".index(s[k]) + 4 * "TCAG".index(s[k + 1]) + "TCAG".index(s[k + 2])] for k in range(0, len(s) - 2, 3))


def test_frames_and_codons_of_whole_texts(spark, texts, seqs):
    late = [(50, "C" * 700 + "ATG" + "GCC" * 30 + "TAA" + "C" * 10), (51, "ATG" + "GCC" * 250), (52, "ATGGCCATG" + "GCC" * 30 + "TGA")]
    want = {}
    for i, s in texts + late:
        for at in (m.start() for m in re.finditer("(?=ATG)", s)):
            peptide = translated(s[at:]).split("*")[0]
            if len(peptide) >= 20:
                want.setdefault((i, at + 3 * len(peptide)), (i, at, peptide))
    got = rows(rd.open_frames(spark.createDataFrame(texts + late, "id long, seq string")), "id", "start", "peptide")
    assert got == sorted(want.values())
    assert {(50, 700), (51, 0), (52, 0)} <= {(i, at) for i, at, _ in got}
    assert rows(rd.codon_phases(seqs), "id", "phase", "peptide") == sorted((i, p, translated(s[p:])) for i, s in texts for p in range(3))


def trimmed(seq, qual, mate):
    """The rule base by base."""
    adapter, n = rd.ADAPTER, len(seq)
    at = next((p - k for k in (0, 1, 2) if (p := seq.rfind(adapter[k : k + 6])) - k >= 0), -1)
    most = min(n - at, len(adapter))
    if at < 40 or (most > 6 and 6 + sum(seq[at + j : at + j + 1] == adapter[j : j + 1] for j in range(6, most + 1)) + 2 < most):
        at = next((n - k for k in (5, 4, 3, 2, 1) if seq.endswith(adapter[:k])), n)
    kept, q = seq[:at], qual[:at] if 40 <= at < n else qual
    return (rc(kept), q[::-1], at < n) if mate == 2 else (kept, q, at < n)


@pytest.mark.parametrize("mate, longest", [(1, 100), (2, 60)])
def test_trimmed_reads_of_whole_texts(spark, seqs, mate, longest):
    reads = plan_reads._with_adapter(seqs)
    rng = random.Random(3)
    a = rd.ADAPTER
    odd = ["", "A", a, a * 2, "C" * 39 + a, "C" * 40 + a, "C" * 50 + a[1:], "C" * 50 + "T" + a[1:], "C" * 50 + "TT" + a[2:], "C" * 60 + a[:4], "C" * 10 + "AG", "C" * 67 + a[:20] + "TTT" + a[23:], "C" * 60 + a + a[:6]]
    odd += ["".join(rng.choices("ACGT", k=60)) + "".join(b if rng.random() > 0.06 else "T" for b in a) + "ACGT" * rng.randint(0, 3) for _ in range(60)]
    reads = reads.unionByName(spark.createDataFrame([(1000 + i, 0, s, ("FFE:,#" * 30)[: len(s)]) for i, s in enumerate(odd)], "id long, off long, seq string, qual string"))
    want = sorted((r["id"], r["off"], t[0][:longest], t[1][:longest], t[2]) for r in reads.collect() for t in [trimmed(r["seq"], r["qual"], mate)])
    assert rows(rd.trim_adapters(reads, mate, longest), "id", "off", "seq", "qual", "cut") == want
    assert 20 < sum(w[4] for w in want) < len(want)


def test_exports_and_orders_of_whole_texts(spark, seqs, texts):
    cut = lambda n, step=None: [(i, off, s[off : off + n]) for i, s in texts for off in range(0, len(s), step or n)]
    assert rows(pairs._fastq(seqs), "record") == sorted((f"@{i}:{off}/1\n{s}\n+\n{'I' * len(s)}",) for i, off, s in cut(100))
    assert rows(pairs._fasta(seqs), "record") == sorted((f">{i}:{off}\n{s}",) for i, off, s in cut(136))
    lines = [(i, off, k, x) for i, off, s in cut(200) for k, x in enumerate((f"000 {i}:{off} fixed_len={len(s[:100])}", f"001 Head1 @{i}:{off}/1", f"002 Read1 {s[:100]}", f"003 Read2 {rc(s[100:])}"))]
    assert rows(pairs._dump(seqs), "id", "off", "no", "line") == sorted(lines)
    assert rows(plan_reads._canonical_reads(seqs), "id", "off", "fwd", "is_reverse") == sorted((i, off, s, rc(s) < s) for i, off, s in cut(50))
    by_bucket = {}
    for i, off, s in cut(120):
        by_bucket.setdefault((s[:1], s[60:61]), []).append((s, len(s), i, off))
    assert rows(plan_reads._pair_ranks(seqs), "id", "off", "rank") == sorted((i, off, k) for group in by_bucket.values() for k, (_, _, i, off) in enumerate(sorted(group), 1))
    sites = [(90, "C" * 123 + "GATCGATC" + "C" * 300 + "TTATAA" + "C" * 50)]
    sites += [(91, "GATCGATC" + "C" * 30 + "TTAGATCTAA" + "C" * 90), (92, "C" * 40 + "GATCTTATAATTAGATCGATC" + "C" * 60)]
    parts = []
    for i, s in texts + sites:
        for off in range(0, len(s), 120):
            head, rest = s[off : off + 127][:28], s[off : off + 127][28:]
            first = re.search("GATCGATC|TTATAA|GATCTAA|TTAGATC", rest)
            tail = (rest[: first.start()] + {"G": "GATC", "T": "TTAA"}[first[0][0]] if first else rest)[:32]
            parts.append((i, off, head, tail, len(head) + len(tail)))
    got = rows(hic._ligation_parts(spark.createDataFrame(texts + sites, "id long, seq string")), "id", "off", "head", "tail", "n_kept")
    assert got == sorted(parts) and any(t.endswith("TTAA") and len(t) < 32 for _, _, _, t, _ in got)


def test_keys_and_slots_of_whole_texts(seqs, texts):
    code = lambda k: sum("ACGT".index(b) * 4 ** (15 - n) for n, b in enumerate(k[:16])) & 0x3FFFFFFF
    assert rows(kmer._encoded(seqs), "id", "off", "next2", "seed_key") == sorted((i, k, s[k + 16 : k + 18], code(s[k : k + 18])) for i, s in texts for k in range(len(s) - 17))
    found = {}
    for i, s in texts:
        for k in range(len(s) - 11):
            found.setdefault(s[k : k + 12], []).append((i, k))
    want = sorted((x, x < rc(x), n, i, k) for x, at in found.items() for n, (i, k) in enumerate(sorted(at)[:8]))
    assert rows(kmer._slots(seqs), "kmer", "fwd", "slot", "id", "off") == want


def test_merged_order_has_no_row_limit(spark):
    rng = random.Random(12)
    kind = "chr int, ordinal long, pos1 long, pos2 long, umi string, l_partkey long, l_suppkey long, l_orderkey long, l_linenumber long"
    made = [(rng.randint(1, 2), i, a, a + rng.randint(-300, 300), "AC", rng.randint(1, 9), 1, i, 1) for i in range(2500) for a in [rng.randint(1, 20000)]]
    by_contig = {}
    for r in made:
        by_contig.setdefault(r[0], []).append((min(r[2:4]), max(r[2:4]), *r[4:], r[1]))
    want = sorted((c, k, r[-1]) for c, group in by_contig.items() for k, r in enumerate(sorted(group), 1))
    assert rows(pairs._merged(spark.createDataFrame(made, kind)), "chr", "rank", "ordinal") == want
    assert max(k for _, k, _ in want) > 500


def test_windows_of_more_than_1024_positions(spark):
    chosen = spark.range(1, 1101).selectExpr("cast(id % 24 + 1 as int) as chr", "id * 10 as pos")
    assert calls._windows(spark, FOLDER, chosen).count() == 1100 * 121
    assert calls.pwm_window(spark, FOLDER).count() == calls._called_twice(spark, FOLDER).count() * 121


def test_every_kmer_is_counted_on_both_strands(seqs, texts):
    forward = Counter(s[k : k + 12] for _, s in texts for k in range(len(s) - 11))
    reverse = Counter(rc(s)[k : k + 12] for _, s in texts for k in range(len(s) - 11))
    assert rows(kmer._both_strands(seqs), "kmer", "n_fwd", "n_rev", "n_all") == sorted((x, forward[x], reverse[x], forward[x] + reverse[x]) for x in forward | reverse)


def test_rare_kmers_stay(spark):
    got = {r["kmer"]: r["cnt"] for r in kmer.kmer_canonical_counts(spark, FOLDER).collect()}
    want = Counter(min(s[k : k + 11], rc(s[k : k + 11])) for (s,) in v.dna(spark, FOLDER).select("seq").collect() for k in range(len(s) - 10))
    assert got == want and min(got.values()) < 4


def test_exons_list_both_mates(spark):
    made = [(i, 1, rng, rng + 40, i % 2 == 0, i % 3 == 0, 100, 100) for i in range(1, 60) for rng in [i * 37 % 900]]
    pairs_ = spark.createDataFrame(made, "ordinal long, chr int, pos1 long, pos2 long, rev1 boolean, rev2 boolean, len1 int, len2 int")
    exons = [(8 * k, 1, k * 100, k * 100 + 50) for k in range(1, 12)]
    want = []
    for f, _, a, b in exons:
        hit = sorted((o, ("l" if r1 else "L") if m == 1 else ("R" if r2 else "r")) for o, _, p1, p2, r1, r2, _, _ in made for m, p in ((1, p1), (2, p2)) if p <= b and p + 99 >= a)
        want += [(f, len(hit), ";".join(f"{o}{c}" for o, c in hit))] if hit else []
    assert rows(coverage._exon_reads(pairs_, spark.createDataFrame(exons, "feature_id long, chr int, start long, end long")), "feature_id", "n_reads", "reads") == sorted(want)


def test_long_exons_in_pieces_list_their_reads_and_overlaps_are_no_rows(spark):
    rng = random.Random(9)
    made = [(i, 1 + i % 2, a, a + rng.randint(-200, 200), i % 2 == 0, i % 3 == 0, 100, 99) for i in range(400) for a in [rng.randint(1, 9000)]]
    exons = [(k, 1 + k % 2, a, a + rng.choice([0, 50, 1023, 1024, 1500, 4000])) for k in range(300) for a in [rng.randint(1, 9000)]]
    pairs_ = spark.createDataFrame(made, "ordinal long, chr int, pos1 long, pos2 long, rev1 boolean, rev2 boolean, len1 int, len2 int")
    want = []
    for f, c, a, b in exons:
        hit = sorted((o, ("l" if r1 else "L") if m == 1 else ("R" if r2 else "r")) for o, h, p1, p2, r1, r2, n1, n2 in made for m, p, n in ((1, p1, n1), (2, p2, n2)) if h == c and p <= b and p + n - 1 >= a)
        want += [(f, len(hit), ";".join(f"{o}{x}" for o, x in hit))] if hit else []
    got = coverage._exon_reads(pairs_, spark.createDataFrame(exons, "feature_id long, chr int, start long, end long"))
    assert rows(got, "feature_id", "n_reads", "reads") == sorted(want)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_all_hits_are_lifted(spark):
    hits = {r["hit"] for r in plan_reads.transcript_lift(spark, FOLDER).collect()}
    assert any(k % 5 == 0 for k in hits)
