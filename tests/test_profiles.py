"""Profile text, trim tables and amplicons."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import amplicon
from strandlake.operators.profile import align, base_codes
from strandlake.plans import coverage as coverage_plans
from strandlake.plans.windows import motif_profile
from strandlake.sources import profiles as pr

TEXT = """ID   SAMPLE_ONE; MATRIX.
AC   PS00001;
DT   01-JAN-2000
DE   A short matrix; with a semicolon
MA   /GENERAL_SPEC: ALPHABET='ACGT'; LENGTH=3;
MA   /DISJOINT: DEFINITION=PROTECT; N1=1; N2=2;
MA   /CUT_OFF: LEVEL=0; SCORE=5; TEXT='a;b';
MA   /DEFAULT: D=-2; I=-1; MI=-7; MD=-6; DM=-1; B1=-3; M0=-9;
MA   /I: B0=-4; BM=0;
MA   /M: SY='A'; M=5,-4,
MA   -4,-4;
MA   /I: MD=-3; MI=-7;
MA   /M: SY='C'; M=-4,5,-4,-4; D=-1;
MA   /M: SY='G'; M=-4,-4,5,-4;
//
ID   EMPTY; MATRIX.
CC   nothing here
//
"""


def rows(df):
    return [r.asDict(recursive=True) for r in df.orderBy("id").collect()]


def test_profile_text_round_trip(spark, tmp_path):
    (tmp_path / "one.prf").write_text(TEXT)
    read = pr.read_profiles(spark, f"file://{tmp_path}/one.prf")
    (row,) = read.collect()
    assert (row["id"], row["ac"], row["description"]) == ("SAMPLE_ONE", "PS00001", "A short matrix; with a semicolon")
    assert [c["kind"] for c in row["commands"]] == ["GENERAL_SPEC", "DISJOINT", "CUT_OFF", "DEFAULT", "I", "M", "I", "M", "M"]
    assert ("TEXT", "'a;b'") in [tuple(p) for p in row["commands"][2]["params"]]
    pr.write_profiles(read, f"file://{tmp_path}/again")
    again = pr.read_profiles(spark, f"file://{tmp_path}/again")
    assert [[(c["kind"], [(p["name"], p["value"].replace(" ", "")) for p in c["params"]]) for c in r["commands"]] for r in rows(again)] == [[(c["kind"], [(p["name"], p["value"].replace(" ", "")) for p in c["params"]]) for c in r["commands"]] for r in rows(read)]
    built = pr.profile_of(row)
    assert built.match.tolist() == [[5, -4, -4, -4, -9], [-4, 5, -4, -4, -9], [-4, -4, 5, -4, -9]]
    assert (built.enter.tolist(), built.inside.tolist(), built.leave.tolist(), built.insert, built.insert_more) == ([-8, -4, -8], [-2, -1, -2], [-1, -1, -1], -8, -1)


def test_reversed_profile(spark, tmp_path):
    (tmp_path / "one.prf").write_text(TEXT)
    read = pr.read_profiles(spark, f"file://{tmp_path}/one.prf")
    turned = pr.reversed_profiles(read)
    commands = {}
    for c in turned.first()["commands"]:
        commands.setdefault(c["kind"], []).append({p["name"]: p["value"] for p in c["params"]})
    assert [c["SY"] for c in commands["M"]] == ["'G'", "'C'", "'A'"]
    assert commands["I"] == [{"DM": "-3", "IM": "-7"}, {"E0": "-4", "ME": "0"}]
    assert (commands["DISJOINT"][0]["N1"], commands["DISJOINT"][0]["N2"]) == ("2", "3")
    assert commands["DEFAULT"][0] == {"D": "-2", "I": "-1", "IM": "-7", "DM": "-6", "MD": "-1", "E1": "-3", "M0": "-9"}
    sort = lambda r: [(c["kind"], sorted((p["name"], p["value"]) for p in c["params"])) for c in r["commands"]]
    assert sort(rows(pr.reversed_profiles(turned))[0]) == sort(rows(read)[0])


def test_a_written_profile_scores_as_before(spark, tmp_path):
    own = motif_profile("GATTACAGATC")
    pr.write_profiles(spark.createDataFrame([pr.profile_row(own, "MOTIF")], pr.SCHEMA), f"file://{tmp_path}/motif")
    read = pr.profile_of(pr.read_profiles(spark, f"file://{tmp_path}/motif").first())
    rng = random.Random(2)
    seqs = base_codes(["".join(rng.choices("ACGTN", k=60)) for _ in range(20)] + [("".join(rng.choices("ACGT", k=20)) + "GATTAAGATTC").ljust(60, "C")])
    for a, b in zip(align(own, seqs), align(read, seqs), strict=True):
        assert np.array_equal(a, b)
    with pytest.raises(ValueError, match="columns"):
        bad = pr.profile_row(own, "BAD")
        pr.profile_of(spark.createDataFrame([(*bad[:3], bad[3][:-1])], pr.SCHEMA).first())


def test_trim_tables(spark, tmp_path):
    rng = np.random.default_rng(4)
    cells = rng.integers(0, 256, size=(1003, 8), dtype=np.uint8)
    (tmp_path / "trim.bin").write_bytes(cells.tobytes())
    got = pr.read_trim_table(spark, f"file://{tmp_path}/trim.bin", records=100)
    assert got.rdd.getNumPartitions() == 11
    assert sorted(tuple(r) for r in got.collect()) == [(i, *map(int, x)) for i, x in enumerate(cells)]
    (tmp_path / "trim.txt").write_text("".join(f"{i} " + " ".join(f"{x[4 + k]} {x[k]}" for k in range(4)) + "\n" for i, x in enumerate(cells)) + "broken line\n")
    assert pr.read_trim_text(spark, f"file://{tmp_path}/trim.txt").exceptAll(got).count() == 0
    (tmp_path / "none.bin").write_bytes(b"")
    assert pr.read_trim_table(spark, f"file://{tmp_path}/none.bin").count() == 0
    (tmp_path / "cut.bin").write_bytes(b"12345")
    with pytest.raises(ValueError, match="whole records"):
        pr.read_trim_table(spark, f"file://{tmp_path}/cut.bin")


def slow_amplicons(spans, deletions, mismatches, least=4, percent=15):
    top = max(e for _, e in spans) + 2
    depth = [sum(s <= p <= e for s, e in spans) - sum(s <= p <= e for s, e in deletions) for p in range(top)]
    found, p = set(), 0
    while p < top:
        if depth[p] < least:
            p += 1
            continue
        start = p
        while depth[p]:
            p += 1
        first, last, most = start, p - 1, max(depth[start:p])
        while 2 * depth[first] < most:
            first += 1
        while 2 * depth[last] < most:
            last -= 1
        var, fell = max(depth[last] * percent // 100, 1), False
        for at in range(first, last + 1):
            others = [n for q, _, n in mismatches if q == at]
            if sum(n >= var for n in [*others, depth[at] - sum(others)]) > 1:
                found.add((at, "SNP", depth[at]))
            if at > first:
                if fell and depth[at] >= depth[at - 1] + var:
                    found.add((at, "DEL", depth[at]))
                fell |= depth[at] + var <= depth[at - 1]
    return found


@pytest.mark.parametrize("seed", range(3))
def test_amplicons_against_positions(spark, seed):
    rng = random.Random(seed)
    spans, deletions, mismatches = [], [], {}
    for _ in range(90):
        s = rng.choice([40, 60, 300, 700, 4080, 16350]) + rng.randint(0, 4)
        e = s + rng.randint(60, 80)
        spans.append((s, e))
        if rng.random() < 0.4:
            deletions.append((s + 20, s + 20 + rng.randint(0, 5)))
        if rng.random() < 0.4:
            key = (s // 10 * 10 + 40, rng.choice("AC"))
            mismatches[key] = mismatches.get(key, 0) + 1
    mm = [(*k, n) for k, n in mismatches.items()]
    frame = lambda data, schema: spark.createDataFrame(data, schema).withColumn("chr", F.lit(1))
    segments = amplicon.base_depth(frame(spans, "s long, e long"), frame(deletions, "s long, e long"), ("chr",))
    got = amplicon.variants(segments, frame(mm, "pos long, allele string, n long"), ("chr",)).collect()
    assert {(r["pos"], r["kind"], r["depth"]) for r in got} == slow_amplicons(spans, deletions, mm) and len({(r["pos"], r["kind"]) for r in got}) == len(got)


def test_an_island_over_many_tiles(spark):
    """What is known of an island reaches its segments in all tiles, and no join deals segments out by island alone."""
    rng = random.Random(9)
    spans = [(s + rng.randint(0, 9), s + 9000) for s in range(1, 70000, 6000) for _ in range(5)]
    deletions = [(s + 7000, s + 7003) for s, _ in spans[::3]]
    mm = [(s + 100, "C", 2) for s in range(1, 70000, 12000)]
    frame = lambda data, schema: spark.createDataFrame(data, schema).withColumn("chr", F.lit(1))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = amplicon.variants(amplicon.base_depth(frame(spans, "s long, e long"), frame(deletions, "s long, e long"), ("chr",)), frame(mm, "pos long, allele string, n long"), ("chr",))
        assert {(r["pos"], r["kind"], r["depth"]) for r in found.collect()} == slow_amplicons(spans, deletions, mm)
        plans = [found, coverage_plans.amplicon_islands(spark, "/root/testdata/sf0.001")]
        joins = [x for p in plans for x in re.findall(r"SortMergeJoin \[([^\]]*)\]", p._jdf.queryExecution().toString())]
        assert joins and all(re.search(r"tile#|bin#|seg_start#", x) for x in joins)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
