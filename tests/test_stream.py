"""Streams with state against the batch rules: the clone filter and FASTQ in chunks."""

import random
from itertools import groupby

import pytest

from strandlake.sources.formats import read_fastq
from strandlake.streaming import clones
from strandlake.streaming import events as ev
from strandlake.streaming.reads import stream_fastq, write_chunks

PAIR = "sample string, chr int, klass string, pos1 long, pos2 long, umi string, ordinal long, l_partkey long, l_suppkey long, l_orderkey long, l_linenumber long, extra string"


@pytest.fixture
def state_store(spark):
    spark.conf.set(*clones.STATE_STORE)
    yield
    spark.conf.unset(clones.STATE_STORE[0])


def kept_by_rule(parts):
    """Ordinals of rows that the previous row of their place, in order of arrival, doesn't make clones."""
    kept, before = set(), {}
    for part in parts:
        for r in sorted(part, key=lambda r: (min(r[3:5]), max(r[3:5]), r[5] or "", r[7:11])):
            place = (*r[:3], min(r[3:5]), max(r[3:5]))
            if place not in before or not clones.same_molecule(r[5], before[place]):
                kept.add(r[6])
            before[place] = r[5]
    return kept


def test_clones_of_several_arrivals(spark, state_store):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        a, b = (100, 300) if i % 3 == 0 else (rng.choice([100, 300, 500]), rng.choice([100, 300, 500]))
        umi = None if i % 97 == 5 else "".join(rng.choices("ACGT", k=rng.choice([4, 4, 4, 3])))
        rows.append((rng.choice("TN"), rng.randint(1, 2), "p", a, b, umi, i, rng.randint(0, 9), 0, i, 0, "x"))
    parts = [rows[:10], rows[10:900], rows[900:]]
    got = ev.arrivals([spark.createDataFrame(p, PAIR) for p in parts], clones.kept_pairs, PAIR).collect()
    assert {r["ordinal"] for r in got if r["kept"]} == kept_by_rule(parts)
    assert sum(r["n"] for r in got) == len(rows)


def test_a_pair_that_arrives_again_is_a_clone(spark, state_store):
    pair = [("T", 1, "p", 5, 9, "ACGT", 1, 0, 0, 0, 0, None)]
    swapped = [("T", 1, "p", 9, 5, "ACGA", 2, 0, 0, 0, 0, None), ("T", 1, "p", 9, 5, "TTTT", 3, 0, 0, 0, 0, None)]
    got = ev.arrivals([spark.createDataFrame(p, PAIR) for p in (pair, swapped)], clones.kept_pairs, PAIR).collect()
    assert {r["ordinal"]: r["kept"] for r in got} == {1: True, 2: False, 3: True}


def test_empty_arrivals_of_pairs(spark, state_store):
    assert ev.arrivals([spark.createDataFrame([], PAIR)], clones.kept_pairs, PAIR).count() == 0


@pytest.fixture(scope="module")
def fastq_lines():
    rng = random.Random(8)
    made = {}
    for name, n in (("a", 57), ("b", 3), ("c", 20)):
        lines = []
        for i in range(n):
            stated = f"{rng.randint(100, 999)}@" if rng.random() < 0.15 else ""
            size = rng.randint(1, 30)
            lines += [f"@{stated}{name}{i}", "".join(rng.choices("ACGT", k=size)), "+", "".join(rng.choices("#@+F", k=size))]
        made[name] = lines
    return made


def cut(lines, rng):
    """Chunks of one to nine lines."""
    at, chunks = 0, []
    while at < len(lines):
        size = rng.randint(1, 9)
        chunks.append(lines[at : at + size])
        at += size
    return chunks


@pytest.mark.parametrize("seed", [1, 2])
def test_fastq_in_chunks_equals_whole_files(spark, fastq_lines, tmp_path, seed):
    rng = random.Random(seed)
    pieces = [(name, k, i, x) for name, lines in fastq_lines.items() for k, chunk in enumerate(cut(lines, rng)) for i, x in enumerate(chunk)]
    names = sorted({p[:2] for p in pieces})
    rng.shuffle(names)
    for run in range(3):
        chosen = set(names[run::3])
        write_chunks(spark.createDataFrame([p for p in pieces if p[:2] in chosen], "stream string, chunk long, line long, value string"), f"file://{tmp_path}/inbox")
        got = stream_fastq(spark, f"file://{tmp_path}/inbox", f"file://{tmp_path}/out")
        if run < 2:
            # what has come out is the beginning of each stream: as many whole records as the chunks in turn hold
            there = {n: [p for p in pieces if p[0] == n] for n in fastq_lines}
            arrived = set(sum((names[r::3] for r in range(run + 1)), []))
            for name, rows in there.items():
                n = 0
                for key, chunk in groupby(rows, key=lambda p: p[:2]):
                    if key not in arrived:
                        break
                    n += len(list(chunk))
                assert got.where(f"stream = '{name}'").count() == n // 4
    for name, lines in fastq_lines.items():
        (tmp_path / f"{name}.fastq").write_text("\n".join(lines) + "\n")
    want = sorted((r["file"][-7], r["ordinal"], r["header"], r["seq"], r["qual"]) for r in read_fastq(spark, f"file://{tmp_path}/*.fastq").collect())
    assert sorted((r["stream"], r["ordinal"], r["header"], r["seq"], r["qual"]) for r in got.collect()) == want
    # nothing new: nothing is lost or repeated
    assert stream_fastq(spark, f"file://{tmp_path}/inbox", f"file://{tmp_path}/out").count() == len(want)


def test_an_unfinished_record_waits(spark, tmp_path):
    schema = "stream string, chunk long, line long, value string"
    place = (f"file://{tmp_path}/inbox", f"file://{tmp_path}/out")
    write_chunks(spark.createDataFrame([("s", 0, i, x) for i, x in enumerate(["@7@x", "AC", "+", "FF", "@y", "G"])], schema), place[0])
    assert [r["ordinal"] for r in stream_fastq(spark, *place).collect()] == [7]
    write_chunks(spark.createDataFrame([("s", 1, 0, "+"), ("s", 1, 1, "F")], schema), place[0])
    assert sorted((r["ordinal"], r["seq"]) for r in stream_fastq(spark, *place).collect()) == [(7, "AC"), (8, "G")]


def test_lines_of_a_stream_are_never_shuffled_by_stream_alone(spark, tmp_path, monkeypatch):
    lines = spark.range(40_000).selectExpr("'s' as stream", "id div 4001 as chunk", "id as line", "case id % 4 when 0 then concat('@r', id) when 1 then 'ACGT' when 2 then '+' else 'FFFF' end as value")
    write_chunks(lines, f"{tmp_path}/inbox")
    plans, write = [], type(lines.write).parquet

    def kept(self, path, *args, **more):
        plans.append((path, self._df._jdf.queryExecution().executedPlan().toString()))
        return write(self, path, *args, **more)

    monkeypatch.setattr(type(lines.write), "parquet", kept)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = stream_fastq(spark, f"{tmp_path}/inbox", f"{tmp_path}/out")
        assert found.count() == 10_000 and found.where("seq = 'ACGT'").count() == 10_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    big = [plan for path, plan in plans if "/waiting/" in path]
    assert big and all("BroadcastHashJoin [stream#" in plan for plan in big)
