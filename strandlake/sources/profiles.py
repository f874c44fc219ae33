"""Profile files in the PROSITE matrix format (``ID``, ``AC``, ``DE`` and ``MA`` lines, ``//`` behind each profile) and tables of trimmed ends.

A file may hold any number of profiles: they are split at ``//`` by the text scan, so a row is a profile. Fixed values of the format: commands
GENERAL_SPEC, DISJOINT, NORMALIZATION, CUT_OFF, DEFAULT, M and I; parameters ALPHABET, LENGTH, N1, N2, SY, M, M0, I, D; states B, M, I, D, E, whose
pairs name transitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.profile import BASES, Profile

COMMAND = "struct<kind: string, params: array<struct<name: string, value: string>>>"
SCHEMA = f"id string, ac string, description string, commands array<{COMMAND}>"
TRIM = ["c0", "c1", "c2", "c3", "n0", "n1", "n2", "n3"]
PARAMETER = r"([A-Za-z0-9_]+)=('[^']*'|[^;]*);"


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """id, ac, description, commands (kind, params in their order, quotes kept) of each profile; lines of other kinds are passed over."""
    whole = spark.read.option("lineSep", "//\n").text(path).where(F.col("value").contains("\nMA ") | F.col("value").startswith("MA "))
    lines = F.filter(F.split("value", "\n"), lambda x: x.startswith("MA "))
    matrix = F.array_join(F.transform(lines, lambda x: F.trim(F.substr(x, F.lit(4)))), " ")
    cells = F.filter(F.split(matrix, r"\s*/(?=[A-Z_]+:)"), lambda x: x != "")
    names = lambda x, group: F.regexp_extract_all(x, F.lit(PARAMETER), group)
    params = lambda x: F.arrays_zip(names(x, 1).alias("name"), names(x, 2).alias("value"))
    commands = F.transform(cells, lambda x: F.struct(F.regexp_extract(x, "^([A-Z_]+):", 1).alias("kind"), params(x).alias("params")))
    field = lambda name: F.regexp_extract("value", f"(?m)^{name} +([^;\n]*)", 1)
    return whole.select(field("ID").alias("id"), field("AC").alias("ac"), F.regexp_extract("value", "(?m)^DE +([^\n]*)", 1).alias("description"), commands.cast(f"array<{COMMAND}>").alias("commands"))


def write_profiles(profiles: DataFrame, path: str) -> None:
    """Profiles as text that ``read_profiles`` reads again."""
    line = lambda c: F.concat(F.lit("MA   /"), c["kind"], F.lit(":"), F.array_join(F.transform(c["params"], lambda p: F.concat(F.lit(" "), p["name"], F.lit("="), p["value"], F.lit(";"))), ""))
    head = F.concat(F.lit("ID   "), "id", F.lit("; MATRIX.\nAC   "), "ac", F.lit(";\nDE   "), "description", F.lit("\n"))
    profiles.select(F.concat(head, F.array_join(F.transform("commands", line), "\n"), F.lit("\n")).alias("value")).write.option("lineSep", "//\n").text(path)


def _turned(name: Column) -> Column:
    """The name of a transition as seen from the profile's end: from and to change places, and so do beginning and end."""
    ends = F.translate(name, "BE", "EB")
    return F.when(name.rlike("^[BMIDE]{2}$"), F.reverse(ends)).when(name.rlike("^[BE][01]$"), ends).otherwise(name)


def reversed_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles from their end: columns in opposite order with their transitions turned, and the protected range counted from there."""
    turn = lambda c: F.struct(c["kind"].alias("kind"), F.transform(c["params"], lambda p: F.struct(_turned(p["name"]).alias("name"), p["value"].alias("value"))).alias("params"))
    size = F.size(F.filter("commands", lambda c: c["kind"] == "M"))
    other = lambda name: F.when(name == "N1", "N2").when(name == "N2", "N1").otherwise(name)
    counted = lambda p: F.when(p["name"].isin("N1", "N2"), (size + 1 - p["value"].try_cast("int")).cast("string")).otherwise(p["value"])
    bounds = lambda c: F.struct(c["kind"].alias("kind"), F.transform(c["params"], lambda p: F.struct(other(p["name"]).alias("name"), counted(p).alias("value"))).alias("params"))
    ahead = F.transform(F.filter("commands", lambda c: ~c["kind"].isin("M", "I")), lambda c: F.when(c["kind"] == "DISJOINT", bounds(c)).when(c["kind"] == "DEFAULT", turn(c)).otherwise(c))
    columns = F.transform(F.reverse(F.filter("commands", lambda c: c["kind"].isin("M", "I"))), turn)
    return profiles.withColumn("commands", F.concat(ahead, columns).cast(f"array<{COMMAND}>"))


def profile_of(row: Row) -> Profile:
    """A row of ``read_profiles`` for the aligner (best stretch of a sequence for all columns). Scores that the aligner has once for a profile (of inserted
    bases) must be the same everywhere; letters that the alphabet lacks get M0."""
    defaults: dict[str, str] = {}
    general: dict[str, str] = {}
    columns, between = [], [{}]
    for kind, params in ((c["kind"], {p["name"]: p["value"] for p in c["params"]}) for c in row["commands"]):
        if kind == "GENERAL_SPEC":
            general |= params
        elif kind == "DEFAULT":
            defaults |= params
        elif kind == "I":
            between[-1] = {**defaults, **params}
        elif kind == "M":
            columns.append({**defaults, **params})
            between.append({})
    if "LENGTH" in general and int(general["LENGTH"]) != len(columns):
        raise ValueError(f"profile {row['id']}: {len(columns)} columns instead of {general['LENGTH']}")
    between = [x or defaults for x in between]
    number = lambda params, name: int(params.get(name, 0))
    inserts = {(number(x, "MI"), number(x, "I"), number(x, "IM")) for x in between[1:-1]}
    if len(inserts) > 1:
        raise ValueError(f"profile {row['id']}: scores of inserted bases differ between places")
    start, more, stop = inserts.pop() if inserts else (number(defaults, "MI"), number(defaults, "I"), number(defaults, "IM"))
    letters = general.get("ALPHABET", "'ACGT'").strip("'")
    match = np.full((len(columns), len(BASES)), 0)
    for at, column in enumerate(columns):
        scores = dict(zip(letters, map(int, column["M"].split(",")), strict=True))
        match[at] = [scores.get(b, number(column, "M0")) for b in BASES]
    deleted = np.array([number(x, "D") for x in columns])
    side = lambda name: np.array([number(x, name) for x in between[: len(columns)]])
    return Profile(match, side("MD") + deleted, side("DD") + deleted, side("DM"), np.zeros(len(columns), dtype=bool), "profile", insert=start + more + stop, insert_more=more)


def profile_row(profile: Profile, name: str, description: str = "") -> tuple:
    """A profile as a row of ``SCHEMA``."""
    text = lambda **params: [(k, str(x)) for k, x in params.items()]
    commands = [("GENERAL_SPEC", text(ALPHABET=f"'{BASES}'", LENGTH=len(profile.slot))), ("DISJOINT", text(DEFINITION="PROTECT", N1=1, N2=len(profile.slot))), ("DEFAULT", text(MI=profile.insert - profile.insert_more, I=profile.insert_more))]
    for at, scores in enumerate(profile.match):
        commands.append(("I", text(MD=profile.enter[at] - profile.inside[at], DM=profile.leave[at])))
        commands.append(("M", text(SY=f"'{BASES[int(np.argmax(scores))]}'", M=",".join(map(str, scores)), D=profile.inside[at])))
    return name, name, description, commands


def read_trim_table(spark: SparkSession, path: str, records: int = 1 << 20) -> DataFrame:
    """ordinal, c0 to c3, n0 to n3 of a binary table: eight bytes for each ordinal from 0, first the four counts and then the four lengths (mate 1 left and
    right, mate 2 left and right).

    A task reads ``records`` records from their offset, so a file is read in parallel and never whole."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    size = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).getLen()
    if size % 8:
        raise ValueError(f"{path}: {size} bytes aren't whole records of eight")
    uri = path if "://" in path else f"file://{path}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs

        store, name = pyarrow.fs.FileSystem.from_uri(uri)
        with store.open_input_file(name) as file:
            for frame in frames:
                for block in frame["id"]:
                    first = int(block) * records
                    cells = np.frombuffer(file.read_at(min(records, size // 8 - first) * 8, first * 8), dtype=np.uint8).reshape(-1, 8).astype(np.int64)
                    yield pd.DataFrame(cells, columns=TRIM).assign(ordinal=np.arange(first, first + len(cells)))[["ordinal", *TRIM]]

    blocks = -(-size // 8 // records)
    return spark.range(0, blocks, 1, max(blocks, 1)).mapInPandas(run, "ordinal long, " + ", ".join(f"{x} long" for x in TRIM))


def read_trim_text(spark: SparkSession, path: str) -> DataFrame:
    """The same of text lines: the ordinal, then length and count of each end; lines without nine numbers are passed over."""
    cells = F.split(F.trim("value"), r"\s+")
    value = lambda i: F.get(cells, F.lit(i)).try_cast("long")
    rows = spark.read.text(path).where(F.size(cells) == 9)
    return rows.select(value(0).alias("ordinal"), *[value(2 + 2 * k).alias(f"c{k}") for k in range(4)], *[value(1 + 2 * k).alias(f"n{k}") for k in range(4)]).na.drop()
