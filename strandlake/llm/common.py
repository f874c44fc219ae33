"""Helpers shared by the training-data operators.

``stage``      cuts lineage by writing a DataFrame as Parquet into the shared folder.
``keyed``      gives each row a key of its own, also rows without or with a repeated id.
``by_groups``  hands whole, key-sorted groups to a Python function, many groups per call.
``text_bytes`` gives the UTF-8 buffer of an Arrow string column without copying rows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where a local session leaves it unset (tests on one machine) a temporary folder of the application stands in; on a cluster that is an
    error, as executors don't see each other's folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/strandlake-{spark.sparkContext.applicationId}"
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a lineage cut that survives lost executors.

    ``made`` collects the paths of tables that their caller drops once nothing reads them any more."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if made is not None:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store through Hadoop's file system API. Only for tables whose readers are all written by now."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def keyed(docs: DataFrame, column: str = "doc_id") -> tuple[DataFrame, str]:
    """(``docs`` with a long column that tells all rows apart, its name).

    The key is the id where only one row has it. Rows without an id, or with one that several rows have, get numbers below every
    id; these rows alone are written to the shared folder, so that their numbers stay. Repeated ids are counted with partial aggregation."""
    spark, key = docs.sparkSession, fresh_name(docs, "row_key")
    ids = docs.select(F.col(column).cast("long").alias("id"))
    counts = stage(ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").select("id"), "repeated-ids")
    if not counts.limit(1).count():
        return docs.withColumn(key, F.col(column).cast("long")), key
    base = min(ids.agg(F.min("id")).first()[0] or 0, 0)
    own, several = F.col(column).cast("long"), counts.where("id is not null").withColumnRenamed("id", fresh_name(docs, "repeated_id"))
    again = own == several[several.columns[0]]
    odd = docs.where(own.isNull()).unionByName(docs.join(several, again, "left_semi"))
    odd = stage(odd.withColumn(key, F.lit(base - 1) - F.monotonically_increasing_id()), "keyed-rows")
    return docs.where(own.isNotNull()).join(several, again, "left_anti").withColumn(key, own).unionByName(odd), key


def arrow_map(df: DataFrame, fn: Callable, schema, rows: int = 1000) -> DataFrame:
    """``mapInArrow`` with at most ``rows`` rows in a batch: texts are long, and a batch lies in the memory of both processes.

    Spark reads the size of batches from the session when the plan runs, so a larger setting of the session is lowered and stays so."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) not in range(1, rows + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df.mapInArrow(fn, schema)


def by_groups(df: DataFrame, keys: list[str], fn: Callable, schema: str, number: Column, order: tuple[str, ...] = ()) -> DataFrame:
    """Apply ``fn(table, bounds)`` to whole groups of ``keys``.

    ``number`` (not null, the same for all rows of a group) deals the groups: number modulo partitions, so that bounded groups with
    consecutive numbers lie in different tasks. Rows are sorted by ``keys`` and ``order`` inside each partition; ``fn`` gets an Arrow table of
    complete groups and their boundaries (``bounds[i]:bounds[i+1]`` is a group) and yields record
    batches; where it has a method ``finish``, what that yields follows at the end of a task (each task has a copy of ``fn``). Only the rows of the groups that meet one Arrow batch are in memory; callers bound groups.
    """
    n = partitions(df.sparkSession)
    dealt = df.repartitionById(n, F.pmod(number, F.lit(n)).cast("int")).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = _last_start(batch, keys)
            if last == 0 and len(held) > 1 and _same_key(held[-2], batch, keys):
                continue  # the whole batch goes on with the group that is held
            held[-1] = batch.slice(0, last)
            if table := pa.Table.from_batches(held).combine_chunks():
                yield from fn(table, _bounds(table, keys))
            held = [batch.slice(last)]
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from fn(table, _bounds(table, keys))
        yield from getattr(fn, "finish", tuple)()

    return arrow_map(dealt, run, schema)


def _key_arrays(data, keys: list[str]) -> list[np.ndarray]:
    return [np.asarray(data.column(k).to_numpy(zero_copy_only=False) if isinstance(data, pa.RecordBatch) else data.column(k).to_numpy()) for k in keys]


def _changes(data, keys: list[str]) -> np.ndarray:
    changed = np.zeros(data.num_rows, dtype=bool)
    changed[0] = True
    for values in _key_arrays(data, keys):
        changed[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(changed)


def _last_start(batch: pa.RecordBatch, keys: list[str]) -> int:
    return int(_changes(batch, keys)[-1])


def _same_key(a: pa.RecordBatch, b: pa.RecordBatch, keys: list[str]) -> bool:
    return all(a.column(k)[a.num_rows - 1] == b.column(k)[0] for k in keys) if a.num_rows else False


def _bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    if not table.num_rows:
        return np.zeros(1, dtype=np.int64)
    return np.append(_changes(table, keys), table.num_rows)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values in one array, offsets of the n values plus the end); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def group_number(at: Column, *hashed: str) -> Column:
    """A number for ``by_groups``: consecutive in ``at`` within equal ``hashed`` columns."""
    return F.pmod(F.xxhash64(*hashed), F.lit(1 << 30)) + at


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
