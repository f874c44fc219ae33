"""Exact de-duplication against a persistent digest index, DataFrame functions only.

The index is a table bucketed and sorted by digest. A batch is reduced to one row per digest (combined before the
shuffle, so a hot text is no hot task), anti-joined with the index bucket by bucket, and its new digests are appended.
Texts are equal when identical after lower-casing A-Z; the digest is SHA-256 of that text in UTF-8.

Defined cases: a null text counts as empty; of equal texts exactly one row stays, the one with the largest doc_id (any doc_id before
none; of rows that tie, the one with the largest row key); other columns of the input are ignored, whatever their names; texts of
any length are hashed whole; an empty batch appends nothing. Rows with null or repeated doc_ids count as rows of their group.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import ascii_lower, stage

#: A sorted bucket of so many digests has about 200 MB.
ROWS_PER_BUCKET = 4_000_000
_COLUMNS = "digest binary, keep_id long, group_size long, batch string"


def digests(docs: DataFrame, key: str | None = None, fold_case: bool = True) -> DataFrame:
    """(doc_id, row_key, digest binary) of each whole text. ``key``: a column that tells all rows apart; without it rows are numbered."""
    text = F.coalesce(F.col("text"), F.lit(""))
    folded = ascii_lower(text) if fold_case else text
    number = F.col(key) if key else F.monotonically_increasing_id()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), number.alias("row_key"), F.unhex(F.sha2(folded.cast("binary"), 256)).alias("digest"))


@dataclass
class DigestIndex:
    """A persistent index of seen digests: table ``name`` of the session's catalog, bucketed and sorted by digest."""

    spark: SparkSession
    name: str
    buckets: int | None = None  # of a new index; None: so many that a bucket holds about ROWS_PER_BUCKET digests

    def exists(self) -> bool:
        """Whether the index is there; a compaction that stopped between its two steps is finished first."""
        if not self.spark.catalog.tableExists(self.name) and self.spark.catalog.tableExists(f"{self.name}_next"):
            self.spark.sql(f"ALTER TABLE {self.name}_next RENAME TO {self.name}")
            self.spark.catalog.refreshTable(self.name)
        return self.spark.catalog.tableExists(self.name)

    def bucket_count(self) -> int:
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").where("col_name = 'Num Buckets'").collect()
        return int(rows[0]["data_type"])

    def _write(self, rows: DataFrame, table: str, buckets: int) -> None:
        rows.select("digest", "keep_id", "group_size", "batch").repartition(buckets, "digest").write.bucketBy(buckets, "digest").sortBy("digest").format("parquet").mode("append").saveAsTable(table)

    def compact(self, appends: int = 16) -> bool:
        """Rewrite the index where buckets hold more than ROWS_PER_BUCKET digests or more than ``appends`` files (several files end the sort order
        that a merge relies on). The new table is whole before the old one goes."""
        table = self.spark.table(self.name)
        rows, now, files = table.count(), self.bucket_count(), table.inputFiles()
        if rows <= now * ROWS_PER_BUCKET and len(files) <= now * appends:
            return False
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_next")
        # read as plain files: of a bucketed table Spark would leave out the repartitioning, and then read it without its buckets
        self._write(self.spark.read.schema(table.schema).parquet(*files), f"{self.name}_next", max(now, -(-rows // ROWS_PER_BUCKET)))
        self.spark.sql(f"DROP TABLE {self.name}")
        return self.exists()

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def ingest(self, docs: DataFrame, batch: str | None = None, key: str | None = None) -> DataFrame:
        """De-duplicate ``docs`` in itself and against the index, append its new digests, and return one row per document: doc_id,
        row_key (the column ``key``, if given), keep_id (null if an older batch holds the text), group_size (in this batch), kept, digest.

        A batch may run again: digests that its own name has in the index don't count as known, and only those not there yet are appended, so a
        run that failed after its append keeps the same rows when it is repeated. Other documents need another name (none: a new one)."""
        batch = batch or uuid.uuid4().hex
        own = stage(digests(docs, key), "digests")
        groups = own.groupBy("digest").agg(F.max(F.struct("doc_id", "row_key")).alias("keep"), F.count("*").alias("group_size"))
        groups = stage(groups.select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row_key").alias("keep_key"), "group_size"), "digest-groups")
        if not self.exists():
            self._write(self.spark.createDataFrame([], _COLUMNS), self.name, self.buckets or max(32, -(-groups.count() // ROWS_PER_BUCKET)))
        index = self.spark.table(self.name)
        older = index.where(F.col("batch") != batch).select("digest").hint("merge")
        fresh = stage(groups.join(older, "digest", "left_anti").withColumn("batch", F.lit(batch)), "digest-new")
        there = index.where(F.col("batch") == batch).select("digest").hint("merge")
        self._write(stage(fresh.join(there, "digest", "left_anti"), "digest-append"), self.name, self.bucket_count())
        self.compact()
        known = groups.join(fresh.select("digest", F.lit(True).alias("is_new")), "digest", "left")
        pick = lambda x: F.when(F.col("is_new"), F.col(x)).alias(x)
        known = stage(known.select("digest", pick("keep_id"), pick("keep_key"), "group_size"), "digest-known")
        return own.join(known, "digest").select("doc_id", "row_key", "keep_id", "group_size", F.coalesce(F.col("row_key") == F.col("keep_key"), F.lit(False)).alias("kept"), "digest")


def deduplicate(docs: DataFrame, index: str, buckets: int | None = None) -> DataFrame:
    """The result of the query over a new index: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = DigestIndex(docs.sparkSession, index, buckets).ingest(docs)
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents)
select doc_id, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
       doc_id = max(doc_id) over (partition by text_sha256) as kept, text_sha256
from d
"""
