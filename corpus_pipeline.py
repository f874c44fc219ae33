"""The corpus pipeline: language identification, exact, SimHash and suffix-array de-duplication, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``. Every stage works on all rows its predecessor kept.

Defined cases, for every stage: rows are told apart by a key of their own, so a null or repeated doc_id neither loses nor doubles
a row; a null text counts as empty (the language stage drops it); ties are settled by that key; further columns, whatever their
names, are handed on unchanged; texts of any length are read whole; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import exact_dedup, language_id, packing, simhash, suffix_dedup
from strandlake.llm.common import drop_path, fresh_name, keyed, stage

#: SQL has no naive Bayes, SimHash closure, suffix array or tokenizer: tested against brute force instead.
ORACLE_SQL = None

#: The suffix-array stage cuts passages of 50 words or more that repeat: runs of repeated strings of so many bytes (50 words have more,
#: also where they are short) that hold so many words.
REPEAT_BYTES, REPEAT_WORDS = 200, 50


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language can't be told: null texts, texts without a letter, and texts that fit no learnt language better than
    chance or two languages alike (a score of at most 0.5)."""
    lang, score = fresh_name(docs, "lang_pred"), fresh_name(docs, "lang_score")
    scored = language_id.predict(docs, language_id.fit(docs), lang, score)
    return scored.where((F.col(lang) != language_id.UNDETERMINED) & (F.col(score) > 0.5)).select(docs.columns)


def _only(rows: DataFrame, key: str, kept: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose key is in ``kept.row_key``."""
    other = fresh_name(rows, "kept_key")
    kept = kept.where("kept").select(F.col("row_key").alias(other))
    return rows.join(kept, rows[key] == kept[other], "left_semi").select(columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for A-Z case) one row stays: the largest doc_id, any before none."""
    rows, key = keyed(docs)
    index = exact_dedup.DigestIndex(spark, f"pipeline_digests_{uuid.uuid4().hex[:12]}")
    kept = index.ingest(rows, key=key)
    index.drop()  # made for this run alone; ``kept`` doesn't read it
    return _only(rows, key, kept, docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group one row stays: the smallest doc_id, any before none."""
    rows, key = keyed(docs)
    return _only(rows, key, simhash.simhash_groups(rows, key=key), docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes runs of repeated strings of ``REPEAT_BYTES`` bytes that hold ``REPEAT_WORDS`` words; ``n_chars`` follows the text. No row goes."""
    return suffix_dedup.without_repeats(docs, words=REPEAT_WORDS, span=REPEAT_BYTES)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of all documents that are left."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made: list[str] = []
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}", made)
        for path in made[:-1]:  # only the last stage's table is read from here on
            drop_path(spark, path)
        del made[:-1]
    return STAGES[-1][1](spark, docs, sf_dir)
