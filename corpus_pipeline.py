"""From raw documents to token ids: language, quality, near copies, benchmark leaks, encoding.

Each stage takes what its predecessor kept and returns the rows that it keeps, with the columns of
documents, the last one the encoding's digests.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindloom.llm import bagminhash, bpe_codec, decontam, langid, quality, queries, store

#: No SQL can express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None
#: Benchmark items with an occurring window from which a document is dropped: one copied item is a leak. The
#: column ``contaminated`` of op8 has a threshold of its own.
LEAKED_ITEMS = 1


def _numbered(docs: DataFrame) -> tuple[DataFrame, str, str, list[str]]:
    """(docs with columns c0, c1, ..., names there of doc_id and text, original names): whatever other
    columns are called, none clashes with a stage's own."""
    names = docs.columns
    return docs.toDF(*[f"c{i}" for i in range(len(names))]), f"c{names.index('doc_id')}", f"c{names.index('text')}", names


def _restored(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with letters whose language is told beyond doubt."""
    model = queries.language_model(docs)
    rows, key, text, names = _numbered(docs)
    found = langid.predict(rows, model, key=key, text=text, keep=tuple(rows.columns))
    return _restored(found.where((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous")), names)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are predicted to be of quality."""
    model = queries.quality_model(docs, queries.table(spark, sf_dir, "labels"))
    rows, key, text, names = _numbered(docs)
    found = quality.score(rows, model, key=key, text=text, keep=tuple(rows.columns))
    return _restored(found.where(F.col("score") >= queries.GOOD), names)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each class of near copies."""
    return bagminhash.keep_first(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no window of any benchmark item."""
    return decontam.clean(docs, queries.table(spark, sf_dir, "benchmark"), n=queries.WINDOW, at_least=LEAKED_ITEMS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode what is left: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return bpe_codec.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("quality", good), ("near_dedup", unique), ("decontaminate", clean), ("bpe", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
