"""One query for each operator, over its whole tables, and the SQL that checks it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, bpe_codec, decontam, langid, license_scan, quality, spotsigs, store, token_counts, token_store, warc

#: Tokens above which a text is over the limit, and the id that ends a document in the token store.
TOKEN_LIMIT, END_ID = 2048, 2
#: Words of a window and items that make a document contaminated; score from which quality is predicted.
WINDOW, ITEMS, GOOD = 8, 2, 0.3
#: Parts into which ids are dealt, and the part held out.
LANG_FOLDS, LANG_HELD, QUALITY_FOLDS, QUALITY_HELD = 4, 2, 5, 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), TOKEN_LIMIT)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.scratch(spark, "token-store")
    base = token_store.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_store.read_stats(spark, path, base)


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def language_model(docs: DataFrame) -> langid.Model:
    """Learned from the documents that are not held out."""
    return langid.fit(docs.where(langid.fold(docs["doc_id"], LANG_FOLDS) != LANG_HELD))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(langid.fold(F.col("doc_id"), LANG_FOLDS) == LANG_HELD, F.lit(False))
    found = langid.predict(docs, language_model(docs))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Learned from the labels of documents that are not held out."""
    return quality.fit(docs, labels.where(langid.fold(labels["doc_id"], QUALITY_FOLDS) != QUALITY_HELD))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(langid.fold(F.col("doc_id"), QUALITY_FOLDS) == QUALITY_HELD, F.lit(False))
    found = quality.score(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.scratch(spark, "packages")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path)


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_edited(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=WINDOW, at_least=ITEMS)


def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH it AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[s + 1 : s + k], ' ') AS g FROM (SELECT item_id, w, least(8, len(w)) AS k, unnest(range(0, len(w) - least(8, len(w)) + 1)) AS s FROM it WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT doc_id, k, s, array_to_string(w[s + 1 : s + k], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS s FROM d, ks WHERE len(w) >= k)),
occ AS (SELECT doc_id, s, dw.k, item_id FROM dw JOIN win USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM occ) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""


def queries():
    return {
        "op1_token_counts": op1_token_counts,
        "op2_license_scan": op2_license_scan,
        "op3_token_store": op3_token_store,
        "op4_bpe_codec": op4_bpe_codec,
        "op5_language_id": op5_language_id,
        "op6_warc": op6_warc,
        "op7_spotsigs": op7_spotsigs,
        "op8_decontaminate": op8_decontaminate,
        "op9_quality": op9_quality,
        "op10_bagminhash": op10_bagminhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": license_scan.oracle(), "op6_warc": warc.oracle(), "op8_decontaminate": OP8_SQL}
