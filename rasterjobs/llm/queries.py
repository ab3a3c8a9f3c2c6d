"""The queries of the thirteen operators: opN_<name>(spark, sf_dir)."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, decontaminate, langid, licenses, lines, neardup, neardup_vectors, negatives, neighbours, pitmanyor, substrings, toxicity
from .common import checkpointed, fold
from .sql import ORACLES

RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held, trains = toxicity.held_out()
    model = toxicity.train(docs.filter(trains), labels.filter(trains))
    return toxicity.score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held, trains = fold("doc_id", 5, 1)
    found = pitmanyor.score(docs, trains)
    return found.select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_templates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return found.withColumn("kept", kept)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.drop_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    places = F.transform("exact", lambda x: x["first"])
    base, fuzzy = F.transform("exact", lambda x: x["label"]), F.transform("spans", lambda x: x["label"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    likeness = F.coalesce(F.array_max(F.transform("spans", lambda x: x["likeness"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("exact").cast("bigint").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, fuzzy)).alias("labels"),
        F.when(F.size("exact") > 0, 1.0).otherwise(likeness).alias("score"),
        "spans",
    )


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return bpe.encode(_table(spark, sf_dir, "documents"), path, pattern, back=True).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held, trains = langid.held_out()
    trees = langid.train(docs.filter(trains))
    return langid.identify(docs, trees).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )
    hits = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])
    return found.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(_table(spark, sf_dir, "embeddings"))
    rows = checkpointed(coded.select("vec_id", "label", codes.hexadecimal(F.col("codes")).alias("code"), "error"))
    told = ",".join(str(x) for book in books for x in book.ravel().tolist())
    return codes.with_group_totals(rows, "label", "error", "label_error").select(
        "vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(told.encode()).hexdigest()).alias("codebooks_sha256")
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op13_vector_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup_vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_line_dedup": op3_line_dedup,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_license_scan": op6_license_scan,
        "op7_nearest_neighbours": op7_nearest_neighbours,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_language_id": op9_language_id,
        "op10_decontamination": op10_decontamination,
        "op11_vector_codes": op11_vector_codes,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_vector_near_duplicates": op13_vector_near_duplicates,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
