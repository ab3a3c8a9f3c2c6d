"""A corpus pipeline: toxic documents go, recurring lines go, near copies and repeated long
lines go, documents with benchmark passages go, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return
the columns of docs. ``run`` chains them over ``documents``; a driver may write and reread
the rows between stages instead.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterjobs.llm import bpe, decontaminate, lines, neardup, toxicity
from rasterjobs.llm.common import checkpointed, free_shuffles

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Documents that score as much are rejected.
TOXIC = 0.3


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1. Learns from the labelled documents among docs; null and empty texts have the
    score of an empty one."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(~toxicity.rejected(F.col("text"), model, TOXIC))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3, with templates at every scale. All rows stay; text loses its recurring lines
    and n_chars follows it."""
    return _shortened(docs, lines.drop_templates(docs, carry=_carried(docs), scaled=True))


def _carried(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("doc_id", "text")]


def _shortened(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """cut, of drop_templates or drop_passages, with the columns of docs."""
    out = cut.withColumn("text", F.col("kept"))
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed)
    return out.select(*docs.columns)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4, five words and similarity 0.8. The document of the least id of each group
    stays; of equal rows one; rows with a null id stay. Of a long line that several of them hold
    (operator 3's passages) the first document's stays."""
    found = neardup.near_duplicates(docs)
    first = checkpointed(found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct())
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    kept = _shortened(docs, lines.drop_passages(kept, carry=_carried(docs)))
    return docs.filter(F.col("doc_id").isNull()).unionByName(kept)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10. Documents that hold ten consecutive words of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8. doc_id, n_tokens, ids (packed little-endian 32-bit), and digests of the ids and
    of what they decode to."""
    path = public_tokenizers.path(RANKS)
    return bpe.encode(docs, path, public_tokenizers.PATTERN, back=True).select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_recurring_lines),
    ("near_duplicates", keep_one_copy),
    ("decontamination", drop_benchmark_passages),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = checkpointed(docs)  # the next stage reads it several times
            free_shuffles(spark)
    return docs


#: A trained classifier is not to be expressed in SQL; tests/llm hold brute-force versions.
ORACLE_SQL = None


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
