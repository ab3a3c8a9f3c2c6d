"""Line dedup by a log-template tree, in DataFrame functions only.

A line descends a tree of fixed depth: first by its number of tokens, then by its leading
tokens, where digits are masked and a token with a digit is a wildcard. In a leaf that enough
documents reach, a token that stands in enough documents at the same place is constant, any
other is a variable field; a line's template keeps the constants. A template is one if enough
of its tokens are constant, and it recurs if enough documents hold it. Lines of recurring
templates are dropped, but for those of the first document that holds the template.

With a fixed number of documents for "enough", the values of a field become constants once the
table is large. ``scaled`` asks at min_docs, 2, 4, 8, ... times min_docs too: at each level a
constant and a template need that many documents, so a line that goes at some size of the
table goes at any larger size with the same distribution, and lines that few documents hold
are judged as before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_shuffles

RARE_BLANKS = "[\\t\\r\\f\\x0B]"
LEADING, MIN_TOKENS, MIN_DOCS, CONSTANT = 3, 3, 10, 0.7
#: Tokens of a line that counts as a passage: equal ones are dropped from two documents on.
LONG_TOKENS = 50
#: Leaves that are broadcast to pick lines; beyond, a shuffle join.
BROADCAST_LEAVES = 500_000


def _cut(docs: DataFrame, masks: bool) -> DataFrame:
    """_id, _th (text hash), pos, tokens of each line. Digits are masked and rare blanks made plain in
    the whole text, so lines and tokens are cut at single characters."""
    text = F.regexp_replace("_text", "[0-9]+", "#") if masks else F.col("_text")
    plain = F.when(F.col("_m").rlike(RARE_BLANKS), F.regexp_replace("_m", RARE_BLANKS, " ")).otherwise(F.col("_m"))
    cut = docs.select("_id", F.xxhash64("_text").alias("_th"), text.alias("_m"))
    cut = cut.select("_id", "_th", F.posexplode(F.split(plain, "\n")).alias("pos", "line"))
    return cut.select("_id", "_th", "pos", F.array_remove(F.split("line", " "), "").alias("tokens"))


def _lines(docs: DataFrame, leading: int, min_tokens: int) -> DataFrame:
    """_id, _th (text hash), pos, tokens, leaf, shape (hash of the masked line)."""
    token = lambda i: F.get("tokens", F.lit(i))
    lead = [F.when(token(i).contains("#"), "<*>").otherwise(token(i)) for i in range(leading)]
    return _cut(docs, True).filter(F.size("tokens") >= min_tokens).select(
        "_id", "_th", "pos", "tokens",
        F.xxhash64(F.size("tokens"), *lead).alias("leaf"),
        F.xxhash64("tokens").alias("shape"),
    )


def drop_templates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None,
    leading: int = LEADING, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, constant: float = CONSTANT,
    scaled: bool = False,
) -> DataFrame:
    """One row per document row: id, ``carry`` columns, n_lines, n_dropped, kept (the text without
    the dropped lines).

    Lines end at a line feed. Null text has no lines and stays null; lines of fewer than
    ``min_tokens`` tokens stay. Rows with a null id count as no document and lose nothing; rows
    with the same id are one document. Line tables hold hashes only; each step is grouped by
    hash with partial aggregation, so a line that a third of all documents hold is summed
    before it is moved, and met in joins that Spark can split.
    """
    spark, carry = docs.sparkSession, carry or []
    rows = docs.select(
        F.struct(id_col, *carry).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text")
    )
    known = rows.filter("_id is not null and _text is not null")
    lines = checkpointed(_lines(known, leading, min_tokens).select("_id", "_th", "pos", "leaf", "shape"))
    held = lines.select("leaf", "shape", "_id").distinct()
    leaves = lines.select("leaf", "_id").distinct().groupBy("leaf").agg(F.count("*").alias("docs"))
    leaves = checkpointed(leaves.filter(F.col("docs") >= min_docs).select("leaf"))
    near = F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves
    held = checkpointed(held.join(near, "leaf", "left_semi"))
    weights = held.groupBy("leaf", "shape").agg(F.count("*").alias("docs"))
    texts = _lines(known, leading, min_tokens).join(near, "leaf", "left_semi")
    texts = texts.groupBy("leaf", "shape").agg(F.first("tokens").alias("tokens"))
    kinds = checkpointed(texts.join(weights, ["leaf", "shape"]))
    each = kinds.select("leaf", "shape", "docs", F.size("tokens").alias("n"), F.posexplode("tokens").alias("place", "token"))
    each = each.withColumn("token", F.xxhash64("token"))
    constants = each.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("s")).filter(F.col("s") >= min_docs)
    # the last level at which the token is constant: log2(s / min_docs), rounded down
    top = F.length(F.bin((F.col("s") / min_docs).cast("bigint"))) - 1 if scaled else F.lit(0)
    levels = F.explode(F.sequence(F.lit(0), top)).alias("level")
    constants = constants.select("leaf", "place", "token", levels)
    templates = (
        each.join(constants, ["leaf", "place", "token"])
        .groupBy("leaf", "shape", "level")
        .agg(F.first("n").alias("n"), F.count("*").alias("kept"), F.bit_xor(F.xxhash64("place", "token")).alias("template"))
        .filter(F.col("kept") >= F.col("n") * F.lit(constant))
        .groupBy("leaf", "shape", "template").agg(F.min("level").alias("level"))
    )
    templates = checkpointed(templates)
    recurring = (
        held.join(templates.drop("level"), ["leaf", "shape"])
        .groupBy("leaf", "template", "_id").agg(F.lit(1).alias("one"))
        .groupBy("leaf", "template").agg(F.count("*").alias("docs"), F.min("_id").alias("first_id"))
        .filter(F.col("docs") >= min_docs)
    )
    doomed = checkpointed(
        templates.join(recurring, ["leaf", "template"])
        .filter(F.col("docs") >= min_docs * F.pow(F.lit(2), F.col("level")))
        .groupBy("leaf", "shape").agg(F.min("first_id").alias("first_id"))
    )
    gone = (
        lines.join(doomed, ["leaf", "shape"])
        .filter(F.col("_id") > F.col("first_id"))
        .groupBy(F.col("_id").alias("_gone_id"), F.col("_th").alias("_gone_th"))
        .agg(F.sort_array(F.collect_set("pos")).alias("_gone"))
    )
    gone = checkpointed(gone)
    free_shuffles(spark)
    return _without(rows, gone)


def drop_passages(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, long_tokens: int = LONG_TOKENS,
) -> DataFrame:
    """As drop_templates, but what goes are lines of at least ``long_tokens`` tokens that a document
    of a lesser id holds too, with the same tokens and digits.

    It belongs after near-duplicates: before, it would cut the copies down to what is left of
    them beside their long lines, and they would no longer be found."""
    rows = docs.select(
        F.struct(id_col, *(carry or [])).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text")
    )
    known = rows.filter("_id is not null and _text is not null")
    cut = _cut(known, False).filter(F.size("tokens") >= long_tokens)
    lines = checkpointed(cut.select("_id", "_th", "pos", F.xxhash64("tokens").alias("line")))
    shared = lines.groupBy("line").agg(F.min("_id").alias("first_id"), F.max("_id").alias("last_id")).filter("first_id < last_id")
    gone = (
        lines.join(shared.select("line", "first_id"), "line")
        .filter(F.col("_id") > F.col("first_id"))
        .groupBy(F.col("_id").alias("_gone_id"), F.col("_th").alias("_gone_th"))
        .agg(F.sort_array(F.collect_set("pos")).alias("_gone"))
    )
    return _without(rows, checkpointed(gone))


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows (_row, _id, _text) without the lines at the places in gone (_gone_id, _gone_th, _gone)."""
    met = (F.col("_id") == F.col("_gone_id")) & (F.xxhash64("_text") == F.col("_gone_th"))
    cut = F.split("_text", "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size("_cut") - 1), "_gone")
    kept = F.array_join(F.transform(places, lambda i: F.get("_cut", i)), "\n")
    return rows.join(gone, met, "left").withColumn("_cut", cut).select(
        "_row.*",
        F.coalesce(F.size("_cut"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(kept).alias("kept"),
    )
