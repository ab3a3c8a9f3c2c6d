"""Repeated rows, clashing columns, very long texts and empty tables of toxicity and language identification."""

import random

from pyspark.sql import functions as F

from rasterjobs.llm import langid, toxicity


def test_toxicity_of_repeated_rows_and_empty_tables(spark):
    draw = random.Random(8)
    bad, good = "filth scum rot vile".split(" "), "garden river bread stone".split(" ")
    rows = [(i, " ".join(draw.choice((bad, good)[i % 2]) for _ in range(12)), 0.5, "x") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(80)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    once = {r.doc_id: r.score for r in toxicity.score(docs, model).select("doc_id", "score").collect()}
    twice = [(r.doc_id, r.score) for r in toxicity.score(docs.unionAll(docs), model).select("doc_id", "score").collect()]
    assert len(twice) == 160 and all(s == once[i] for i, s in twice)
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_languages_of_repeated_rows_long_texts_clashing_columns_and_empty_tables(spark):
    draw = random.Random(9)
    kinds = ("banana mana kala sana lama".split(" "), "brust schlag knopf wurst strumpf".split(" "))
    text = lambda i, n: " ".join(draw.choice(kinds[i % 2]) for _ in range(n))
    rows = [(i, text(i, 12), ("aa", "bb")[i % 2], "zz", 7.0) for i in range(80)] + [(900, text(1, 200_000), None, "zz", 7.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    trees = langid.train(docs.filter("doc_id < 80"))
    found = lambda df: sorted((r.doc_id, r.lang_pred, r.score) for r in langid.identify(df, trees).select("doc_id", "lang_pred", "score").collect())
    once = found(docs)
    assert once[-1][:2] == (900, "bb") and all(0 <= s <= 1 for _, _, s in once)
    assert [p for _, p, _ in once[:80]] == ["aa", "bb"] * 40
    assert found(docs.unionAll(docs)) == sorted(once * 2)
    assert found(docs.filter(F.lit(False))) == []
