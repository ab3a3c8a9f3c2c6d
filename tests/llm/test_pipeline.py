"""The pipeline's stages on a small folder of tables, each against what it must do to its input."""

import random

import corpus_pipeline
from rasterjobs.llm import toxicity


def test_stages(spark, tmp_path):
    draw = random.Random(0)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter", "pon") for b in ("na", "ri", "so", "vu", "del")]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    rows = []
    for i in range(160):
        body = text(60)
        if i % 5 == 0:
            body = " ".join(w if k % 8 else "zargblot" for k, w in enumerate(body.split(" ")))
        rows.append((i, body + "\n" + text(6) + "\nplease read our terms first", "en", "s", len(body)))
    rows += [(200, rows[1][1], "en", "s", 1), (201, rows[1][1] + " extra", "en", "s", 1), (202, None, None, None, None), (203, "", "en", "s", 0)]
    passage = " ".join(f"q{i}" for i in range(12))
    rows.append((204, text(20) + " " + passage + " " + text(20), "en", "s", 9))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r for r in docs.collect()}
    kept = seen["toxicity"]
    assert not [i for i in range(0, 160, 5) if i in kept] and len([i for i in kept if i < 160]) >= 125 and 202 in kept
    first = min(i for i in kept if i < 160)
    after = seen["line_dedup"]
    assert set(after) == set(kept)
    assert all(("please read" in r.text) == (i == first) for i, r in after.items() if i < 160)
    groups = seen["near_duplicates"]
    assert 1 in groups and 200 not in groups and 201 not in groups and {202, 203} <= set(groups)
    assert set(seen["decontamination"]) == set(groups) - {204}
    assert set(seen["byte_bpe"]) == set(seen["decontamination"])
    assert toxicity.ORDERS == (5, 7)


def test_a_long_line_of_few_documents_stays_once(spark):
    draw = random.Random(1)
    text = lambda n: " ".join(f"{draw.choice('abcdefgh')}{draw.choice('klmnopqr')}{draw.randint(0, 99)}" for _ in range(n))
    passage, short, own = text(55), text(20), [text(90) for _ in range(4)]
    rows = [(i, f"{own[i]}\n{passage}\n{short}", 7) for i in range(3)]
    rows += [(3, own[3] + "\n" + passage.replace("1", "2"), 7), (4, rows[2][1] + " more", 7), (5, None, None), (None, passage, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.keep_one_copy(spark, docs, "").collect()}
    cut = {i: f"{own[i]}\n{short}" for i in (1, 2)}
    assert got == {0: (rows[0][1], 7), **{i: (t, len(t)) for i, t in cut.items()}, 3: (rows[3][1], 7), 5: (None, None), None: (passage, 7)}
