"""Line dedup, decontamination, licenses, toxicity, language id, neighbours and scoring: brute
force, exact properties and held-out accuracy on small tables."""

import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterjobs.llm import decontaminate, langid, licenses, lines, neighbours, pitmanyor, toxicity
from rasterjobs.llm.sql import ORACLES

ODD = [(9001, None), (9002, ""), (9003, " \n\t "), (None, "some words here"), (9004, "x" * 50_000)]


def frame(spark, rows, extra=True):
    if extra:
        rows = [(*r, "s", 1, 0.5) for r in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words long, score double").repartition(3)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


@pytest.mark.parametrize("block_words", [4_000_000, 20])
def test_decontamination_equals_brute_force(spark, block_words):
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, text(draw.choice([3, 9, 10, 11, 30]))) for i in range(12)] + [(50, None), (51, ""), (3, "w1 w2 w3 w4")]
    rows = []
    for i in range(60):
        parts = [text(draw.randint(0, 12)) for _ in range(3)]
        if i % 2:
            source = draw.choice(items[:12])[1].split(" ")
            a = draw.randint(0, len(source))
            parts.insert(1, "-".join(source[a : a + 14]).upper())
        rows.append((i, ". ".join(parts)))
    rows += [*ODD, rows[1], (None, rows[3][1])]
    found = decontaminate.find_contamination(
        frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words
    ).collect()
    want = []
    for doc, body in rows:
        w, hit, met = words_of(body), set(), set()
        for item, passage in items:
            p = words_of(passage)
            n = min(10, len(p))
            grams = {tuple(p[k : k + n]) for k in range(len(p) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    met.add(str(item))
        want.append((doc, len(w), len(hit), sorted(met)))
    got = [(r.doc_id, r.n_words, sum(s.end - s.first for s in r.spans), list(r["items"])) for r in found]
    assert sorted(got, key=str) == sorted(want, key=str)
    clean = decontaminate.drop_contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words)
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, _, n, _ in want if not n)


def test_line_dedup_equals_sql(spark):
    draw = random.Random(8)
    rows = []
    for i in range(60):
        body = [" ".join(draw.choice("abcdefgh") * draw.randint(1, 3) for _ in range(draw.randint(1, 14))) for _ in range(4)]
        body.insert(draw.randint(0, 4), f"Posted by {draw.choice(['ann', 'bob', 'eve'])} on day {i} of the year")
        if i % 3 == 0:
            body.append("All rights reserved.")
        rows.append((i, "\n".join(body)))
    rows += [(9001, None), (9002, ""), (9003, " \n\t "), (None, rows[0][1]), rows[3], (4, rows[7][1])]
    got = lines.drop_templates(frame(spark, rows)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("h"))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.sql(ORACLES["op3_line_dedup"]).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert got.agg(F.sum("n_dropped")).first()[0] > 60
    assert lines.drop_templates(frame(spark, [], False)).collect() == []


@pytest.mark.parametrize("size", [300, 3000])
def test_fields_stay_fields_in_a_larger_table(spark, size):
    """20 names and 20 cities: in 3,000 documents each value passes MIN_DOCS, hardly any line does."""
    rows = [(i, f"the parcel was sent by n{'abcdefghijklmnopqrst'[i % 20]} to c{'abcdefghijklmnopqrst'[i * 7 % 401 % 20]} on time") for i in range(size)]
    rows += [(size + i, f"the parcel was found again by the river near {w} mill") for i, w in enumerate("abcdefghijkl")]
    dropped = {r.doc_id for r in lines.drop_templates(frame(spark, rows), scaled=True).collect() if r.n_dropped}
    assert dropped == set(range(1, size + 12)) - {size}


def test_license_places_and_edits(spark):
    rows = [
        (1, "Released Under the MIT License. under the mit license"), (2, "Released under the MTT Licence."),
        (3, "the Apache-License, version 2.0"), (4, "apache licence version 1"), (5, "CC BY-NC cc by nc cc by nd"), (6, "no notice under the sun"), *ODD,
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    labels = {k: sorted({s.label for s in r.spans}) for k, r in got.items()}
    assert [x.first for x in got[1].exact] == [1, 5] and labels[2] == ["mit"] and got[2].spans[0].errors > 0
    assert labels[3] == ["apache-2"] and labels[4] == [] and labels[6] == []
    assert [x.first for x in got[5].exact] == [0, 3] and got[9001].n_words == 0 and len(got) == 11


def test_seeds_find_every_notice_with_few_edits():
    """Whatever edits are made, up to the bound, one piece stays and the notice is found."""
    scanner, draw = licenses.Scanner(licenses.BASE, licenses.NOTICES), random.Random(1)
    for notice in licenses.NOTICES:
        for _ in range(40):
            body = list(notice.phrase)
            for _ in range(notice.errors):
                k = draw.randrange(1, len(body) - 1)
                if body[k] != " " and body[k - 1] != " " and body[k + 1] != " ":
                    body[k : k + 1] = draw.choice([["q"], [], [body[k], "q"]])
            found = scanner.scan(f"aaa {''.join(body)}{notice.tail} zzz".encode())[2]
            assert notice.label in {f["label"] for f in found}, "".join(body)


def toxic_rows():
    draw, rows = random.Random(2), []
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter") for b in ("na", "ri", "so", "vu")]
    for i in range(400):
        body = [draw.choice(words) for _ in range(draw.randint(20, 60))]
        if i % 4 == 0:
            for _ in range(4):
                body[draw.randrange(len(body))] = draw.choice(["zargblot", "zargwump", "frotzbag"])
        rows.append((i, " ".join(body)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows()
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i, _ in rows] + [(None, 1, 0), (7, None, 0)], "doc_id long, toxic int, text int")
    held, trains = toxicity.held_out()
    docs = frame(spark, rows + ODD)
    model = toxicity.train(docs.filter(trains), labels.filter(trains))
    got = toxicity.score(docs, model).select("doc_id", "score", held.alias("h")).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in got)
    right = [(r.score >= 0.3) == (r.doc_id % 4 == 0) for r in got if r.h and r.doc_id < 9000]
    assert len(right) > 60 and np.mean(right) > 0.95
    empty = toxicity.train(docs.limit(0), labels)
    assert toxicity.score(docs, empty).select("score").distinct().count() == 1


def test_license_scan_equals_patterns_over_whole_texts():
    """Brute force: every notice's pattern over all of every mutated text, and every place of the base phrases."""
    scanner, draw = licenses.Scanner(licenses.BASE, licenses.NOTICES), random.Random(5)
    fill = "the code is here under a license and may be used by all without any version 2 of it mit apache cc by".split(" ")
    hits = 0
    for _ in range(400):
        parts = [" ".join(draw.choice(fill) for _ in range(draw.randint(0, 9)))]
        for notice in draw.sample(licenses.NOTICES, 2):
            body = list(notice.phrase)
            for _ in range(draw.randint(0, notice.errors + 2)):
                k = draw.randrange(len(body))
                body[k : k + 1] = draw.choice([["q"], [], [body[k], "q"]])
            parts += ["".join(body) + notice.tail, draw.choice(fill)]
        parts += [draw.choice(licenses.BASE)[0]] * draw.randint(0, 2)
        text = " ".join(parts)
        words, exact, spans = scanner.scan(text.encode())
        line = " " + " ".join(words_of(text)) + " "
        want = {n.label for n, p in zip(licenses.NOTICES, scanner.patterns, strict=True) if p.search(line)}
        assert {x["label"] for x in spans} == want and words == len(words_of(text))
        for x in spans:  # a span's words hold the notice with as many edits as are told
            inside = " " + " ".join(words_of(text)[x["first"] : x["end"]]) + " "
            told = [sum(m.fuzzy_counts) for n, p in zip(licenses.NOTICES, scanner.patterns, strict=True) if n.label == x["label"] and (m := p.search(inside))]
            assert told and min(told) <= x["errors"]
        held = words_of(text)
        assert sorted((x["label"], x["first"]) for x in exact) == sorted(
            (label, i) for phrase, label in licenses.BASE for i in range(len(held)) if held[i : i + len(phrase.split(" "))] == phrase.split(" ")
        )
        hits += len(want)
    assert hits > 200


def test_a_long_text_is_scored_as_a_whole(monkeypatch):
    text = " ".join(t for _, t in toxic_rows()).encode()
    whole = [x[3].tolist() for x in toxicity.features([b"a b c d e f", text, b"q" * 40])]
    assert len(whole) == 1
    monkeypatch.setattr(toxicity, "CHUNK", 1000)
    parts = {first: bucket.tolist() for first, _, _, bucket in toxicity.features([b"a b c d e f", text, b"q" * 40])}
    monkeypatch.undo()
    assert parts[1] == next(iter(toxicity.features([text])))[3].tolist()


def test_language_codes_and_accuracy(spark):
    draw, rows = random.Random(4), []
    kinds = {"aa": "banana mana kala sana lama ".split(" "), "bb": "brust schlag knopf wurst strumpf ".split(" ")}
    for i in range(200):
        lang = ("aa", "bb")[i % 2]
        rows.append((i, " ".join(draw.choice(kinds[lang]) for _ in range(12)), None if i % 17 == 0 else lang))
    docs = spark.createDataFrame(rows + [(900, None, "aa"), (901, "12 34 !", None)], "doc_id long, text string, lang string")
    held, trains = langid.held_out()
    trees = langid.train(docs.filter(trains))
    got = {r.doc_id: r for r in langid.identify(docs, trees).collect()}
    assert all(got[i].lang_pred == ("aa", "bb")[i % 2] for i in range(200))
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.train(docs.limit(0))).collect()} == {"und"}


def test_code_lengths_equal_the_trees():
    """The flat tables against a walk along the contexts."""
    text, other = b"abracadabra banana", b"cabbage badger abacus zoo"
    from collections import Counter

    n = langid.ORDER
    padded = bytes(n) + text
    seen = [Counter(padded[i + n - k : i + n + 1] for i in range(len(text))) for k in range(n + 1)]
    bits = 0.0
    full = bytes(n) + other
    for i in range(len(other)):
        for k in range(n, -1, -1):
            gram = full[i + n - k : i + n + 1]
            mine = {g: c for g, c in seen[k].items() if g[:-1] == gram[:-1]}
            total = sum(mine.values())
            if gram in mine:
                bits += math.log2(2 * total / (2 * mine[gram] - 1))
                break
            if total:
                bits += math.log2(2 * total / len(mine))
        else:
            bits += 8
    from rasterjobs.llm.bytegrams import counted, grams

    trees = langid.Trees(["x"], [counted(grams(np.frombuffer(padded, np.uint8), n + 1))])
    assert trees.lengths([other])[0, 0] == pytest.approx(bits, rel=1e-5)


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((900, 12)) * rng.random((900, 1)) * 3
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 12), (2002, [float("nan")] * 12), (2003, [1.0, None]), (None, [1.0] * 12), (2004, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(table, table.filter("vec_id % 20 = 0"), shard=300).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 20))
    hits = 0
    for q, found in got.items():
        score = (x * x[q]).sum(axis=1)
        best = sorted((i for i in range(900) if i != q), key=lambda i: (-score[i], i))[:20]
        assert len(found) == 20 and found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(s == pytest.approx(score[i], abs=1e-12) for i, s in found)
        hits += len({i for i, _ in found} & set(best))
    assert hits / (20 * len(got)) >= 0.9
    assert neighbours.nearest(table.limit(0), table).collect() == []


def test_a_full_shard_finds_nine_tenths_by_a_fifth_of_its_rows():
    x = np.random.default_rng(1).standard_normal((neighbours.SHARD, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    forest, n = neighbours.Forest(x, 1.0, 7), len(x)
    gathered, compared = int(neighbours.REACH * neighbours.TREES * n), int(neighbours.COMPARED * n)
    met = list(forest.candidates(x[:60], gathered, compared))
    hits = sum(len(np.intersect1d(m, np.argsort(-(x @ x[i]))[1:21])) for i, m in enumerate(met))
    assert hits / (60 * 20) >= 0.9
    assert sum(len(m) for m in met) / (60 * n) < 0.2


def test_neighbours_with_repeated_rows_clashing_columns_and_several_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist(), 1.0, 2, 3) for i, v in enumerate(rng.standard_normal((200, 4)))]
    kinds = "vec_id long, embedding array<double>, score double, rank int, query_id long"
    once, twice = spark.createDataFrame(rows, kinds), spark.createDataFrame(rows + rows[:50], kinds)
    own = lambda t, **more: sorted(map(tuple, neighbours.nearest(t, t.filter("vec_id % 20 = 0"), k=5, compared=1.0, **more).collect()))
    found = own(once)
    assert len(found) == 50 and own(twice) == found and own(once, shard=40, block=3) == found
    assert neighbours.nearest(once, once.limit(0)).collect() == []


def test_licenses_of_long_texts_repeated_rows_and_empty_tables(spark):
    body = "Under the MIT License, " * 20_000
    got = licenses.scan_licenses(frame(spark, [(1, body), (1, body), *ODD])).collect()
    long = [r for r in got if r.doc_id == 1]
    assert len(long) == 2 and all(r.n_words == 80_000 and [x["first"] for x in r.exact] == list(range(0, 80_000, 4)) for r in long)
    assert licenses.scan_licenses(frame(spark, ODD).limit(0)).collect() == []


def test_decontamination_of_empty_tables(spark):
    docs, items = frame(spark, [(1, "a b c"), *ODD]), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.find_contamination(docs.limit(0), items).collect() == []
    assert all(r.spans == [] and r["items"] == [] for r in decontaminate.find_contamination(docs, items.limit(0)).collect())
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == 6
    assert decontaminate.drop_contaminated(docs, items).count() == 5


def test_scoring_sums_and_probabilities(spark):
    rows = toxic_rows()[:120] + ODD
    docs = frame(spark, rows)
    trains = F.coalesce(F.col("doc_id") % 5 != 1, F.lit(False))
    got = pitmanyor.score(docs, trains, chunk_count=3).collect()
    assert len(got) == len(rows)
    from collections import Counter

    learned = Counter(w for d, t in rows if d is not None and d % 5 != 1 for w in [*((t or "").lower().split()), "\n"])
    n, v = sum(learned.values()), len(learned)
    texts = {d: t for d, t in rows}
    for r in got:
        tokens = [*((texts[r.doc_id] or "").lower().split()), "\n"]
        assert r.n_tokens == len(tokens) and r.train_tokens == n and r.n_known == sum(t in learned for t in tokens)
        assert r.base_score == pytest.approx(sum(math.log10((learned[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens))
        assert r.score < 0
    held = [r for r in got if r.doc_id is not None and r.doc_id % 5 == 1 and r.doc_id < 9000]
    # the words are drawn one by one, so their frequencies are all there is to learn: not 5 % worse than these
    assert 1.05 * sum(r.base_score for r in held) < sum(r.score for r in held) < 0


def test_scores_of_ordered_texts_are_far_above_the_base(spark):
    """Words follow each other in one order, which frequencies do not tell; log probabilities are negative."""
    order = "amber birch cedar daisy elder fern grass hazel iris juniper".split(" ")
    rows = [(i, " ".join(order[(i * 7 + k) % 10] for k in range(30))) for i in range(80)]
    got = pitmanyor.score(frame(spark, rows), F.col("doc_id") % 5 != 1, chunk_count=2).collect()
    held = [r for r in got if r.doc_id % 5 == 1]
    assert len(held) == 16 and all(0.3 * r.base_score < r.score < 0 for r in held)


def test_predictions_of_a_context_sum_to_one():
    from rasterjobs.llm.bytegrams import counted, grams

    data = np.frombuffer(bytes(pitmanyor.ORDER) + b"the cat sat on the mat; the cat ate the rat" * 3, np.uint8)
    keys, n = counted(grams(data, pitmanyor.ORDER + 1))
    own = pitmanyor.Restaurants(keys, n)
    c = np.zeros((256, 256))
    c[own.byte, own.dish] += 1
    own.sample(pitmanyor.upper_restaurants(c, 1), np.random.default_rng(2))
    for context in (b"he cat", b"xxxxxx", b"xx the"):
        head = int.from_bytes(context, "big") << 8
        p = 10 ** own.log10(np.array([head | s for s in range(256)], np.uint64))
        assert p.sum() == pytest.approx(1, abs=1e-6)
    assert all((own.t[k] >= 1).all() and (own.t[k] <= own.c[k]).all() for k in own.t)


def test_seating_matches_the_definition():
    """Mean number of tables against seating one by one without blocks."""
    draw, c, a, d, p = np.random.default_rng(0), 400, 5.0, 0.5, 0.3
    fast = pitmanyor.seat(np.full(3000, c), np.full(3000, a), d, np.full(3000, p), draw).mean()
    t = np.ones(3000)
    for seated in range(1, c):
        new = (a + d * t) * p
        t += draw.random(3000) * (seated - d * t + new) < new
    assert fast == pytest.approx(t.mean(), rel=0.03)


def test_arrow_tables_are_read_as_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["é", None])], ["t"])
    from rasterjobs.llm.common import texts_of

    assert texts_of(batch, "t") == ["é".encode(), None]
