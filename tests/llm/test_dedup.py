"""Near duplicates and substring dedup against brute force on small tables."""

import hashlib
import random

import pytest

from rasterjobs.llm import neardup, substrings
from rasterjobs.llm.common import lower_words, plain_words
from rasterjobs.llm.components import components


def brute_components(rows, size, hundredths):
    sets = []
    for _, text in rows:
        w = lower_words(text.encode() if text else None)
        n = min(size, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= hundredths * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(root(i))) for i, (doc, _) in enumerate(rows)), key=str)


def near_copies(draw, n):
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(n):
        if rows and draw.random() < 0.75:
            text = draw.choice([t for _, t in rows if t] or ["x"]).split(" ")
            for _ in range(draw.randint(0, 3)):
                text[draw.randrange(len(text))] = draw.choice(words)
            if draw.random() < 0.2:
                text.insert(draw.randrange(len(text)), draw.choice(words))
            rows.append((len(rows), " ".join(text)))
        else:
            rows.append((len(rows), " ".join(draw.choice(words) for _ in range(draw.choice([1, 2, 30, 60])))))
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    draw = random.Random(size)
    rows = near_copies(draw, 150)
    rows += [(900, None), (901, ""), (902, " \n "), (903, "A b"), (904, "a B"), (None, "a b"), (905, rows[3][1])]
    rows += [rows[5], (906, rows[5][1].upper())]
    draw.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, n long, cls string")
    got = neardup.near_duplicates(docs.repartition(3), shingle=size).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows, size, 80)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rows_with_null_ids_are_near_others(spark, seed):
    """Null rows as pivots and as members, and the only link between two others."""
    draw = random.Random(seed)
    words = [f"v{seed}_{i}" for i in range(600)]
    rows = []
    for k in range(6):
        body = words[90 * k : 90 * k + 80]
        turns = [" ".join(body[: 60]), " ".join(body[6:66]), " ".join(body[12:72])]
        rows += [(10 * k + 1, turns[0]), (None, turns[1]), (10 * k + 2, turns[2])]
    rows += [(None, " ".join(words[540:590])), (None, " ".join(words[541:591]))]
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, neardup.near_duplicates(docs.repartition(3), shingle=2).collect()), key=str)
    assert got == brute_components(rows, 2, 80)
    assert [r for r in got if r[0] == 12] == [(12, 59, 11)]


def test_chains_meet_in_one_component(spark):
    """Neighbours are similar, ends are not: pivots alone would lose links."""
    words = [f"x{i}" for i in range(260)]
    rows = [(100 - i, " ".join(words[2 * i : 2 * i + 60])) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, neardup.near_duplicates(docs, shingle=2).collect()), key=str)
    assert got == brute_components(rows, 2, 80)
    assert {r[2] for r in got} == {11}


def test_near_duplicates_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(docs).collect() == []


def test_components(spark):
    edges = [(5, 4), (4, 5), (5, 9), (1, 2), (2, 3), (3, 8), (7, 7), (None, 1), *((i, i + 1) for i in range(20, 60))]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {4: 4, 5: 4, 9: 4, 1: 1, 2: 1, 3: 1, 8: 1, **{i: 20 for i in range(20, 61)}}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def brute_repeats(rows, n):
    least = {}
    for doc, text in rows:
        w = plain_words(text.encode() if text else None)
        for i in range(len(w) - n + 1):
            if doc is not None:
                key = tuple(w[i : i + n])
                least[key] = min(least.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = plain_words(text.encode() if text else None)
        gone = set()
        for i in range(len(w) - n + 1):
            if doc is not None and least[tuple(w[i : i + n])] < doc:
                gone |= set(range(i, i + n))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [4, 13])
def test_repeats_equal_brute_force(spark, window):
    draw = random.Random(window)
    words = ["a", "b", "é", "c", "the", "x" * 20]
    passages = [" ".join(draw.choice(words) for _ in range(draw.randint(window, 50))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [" ".join(f"{draw.choice(words)}{draw.randint(0, 90)}" for _ in range(draw.randint(0, 25))) for _ in range(3)]
        parts.insert(draw.randint(0, 3), draw.choice(passages))
        rows.append((i, draw.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(200, None), (201, ""), (202, "a b"), rows[4], (4, rows[7][1]), (None, rows[9][1]), (203, rows[9][1])]
    rows += [(204, "a " * 3000), (205, "a " * 2000)]
    draw.shuffle(rows)
    docs = spark.createDataFrame([(*r, "z", 3) for r in rows], "doc_id long, text string, kept string, first long")
    got = substrings.drop_repeats(docs.repartition(3), window=window).collect()
    found = sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got), key=str)
    assert found == brute_repeats(rows, window)


def test_repeats_of_nothing(spark):
    assert substrings.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
