"""Vector codes, hard negatives and near-duplicate vectors against brute force on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterjobs.llm import codes, neardup_vectors, negatives
from rasterjobs.llm.codes import BallTree
from rasterjobs.llm.vectors import whole_numbers

SCHEMA = "vec_id long, embedding array<double>, label int, codes string, error string, n_links int, component_id int, rank int"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    """(id, vector, label), with further columns whose names results use too."""
    return spark.createDataFrame([(*r, "c", "e", 1, 2, 3) for r in rows], SCHEMA).repartition(3)


def odd(dim):
    return [
        (901, None, 1), (902, [NAN] + [0.5] * (dim - 1), 1), (903, [INF] + [0.5] * (dim - 1), 1), (904, [None] + [0.5] * (dim - 1), 2),
        (905, [], 1), (906, [0.5] * (dim + 4), 1), (907, [0.0] * dim, 1), (None, [0.25] * dim, 1), (908, [0.25] * dim, None),
    ]


def clustered(seed, n, dim, labels=3, spread=0.05):
    draw, out = np.random.default_rng(seed), []
    centres = draw.standard_normal((max(1, n // 8), dim))
    for i in range(n):
        v = centres[draw.integers(len(centres))] + spread * draw.standard_normal(dim)
        out.append((i, v.tolist(), int(draw.integers(labels))))
    out += [(n + i, list(out[7][1]), 1) for i in range(6)]  # exact copies
    return out


def usable(v, dim):
    return v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)


# --- codes -------------------------------------------------------------------------------------


def by_hand(rows, dim, parts, entries, rounds):
    kept = [(i, v, lab) for i, v, lab in rows if usable(v, dim)]
    x = np.floor(1024 * np.array([v for _, v, _ in kept])).astype(np.int64)
    first = {}
    for k, (i, v, _) in enumerate(kept):
        if i is not None and (i not in first or v < kept[first[i]][1]):
            first[i] = k
    seeds = [first[i] for i in sorted(first)[:entries]]
    code, error, books = np.zeros((len(kept), parts), int), np.zeros(len(kept), np.int64), []
    for p, part in enumerate(np.split(x, parts, axis=1)):
        book = part[seeds].copy()
        for r in range(rounds + 1):
            far = ((part[:, None] - book[None]) ** 2).sum(axis=2)
            code[:, p] = far.argmin(axis=1)
            if r < rounds:
                for e in range(len(book)):
                    own = part[code[:, p] == e]
                    if len(own):
                        book[e] = own.sum(axis=0) // len(own)
        error += far.min(axis=1)
        books.append(book)
    return sorted(((i, lab, tuple(c), int(e)) for (i, _, lab), c, e in zip(kept, code.tolist(), error, strict=True)), key=str), books


@pytest.mark.parametrize("pack", [8192, 37])
def test_codes_equal_plain_rounds(spark, pack):
    rows = clustered(1, 300, 16) + odd(16) + [(5, [0.125] * 16, 2), (6, [9e30] * 16, 0)]
    rows.append(rows[3])
    rows = [r for r in rows if r[1] is None or 9e30 not in r[1]]
    coded, books = codes.compress(frame(spark, rows), entries=20, pack=pack)
    want, want_books = by_hand(rows, 16, 4, 20, 4)
    assert sorted(((r.vec_id, r.label, tuple(r.codes), r.error) for r in coded.collect()), key=str) == want
    assert all(np.array_equal(a, b) for a, b in zip(books, want_books, strict=True))
    totals = codes.with_group_totals(coded, "label", "error", "all").select("label", "all").distinct().collect()
    sums = {lab: sum(e for _, k, _, e in want if k == lab) for lab in {w[1] for w in want}}
    assert {r.label: r["all"] for r in totals} == sums and len(totals) == len(sums)


def test_codes_of_odd_tables(spark):
    for rows in ([], [(1, None, 1)], [(1, [0.5] * 6, 1)], [(None, [0.5] * 8, 1)]):
        coded, books = codes.compress(frame(spark, rows))
        assert coded.collect() == [] and books == []
    huge = [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [0.5] * 8, None)]
    coded, books = codes.compress(frame(spark, huge), rounds=0)
    assert sorted(tuple(r.codes) for r in coded.collect()) == [(0,) * 4, (1,) * 4, (2,) * 4] and abs(books[0]).max() < 2**29


@pytest.mark.parametrize("kind", ["random", "copies", "line", "clusters"])
def test_trees_give_each_point_its_nearest_entry(kind):
    draw = np.random.default_rng(3)
    x = draw.integers(-500, 500, (700, 5))
    if kind == "copies":
        x = np.repeat(x[:9], 80, axis=0)
    if kind == "line":
        x[:, 1:] = 0
    if kind == "clusters":
        x = x[draw.integers(0, 12, 700)] + draw.integers(-3, 3, (700, 5))
    book = np.concatenate([x[draw.integers(0, len(x), 30)], draw.integers(-800, 800, (30, 5)), x[:2]])
    tree = BallTree.over(x, leaf=8)
    want = ((x[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
    code, total, count = tree.owners(book)
    assert np.array_equal(tree.in_order(code), want) and np.array_equal(count, np.bincount(want, minlength=len(book)))
    for e in range(len(book)):
        assert np.array_equal(total[e], x[want == e].sum(axis=0))
    inside = [np.sqrt(((tree.x[a:b] - c) ** 2).sum(axis=1)).max() <= r + 1e-9 for a, b, c, r in zip(tree.first, tree.last, tree.centre, tree.radius, strict=True)]
    assert all(inside) and len(tree.first) > 1


def test_balls_are_owned_whole_where_points_lie_in_clusters():
    """Most entries get all their points as whole balls, by the cached sums."""
    draw = np.random.default_rng(5)
    centres = draw.integers(-2000, 2000, (40, 8))
    x = centres[draw.integers(0, 40, 4000)] + draw.integers(-5, 6, (4000, 8))
    tree = BallTree.over(x)
    tree.total = 3 * tree.total  # only what balls give goes by this cache
    code, total, count = tree.owners(centres)
    assert count.sum() == 4000 and np.array_equal(tree.in_order(code), ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1))
    assert (total[count > 0] == 3 * np.stack([x[tree.in_order(code) == e].sum(axis=0) for e in np.flatnonzero(count)])).all(axis=1).mean() > 0.7


# --- hard negatives ----------------------------------------------------------------------------


def mined(rows, dim, anchor, positives, take):
    x = {}
    for i, v, lab in rows:
        if i is not None and lab is not None and usable(v, dim) and i not in x:
            x[i] = (np.floor(256 * np.array(v)).astype(int), lab)
    out = []
    for a in (i for i in x if anchor(i)):
        score = {i: int(x[a][0] @ v) for i, (v, _) in x.items() if i != a}
        first = sorted((i for i in score if x[i][1] == x[a][1]), key=lambda i: (-score[i], i))[:positives]
        for p in first:
            fits = [i for i in score if x[i][1] != x[a][1] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            for rank, i in enumerate(sorted(fits, key=lambda i: (-score[i], i))[:take], 1):
                out.append((a, p, rank, i, score[p], score[i]))
    return sorted(out)


@pytest.mark.parametrize("block", [1024, 50])
def test_hard_negatives_equal_brute_force(spark, block):
    rows = clustered(2, 240, 20, spread=0.4) + odd(20)
    rows.append(rows[11])
    got = negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, block=block, anchor_block=block)
    want = mined([r for r in rows if r[0] != 906], 20, lambda i: i % 10 == 0, 5, 10)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 200
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_of_odd_tables(spark):
    assert negatives.hard_negatives(frame(spark, []), F.col("vec_id") % 10 == 0).collect() == []
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (2, [0.5, 0.0], 2), (3, [0.5, 0.0], 3), (100, [1.0, 0.5, 0.5], 1)]
    assert negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0).collect() == []  # no positives
    rows.append((4, [1.0, 0.0], 1))
    got = negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 4, 1, 2, 65536, 32768), (0, 4, 2, 3, 65536, 32768)]


def test_bounds_hold_and_leave_out_pairs():
    """Scores lie within the bounds of every level, and smooth vectors are settled before the exact score."""
    draw = np.random.default_rng(4)
    x = np.cumsum(draw.integers(-20, 21, (600, 64)), axis=1)
    s, exact = negatives.Summaries(x), x @ x.T
    for mean, spread in s.levels:
        assert (np.abs(exact - mean @ mean.T) <= spread @ spread.T + 1e-6).all()
    ids, labels = np.arange(600), np.arange(600) % 3
    rows = negatives.Block(ids, labels, x)
    anchors = negatives.Block(ids[:50], labels[:50], x[:50])
    best, scored = negatives.search(anchors, rows, np.arange(50), np.full(50, -np.inf), np.full(50, np.inf), 5, True, chunk=64)
    assert scored < 0.5 * 50 * 200
    for a in range(50):
        fits = [i for i in range(600) if i != a and labels[i] == labels[a]]
        assert best.id[best.query == a].tolist() == sorted(fits, key=lambda i: (-exact[a, i], i))[:5]


# --- near-duplicate vectors --------------------------------------------------------------------


def linked(rows, cosine):
    """(id, links, least id reached) of every row, from all pairs."""
    unit = {}
    for k, (i, v, lab) in enumerate(rows):
        if i is not None and lab is not None and v and usable(v, len(v)) and any(v):
            unit[k] = np.array(v) / np.linalg.norm(v)
    near = {k: [j for j in unit if j != k and rows[j][2] == rows[k][2] and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= cosine] for k in unit}
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = set(near.get(todo.pop(), [])) - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((i, len(near.get(k, [])), min(ids) if ids else None))
    return sorted(out, key=str)


def copies(seed, n, dim, spread):
    draw, out = np.random.default_rng(seed), []
    for i in range(n):
        v = draw.standard_normal(dim)
        if i > 4 and draw.random() < 0.6:
            v = np.array(out[draw.integers(5) if draw.random() < 0.6 else draw.integers(i)][1]) + spread * v * draw.random()
        out.append((i, (v * draw.uniform(0.5, 2)).tolist(), int(draw.integers(2))))
    return out


@pytest.mark.parametrize(("spread", "heavy", "block"), [(0.12, 64, 1024), (0.12, 4, 3), (0.3, 4, 5), (0.45, 3, 1024)])
def test_near_duplicate_vectors_equal_brute_force(spark, spread, heavy, block):
    """Groups of near copies in balls and outside, buckets cut into blocks; 0.3 and 0.45 have pairs about the
    threshold, so that balls are taken apart. A pair at the threshold is missed with probability 0.002."""
    rows = copies(7, 160, 32, spread) + odd(32)
    rows += [(1000 + i, list(rows[2][1]), rows[2][2]) for i in range(9)] + [rows[5], (2000, (-np.array(rows[2][1])).tolist(), rows[2][2])]
    random.Random(1).shuffle(rows)
    got = sorted(map(tuple, neardup_vectors.near_duplicates(frame(spark, rows), heavy=heavy, block=block).collect()), key=str)
    assert got == linked(rows, 0.93) and sum(r[1] for r in got) > 100


def test_near_duplicate_vectors_of_odd_tables(spark):
    assert neardup_vectors.near_duplicates(frame(spark, [])).collect() == []
    got = neardup_vectors.near_duplicates(frame(spark, odd(8))).collect()
    assert sorted(r.n_links for r in got) == [0] * 9 and all(r.component_id == r.vec_id for r in got)
    extreme = [(2, [1e-300, 2e-300], 1), (1, [1e300, 2e300], 1), (3, [5e-324, 0.0], 1)]
    assert sorted(map(tuple, neardup_vectors.near_duplicates(frame(spark, extreme)).collect())) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_chance_of_meeting():
    assert neardup_vectors.chance(0.93) > 0.995 and neardup_vectors.chance(0.97) > 0.99999 and neardup_vectors.chance(0.0) < 0.02


def test_whole_numbers_stay_in_bounds():
    assert whole_numbers(np.array([[-0.1, 0.1, 1e300, -1e300]]), 1024, 4)[0].tolist()[:2] == [-103, 102]
    assert abs(whole_numbers(np.array([[1e300]]), 1024, 4)).max() ** 2 * 4 * 4 < 2**63
