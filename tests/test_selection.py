"""Percentiles by rounds of selection and points spread apart by rounds of aggregates, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterjobs.operators import pixels, prompts, stats


def values(kind):
    draw = np.random.default_rng(4)
    return {
        "random": draw.standard_normal(3_000),
        "tails": np.exp(40 * draw.standard_normal(3_000)) * draw.choice([-1, 1], 3_000),
        "tied": np.round(draw.standard_normal(3_000), 1),
        "one": np.full(500, 2.5),
        "mostly one": np.concatenate([np.full(4_000, 0.25), draw.random(900)]),
    }[kind]


@pytest.mark.parametrize("kind", ["random", "tails", "tied", "one", "mostly one"])
def test_selection_equals_percentile(spark, kind):
    v = values(kind)
    rows = [("a", 0, float(x)) for x in v] + [("a", 1, float(x)) for x in v[:7]] + [(None, 2, float(-x)) for x in v] + [("a", 3, None)] * 3
    px = spark.createDataFrame(rows, "subject string, z int, v double").repartition(5)
    ps = {"low": 0, "p3": 3, "mid": 50, "p97": 97.5, "top": 100}
    want = px.groupBy("subject", "z").agg(*[F.percentile("v", p / 100).alias(n) for n, p in ps.items()])
    # 20 distinct values may be ordered at once, so several rounds are needed
    got = stats.percentiles(px, ps, gathered=20)
    plain = lambda df: sorted(str([x + 0.0 if isinstance(x, float) else x for x in r]) for r in df.collect())
    assert plain(got) == plain(want)


def test_selection_orders_no_group(spark):
    """What a window orders is no more than what may be gathered."""
    px = spark.range(20_000).select(F.lit("a").alias("subject"), F.lit(0).alias("z"), (F.xxhash64("id") / 7).alias("v"))
    got = stats.percentiles(px, {"p": 40}, gathered=50).first()
    assert got.p == px.agg(F.percentile("v", 0.4)).first()[0]
    assert stats.percentiles(px.limit(0), {"p": 40}).collect() == []


def by_hand(points, first, k):
    points, chosen = sorted(points), [first]
    while len(chosen) < min(k, len(points)):
        gap = [min((y - a) ** 2 + (x - b) ** 2 for a, b in chosen) for y, x in points]
        chosen.append(points[int(np.argmax(gap))])
    return chosen


@pytest.mark.parametrize("k", [0, 1, 2, 5])
def test_farthest_points_equal_a_greedy_search(spark, k):
    draw = np.random.default_rng(k)
    groups = {("S", z): sorted({tuple(map(int, p)) for p in draw.integers(0, 12, (n, 2))}) for z, n in enumerate((1, 3, 40, 90))}
    groups[(None, 9)] = [(0, 0), (0, 5), (5, 0), (5, 5)]
    rows = [(s, z, y, x) for (s, z), ps in groups.items() for y, x in ps]
    px = spark.createDataFrame(rows + rows[:20], "subject string, z int, y int, x int").repartition(3)
    got = {}
    for r in prompts.farthest_points(px, 5, k).orderBy("z", "ord").collect():
        got.setdefault((r.subject, r.z), []).append((r.y, r.x))
    if not k:
        assert got == {}
        return
    assert got == {g: by_hand(ps, got[g][0], k) for g, ps in groups.items()}


def test_farthest_points_with_a_number_of_its_own_for_each_group(spark):
    rows = [("S", z, y, x, z) for z in (0, 1, 3) for y in range(4) for x in range(4)]
    px = spark.createDataFrame(rows, "subject string, z int, y int, x int, k int")
    got = prompts.farthest_points(px).groupBy("z").count()
    assert sorted(map(tuple, got.collect())) == [(1, 1), (3, 3)]
    assert prompts.farthest_points(px.limit(0)).collect() == []


@pytest.mark.parametrize("k", [0, 1, 2, 5, 9])
def test_farthest_points_of_runs_equal_a_greedy_search(spark, k):
    draw = np.random.default_rng(k)
    runs = [("S", z, 2 * i, a, a + w) for z, n in enumerate((1, 3, 12)) for i, (a, w) in enumerate(map(tuple, draw.integers(0, 14, (n, 2)).tolist()))]
    runs += [(None, 9, 0, 0, 0), (None, 9, 1, 0, 0), (None, 8, 0, 0, 40), (None, 8, 20, 0, 40)]
    groups = {}
    for s, z, y, a, b in runs:
        groups.setdefault((s, z), []).extend((y, x) for x in range(a, b + 1))
    table = spark.createDataFrame(runs, "subject string, z int, y int, x0 int, x1 int").repartition(3)
    got = {}
    for r in prompts.farthest_points_runs(table, 5, k).orderBy("z", "ord").collect():
        got.setdefault((r.subject, r.z), []).append((r.y, r.x))
    first = {(r.subject, r.z): (r.y, r.x) for r in prompts.farthest_points(pixels.pixels_of(table), 5, 1).collect()}
    assert got == ({g: by_hand(ps, first[g], k) for g, ps in groups.items()} if k else {})
