"""Run algebra against sets of pixels."""

import random

import pytest
from pyspark.sql import functions as F

from rasterjobs import fixtures
from rasterjobs.operators import metrics, pixels, runs

SCHEMA = "subject string, z int, y int, x0 int, x1 int"


def drawn(seed, n=60):
    """Runs that overlap, touch and repeat, in two slices, one without a subject."""
    draw = random.Random(seed)
    out = [(draw.choice(["S", None]), 0, draw.randrange(4), a := draw.randrange(30), a + draw.randrange(6)) for _ in range(n)]
    return out + out[:3]


def cells(rows):
    return {(s, z, y, x) for s, z, y, a, b in rows for x in range(a, b + 1)}


def of(df):
    got = [tuple(r[c] for c in ("subject", "z", "y", "x0", "x1")) for r in df.collect()]
    for s, z, y, a, b in got:  # maximal, so no two touch
        assert not any((s, z, y) == (t, w, v) and a <= d + 1 and c <= b + 1 for t, w, v, c, d in got if (a, b) != (c, d))
    assert len(got) == len(set(got))
    return cells(got)


@pytest.mark.parametrize("seed", [1, 2])
def test_union_intersection_difference(spark, seed):
    rows = [drawn(seed * 10 + k) for k in range(2)]
    a, b = (spark.createDataFrame(r, SCHEMA).repartition(3) for r in rows)
    p, q = map(cells, rows)
    assert of(runs.union(a, b)) == p | q and of(runs.intersection(a, b)) == p & q and of(runs.difference(a, b)) == p - q
    none = a.limit(0)
    assert of(runs.union(a, none)) == p and of(runs.intersection(a, none)) == set() and of(runs.difference(a, none)) == p and of(runs.difference(none, a)) == set()


def test_segments_hold_what_their_layers_hold(spark):
    rows = {n: drawn(k, 25) for k, n in enumerate(("a", "b", "c"))}
    got = runs.segments({n: spark.createDataFrame(r, SCHEMA) for n, r in rows.items()}).collect()
    seen = [(r.subject, r.z, r.y, x) for r in got for x in range(r.x0, r.x1 + 1)]
    assert len(seen) == len(set(seen)) and set(seen) == set().union(*map(cells, rows.values()))
    for n, r in rows.items():
        assert {(g.subject, g.z, g.y, x) for g in got if g[n] for x in range(g.x0, g.x1 + 1)} == cells(r)


def test_class_runs_equal_class_pixels(spark):
    rows = [drawn(k, 30) for k in range(4)]
    parts = [spark.createDataFrame(r, SCHEMA) for r in rows]
    found = runs.class_map(*parts[:3], within=parts[3])
    got = {(r.subject, r.z, r.y, x): r.cls for r in found.collect() for x in range(r.x0, r.x1 + 1)}
    want = {}
    for k in range(3):
        want |= {c: k + 1 for c in cells(rows[k]) & cells(rows[3])}
    assert got == want


def test_counts_of_runs_equal_counts_of_pixels(spark):
    rows = [[r for r in drawn(k, 30) if r[0]] for k in range(4)]
    light, moderate, dense, pred = (spark.createDataFrame(r, SCHEMA) for r in rows)
    slices = spark.createDataFrame([("S", 0), ("T", 0)], "subject string, z int")
    key = ("subject", "z")
    truth = runs.class_map(light, moderate, dense)
    found = runs.segments({"p": pred} | {n: truth.filter(F.col("cls") == k) for k, n in metrics.CLASSES}).withColumn("cls", runs.class_of())
    by_pixel = metrics.paired(pixels.pixels_of(runs.union(pred)), pixels.pixels_of(truth), key)
    got, want = (sorted(map(tuple, df.collect())) for df in (metrics.run_counts(slices, found, key), metrics.pixel_counts(slices, by_pixel, key)))
    assert got == want and got[0][2] > 0 and got[1][2] == 0


def test_run_views_hold_the_pixels_of_the_pixel_views(spark, small):
    for name, by in (("mask", ("subject", "z", "cls")), ("roi", ("subject", "z")), ("pred", ("m", "subject", "z"))):
        want = fixtures.view(spark, small, {"mask": "masks"}.get(name, name)).select(*by, "y", "x")
        got = pixels.pixels_of(fixtures.view(spark, small, f"{name}_runs").select(*by, "y", "x0", "x1")).distinct()
        assert got.count() == want.count() == got.join(want, [*by, "y", "x"]).count() > 0
