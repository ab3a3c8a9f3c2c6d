"""What kept queries from larger tables: pixels as rows where runs or tiles of bits do, and groups ordered whole."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterjobs import plans
from rasterjobs.operators import kernels, pixels, prompts, runs, stats, stencils, tiles


def without_pixels(spark, small, name):
    """Builds a query whose views of pixels are missing."""
    from rasterjobs.plans.registry import Views

    class Runs(Views):
        def __getattr__(self, view):
            assert view not in ("masks", "pred", "roi", "candidates", "prob", "image"), view
            return super().__getattr__(view)

    real = plans.registry.Views
    plans.registry.Views = Runs
    try:
        return plans.queries()[name](spark, small)
    finally:
        plans.registry.Views = real


def rows(df, *cols):
    return sorted(str(tuple(r)) for r in df.select(*cols).collect())


@pytest.mark.parametrize("name", ["skeleton"])
def test_lines_are_made_of_runs(spark, small, name):
    without_pixels(spark, small, name)


def test_sums_of_neighbours_copy_no_window():
    class Whole(np.ndarray):
        def take(self, *_, **__):
            raise AssertionError("a copy for each weight")

    a, w = np.random.default_rng(1).random((9, 11)), np.array([0.25, 0.5, 0.25])
    for axis in (0, 1):
        want = sum(w[k] * np.take(a, range(k, k + a.shape[axis] - 2), axis) for k in range(3))
        assert np.array_equal(kernels.correlate(a.view(Whole), w, axis), want)


@pytest.mark.parametrize("name", ["sample_pixels", "points_in_patches"])
def test_samples_are_drawn_from_runs(spark, small, name):
    without_pixels(spark, small, name)


@pytest.mark.parametrize("spare", [6, -9, -100])
def test_sample_of_runs_is_that_of_their_pixels(spark, spare):
    """With less to spare, fewer than k pixels lie below the limit, and groups are ordered whole."""
    held = [("a", z, y, 2 * y, 2 * y + 5 * z) for z in (0, 1, 4) for y in range(9)] + [(None, 1, y, 0, 30) for y in range(9)] + [("b", 2, 0, 3, 3)]
    runs = spark.createDataFrame(held, "subject string, z int, y int, x0 int, x1 int").repartition(3)
    got = stats.sample_runs(runs, 12, 5, spare=spare)
    want = stats.sample(pixels.pixels_of(runs), 12, 5)
    assert rows(got, "subject", "z", "y", "x", "ord") == rows(want, "subject", "z", "y", "x", "ord")


@pytest.mark.parametrize("name", ["max_stitch", "combine_weighted", "map_threshold"])
def test_candidates_are_tiles_of_bits(spark, small, name):
    without_pixels(spark, small, name)


def test_candidates_as_bits_give_what_pixels_give(spark):
    by, draw = ("subject", "z"), np.random.default_rng(3)
    scores = {("a", 0): [0.8, 0.8, 0.1], ("a", 1): [0.2, 0.9, 0.75], ("b", 0): [0.0, 0.5, 0.5]}
    held = [(s, z, c, v, y, int(x), int(x + draw.integers(0, 6))) for (s, z), vs in scores.items() for c, v in enumerate(vs) for y in range(10) for x in draw.integers(0, 6, 2)]
    runs = spark.createDataFrame(held, "subject string, z int, cand int, score double, y int, x0 int, x1 int")
    dims = spark.createDataFrame([(s, z, 10, 12) for s, z in scores], "subject string, z int, h int, w int")
    px, own = pixels.pixels_of(runs).distinct(), (*by, "cand", "score")
    bits = tiles.bits(runs, dims, own, tile=4)
    want = prompts.combine(px, px.select(*own).distinct(), "weighted", by)
    assert rows(prompts.weighted_tiles(bits, by), *by, "y", "x") == rows(want, *by, "y", "x")
    stacks = tiles.stacked(bits, by, ("score",))
    got = tiles.overlaid_pixels(stacks, tiles.greatest_score, by, "score")
    assert rows(got, *by, "y", "x", "score") == rows(pixels.max_stitch(px, "score"), *by, "y", "x", "score")
    prob = tiles.overlaid(stacks, lambda row: np.nan_to_num(tiles.greatest_score(row)), by)
    from rasterjobs.operators import stencils

    table = prompts.probability_map(px)
    limits = prompts.threshold_map(table, stencils.gaussian(table.withColumnRenamed("p", "v"), dims, 1), dims)[0]
    plain = lambda df: rows(df.withColumn("threshold", F.round("threshold", 9)), *by, "threshold")
    assert plain(prompts.threshold_tiles(prob, dims, tile=4)) == plain(limits)


@pytest.mark.parametrize(("name", "used"), [("instance_prompts", "instance_prompts"), ("multi_instance_segmentation", "multi_instance_tiles"), ("box_only_segmentation", "multi_instance_tiles")])
def test_instances_are_prompted_on_tiles_and_runs(spark, small, monkeypatch, name, used):
    from rasterjobs.plans import prompting

    seen = []
    monkeypatch.setattr(prompting, "instances", lambda v: None)
    monkeypatch.setattr(prompting, used, lambda image, region, *_, **__: seen.append((image.columns, region.columns)))
    without_pixels(spark, small, name)
    assert "data" in seen[0][0] and "x0" in seen[0][1]


def test_two_points_of_runs_are_those_of_their_pixels(spark):
    held = [("a", z, i, y, 3 * y - z, 3 * y + z) for z in (0, 2) for i in (1, 2) for y in range(2, 9) if (y + i) % 3] + [("b", 1, 1, 4, 4, 4)]
    runs = spark.createDataFrame(held, "subject string, z int, inst_id int, y int, x0 int, x1 int").repartition(3)
    by = ("subject", "z", "inst_id")
    assert rows(prompts.two_apart_runs(runs, 1, by), *by, "ord", "y", "x") == rows(prompts.two_apart(pixels.pixels_of(runs), 1, by), *by, "ord", "y", "x")


def test_values_in_masks_of_a_slice(spark):
    px = spark.createDataFrame([("a", 0, y, x, float(10 * y + x)) for y in range(7) for x in range(9)], "subject string, z int, y int, x int, v double")
    dims = spark.createDataFrame([("a", 0, 7, 9)], "subject string, z int, h int, w int")
    runs = spark.createDataFrame([("a", 0, k, y, k, 2 * k + y) for k in (1, 2) for y in range(1, 5)], "subject string, z int, inst_id int, y int, x0 int, x1 int")
    got = tiles.inside(tiles.from_pixels(px, dims, tile=4), runs, "inst_id", tile=4)
    want = pixels.pixels_of(runs).join(px, ["subject", "z", "y", "x"])
    cols = ("subject", "z", "inst_id", "y", "x", "v")
    assert rows(got, *cols) == rows(want, *cols)


def test_importance_goes_through_no_broadcast(spark, small):
    plan = plans.queries()["importance"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_farthest_points_are_made_of_runs(spark, small):
    without_pixels(spark, small, "farthest_points")


@pytest.mark.parametrize("name", ["object_metrics", "centerline_dice", "evaluation_in_box", "evaluation_table"])
def test_truth_is_not_swept_for_each_model(spark, small, name, monkeypatch):
    def swept(*_, **__):
        raise AssertionError("a sweep by model")

    monkeypatch.setattr(runs, "segments", swept)
    assert without_pixels(spark, small, name).count() > 0


def test_lines_of_many_slices_are_thinned_at_once(monkeypatch):
    calls, plain = [], kernels.thin
    monkeypatch.setattr(kernels, "thin", lambda a: calls.append(a.shape) or plain(a))
    shapes = {z: [(0, 2, 9), (1, 2, 9), (2, 2, 9 + z)] for z in range(40)}
    rows = [(z, 1, y, a, b) for z, held in shapes.items() for y, a, b in held]
    batches = pa.table([pa.array(c, pa.int32()) for c in zip(*rows)], ["z", "comp_id", "y", "x0", "x1"]).to_batches(max_chunksize=7)
    got = {(z, y, x) for b in stencils._thinned(1)(iter(batches)) for z, y, x0, x1 in zip(*b.to_pydict().values()) for x in range(x0, x1 + 1)}
    want = set()
    for z, held in shapes.items():
        grid = np.zeros((3, 60), bool)
        for y, a, b in held:
            grid[y, a : b + 1] = True
        want |= {(z, int(y), int(x)) for y, x in zip(*np.nonzero(plain(grid)))}
    assert got == want and len(calls) == 1


@pytest.mark.parametrize("held", [1, 5, 1 << 16])
def test_sweeps_and_labels_do_not_depend_on_what_is_held_at_once(spark, held, monkeypatch):
    monkeypatch.setattr(runs, "HELD", held)
    draw = np.random.default_rng(3)
    rows = sorted((int(z), int(y), int(a), int(a + w), int(k)) for z, y, a, w, k in zip(*(draw.integers(0, n, 300) for n in (3, 9, 40, 6)), 1 << draw.integers(0, 2, 300)))
    table = pa.table([pa.array(c, pa.int32()) for c in zip(*rows)], ["z", "y", "x0", "x1", "_held"])
    cells = {}
    for z, y, a, b, k in rows:
        for x in range(a, b + 1):
            cells[z, y, x] = cells.get((z, y, x), 0) | k
    out = [r for b in runs._swept(2, 2, None)(iter(table.to_batches(max_chunksize=11))) for r in zip(*b.to_pydict().values())]
    assert {(z, y, x): k for z, y, a, b, k in out for x in range(a, b + 1)} == cells
    both = [r for b in runs._swept(2, 2, lambda bits: (bits > 0).astype(np.int64))(iter(table.to_batches(max_chunksize=11))) for r in zip(*b.to_pydict().values())]
    assert {(z, y, x) for z, y, a, b, _ in both for x in range(a, b + 1)} == set(cells)
    assert all((z, y, b + 1) not in cells and (z, y, a - 1) not in cells for z, y, a, b, _ in both)


@pytest.mark.parametrize(("name", "used"), [("segmented_slices", "segment_tiles"), ("segmentation_counters", "segment_tiles"), ("ridge_segmentation", "ridge_tiles"), ("ridge_counters", "ridge_tiles")])
def test_runs_of_a_model_begin_with_tiles_and_runs(spark, small, monkeypatch, name, used):
    from rasterjobs.plans import prompting

    class Reached(Exception):
        pass

    def stop(image, region, *_, **__):
        raise Reached(image.columns, region.columns)

    monkeypatch.setattr(prompting, used, stop)
    with pytest.raises(Reached) as seen:
        without_pixels(spark, small, name)
    image, region = seen.value.args
    assert "data" in image and "x0" in region


def scene_of_planes(spark, n=3, h=23, w=19, seed=5):
    draw = np.random.default_rng(seed)
    a = draw.random((2, n, h, w))
    px = spark.createDataFrame([("a", z, c, y, x, float(v)) for (z, c, y, x), v in np.ndenumerate(a)], "subject string, z int, c int, y int, x int, v double")
    dims = spark.createDataFrame([("a", z, h, w) for z in range(2)], "subject string, z int, h int, w int")
    every = px.select("subject", "z", "c").distinct().join(dims, ["subject", "z"])
    return px, dims, tiles.joined(tiles.from_pixels(px, every, ("subject", "z", "c"), tile=8))


@pytest.mark.parametrize("shrink", [1, 2])
def test_tiles_go_to_working_frames_as_pixels_do(spark, shrink):
    from rasterjobs.operators import frames

    px, dims, planes = scene_of_planes(spark)
    crops = dims.selectExpr("subject", "z", "1 + z AS y0", "17 AS h", "2 AS x0", "16 - z AS w")
    region = spark.createDataFrame([("a", z, y, 5, 13) for z in range(2) for y in range(6, 15)], "subject string, z int, y int, x0 int, x1 int")
    work = frames.work_frames(dims, crops, region, shrink, 1, None if shrink == 1 else 60).cache()
    want = {(r.z, r.c, r.y, r.x): r.v for r in frames.image_to_work(px, work).collect()}
    got = tiles.split(frames.tiles_to_work(planes, work, tile=4))
    got = {(r.z, r.c, r.y, r.x): r.v for r in tiles.pixels(got, ("subject", "z", "c")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < (1e-12 if shrink > 1 else 1e-300) for k, v in want.items())


def test_patches_are_cut_from_tiles_as_from_pixels(spark):
    from rasterjobs.functions.columns import to_byte

    px, dims, planes = scene_of_planes(spark)
    grid = prompts.patch_grid(dims, 10, 6, rule="regular").filter("patch_id <> 3").cache()
    want = prompts.patch_images(px.withColumn("v", to_byte(F.col("v"))), grid, 10)
    got = tiles.cut(planes, grid, lambda a: np.trunc(np.clip(a * 255, 0, 255)), np.uint8, tile=8)
    cols = ("subject", "z", "patch_id", "y0", "x0", "h", "w", "data")
    assert rows(got, *cols) == rows(want, *cols)


def test_ridge_points_of_patches_are_those_of_their_pixels(spark):
    px, dims, _ = scene_of_planes(spark, 1, 40, 36, 7)
    px = px.drop("c").withColumn("v", F.round("v", 1)).cache()
    roi = px.filter("(y - 20) * (y - 20) + (x - 18) * (x - 18) <= 260").select("subject", "z", "y", "x").cache()
    grid, by = prompts.patch_grid(dims, 24, 12, rule="regular").cache(), ("subject", "z", "patch_id")
    local = lambda df, *more: prompts.in_patches(df, grid, 24).select(*by, "y", "x", *more)
    want = prompts.ridge_prompts(local(px, "v"), local(roi), dims, by=by, p=80)
    marked = tiles.masked(tiles.from_pixels(px, dims, tile=16), pixels.runs(roi), tile=16, rest=np.nan)
    got = prompts.ridge_prompts_of(tiles.cut(marked, grid, lambda a: a, np.float64, tile=16), by=by, p=80)
    cols = (*by, "ord", "y", "x", "label")
    assert rows(got, *cols) == rows(want, *cols) and got.count() > 20


@pytest.mark.parametrize("strict", [True, False])
def test_what_lies_above_a_percentile_as_runs(spark, strict):
    px, dims, _ = scene_of_planes(spark, 1)
    px = px.drop("c").withColumn("v", F.round("v", 1)).cache()
    region = spark.createDataFrame([("a", z, y, 3, 15) for z in range(2) for y in range(4, 20)], "subject string, z int, y int, x0 int, x1 int")
    held = tiles.from_pixels(px, dims, tile=8)
    for runs_, mask in ((region, pixels.pixels_of(region)), (None, px)):
        want = stats.above_percentile(px, mask, 70, strict)
        got = pixels.pixels_of(tiles.above_percentile_runs(held, 70, strict, runs=runs_, tile=8))
        assert rows(got, "subject", "z", "y", "x") == rows(want, "subject", "z", "y", "x")


def test_counters_sum_a_column(spark):
    every = spark.createDataFrame([("a", z) for z in range(3)], "subject string, z int")
    runs_ = spark.createDataFrame([("a", 0, 1, 0, 4), ("a", 0, 2, 3, 3), ("a", 2, 1, 0, 1), ("b", 0, 1, 0, 1)], "subject string, z int, y int, x0 int, x1 int")
    got = stats.counters(every, {"n": runs_, "px": (runs_, runs.length())})
    assert sorted(map(tuple, got.collect())) == [("a", 0, 2, 6), ("a", 1, 0, 0), ("a", 2, 1, 2)] and [t for _, t in got.dtypes[2:]] == ["bigint", "bigint"]
