"""Goldens and properties of the raster operators on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterjobs.functions.columns import to_byte
from rasterjobs.operators import components, graph, kernels, metrics, pixels, prompts, stats, stencils
from rasterjobs.plans import prompting

KEY = ("subject", "z")
MKEY = ("model", "subject", "z")


def table(spark, grids, name="cls", model=None):
    """Foreground pixels of small arrays, one slice each."""
    rows = [
        (*([model] if model is not None else []), "S", z, y, x, int(v))
        for z, grid in enumerate(grids) for y, row in enumerate(grid) for x, v in enumerate(row) if v
    ]
    head = "model int, " if model is not None else ""
    return spark.createDataFrame(rows, f"{head}subject string, z int, y int, x int, {name} int")


def sizes(spark, *hw):
    return spark.createDataFrame([("S", z, h, w) for z, (h, w) in enumerate(hw)], "subject string, z int, h int, w int")


def mask(df):
    return {(r.z, r.y, r.x) for r in df.collect()}


def test_pixel_and_object_goldens(spark):
    pred = [[[0]], [[1, 1], [0, 0]], [[1, 2, 0]], [[1, 0, 0, 1], [0, 0, 0, 1]]]
    truth = [[[0]], [[1, 0], [1, 0]], [[1, 0, 3]], [[1, 0, 1, 0], [1, 0, 1, 0]]]
    slices = spark.createDataFrame([(0, "S", z) for z in range(4)], "model int, subject string, z int")
    p, t = table(spark, pred, model=0), table(spark, truth, model=0)
    rows = {r.z: r for r in metrics.pixel_metrics(metrics.pixel_counts(slices, metrics.paired(p, t))).collect()}
    assert (rows[0].iou, rows[0].dice) == (1.0, 1.0)
    assert (rows[1].iou, rows[1].dice) == (pytest.approx(1 / 3), 0.5)
    assert (rows[2].iou_light, rows[2].iou_moderate, rows[2].iou_dense) == (1.0, 0.0, 0.0)
    assert all(r.dice == pytest.approx(2 * r.iou / (1 + r.iou)) for r in rows.values())
    assert rows[0].pixel_recall_light is None
    objects = {r.z: r for r in metrics.object_metrics(slices, p.drop("cls"), t).collect()}
    o = objects[3]
    assert (o.sensitivity_light, o.sensitivity_moderate, o.sensitivity_dense) == (0.5, 1.0, 1.0)
    assert (o.tp, o.fp, o.fdr) == (1, 1, 0.5)
    assert (objects[0].tp, objects[0].fp, objects[0].fdr) == (0, 0, 0.0)
    lines = {r.z: r.cldice for r in metrics.centerline_dice(slices, p.drop("cls"), t.drop("cls")).collect()}
    assert lines[0] == 1.0


@pytest.mark.parametrize("band", [1, 3, 256])
def test_labels_do_not_depend_on_bands(spark, band):
    grid = np.random.default_rng(4).random((24, 20)) < 0.55
    for connectivity in (4, 8):
        got = {}
        for r in components.pixels(components.label(table(spark, [grid]), KEY, connectivity, band)).collect():
            got[r.y, r.x] = r.comp_id
        seen, number = {}, 0
        for start in zip(*np.nonzero(grid), strict=True):
            if start in seen:
                continue
            number, stack = number + 1, [start]
            seen[start] = number
            while stack:
                y, x = stack.pop()
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        n = (y + dy, x + dx)
                        if (connectivity == 8 or not (dy and dx)) and 0 <= n[0] < 24 and 0 <= n[1] < 20 and grid[n] and n not in seen:
                            seen[n] = number
                            stack.append(n)
        assert got == {(int(y), int(x)): n for (y, x), n in seen.items()}


def test_labels_of_winding_pieces_and_null_keys(spark):
    """A comb and a spiral that pass every band border many times, a slice without a subject, and slices of different
    heights: labels of any band height are those of one band."""
    rng = np.random.default_rng(6)
    comb, spiral = np.zeros((40, 33), int), np.zeros((31, 31), int)
    comb[:, ::2], comb[39, :], comb[20, 3] = 1, 1, 1
    top, left, bottom, right = 0, 0, 30, 30
    while top <= bottom and left <= right:
        spiral[top, left : right + 1] = spiral[top : bottom + 1, right] = spiral[bottom, left + 2 : right + 1] = spiral[top + 2 : bottom + 1, left + 2 - 2 if left == 0 else left] = 1
        top, left, bottom, right = top + 2, left + 2, bottom - 2, right - 2
    grids = [comb, spiral, rng.random((50, 9)) < 0.6, np.ones((3, 3), int)]
    px = table(spark, [np.asarray(g, int) for g in grids])
    px = px.withColumn("subject", F.when(F.col("z") != 2, F.col("subject")))
    for connectivity in (4, 8):
        one, two, seven = (sorted(map(tuple, components.label(px, KEY, connectivity, b).collect()), key=str) for b in (256, 2, 7))
        assert one == two == seven and len(one) > 100


def test_least_reached_nodes(spark):
    """Stars, a long path and a ring, each by key; equal nodes of different keys are different."""
    rng = np.random.default_rng(1)
    path = rng.permutation(200).tolist()
    links = [("a", u, v) for u, v in zip(path, path[1:])] + [("b", 7, i) for i in range(300, 400)] + [("b", 5, 6), ("b", 6, 5), ("b", 9, 9), ("c", 0, 1)]
    got = graph.least_reached(spark.createDataFrame(links, "k string, u long, v long"), ("k",)).collect()
    want = {("a", i): 0 for i in range(1, 200)} | {("b", i): 7 for i in range(300, 400)} | {("b", 6): 5, ("c", 1): 0}
    assert {(r.k, r.node): r.root for r in got} == want
    assert graph.least_reached(spark.createDataFrame([], "k string, u long, v long"), ("k",)).collect() == []


def test_properties_of_a_line(spark):
    row = components.properties(components.label(table(spark, [[[1] * 9]]), KEY, 8)).first()
    assert (row.area, row.cx, row.cy, row.eccentricity) == (9, 4, 0, 1.0)
    assert row.major_axis == pytest.approx(4 * math.sqrt((81 - 1) / 12))


@pytest.mark.parametrize("area, left", [(2, 3), (3, 3), (4, 0)])
def test_removal_keeps_the_limit(spark, area, left):
    assert components.remove_small(table(spark, [[[1, 1, 1]]]), area).count() == left


def test_merge_keeps_the_first_centroid(spark):
    props = spark.createDataFrame([("S", 0, i + 1, 0, x) for i, x in enumerate((0, 29, 58))], "subject string, z int, comp_id bigint, cy int, cx int")
    got = {r.comp_id: r.inst for r in components.merge_near(props, 30).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("rule, down, up", [("half_even", [0, 4], [0, 0, 1, 2, 2]), ("floor", [0, 2], [0, 0, 1, 1, 2])])
def test_nearest_rules(spark, rule, down, up):
    for source, target in ((5, down), (3, up)):
        px = table(spark, [[[10 + i] for i in range(source)]], "v")
        got = pixels.resize_nearest(px, sizes(spark, (source, 1)), sizes(spark, (len(target), 1)), rule).orderBy("y").collect()
        assert [r.v - 10 for r in got] == target


def test_tight_crop_keeps_interior_zeros(spark):
    image = table(spark, [[[0, 0, 0], [0, 5, 0], [0, 0, 0], [0, 1, 0]], [[0]]], "v")
    got = {r.z: tuple(r)[2:] for r in pixels.tight_crop_bounds(image, sizes(spark, (4, 3), (1, 1))).collect()}
    assert got == {0: (1, 3, 1, 1), 1: (0, 0, 0, 0)}


def test_patch_grids(spark):
    big, odd, small = sizes(spark, (2500, 64)), sizes(spark, (100, 64)), sizes(spark, (30, 30))
    starts = lambda dims, p, s, rule: [r.y0 for r in prompts.patch_grid(dims, p, s, rule=rule).orderBy("patch_id").collect()]
    assert starts(big, 2048, 1024, "clamped") == [0, 452, 452]
    assert starts(odd, 64, 48, "regular") == [0, 36]
    assert starts(small, 64, 48, "regular") == [0] and starts(small, 64, 48, "clamped") == [0]


def test_morphology_at_the_edge(spark):
    dims, dot = sizes(spark, (5, 5)), table(spark, [[[0] * 5] * 2 + [[0, 0, 1, 0, 0]] + [[0] * 5] * 2])
    assert mask(stencils.dilate_cross(dot, dims, 2)) == {(0, y, x) for y in range(5) for x in range(5) if abs(y - 2) + abs(x - 2) <= 2}
    assert mask(stencils.close_disk(dot, dims, 2)) == {(0, 2, 2)} and mask(stencils.open_disk(dot, dims, 1)) == set()
    full = table(spark, [[[1] * 5] * 5])
    assert mask(stencils.erode_disk(full, dims, 2)) == mask(full)


def test_blur_and_edges_of_tiles_equal_the_whole(spark):
    a = np.random.default_rng(1).random((23, 17))
    rows = [("S", 0, y, x, float(a[y, x])) for y in range(23) for x in range(17)]
    image = spark.createDataFrame(rows, "subject string, z int, y int, x int, v double")
    for op in (lambda t: stencils.gaussian(image, sizes(spark, (23, 17)), 1.5, tile=t), lambda t: stencils.sobel(image, sizes(spark, (23, 17)), tile=t)):
        whole, parts = ({(r.y, r.x): r.v for r in op(t).collect()} for t in (64, 7))
        assert whole.keys() == parts.keys() and all(abs(whole[k] - parts[k]) < 1e-12 for k in whole)
    corner = kernels.reflect(np.arange(-3, 6), 3).tolist()
    assert corner == [2, 1, 0, 0, 1, 2, 2, 1, 0]


def test_ridge_lies_on_the_line(spark):
    a = np.zeros((24, 24), int)
    a[11:14] = 100
    out = stencils.ridges(table(spark, [a], "v"), sizes(spark, (24, 24)), (1, 2))
    best = out.filter((F.col("x") > 4) & (F.col("x") < 19)).groupBy("y").agg(F.max("v").alias("v")).orderBy(F.desc("v")).first()
    assert best.y == 12


def test_candidates(spark):
    px = spark.createDataFrame([("S", 0, c, s, 0, x) for c, s, xs in ((0, 0.5, (0,)), (1, 0.7, (1,)), (2, 0.7, (2,))) for x in xs], "subject string, z int, cand int, score double, y int, x int")
    scores = px.select(*KEY, "cand", "score").distinct()
    for how in ("best", "union", "weighted"):
        assert mask(prompts.combine(px, scores, how, KEY)) == {(0, 0, 1)}
    with pytest.raises(ValueError, match="no such way"):
        prompts.combine(px, scores, "none", KEY)


def test_histogram_and_bytes(spark):
    prob = spark.createDataFrame([("S", 0, 0, x, p) for x, p in enumerate((0.0, 0.01, 0.02, 1.0))], "subject string, z int, y int, x int, p double")
    counts = {r.bin: r["count"] for r in stats.histogram(prob).collect()}
    assert counts[0] == 1 and counts[1] == 1 and counts[49] == 1 and sum(counts.values()) == 3
    v = spark.createDataFrame([(0.999,), (-1.0,), (2.0,)], "v double")
    assert [r[0] for r in v.select(to_byte(F.col("v"))).collect()] == [254, 0, 255]


def test_continuity_limits(spark):
    def block(z, y, x, n):
        return [("S", z, y + i // 50, x + i % 50) for i in range(n)]

    rows = block(0, 0, 0, 50) + block(1, 0, 49, 50) + block(1, 10, 0, 50) + block(1, 40, 0, 1000) + block(3, 0, 60, 30)
    px = spark.createDataFrame(rows, "subject string, z int, y int, x int")
    got = {(r.z, r.area): r.stays for r in components.continuity(px).collect() if r.z != 1}
    one = [(r.area, r.stays) for r in components.continuity(px).collect() if r.z == 1]
    assert got == {(0, 50): True, (3, 30): True} and sorted(one) == [(50, False), (50, True), (1000, True)]


def test_an_empty_processed_slice_resets_continuity(spark):
    rows = [("S", 0, 0, x) for x in range(50)] + [("S", 2, 9, x) for x in range(50)]
    px = spark.createDataFrame(rows, "subject string, z int, y int, x int")
    stays = lambda zs: [r.stays for r in components.continuity(px, slices=spark.createDataFrame([("S", z) for z in zs], "subject string, z int")).orderBy("z").collect()]
    assert stays([0, 2]) == [True, False]  # slice 1 was skipped
    assert stays([0, 1, 2]) == [True, True]


def test_components_across_bands_and_two_points_apart(spark):
    draw = np.random.default_rng(3)
    rows = [("S", z, int(y), int(x)) for z in range(3) for y, x in np.argwhere(draw.random((40, 30)) < 0.45)]
    px = spark.createDataFrame(rows, "subject string, z int, y int, x int")
    for n in (4, 8):
        one, many = (sorted(map(tuple, components.label(px, ("subject", "z"), n, band).collect())) for band in (64, 3))
        assert one == many and max(r[-1] for r in one) > 5
    far = sorted(map(tuple, prompts.farthest_points(px, 5, 2).collect()))
    assert far == sorted(map(tuple, prompts.two_apart(px, 5).collect())) and len(far) == 6


def test_instances_are_segmented_each_and_united(spark):
    a = np.full((60, 60), 10)
    a[5:25, 5:25], a[35:55, 30:55] = 200, 220
    image, dims = scene(spark, a, np.full((60, 60), 10))
    roi = dims.selectExpr("subject", "z", "explode(sequence(0, h - 1)) AS y", "w").selectExpr("subject", "z", "y", "explode(sequence(0, w - 1)) AS x")
    find = {"min_object": 20, "min_area": 25, "percentile": 60}
    for points in (True, False):
        mask = prompting.multi_instance_run(image, roi, dims, min_box=8, find=find, use_points=points)
        got = {(r.z, r.y, r.x) for r in mask.collect()}
        assert {z for z, _, _ in got} == {0}  # no instance in the flat slice
        assert {(0, 15, 15), (0, 45, 45)} <= got and (0, 30, 5) not in got


def scene(spark, *grids):
    """Three channels of small arrays, a slice each, and their sizes."""
    rows = [("S", z, c, y, x, int(v)) for z, a in enumerate(grids) for (y, x), v in np.ndenumerate(a) for c in range(3)]
    image = spark.createDataFrame(rows, "subject string, z int, c int, y int, x int, v int")
    return image, sizes(spark, *(np.shape(a) for a in grids))


class Reached(Exception):
    pass


def given(monkeypatch, module, name, run):
    """What the plan gives to an operator; it ends there."""
    seen = []

    def stop(*args, **named):
        seen.append((args, named))
        raise Reached

    with monkeypatch.context() as m, pytest.raises(Reached):
        m.setattr(module, name, stop)
        run()
    return seen[0][0]


def test_slices_without_a_region_get_one(spark, monkeypatch):
    a = np.add.outer(np.arange(24), np.arange(24))
    a[6:18, 6:18] += 200
    image, dims = scene(spark, a, a)
    roi = table(spark, [np.ones((24, 24)), np.zeros((24, 24))]).drop("cls")
    _, used = given(monkeypatch, stats, "roi_stats", lambda: prompting.segment_slices(image, roi, dims, patch=16, stride=8, min_region=50))
    found = mask(used)
    assert len([p for p in found if p[0] == 0]) == 576
    assert {p for p in found if p[0] == 1} >= {(1, y, x) for y in range(6, 18) for x in range(6, 18)} and (1, 0, 0) not in found


def test_ridge_run_answers_to_wide_ridges(spark, monkeypatch):
    """Scales 1 and 2 answer only near the edges of a ridge 16 pixels wide, 4 and 8 along its middle."""
    a = np.zeros((56, 32), int)
    a[20:36] = 100
    image, dims = scene(spark, a)
    roi = table(spark, [np.ones((56, 32))]).drop("cls")
    args = given(monkeypatch, stencils, "ridges", lambda: prompting.ridge_run(image, roi, dims))
    middle = [stencils.ridges(table(spark, [a], "v"), dims, *s).filter("y = 28 and x = 16").first().v for s in (args[2:], [(1, 2)])]
    assert middle[0] > 0.5 and middle[1] < 0.1


def test_calls_that_fail_are_told_and_short_patches_filled(spark):
    """A model that fails on dark patches; it sees patches of the full size, and only their own pixels come back."""

    def factory():
        def predict(image, points, labels, box):
            assert image.shape == (8, 8, 3)
            if image.max() < 9:
                raise ValueError("too dark")
            return np.stack([image[..., 0] >= 0, image[..., 0] > 50]), np.array([0.5, 1])

        return predict

    body = lambda h, w, v: np.full((h, w, 3), v, np.uint8).tobytes()
    rows = [("S", 0, 0, 4, 6, 8, 8, body(8, 8, 60), [(7, 5, 1)]), ("S", 0, 1, 0, 0, 3, 5, body(3, 5, 200), None), ("S", 1, 0, 0, 0, 8, 8, body(8, 8, 3), [])]
    patches = spark.createDataFrame(rows, "subject string, z int, patch_id int, y0 int, x0 int, h int, w int, data binary, prompts array<struct<y:int,x:int,label:int>>")
    made, calls = prompts.answers(prompts.segment_patches(patches, factory, pad=8))
    assert {(r.z, r.patch_id): r.status for r in calls.collect()} == {(0, 0): "ok", (0, 1): "ok", (1, 0): "failed: ValueError: too dark"}
    got = {}
    for r in made.collect():
        got.setdefault((r.z, r.patch_id, r.cand, r.score), set()).add((r.y, r.x))
    full, short = {(y, x) for y in range(4, 12) for x in range(6, 14)}, {(y, x) for y in range(3) for x in range(5)}
    assert got == {(0, 0, 0, 0.5): full, (0, 0, 1, 1.0): full, (0, 1, 0, 0.5): short, (0, 1, 1, 1.0): short}
    counts = {r.z: (r.n_masks, r.n_failed) for r in prompts.call_counters(calls).collect()}
    assert counts == {0: (2, 0), 1: (0, 1)}


def test_ridge_counters_are_taken_where_the_run_takes_them(spark):
    """Components right after the threshold, patches in all and used, answers of the model, which is as sure everywhere
    here, so nothing exceeds the percentile."""
    a = np.full((48, 48), 20)
    a[10:13, 4:44], a[30:33, 4:44], a[40:42, 4:7] = 220, 220, 220
    image, dims = scene(spark, a)
    roi = table(spark, [np.ones((48, 48))]).drop("cls")
    found, counts = prompting.ridge_run(image, roi, dims, patch=32, long=10, sigmas=(1, 2), factor=1, crop=False)
    r = counts.first()
    assert r.n_patches_total == 4 and 0 < r.n_prompted <= r.n_patches <= 4 and r.n_masks == r.n_prompted and r.n_failed == 0
    assert r.n_before >= r.n_cleaned >= r.n_after == found.count() == 0 and r.n_removed == r.n_cleaned - r.n_after and r.points_per_patch == r.n_points / r.n_patches


def test_negatives_fall_back_to_a_grid(spark):
    """Instance 1 is long and its dilation covers the region: the grid's far points; 2 has none far enough."""
    rows = [("S", 0, 1, 40, x) for x in range(120)] + [("S", 1, 2, 8, x) for x in range(20)]
    inst = spark.createDataFrame(rows, "subject string, z int, inst_id int, y int, x int")
    roi = spark.createDataFrame([("S", 0, y, x) for y in range(30, 42) for x in range(120)] + [("S", 1, 8, x) for x in range(20)], "subject string, z int, y int, x int")
    assert mask(prompting.negative_places(inst, roi, sizes(spark, (120, 120), (20, 20)))) == {(0, 30, 0), (0, 30, 119)}


def test_truth_without_model_gives_the_same_as_truth_by_model(spark):
    draw = np.random.default_rng(4)
    p = [[(draw.random((9, 11)) < 0.4).astype(int).tolist() for _ in range(3)] for _ in range(2)]
    t = [draw.integers(0, 4, (9, 11)).tolist() for _ in range(3)]
    slices = spark.createDataFrame([(m, "S", z) for m in (0, 1) for z in range(3)], "model int, subject string, z int")
    pred = table(spark, p[0], model=0).unionAll(table(spark, p[1], model=1)).drop("cls")
    both, once = table(spark, t, model=0).unionAll(table(spark, t, model=1)), table(spark, t, model=0).drop("model")
    for score in (metrics.object_metrics, metrics.centerline_dice):
        assert sorted(score(slices, pred, both).collect()) == sorted(score(slices, pred, once).collect())


def test_thinning_of_components_on_one_sheet(spark):
    from rasterjobs.operators import kernels, stencils

    grid = np.random.default_rng(5).random((60, 70)) < 0.35
    got = stencils.skeleton(table(spark, [grid.astype(int).tolist()], model=0).drop("cls"), ("subject", "z")).collect()
    assert {(r.y, r.x) for r in got} == set(zip(*map(list, map(np.ndarray.tolist, np.nonzero(kernels.thin(grid)))), strict=True))
