"""What kept queries from larger tables by disk, and failures of a model that looked like results."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterjobs.operators import graph, kernels, pixels, prompts, stencils, tiles
from rasterjobs.plans import prompting


def scene(spark):
    """A slice of two bright instances, its region, and its size."""
    a = np.full((60, 60), 10)
    a[5:25, 5:25], a[35:55, 30:55] = 200, 220
    image = spark.createDataFrame([("S", 0, c, y, x, int(v)) for (y, x), v in np.ndenumerate(a) for c in range(3)], "subject string, z int, c int, y int, x int, v int")
    dims = spark.createDataFrame([("S", 0, 60, 60)], "subject string, z int, h int, w int")
    return image, image.select("subject", "z", "y", "x").distinct(), dims


FIND = {"min_object": 20, "min_area": 25, "percentile": 60}


def test_an_instance_that_fails_is_not_a_slice_without_it(spark):
    """The model fails on the instance in the lower half, whose box begins there."""

    def fails_low():
        def predict(image, points, labels, box):
            if box[1] > 20:
                raise ValueError("out of memory")
            return np.ones((1, *image.shape[:2])), np.ones(1)

        return predict

    image, roi, dims = scene(spark)
    with pytest.raises(RuntimeError, match="1 calls of the model failed.*ValueError: out of memory"):
        prompting.multi_instance_run(image, roi, dims, factory=fails_low, min_box=8, find=FIND, use_points=False).count()


def patches(spark, shape=(4, 6)):
    body = np.zeros((*shape, 3), np.uint8).tobytes()
    rows = [("S", 0, i, 10, 20, *shape, body, None) for i in range(3)]
    return spark.createDataFrame(rows, "subject string, z int, patch_id int, y0 int, x0 int, h int, w int, data binary, prompts array<struct<y:int,x:int,label:int>>")


def test_masks_that_do_not_cover_the_patch_are_a_failure(spark):
    made = prompts.segment_masks(patches(spark), lambda: lambda *_: (np.ones((1, 3, 6)), np.ones(1)))
    assert {r.status.split(" for")[0] for r in made.collect()} == {"failed: ValueError: masks of (1, 3, 6)"}


def test_a_call_is_one_row_and_its_best_candidate_is_that_of_all_rows(spark):
    """Empty candidates and scores that are no numbers do not win; of equals the first does."""
    for scores in ((0.2, 0.9, 0.9, 1.0), (np.nan, np.nan, 0.1, 0.3), (np.nan, np.nan, np.nan, 2.0), (-1.0, -2.0, -1.0, 5.0)):
        masks = np.random.default_rng(3).random((4, 4, 6)) < 0.5
        masks[3] = False
        made = prompts.segment_masks(patches(spark), lambda m=masks, s=scores: lambda *_: (m, np.array(s))).cache()
        assert made.count() == 3
        key, every = ("subject", "z", "patch_id"), prompts.mask_runs(made)
        chosen = prompts.best_candidate(every.select(*key, "cand", "score").distinct(), key)
        want = every.join(chosen, [*key, "cand"], "left_semi")
        read = lambda df: sorted(str(tuple(r)) for r in df.select(*key, "cand", "score", "y", "x0", "x1").collect())
        assert read(prompts.mask_runs(made, best=True)) == read(want)
        assert every.agg(F.sum(F.col("x1") - F.col("x0") + 1)).first()[0] == 3 * masks.sum() and every.agg(F.min("y"), F.min("x0")).first()[0] >= 10


def test_packed_values_are_the_same_bit_for_bit():
    draw = np.random.default_rng(0)
    image, few = draw.integers(0, 200, (3, 64, 64)), np.round(draw.random(4096), 2)
    odd = np.array([np.inf, -np.inf, np.nan, -0.0, 1e300, 5e-324, -3])
    for a in (image, image / 7, few, draw.random((64, 64)), odd, np.tile(odd, 90), np.where(few > 0.5, -0.0, 0.0), np.array([70_000.0, 65_535]), np.empty(0)):
        flat = np.ascontiguousarray(a, np.float64).reshape(-1)
        assert np.array_equal(kernels.unpacked(kernels.packed(a)).view(np.uint64), flat.view(np.uint64))
    assert np.array_equal(kernels.unpacked(kernels.packed(few) + kernels.packed(image)), np.concatenate([few, image.reshape(-1)]))
    assert len(kernels.packed(image)) < 1.1 * image.size and len(kernels.packed(few)) < 2 * few.size and len(kernels.packed(np.zeros(4096))) < 100


@pytest.mark.parametrize("kind", ["random", "tied", "one", "mostly one", "signs"])
def test_percentiles_of_tiles_in_rounds(spark, kind):
    """Few marks and little that may be left, so tiles are asked several times; regions, and a slice of which nothing is inside."""
    draw = np.random.default_rng(6)
    v = {
        "random": draw.standard_normal((40, 50)), "tied": np.round(draw.standard_normal((40, 50)), 1), "one": np.full((40, 50), 2.5),
        "mostly one": np.where(draw.random((40, 50)) < 0.8, 0.25, draw.random((40, 50))), "signs": np.exp(30 * draw.standard_normal((40, 50))) * draw.choice([-1, 1], (40, 50)),
    }[kind]
    px = spark.createDataFrame([("a", z, y, x, float(v[y, x] + z)) for z in range(3) for y, x in np.ndindex(*v.shape)], "subject string, z int, y int, x int, v double")
    dims = spark.createDataFrame([("a", z, 40, 50) for z in range(3)], "subject string, z int, h int, w int")
    region = spark.createDataFrame([("a", z, y, 3, 30 + y % 7) for z in range(2) for y in range(5, 33)], "subject string, z int, y int, x0 int, x1 int")
    image, ps = tiles.from_pixels(px, dims, tile=16).cache(), {"low": 0, "p3": 3, "mid": 50, "p97": 97.5, "top": 100}
    for source, values in ((image, px), (tiles._only_inside(image, region, ("subject", "z"), 16).cache(), pixels.within(px, pixels.pixels_of(region)))):
        want = sorted(values.groupBy("subject", "z").agg(*[F.percentile("v", p / 100).alias(n) for n, p in ps.items()]).collect())
        for how in ({}, {"marks": 5, "gathered": 9}):
            assert sorted(tiles.percentiles(source, ps, **how).collect()) == want


def test_files_of_steps_that_are_over_go(spark, monkeypatch):
    """Whatever the session says of checkpoints; and what is still needed stays."""
    context = spark.sparkContext
    names = lambda: {f for d, _, fs in os.walk(context._jsc.sc().getCheckpointDir().get().removeprefix("file:")) for f in (f"{d}/{x}" for x in fs) if "part-" in f}
    first = graph.saved(spark.range(1000).repartition(3).withColumn("v", F.col("id") * 2))
    before = names()
    kept = graph.saved(first.filter("v > 10"))
    mine = names() - before
    monkeypatch.setattr(graph, "LONG", -1)
    del first
    for _ in range(40):
        graph.saved(spark.range(3))
        if not before & names():
            break
        time.sleep(0.25)
    assert not before & names() and mine <= names() and kept.count() == 994
    assert context._jsc.sc().conf().get(graph._CLEANS, None) is None


def recorded(monkeypatch, module):
    """Bytes a row that a module's steps save."""
    seen, plain = [], graph.saved

    def save(df):
        out = plain(df)
        seen.append((out.agg(F.max(F.length("data"))).first()[0] or 0) if "data" in out.columns else 0)
        return out

    monkeypatch.setattr(module, "saved", save)
    return seen


def test_ridges_save_a_response_and_no_hessians(spark, monkeypatch):
    a = np.random.default_rng(1).random((32, 32))
    px = spark.createDataFrame([("a", 0, y, x, float(v)) for (y, x), v in np.ndenumerate(a)], "subject string, z int, y int, x int, v double")
    dims = spark.createDataFrame([("a", 0, 32, 32)], "subject string, z int, h int, w int")
    seen = recorded(monkeypatch, tiles)
    assert tiles.pixels(tiles.ridges(tiles.from_pixels(px, dims), (1, 2))).count() == a.size
    assert 0 < max(seen) <= 9 * a.size


def test_importance_saves_no_field(spark, small, monkeypatch):
    from rasterjobs import plans
    from rasterjobs.plans import imaging

    seen, more = recorded(monkeypatch, tiles), recorded(monkeypatch, stencils)
    gray = recorded(monkeypatch, imaging)
    assert plans.queries()["importance"](spark, small).count() > 0
    assert not any([*seen, *more]) and len(gray) == 1 and gray[0] < 3 * 64 * 64


@pytest.mark.parametrize("name", ["roi_statistics", "combine_best", "combine_union"])
def test_no_pixel_view_is_read(spark, small, name):
    from rasterjobs import plans
    from rasterjobs.plans.registry import Views

    class Runs(Views):
        def __getattr__(self, view):
            assert view not in ("masks", "pred", "roi", "candidates", "prob", "image"), view
            return super().__getattr__(view)

    monkey = pytest.MonkeyPatch()
    with monkey.context() as m:
        m.setattr(plans.registry, "Views", Runs)
        plans.queries()[name](spark, small)


@pytest.mark.parametrize("how", ["best", "union"])
def test_candidates_of_bits_are_combined_as_pixels(spark, how):
    """Several that score enough, one, none, and equals."""
    scores = [(0, (0.8, 0.9, 0.75)), (1, (0.2, 0.76, 0.1)), (2, (0.3, 0.3, 0.1)), (3, (0.9, 0.9, 0.2))]
    draw, by = np.random.default_rng(8), ("subject", "z")
    held = [("a", z, c, s, int(y), int(a), int(min(a + 4, 17))) for z, each in scores for c, s in enumerate(each) for y in range(9) for a in draw.integers(0, 18, 2)]
    runs = spark.createDataFrame(held, "subject string, z int, cand int, score double, y int, x0 int, x1 int")
    dims = spark.createDataFrame([("a", z, 9, 18) for z, _ in scores], "subject string, z int, h int, w int")
    px = pixels.pixels_of(runs).distinct()
    want = prompts.combine(px, px.select(*by, "cand", "score").distinct(), how, by)
    got = prompts.combined_tiles(tiles.bits(runs, dims, (*by, "cand", "score"), tile=5), how, by)
    read = lambda df: sorted(map(tuple, df.select(*by, "y", "x").collect()))
    assert read(got) == read(want)


def test_importance_inside_masks_is_that_of_their_pixels(spark):
    a = np.random.default_rng(2).integers(0, 90, (21, 26)).astype(float)
    px = spark.createDataFrame([("a", 0, y, x, float(v)) for (y, x), v in np.ndenumerate(a)], "subject string, z int, y int, x int, v double")
    dims = spark.createDataFrame([("a", 0, 21, 26)], "subject string, z int, h int, w int")
    runs = spark.createDataFrame([("a", 0, i, y, 2 * i + y % 3, 14 + i) for i in (1, 2) for y in range(3, 17)], "subject string, z int, inst_id int, y int, x0 int, x1 int")
    gray, key = tiles.from_pixels(px, dims, tile=8), ("subject", "z", "inst_id")
    want = pixels.pixels_of(runs).join(tiles.pixels(stencils.importance_tiles(gray, tile=8)), ["subject", "z", "y", "x"])
    lines = tiles.important_inside(gray, runs, "inst_id", tile=8)
    read = lambda df: sorted(map(tuple, df.select(*key, "y", "x").collect()))
    assert read(tiles.places_where(lines, lambda v, _: v >= 0.4, key)) == read(want.filter("v >= 0.4"))
    assert read(tiles.places_where(lines, lambda v, _: v == v, key)) == read(pixels.pixels_of(runs))
    limit = want.groupBy(*key).agg(F.percentile("v", 0.9).alias("p"))
    assert sorted(map(tuple, tiles.percentiles(lines, {"p": 90}, key).collect())) == sorted(map(tuple, limit.select(*key, "p").collect()))


@pytest.mark.parametrize("name", ["roi_statistics", "density_prompts", "segmented_slices"])
def test_blocks_of_subjects_give_the_whole(spark, monkeypatch, name):
    """All subjects, each in one block; the files of a block do not wait for the last."""
    from rasterjobs import plans
    from rasterjobs.plans import registry

    data = "/root/testdata/sf0.01"
    read = lambda: sorted(str(tuple(r)) for r in plans.queries()[name](spark, data).collect())
    whole, seen, plain = read(), [], registry.saved
    monkeypatch.setattr(registry, "BLOCK", 20 * 128 * 128)
    monkeypatch.setattr(registry, "saved", lambda df: seen.append(plain(df)) or seen[-1])
    assert read() == whole and len(seen) == 3
    held = [{r.subject for r in df.select("subject").distinct().collect()} for df in seen]
    assert all(held) and sum(map(len, held)) == len(set.union(*held))
