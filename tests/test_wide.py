"""What is made of a few rows is joined by shuffles and dealt to many tasks, however small Spark takes it to be."""

import pytest
from pyspark.sql import functions as F

from rasterjobs import fixtures, plans
from rasterjobs.operators.graph import saved


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["min_max_roi", "patch_shares", "touched_components", "tight_crop", "resize_linear", "crop_masks"])
def test_no_pixels_are_broadcast(spark, small, name):
    assert "BroadcastExchange" not in plan_of(plans.queries()[name](spark, small))


def test_saved_tables_are_not_broadcast(spark):
    rows = saved(spark.range(5).withColumn("v", F.explode(F.sequence(F.lit(1), F.lit(1000)))))
    assert "BroadcastExchange" not in plan_of(spark.range(5).join(rows, "id"))


def test_pixels_are_made_in_many_tasks(spark, small):
    parts = fixtures.view(spark, small, "roi").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1


@pytest.mark.parametrize("name", ["binarize", "tight_crop", "gray", "byte_rgb", "percentiles", "min_max_roi", "robust_slice", "min_max_gray", "by_slice_max", "resize_linear"])
def test_no_pixel_of_the_image_is_a_row(spark, small, name):
    plan = plan_of(plans.queries()[name](spark, small))
    assert "MapInArrow" in plan or "Scan ExistingRDD" in plan
    assert "sequence(0, 127" not in plan


def test_few_rows_of_a_batch_are_objects_at_once():
    import pyarrow as pa

    from rasterjobs.operators import tiles

    batch = pa.RecordBatch.from_pylist([{"a": i, "_runs": [{"y": i}] if i % 2 else None} for i in range(20)])
    rows = list(tiles._rows(batch))
    assert [r["a"] for r in rows] == list(range(20)) and tiles.HELD < 20
    assert [None if r["_runs"] is None else r["_runs"].field("y").to_pylist() for r in rows] == [[i] if i % 2 else None for i in range(20)]


def test_percentiles_of_counted_values(spark):
    from rasterjobs.operators import stats

    px = spark.createDataFrame([("a", 1, float(v)) for v in (1, 1, 1, 2, 9)], "subject string, z int, v double")
    counted = px.groupBy("subject", "z", "v").agg(F.count("*").alias("n"))
    assert stats.percentiles(counted, {"p": 60}, times="n").collect() == stats.percentiles(px, {"p": 60}).collect()


@pytest.mark.parametrize("name", ["patch_shares", "instance_clean_up", "touched_components", "resize_floor", "slice_counters", "near_instances"])
def test_masks_are_runs_until_the_end(spark, small, name):
    from rasterjobs.plans.registry import Views

    class Runs(Views):
        def __getattr__(self, view):
            assert view not in ("masks", "pred", "roi", "outline_half", "image"), view
            return super().__getattr__(view)

    real, fixed = plans.registry.Views, plans.queries()[name]
    plans.registry.Views = Runs
    try:
        fixed(spark, small)
    finally:
        plans.registry.Views = real


def test_shares_of_touching_cells(spark):
    from rasterjobs.operators import prompts

    runs = spark.createDataFrame([("a", 1, y, 3, 9) for y in range(6)], "subject string, z int, y int, x0 int, x1 int")
    dims = spark.createDataFrame([("a", 1, 10, 10)], "subject string, z int, h int, w int")
    grid = prompts.patch_grid(dims, 4, 2, rule="regular")
    from rasterjobs.operators.pixels import pixels_of

    want = {r["patch_id"]: sum(r["y0"] <= y < r["y1"] and r["x0"] <= x < r["x1"] for y in range(6) for x in range(3, 10)) for r in grid.collect()}
    for made in (prompts.patch_share_runs(grid, runs, 4), prompts.patch_share(grid, pixels_of(runs), 4)):
        assert {r["patch_id"]: r["n_roi"] for r in made.collect()} == want


@pytest.mark.parametrize("strict", [True, False])
def test_tiles_above_a_percentile_as_pixels(spark, strict):
    from rasterjobs.operators import pixels, stats, tiles

    px = spark.createDataFrame([("a", 1, y, x, float((y * 7 + x * 3) % 11)) for y in range(9) for x in range(10)], "subject string, z int, y int, x int, v double")
    dims = spark.createDataFrame([("a", 1, 9, 10)], "subject string, z int, h int, w int")
    region = spark.createDataFrame([("a", 1, y, 2, 7) for y in range(1, 6)], "subject string, z int, y int, x0 int, x1 int")
    image, key = tiles.from_pixels(px, dims, tile=4), lambda df: sorted((r["y"], r["x"]) for r in df.select("y", "x").collect())
    mask = pixels.pixels_of(region)
    assert key(tiles.above_percentile(image, 70, strict, runs=region, tile=4)) == key(stats.above_percentile(px, mask, 70, strict))
    assert key(tiles.above_percentile(image, 70, strict)) == key(stats.above_percentile(px, px, 70, strict))
    assert key(pixels.within_runs(px, region)) == key(pixels.within(px, mask))
