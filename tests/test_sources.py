"""Stores and images made on the spot, read back."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterjobs.operators import pixels
from rasterjobs.sources import chunks, images, volumes


def put_v2(root, a, chunks, squeeze=None):
    root.mkdir(parents=True)
    codec = {"id": "gzip"} if squeeze else None
    (root / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": a.shape, "chunks": chunks, "dtype": a.dtype.str, "compressor": codec, "order": "C", "fill_value": 0}))
    for at in np.ndindex(*[-(-s // c) for s, c in zip(a.shape, chunks)]):
        block = np.zeros(chunks, a.dtype)
        part = a[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        if block.any():
            body = block.tobytes()
            (root / ".".join(map(str, at))).write_bytes(gzip.compress(body) if squeeze else body)


def test_store_listing_and_tiles(spark, tmp_path):
    rng = np.random.default_rng(0)
    a = (rng.random((2, 3, 10, 7)) < 0.4).astype(np.uint16) * 300
    put_v2(tmp_path / "v.zarr" / "0", a, (1, 2, 4, 4))
    put_v2(tmp_path / "v.zarr" / "labels" / "1", a[0], (1, 5, 5), squeeze=True)
    rows = volumes.list_store_arrays(spark, str(tmp_path / "v.zarr")).collect()
    assert [(r.level, list(r.shape)) for r in rows] == [("0", [2, 3, 10, 7]), ("labels/1", [3, 10, 7])]
    tiles = volumes.read_zarr_tiles(spark, str(tmp_path / "v.zarr"), "0", "S1", "image")
    got = {(r.c, r.z, r.y, r.x) for r in volumes.tile_pixels(tiles).filter("v = 300").collect()}
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(a)), strict=True))
    some = volumes.read_zarr_tiles(spark, str(tmp_path / "v.zarr"), "labels/1", "S1", "mask", z_range=(1, 2))
    assert {(r.z, r.y, r.x) for r in volumes.tile_pixels(some).collect()} == {(1, y, x) for y, x in zip(*map(np.ndarray.tolist, np.nonzero(a[0, 1])), strict=True)}


def put_v3(root, a, size, separator="/", fill=0, codec=None, turn=None, endian="little"):
    root.mkdir(parents=True)
    codecs = [{"name": "transpose", "configuration": {"order": turn}}] if turn else []
    codecs += [{"name": "bytes", "configuration": {"endian": endian}}] + ([{"name": codec, "configuration": {}}] if codec else [])
    grid = {"name": "regular", "configuration": {"chunk_shape": size}}
    keys = {"name": "default", "configuration": {"separator": separator}}
    (root / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "array", "shape": a.shape, "data_type": a.dtype.name, "chunk_grid": grid, "chunk_key_encoding": keys, "fill_value": fill, "codecs": codecs}))
    for at in np.ndindex(*[-(-s // c) for s, c in zip(a.shape, size)]):
        block = np.full(size, fill, a.dtype)
        part = a[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, size))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        if (block != fill).any():
            body = block.transpose(turn or range(block.ndim)).astype(block.dtype.newbyteorder(">" if endian == "big" else "<")).tobytes()
            path = root / separator.join(["c", *map(str, at)])
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(gzip.compress(body) if codec else body)


def volume_of(tiles, shape):
    """The tiles put together, (c, z, y, x); what no tile holds is -1."""
    out = np.full(shape, -1.0)
    for r in tiles.collect():
        out[r.c, r.z, r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w] = np.frombuffer(r.data, r.dtype).reshape(r.h, r.w)
    return out


@pytest.mark.parametrize("how", [{}, {"separator": "."}, {"codec": "gzip", "turn": [3, 1, 0, 2]}, {"endian": "big"}])
def test_version_3_and_fill_values_come_back(spark, tmp_path, how):
    a = np.full((2, 5, 9, 7), 7, np.uint16)
    a[0, 1, 2:6, 1:3], a[1, 4, 8, 6] = 300, 0
    put_v3(tmp_path / "v.zarr" / "0", a, (1, 2, 4, 3), fill=7, **how)
    (tmp_path / "v.zarr" / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "group"}))
    written = len([p for p in (tmp_path / "v.zarr" / "0").rglob("*") if p.is_file()]) - 1
    assert 0 < written < 2 * 3 * 3 * 3  # most chunks are absent
    assert np.array_equal(volume_of(volumes.read_zarr_tiles(spark, str(tmp_path / "v.zarr"), "0", "S", "image"), a.shape), a)
    only = volumes.read_zarr_tiles(spark, f"file://{tmp_path}/v.zarr/", "0", "S", "image", z_range=(1, 3), channels=(0, 1), y_range=(2, 4), x_range=(3, 7))
    got = volume_of(only, a.shape)
    assert np.array_equal(got[0, 1:3, :4, 3:], a[0, 1:3, :4, 3:]) and (got[:, [0, 3, 4]] == -1).all() and (got[1] == -1).all() and (got[:, :, 4:] == -1).all() and (got[..., :3] == -1).all()


def test_absent_chunks_of_zeros_are_no_rows_unless_asked(spark, tmp_path):
    a = np.zeros((3, 8, 8), np.uint8)
    a[1, 5, 5] = 9
    put_v2(tmp_path / "v" / "0", a, (1, 4, 4))
    assert volumes.read_zarr_tiles(spark, str(tmp_path / "v"), "0", "S", "m").count() == 1
    dense = volumes.read_zarr_tiles(spark, str(tmp_path / "v"), "0", "S", "m", dense=True)
    assert dense.count() == 12 and np.array_equal(volume_of(dense, (1, 3, 8, 8))[0], a)
    assert volumes.read_zarr_tiles(spark, str(tmp_path / "v"), "0", "S", "m", z_range=(7, 9)).collect() == []
    with pytest.raises(ValueError, match="no array"):
        volumes.read_zarr_tiles(spark, str(tmp_path / "v"), "1", "S", "m")


@pytest.mark.parametrize("version", [2, 3])
def test_only_chunks_that_are_asked_for_are_opened(tmp_path, monkeypatch, version):
    """Files opened by the reader for Spark's filters, counted; what it doesn't meet goes back to Spark."""
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan, StringContains

    a = np.arange(1, 1 + 3 * 12 * 8 * 8, dtype=np.uint16).reshape(3, 12, 8, 8)
    (put_v2 if version == 2 else put_v3)(tmp_path / "v" / "0", a, (1, 3, 4, 4))
    files = []
    real = chunks.read_file
    monkeypatch.setattr(chunks, "read_file", lambda fs, path: files.append(path) or real(fs, path))
    options = {"path": str(tmp_path / "v"), "level": "0", "subject": "S", "pushdown": "true", "partitionbytes": str(2 * 3 * 4 * 4 * 2)}
    for filters, many, rows in [
        ([], 3 * 4 * 2 * 2, 3 * 12 * 2 * 2), ([GreaterThanOrEqual(("z",), 4), LessThan(("z",), 7)], 3 * 2 * 2 * 2, 3 * 3 * 2 * 2),
        ([EqualTo(("c",), 2), In(("z",), (0, 11)), IsNotNull(("z",))], 2 * 2 * 2, 2 * 2 * 2), ([LessThan(("y0",), 4), EqualTo(("x0",), 4), EqualTo(("z",), 99)], 0, 0),
        ([LessThan(("y0",), 4), EqualTo(("x0",), 4)], 3 * 4, 3 * 12),
    ]:
        reader = chunks.ChunkedVolume(options).reader(None)
        left = [StringContains(("subject",), "S"), EqualTo(("h",), 4)]
        assert list(reader.pushFilters([*filters, *left])) == left
        files.clear()
        parts = reader.partitions()
        assert len(parts) == max(1, -(-many // 2)) and not files  # nothing is opened or listed to plan
        assert sum(b.num_rows for p in parts for b in reader.read(p)) == rows and len(files) == many


def test_filters_reach_the_source(spark, tmp_path):
    """Chunks outside the filters are no chunks at all: to open one would fail."""
    a = np.arange(1, 1 + 6 * 8 * 8, dtype=np.uint16).reshape(6, 8, 8)
    put_v2(tmp_path / "v" / "0", a, (2, 4, 4))
    for path in (tmp_path / "v" / "0").glob("[02].*"):
        path.write_bytes(b"no chunk")
    tiles = lambda: volumes.read_zarr_tiles(spark, str(tmp_path / "v"), "0", "S", "m")
    assert spark.conf.get("spark.sql.python.filterPushdown.enabled") == "false"
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = volume_of(tiles().filter("z between 2 and 3 and x0 < 4"), (1, 6, 8, 8))[0]
        assert np.array_equal(got[2:4, :, :4], a[2:4, :, :4]) and (got[:2] == -1).all() and (got[:, :, 4:] == -1).all()
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_stores_are_listed_together(spark, tmp_path):
    a = np.ones((2, 4, 4), np.uint8)
    for name in ("a", "b"):
        put_v2(tmp_path / name / "0", a, (1, 4, 4))
    put_v3(tmp_path / "b" / "1", a, (1, 4, 4))
    found = volumes.list_store_arrays(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert [(r.store[-1], r.level, r.version) for r in found.collect()] == [("a", "0", 2), ("b", "0", 2), ("b", "1", 3)]


def test_png_round_trip(spark, tmp_path):
    px = spark.createDataFrame([("S", 0, 1, x) for x in (0, 1, 4)] + [("S", 0, 2, 4)], "subject string, z int, y int, x int")
    dims = spark.createDataFrame([("S", 0, 3, 5), ("S", 1, 2, 2)], "subject string, z int, h int, w int")
    for r in volumes.mask_pngs(pixels.runs(px), dims).collect():
        (tmp_path / f"slice_{r.z:03d}_pred.png").write_bytes(r.png)
    slices, runs = volumes.read_pred_masks(spark, str(tmp_path))
    assert {(r.z, r.h, r.w) for r in slices.collect()} == {(0, 3, 5), (1, 2, 2)}
    assert {(r.z, r.y, r.x) for r in pixels.pixels_of(runs).collect()} == {(0, 1, 0), (0, 1, 1), (0, 1, 4), (0, 2, 4)}


def masks_of(spark):
    """Runs and sizes of two models and two subjects, one of an odd name; slice 1 is black."""
    names = [(m, s) for m in ("one", "two") for s in ("01", "a b/c=50%+é")]
    runs = [(m, s, 0, y, i, i + 2) for i, (m, s) in enumerate(names) for y in (0, 3)]
    dims = [(m, s, z, 6, 8) for m, s in names for z in (0, 1)]
    kinds = "model string, subject string, z int, "
    return spark.createDataFrame(runs, kinds + "y int, x0 int, x1 int"), spark.createDataFrame(dims, kinds + "h int, w int")


def test_mask_files_of_models_and_subjects(spark, tmp_path):
    runs, dims = masks_of(spark)
    by, path = ("model", "subject", "z"), str(tmp_path / "masks")
    volumes.write_mask_files(runs, dims, path, by)
    rows = lambda df: sorted(map(tuple, df.collect()))
    slices, back = volumes.read_pred_masks(spark, path, keys=("model", "subject"))
    assert rows(slices) == rows(dims) and rows(back) == rows(runs)
    files = sorted(str(f.relative_to(path)) for f in (tmp_path / "masks").rglob("*") if f.is_file() and f.suffix != ".crc")
    assert len(files) == 8 and "model=one/subject=01/slice_0001_pred.png" in files
    # a file that is there stays, unless it may be replaced
    with pytest.raises(Exception, match="there already"):
        volumes.write_mask_files(runs.limit(0), dims, path, by)
    assert rows(volumes.read_pred_masks(spark, path, keys=("model", "subject"))[1]) == rows(runs)
    volumes.write_mask_files(runs.limit(0), dims, path, by, overwrite=True)
    slices, back = volumes.read_pred_masks(spark, path, keys=("model", "subject"))
    assert rows(slices) == rows(dims) and rows(back) == []


def test_failed_tasks_leave_no_mask_file(spark, tmp_path):
    runs, dims = masks_of(spark)
    path = tmp_path / "masks"
    spark.dataSource.register(images.MaskFiles)
    rows = volumes.mask_pngs(runs, dims, ("model", "subject", "z"))
    broken = rows.withColumn("png", F.when((F.col("z") == 1) & (F.col("model") == "two"), None).otherwise(F.col("png")))
    twice = rows.unionByName(rows.limit(1))
    for bad, told in ((broken, "needs z and png"), (twice, "same place")):
        with pytest.raises(Exception, match=told):
            bad.write.format("mask_files").mode("append").save(str(path))
        assert not path.exists() or [f for f in path.rglob("*") if f.is_file()] == []
    assert volumes.write_mask_files(runs.limit(0), dims.limit(0), str(path), ("model", "subject", "z")) is None


def test_metrics_file(spark, tmp_path):
    df = spark.createDataFrame([("001", 0.5, None)], "slice string, dice double, recall double")
    volumes.write_metrics(df, str(tmp_path / "m"))
    (part,) = (tmp_path / "m").glob("*.csv")
    assert part.read_text() == "slice,dice,recall\n001,0.5,\n"
    bins = spark.createDataFrame([(0, 0.0, 0.02, 3)], "bin int, bin_left double, bin_right double, count long")
    assert volumes.histogram_rows(bins).first() == ("0.000000", "0.020000", 3)


def test_level_rules(spark):
    rows = [("s", x, f"s/{x}", [1, 4, 4] if x == "b" else [1, 8, 8]) for x in ("a", "b", "0/2", "0/0")]
    arrays = spark.createDataFrame(rows, "store string, level string, path string, shape array<long>")
    pick = lambda *a: [r.level for r in volumes.pick_level(arrays, *a).collect()]
    assert pick("2", "strict") == [] and pick("b", "strict") == ["b"]
    assert pick("2", "preferred") == ["0/0"] and pick("2", "nested") == ["0/2"] and pick("7", "nested") == ["0/0"]
    assert pick("7", "sized", [4, 4]) == ["b"] and arrays.filter(F.col("level") == "a").count() == 1
