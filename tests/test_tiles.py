"""Tile operators against whole frames in numpy and against the long form in SQL, pixel by pixel."""

import json

import duckdb
import numpy as np
import pytest

from rasterjobs.fixtures import ctes
from rasterjobs.operators import kernels, stencils, tiles
from rasterjobs.plans import imaging
from rasterjobs.plans.registry import Views
from rasterjobs.sources import volumes

KEY = ("subject", "z")


def image(spark, *frames):
    """(pixel table without zeros, dims)"""
    rows = [("S", z, int(y), int(x), float(a[y, x])) for z, a in enumerate(frames) for y, x in zip(*np.nonzero(a))]
    dims = [("S", z, *a.shape) for z, a in enumerate(frames)]
    return spark.createDataFrame(rows, "subject string, z int, y int, x int, v double"), spark.createDataFrame(dims, "subject string, z int, h int, w int")


def frames_of(px, dims):
    out = {r.z: np.full((r.h, r.w), np.nan) for r in dims.collect()}
    for r in px.collect():
        assert np.isnan(out[r.z][r.y, r.x])
        out[r.z][r.y, r.x] = r.v
    return [out[z] for z in sorted(out)]


def mirrored(a, halo):
    return a[np.ix_(*[kernels.reflect(np.arange(-halo, n + halo), n) for n in a.shape])]


def blurred(a, sigma):
    w = kernels.gaussian_weights(sigma)
    return kernels.correlate(kernels.correlate(mirrored(a, len(w) // 2), w, 0), w, 1)


def frangi(a, sigmas, beta=0.5):
    """Over the whole frame."""
    out = np.zeros(a.shape)
    for s in sigmas:
        small, large = kernels.hessian_eigenvalues(mirrored(a, int(4 * s + 0.5) + 2), s)
        norm = np.sqrt(small**2 + large**2)
        if norm.max() > 0:
            blob = np.exp(-((small / np.where(np.abs(large) > 1e-10, large, 1e-10)) ** 2) / (2 * beta**2))
            out = np.maximum(out, np.where(large < 0, blob * (1 - np.exp(-2 * (norm / norm.max()) ** 2)), 0))
    return out / (out.max() + 1e-8)


@pytest.fixture(scope="module")
def drawn():
    draw = np.random.default_rng(2)
    return [draw.integers(0, 50, (23, 17)).astype(float), np.zeros((9, 30)), draw.random((3, 2))]


@pytest.mark.parametrize("tile", [4, 8, 512])
def test_tiles_equal_whole_frames(spark, drawn, tile):
    """Halos wider than a tile and than the frame; an empty slice keeps its frame."""
    px, dims = image(spark, *drawn)
    source = tiles.from_pixels(px, dims, KEY, tile)
    for got, want in [
        (tiles.gaussian(source, 2, KEY, tile), lambda a: blurred(a, 2)), (tiles.by_max(source), lambda a: a / (a.max() + 1e-8)),
        (tiles.ridges(source, (1, 2), tile=tile), lambda a: frangi(a, (1, 2))),
    ]:
        for a, b in zip(frames_of(tiles.pixels(got), dims), drawn, strict=True):
            assert np.allclose(a, want(b), atol=1e-12)


def linear(a, h, w):
    def taps(n, to):
        at = (np.arange(to) + 0.5) * n / to - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, n - 1), np.clip(low + 1, 0, n - 1), at - low

    (l, u, k), (m, v, j) = taps(a.shape[0], h), taps(a.shape[1], w)
    tall = a[l] * (1 - k)[:, None] + a[u] * k[:, None]
    return tall[:, m] * (1 - j) + tall[:, v] * j


@pytest.mark.parametrize("tile", [4, 512])
def test_samples_and_ridges_at_half_size(spark, drawn, tile):
    px, dims = image(spark, *drawn)
    source = tiles.from_pixels(px, dims, KEY, tile)
    target = spark.createDataFrame([("S", 0, 11, 40), ("S", 1, 4, 15), ("S", 2, 1, 9)], "subject string, z int, h int, w int")
    for a, b, (h, w) in zip(frames_of(tiles.pixels(tiles.resampled(source, target, KEY, tile)), target), drawn, [(11, 40), (4, 15), (1, 9)], strict=True):
        assert np.allclose(a, linear(b, h, w), atol=1e-12)
    for a, b in zip(frames_of(tiles.pixels(tiles.ridges_at(source, dims, 2, (1, 2), tile=tile)), dims), drawn, strict=True):
        small = linear(b, max(1, b.shape[0] // 2), max(1, b.shape[1] // 2))
        assert np.allclose(a, linear(frangi(small, (1, 2)), *b.shape), atol=1e-12)


def test_values_of_a_ridge(spark):
    """A bright bar of three rows: pinned values at its middle, its edge and beside it, and the wide scale's."""
    a = np.zeros((40, 40))
    a[19:22, 4:36] = 1
    px, dims = image(spark, a)
    got = frames_of(stencils.ridges(px, dims, (1, 2), tile=16), dims)[0]
    assert got.max() == pytest.approx(1, abs=1e-7) and got[20].argmax() in range(4, 36)
    assert np.allclose(got, frangi(a, (1, 2))) and got[20, 20] > 0.9 and got[19, 20] == pytest.approx(got[21, 20]) and got[10, 20] < 0.05
    dark = frames_of(stencils.ridges(*image(spark, 1 - a), (1, 2)), dims)[0]
    assert dark[20, 20] < 0.05  # dark ridges do not count


def test_masks_and_classes(spark, drawn):
    px, dims = image(spark, *drawn)
    rows = [("S", 0, 3, 2, 16, 1), ("S", 0, 3, 5, 5, 2), ("S", 0, 22, 0, 3, 3), ("S", 1, 8, 29, 29, 1)]
    runs = spark.createDataFrame(rows, "subject string, z int, y int, x0 int, x1 int, cls int")
    got = frames_of(tiles.pixels(tiles.masked(tiles.from_pixels(px, dims, KEY, 4), runs, tile=4)), dims)
    for z, a in enumerate(drawn):
        inside = np.zeros(a.shape, bool)
        for r in rows:
            if r[1] == z:
                inside[r[2], r[3] : r[4] + 1] = True
        assert np.array_equal(got[z], np.where(inside, a, 0))


def test_volumes_become_tiles_without_pixels(spark, tmp_path):
    a = np.random.default_rng(0).integers(0, 99, (2, 10, 7)).astype(np.uint16)
    (tmp_path / "v" / "0").mkdir(parents=True)
    (tmp_path / "v" / "0" / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": a.shape, "chunks": (1, 4, 4), "dtype": "<u2", "compressor": None, "order": "C", "fill_value": 0}))
    for z, j, i in np.ndindex(2, 3, 2):
        block = np.zeros((4, 4), np.uint16)
        part = a[z, 4 * j : 4 * j + 4, 4 * i : 4 * i + 4]
        block[: part.shape[0], : part.shape[1]] = part
        (tmp_path / "v" / "0" / f"{z}.{j}.{i}").write_bytes(block.tobytes())
    dims = spark.createDataFrame([("S", z, 10, 7) for z in range(2)], "subject string, z int, h int, w int")
    source = tiles.from_volume(volumes.read_zarr_tiles(spark, str(tmp_path / "v"), "0", "S", "image"), dims)
    for got, want in zip(frames_of(tiles.pixels(tiles.gaussian(source, 1, tile=4)), dims), a, strict=True):
        assert np.allclose(got, blurred(want.astype(float), 1))


def test_tiles_equal_the_long_form_in_sql(spark, small):
    """Gray, blur, edges, density and importance of the raster views, every pixel."""
    con = duckdb.connect()
    for name in ("part", "supplier"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    v = Views(spark, small)
    gray = imaging.gray_tiles(v)
    inside = tiles.masked(gray, v.roi_runs, tile=64)
    for got, sql in [
        (gray, f"{imaging._GRAY} SELECT subject, z, y, x, v FROM g"),
        (tiles.gaussian(gray, 1, tile=64), f"{imaging._GRAY}, {imaging._blur_sql('g', 'b', 1)} SELECT subject, z, y, x, v FROM b"),
        (tiles.sobel(gray, tile=64), f"{imaging._GRAY}, {imaging._sobel_sql('g', 'e')} SELECT subject, z, y, x, v FROM e"),
        (tiles.by_max(tiles.gaussian(inside, 5, tile=64)), f"{imaging._DENSITY} SELECT subject, z, y, x, v FROM de"),
        (stencils.importance_tiles(gray, tile=64), f"""{imaging._GRAY}, {imaging._blur_sql('g', 'b', 2)}, {imaging._sobel_sql('g', 'e')}
SELECT b.subject, b.z, b.y, b.x, 0.4 * b.v / max(b.v) OVER (PARTITION BY b.subject, b.z) + 0.6 * e.v / max(e.v) OVER (PARTITION BY b.subject, b.z) AS v FROM b JOIN e USING (subject, z, y, x)"""),
    ]:
        want = con.sql(ctes("image", "roi") + ",\n" + sql).df()
        have = tiles.pixels(got).toPandas()
        both = have.merge(want, on=["subject", "z", "y", "x"])
        assert len(both) == len(have) == len(want) > 80_000 and np.allclose(both.v_x, both.v_y, atol=1e-9)


def thick(draw):
    """A mask whose components are wide, touch frame and tile edges, and wind over many tiles."""
    a = draw.random((70, 90)) < 0.02
    grown = a.copy()
    for dy in range(-4, 5):
        for dx in range(-4, 5):
            grown |= np.roll(a, (dy, dx), (0, 1))
    grown[:30, 20:50], grown[28:33, :] = True, True
    return grown


@pytest.mark.parametrize(("tile", "passes"), [(9, 2), (16, 4), (30, 32)])
def test_thinning_over_tiles_equals_the_whole(spark, tile, passes):
    """Components over nine tiles and more, halos wider than a tile, a null key, an empty mask."""
    draw = np.random.default_rng(11)
    masks = {None: thick(draw), "a": thick(draw), "b": np.zeros((3, 3), bool)}
    rows = [(m, int(y), int(x), int(x)) for m, a in masks.items() for y, x in zip(*np.nonzero(a))]
    runs = spark.createDataFrame(rows, "model string, y int, x0 int, x1 int")
    source = tiles.from_runs(runs, 70, 90, ("model",), tile)
    got = {(r.model, r.y, r.x) for r in tiles.foreground(tiles.thinned(source, ("model",), tile, passes), ("model",)).collect()}
    want = {(m, int(y), int(x)) for m, a in masks.items() for y, x in zip(*np.nonzero(kernels.thin(a)))}
    assert got == want
    assert tiles.foreground(tiles.thinned(source.filter("model = 'b'"), ("model",), tile, passes), ("model",)).count() == 0


def test_large_components_are_thinned_over_tiles(spark, monkeypatch):
    """Small ones on sheets, large ones over tiles, null keys among them: the same lines as of the whole."""
    draw = np.random.default_rng(12)
    a, b = thick(draw), thick(draw)
    px = spark.createDataFrame([(m, int(y), int(x)) for m, g in ((None, a), ("a", b)) for y, x in zip(*np.nonzero(g))], "model string, y int, x int")
    want = {(m, int(y), int(x)) for m, g in ((None, a), ("a", b)) for y, x in zip(*np.nonzero(kernels.thin(g)))}
    sheets = []
    plain = stencils._thin_by_sheets
    monkeypatch.setattr(stencils, "_thin_by_sheets", lambda df, by: sheets.append(df) or plain(df, by))
    for large in (1 << 24, 400):
        got = [(r.model, r.y, r.x) for r in stencils.skeleton(px, ("model",), large=large, tile=16).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    whole, rest = (df.select("model", "comp_id").distinct().count() for df in sheets)
    assert 0 < rest < whole
