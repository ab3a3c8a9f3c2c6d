"""Neighbourhood operators. Masks are handled as runs; images as tiles (see ``tiles``), here from and to pixel tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import components, kernels, tiles
from . import pixels as px_ops
from .components import _fields
from .graph import few, saved
from .runs import whole_groups

KEY = ("subject", "z")
Key = tuple[str, ...]
TILE = tiles.TILE


def gaussian(image: DataFrame, dims: DataFrame, sigma: float, by: Key = KEY, tile: int = TILE) -> DataFrame:
    """Blur with weights cut at 4 sigma and mirrored edges, of a pixel table; every pixel of dims' frames is in the result."""
    return tiles.pixels(tiles.gaussian(tiles.from_pixels(image, dims, by, tile), sigma, by, tile), by)


def sobel(image: DataFrame, dims: DataFrame, by: Key = KEY, tile: int = TILE) -> DataFrame:
    """Edge magnitude: sqrt((gy^2 + gx^2) / 2), [1 2 1] / 4 across and [1 0 -1] / 2 along."""
    return tiles.pixels(tiles.sobel(tiles.from_pixels(image, dims, by, tile), by, tile), by)


def density(gray: DataFrame, roi: DataFrame, dims: DataFrame, sigma: float = 5, by: Key = KEY) -> DataFrame:
    """Blurred gray inside the region, divided by the slice's maximum."""
    inside = tiles.from_pixels(px_ops.within(gray, roi, by), dims, by)
    return tiles.pixels(tiles.by_max(saved(tiles.gaussian(inside, sigma, by)), by), by)


def importance_tiles(gray: DataFrame, by: Key = KEY, sigma: float = 2, tile: int = TILE) -> DataFrame:
    """0.4 of the density and 0.6 of the edges of gray tiles, each divided by its slice's maximum."""
    return tiles.importance(gray, lambda a, _: {"data": kernels.packed(a)}, "data binary", by, sigma, tile)


def importance(gray: DataFrame, dims: DataFrame, instances: DataFrame, by: Key = KEY, sigma: float = 2) -> DataFrame:
    """The same on the pixels of instances (by, ..., y, x)."""
    field = importance_tiles(saved(tiles.from_pixels(gray, dims, by)), by, sigma)
    return instances.join(tiles.pixels(field, by), [*by, "y", "x"])


def ridges(
    gray: DataFrame, dims: DataFrame, sigmas: tuple[float, ...] = (1, 2, 4, 8), beta: float = 0.5, by: Key = KEY, tile: int = TILE, factor: int = 1, inside: DataFrame | None = None
) -> DataFrame:
    """Bright ridges (Frangi 1998) of a pixel table at several scales, divided by the slice's maximum; ``factor``: found
    on frames sampled down by it, and brought back; ``inside``: a mask's runs, outside of which nothing is found."""
    source = tiles.from_pixels(gray, dims, by, tile)
    plain = factor <= 1 and inside is None
    found = tiles.ridges(source, sigmas, beta, by, tile) if plain else tiles.ridges_at(source, dims, factor, sigmas, by, tile, inside)
    return tiles.pixels(found, by)


def _widened(runs: DataFrame, spans: list[tuple[int, int]], dims: DataFrame, by: Key) -> DataFrame:
    """The union of runs moved by dy and widened by r for each (dy, r), as runs."""
    offsets = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(r).alias("r")) for d, r in spans])).alias("_o")
    size = [*(c for c in by if c in dims.columns)]
    moved = runs.select(*by, "y", "x0", "x1", offsets).join(dims.select(*size, "h", "w"), size)
    moved = moved.select(
        *by, (F.col("y") + F.col("_o.d")).alias("y"), F.greatest(F.lit(0), F.col("x0") - F.col("_o.r")).alias("x0"),
        F.least(F.col("w") - 1, F.col("x1") + F.col("_o.r")).alias("x1"), "h",
    ).filter("y >= 0 and y < h and x0 <= x1")
    order = Window.partitionBy(*by, "y").orderBy("x0", "x1")
    before = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = moved.withColumn("_new", F.when(F.col("x0") <= before + 1, 0).otherwise(1))
    group = new.withColumn("_g", F.sum("_new").over(order))
    return group.groupBy(*by, "y", "_g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_g")


def _disk(radius: int) -> list[tuple[int, int]]:
    return [(d, int((radius * radius - d * d) ** 0.5)) for d in range(-radius, radius + 1)]


def dilate_cross(mask: DataFrame, dims: DataFrame, steps: int, by: Key = KEY) -> DataFrame:
    """n dilations by the 4-neighbour cross: all pixels within n steps."""
    return px_ops.pixels_of(dilate_cross_runs(px_ops.runs(mask, by), dims, steps, by))


def dilate_cross_runs(runs: DataFrame, dims: DataFrame, steps: int, by: Key = KEY) -> DataFrame:
    """As dilate_cross, from and to runs."""
    return _widened(runs, [(d, steps - abs(d)) for d in range(-steps, steps + 1)], dims, by)


def dilate_disk(mask: DataFrame, dims: DataFrame, radius: int, by: Key = KEY) -> DataFrame:
    return px_ops.pixels_of(_widened(px_ops.runs(mask, by), _disk(radius), dims, by))


def _complement(runs: DataFrame, keys: DataFrame, dims: DataFrame, by: Key) -> DataFrame:
    """What runs leave of the frames of keys, as runs: a row of the frame at a time."""
    size = [*(c for c in by if c in dims.columns)]
    rows = keys.join(dims.select(*size, "h", "w"), size).select(*by, "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"))
    filled = runs.groupBy(*by, "y").agg(F.sort_array(F.collect_list(F.struct("x0", "x1"))).alias("_r"))
    both = rows.join(filled, [*by, "y"], "left").withColumn("_r", F.coalesce("_r", F.expr("cast(array() as array<struct<x0:int,x1:int>>)")))
    starts = F.concat(F.array(F.lit(0)), F.transform("_r", lambda r: r["x1"] + 1))
    ends = F.concat(F.transform("_r", lambda r: r["x0"] - 1), F.array(F.col("w") - 1))
    gap = F.explode(F.filter(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda g: g["a"] <= g["b"])).alias("_g")
    return both.select(*by, "y", gap).select(*by, "y", F.col("_g.a").alias("x0"), F.col("_g.b").alias("x1"))


def _eroded(runs: DataFrame, dims: DataFrame, radius: int, by: Key) -> DataFrame:
    """The background widened, and what that leaves: no pixel of it is made."""
    keys = runs.select(*by).distinct()
    return _complement(_widened(_complement(runs, keys, dims, by), _disk(radius), dims, by), keys, dims, by)


def erode_disk(mask: DataFrame, dims: DataFrame, radius: int, by: Key = KEY) -> DataFrame:
    """Pixels whose disk lies in the mask; what is outside the frame doesn't count."""
    return px_ops.pixels_of(_eroded(px_ops.runs(mask, by), dims, radius, by))


def close_disk(mask: DataFrame, dims: DataFrame, radius: int, by: Key = KEY) -> DataFrame:
    return px_ops.pixels_of(close_runs(px_ops.runs(mask, by), dims, radius, by))


def close_runs(runs: DataFrame, dims: DataFrame, radius: int, by: Key = KEY) -> DataFrame:
    """As close_disk, from and to runs."""
    return _eroded(_widened(runs, _disk(radius), dims, by), dims, radius, by)


def open_disk(mask: DataFrame, dims: DataFrame, radius: int, by: Key = KEY) -> DataFrame:
    return px_ops.pixels_of(open_runs(px_ops.runs(mask, by), dims, radius, by))


def open_runs(runs: DataFrame, dims: DataFrame, radius: int, by: Key = KEY) -> DataFrame:
    """As open_disk, from and to runs."""
    return _widened(_eroded(runs, dims, radius, by), _disk(radius), dims, by)


def ring(mask: DataFrame, dims: DataFrame, radius: int, by: Key = KEY) -> DataFrame:
    """The dilated mask without the mask."""
    return px_ops.without(dilate_disk(mask, dims, radius, by), mask, by)


def outside(roi: DataFrame, mask: DataFrame, dims: DataFrame, steps: int, by: Key = KEY) -> DataFrame:
    """The region without the mask dilated by ``steps``."""
    return px_ops.without(roi, dilate_cross(mask, dims, steps, by), by)


#: Cells of a sheet, of which a larger component has one of its own.
SHEET = 1 << 20
#: Cells of the box of a component beyond which it is thinned tile by tile.
LARGE = 1 << 24


def _sheets(h: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """Boxes (by place) that are stacked on a sheet, one blank row between; boxes of like widths meet."""
    out, rows = [], 0
    for i in np.argsort(w, kind="stable"):
        if not out or (rows + h[i] + 1) * w[i] > SHEET:
            out.append([])
            rows = 0
        out[-1].append(i)
        rows += h[i] + 1
    return [np.array(x) for x in out]


def skeleton(mask: DataFrame | None, by: Key = KEY, labelled: DataFrame | None = None, large: int = LARGE, tile: int = TILE) -> DataFrame:
    """Pixels of one-pixel centre lines (Zhang-Suen) of a mask, or of its labelled runs (8-connected), if they are known."""
    labelled = components.label(mask, by, 8) if labelled is None else labelled
    return px_ops.pixels_of(skeleton_runs(labelled, by, large, tile))


def skeleton_runs(labelled: DataFrame, by: Key = KEY, large: int = LARGE, tile: int = TILE) -> DataFrame:
    """Runs of the centre lines, component by component: 8-connected components never
    change each other, so each is cut out by its box, and small ones, of whatever slices, are thinned on one sheet. Those whose
    box has more than ``large`` cells are thinned by tiles that exchange strips (see tiles.thinned), so no task holds one whole;
    the lines are the same. ``labelled`` is computed once."""
    size = (F.max("y") - F.min("y") + 1).cast("bigint") * (F.max("x1") - F.min("x0") + 1)
    span = labelled.agg(size.alias("_n")).first()[0]
    if span is None or span <= large:  # nor is any component larger
        return _thin_by_sheets(labelled, by)
    boxes = labelled.groupBy(*by, "comp_id").agg(size.alias("_n"), (F.max("y") + 1).alias("_h"), (F.max("x1") + 1).alias("_w"))
    wide = saved(boxes.filter(F.col("_n") > large))
    height, width = wide.agg(F.max("_h"), F.max("_w")).first()
    if height is None:
        return _thin_by_sheets(labelled, by)
    # keys may be null
    same = [labelled[n].eqNullSafe(F.col(f"_b{i}")) for i, n in enumerate((*by, "comp_id"))]
    which = few(wide.select(*[F.col(n).alias(f"_b{i}") for i, n in enumerate((*by, "comp_id"))]))
    across = tiles.thinned(tiles.from_runs(labelled.join(which, same, "left_semi"), height, width, by, tile), by, tile)
    lines = tiles.foreground(across, by).select(*by, "y", F.col("x").alias("x0"), F.col("x").alias("x1"))
    return _thin_by_sheets(labelled.join(which, same, "left_anti"), by).unionByName(lines)


def _thinned(keys: int):
    """Batches (by, comp_id, y, x0, x1) sorted by by and comp_id to runs (by, y, x0, x1) of their lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, of in whole_groups(batches, keys + 1):
            y, a, b = (table.column(keys + i).to_numpy().astype(np.int64) for i in (1, 2, 3))
            start = np.flatnonzero(np.concatenate([[True], np.diff(of) != 0]))
            top, left = np.minimum.reduceat(y, start), np.minimum.reduceat(a, start)
            h, w = np.maximum.reduceat(y, start) - top + 1, np.maximum.reduceat(b, start) - left + 1
            for sheet in _sheets(h, w):
                at, place = np.concatenate([[0], np.cumsum(h[sheet] + 1)]), np.full(len(start), -1)
                place[sheet] = at[:-1]
                r = np.flatnonzero(place[of] >= 0)
                row, shift = place[of[r]] + y[r] - top[of[r]], left[of[r]]
                ends = np.zeros((at[-1], w[sheet].max() + 1), np.int8)
                np.add.at(ends, (row, a[r] - shift), 1)
                np.add.at(ends, (row, b[r] - shift + 1), -1)
                row, column = np.nonzero(kernels.thin(np.cumsum(ends, axis=1, dtype=np.int8)[:, :-1]))
                first = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(column) != 1)]))
                last = np.concatenate([first[1:], [len(row)]]) - 1
                comp = sheet[np.searchsorted(at, row[first], "right") - 1]
                out = [table.column(i).combine_chunks().take(pa.array(start[comp])) for i in range(keys)]
                out += [pa.array(v.astype(np.int32)) for v in (row[first] - place[comp] + top[comp], column[first] + left[comp], column[last] + left[comp])]
                yield pa.RecordBatch.from_arrays(out, [*table.schema.names[:keys], "y", "x0", "x1"])

    return run


def _thin_by_sheets(labelled: DataFrame, by: Key) -> DataFrame:
    """Components that fit into a task."""
    dealt = labelled.select(*by, "comp_id", "y", "x0", "x1").repartition(*by, "comp_id").sortWithinPartitions(*by, "comp_id")
    return dealt.mapInArrow(_thinned(len(by)), f"{_fields(labelled, by)}, y int, x0 int, x1 int")
