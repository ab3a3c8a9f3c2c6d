"""Connected components of masks: labels, properties, filters, merging and continuity.

A mask is cut into row runs. Runs are labelled inside bands of rows, many bands of a partition at
once in numpy. Only runs on either side of a band border leave their band: pieces that touch there
are the links of a small graph, solved by star rounds, and its roots are joined back. Components
are numbered 1..n by their first pixel in scan order, band by band. No group or task holds a
slice, and the labels do not depend on the band height.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import pixels as px_ops
from .graph import least_reached, saved
from .runs import sampled, whole_groups

KEY = ("subject", "z")
Key = tuple[str, ...]
BAND = 256


def _fields(df: DataFrame, names: Key) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of 0..n-1 that links a-b reach from each: roots are hung under lower roots, then paths are cut."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        live = low < high
        a, b = a[live], b[live]
        np.minimum.at(root, high[live], low[live])
        while True:
            further = root[root]
            if np.array_equal(further, root):
                break
            root = further
    return root


def link_runs(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int, group: np.ndarray | None = None) -> np.ndarray:
    """The first run (by place) of each run's component; runs are sorted by group, y, x0. ``reach`` is 1
    where diagonal neighbours touch, else 0. Runs of different groups never touch."""
    if not len(y):
        return np.empty(0, np.int64)
    # rows of all groups one after the other, two apart where they do not follow each other
    step = np.diff(y.astype(np.int64))
    step = np.where(step == 1, 1, np.where(step == 0, 0, 2))
    if group is not None:
        step = np.where(np.diff(group) != 0, 2, step)
    row = np.concatenate([[1], 1 + np.cumsum(step)])
    wide = int(x1.max()) + 4
    start, end = row * wide + x0, row * wide + x1
    # what touches a run in the row below lies together
    first = np.searchsorted(end, start + wide - reach)
    count = np.maximum(0, np.searchsorted(start, end + wide + reach, "right") - first)
    above = np.repeat(np.arange(len(y)), count)
    below = np.repeat(first, count) + np.arange(len(above)) - np.repeat(np.cumsum(count) - count, count)
    fine = row[below] == row[above] + 1
    return _least(len(y), above[fine], below[fine])


def _banded(keys: int, reach: int):
    """Batches (by, _band, y, x0, x1) sorted by them to the same with _piece, the first pixel of the run's piece,
    and _k, the place of the piece among its band's. Runs of a row that touch or overlap are made one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, keys + 1):
            y, x0, x1 = (table.column(keys + i).to_numpy().astype(np.int64) for i in (1, 2, 3))
            row = np.concatenate([[0], np.cumsum((np.diff(group) != 0) | (np.diff(y) != 0))])
            wide = x1.max() - x0.min() + 3
            reached = np.maximum.accumulate(row * wide + x1)
            first = np.flatnonzero(np.concatenate([[True], row[1:] * wide + x0[1:] > reached[:-1] + 1]))
            x1 = np.maximum.reduceat(x1, first)
            y, x0, group = y[first], x0[first], group[first]
            root = link_runs(y, x0, x1, reach, group)
            heads = np.cumsum(root == np.arange(len(root)))
            before = (heads - (root == np.arange(len(root))))[np.searchsorted(group, group)]
            out = table.select(range(keys + 2)).take(pa.array(first)).append_column("x0", pa.array(x0.astype(np.int32))).append_column("x1", pa.array(x1.astype(np.int32)))
            out = out.append_column("_piece", pa.array((y[root] << 32) + x0[root])).append_column("_k", pa.array(heads[root] - before))
            yield out.combine_chunks().to_batches()[0]

    return run


def label_runs(runs: DataFrame, by: Key = KEY, connectivity: int = 8, band: int = BAND) -> DataFrame:
    """runs (by, y, x0, x1) with comp_id, from 1 in scan order of the first pixels; runs of a row that touch or overlap are made
    one. Computed once, at once."""
    reach = {4: 0, 8: 1}[connectivity]
    banded = runs.select(*by, F.floor(F.col("y") / band).cast("int").alias("_band"), "y", F.col("x0").cast("int").alias("x0"), F.col("x1").cast("int").alias("x1"))
    dealt = banded.repartition(*by, "_band").sortWithinPartitions(*by, "_band", "y", "x0")
    pieces = saved(dealt.mapInArrow(_banded(len(by), reach), f"{_fields(banded, (*by, '_band', 'y', 'x0', 'x1'))}, _piece bigint, _k bigint"))
    if not pieces.agg(F.max("_band")).first()[0]:  # no slice is higher than a band
        return pieces.select(*by, "y", "x0", "x1", F.col("_k").alias("comp_id"))
    upper = pieces.filter((F.col("y") + 1) % band == 0).select(*by, (F.col("y") + 1).alias("y"), F.col("x0").alias("_a"), F.col("x1").alias("_b"), F.col("_piece").alias("u"))
    lower = pieces.filter((F.col("y") % band == 0) & (F.col("y") > 0)).select(*by, "y", "x0", "x1", F.col("_piece").alias("v"))
    touching = (F.col("x0") <= F.col("_b") + reach) & (F.col("_a") <= F.col("x1") + reach)
    links = lower.join(upper.withColumnsRenamed({n: f"_{n}" for n in (*by, "y")}), [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in (*by, "y")])
    links = links.filter(touching).select(*by, "u", "v")
    roots = least_reached(links.select(F.struct(*by).alias("_at"), "u", "v"), ("_at",))
    rooted = pieces.withColumn("_at", F.struct(*by)).join(roots.withColumnRenamed("node", "_piece"), ["_at", "_piece"], "left")
    rooted = rooted.withColumn("_root", F.coalesce("root", "_piece"))
    # a component's first run is its root: these are numbered within their bands, after those of the bands above
    heads = rooted.filter((F.col("y").cast("bigint") * (1 << 32) + F.col("x0")) == F.col("_root")).select("_at", "_band", "_root")
    above = Window.partitionBy("_at").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    sizes = heads.groupBy("_at", "_band").agg(F.count("*").alias("_n")).withColumn("_above", F.coalesce(F.sum("_n").over(above), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_at", "_band").orderBy("_root"))
    numbers = heads.withColumn("_r", place).join(sizes, ["_at", "_band"]).select("_at", "_root", (F.col("_above") + F.col("_r")).alias("comp_id"))
    return saved(rooted.join(numbers, ["_at", "_root"]).select(*by, "y", "x0", "x1", "comp_id"))


def label(px: DataFrame, by: Key = KEY, connectivity: int = 8, band: int = BAND) -> DataFrame:
    """Labelled runs of a mask of distinct pixels."""
    return label_runs(px_ops.runs(px, by), by, connectivity, band)


def pixels(labelled: DataFrame) -> DataFrame:
    return px_ops.pixels_of(labelled)


def properties(labelled: DataFrame, by: Key = KEY) -> DataFrame:
    """One row a component: area, box (inclusive), whole centroid, major axis and eccentricity
    from the second moments (a pixel counts as a point)."""
    n = (F.col("x1") - F.col("x0") + 1).cast("double")
    a, b, y = F.col("x0").cast("double"), F.col("x1").cast("double"), F.col("y").cast("double")
    sx = (a + b) * n / 2
    power = lambda v: v * (v + 1) * (2 * v + 1) / 6  # noqa: E731  1^2 + ... + v^2
    sums = labelled.groupBy(*by, "comp_id").agg(
        F.sum(n).alias("_n"), F.sum(sx).alias("_x"), F.sum(n * y).alias("_y"), F.sum(power(b) - power(a - 1)).alias("_xx"),
        F.sum(n * y * y).alias("_yy"), F.sum(sx * y).alias("_xy"), F.min("y").alias("y_min"), F.max("y").alias("y_max"),
        F.min("x0").alias("x_min"), F.max("x1").alias("x_max"),
    )
    n = F.col("_n")
    mx, my = F.col("_x") / n, F.col("_y") / n
    vx, vy, vxy = F.col("_xx") / n - mx * mx, F.col("_yy") / n - my * my, F.col("_xy") / n - mx * my
    root = F.sqrt((vx - vy) * (vx - vy) + 4 * vxy * vxy)
    l1, l2 = (vx + vy + root) / 2, F.greatest((vx + vy - root) / 2, F.lit(0.0))
    major = F.when(l1 > 0, 4 * F.sqrt(F.greatest(l1, F.lit(0.0)))).otherwise(0.0)
    return sums.select(
        *by, "comp_id", n.cast("bigint").alias("area"), "y_min", "y_max", "x_min", "x_max",
        my.cast("int").alias("cy"), mx.cast("int").alias("cx"), major.alias("major_axis"),
        F.when(l1 > 1e-12, F.sqrt(1 - l2 / l1)).otherwise(0.0).alias("eccentricity"),
    )


def count(labelled: DataFrame, by: Key = KEY) -> DataFrame:
    return labelled.groupBy(*by).agg(F.max("comp_id").alias("n_components"))


def areas(labelled: DataFrame, by: Key = KEY) -> DataFrame:
    return labelled.groupBy(*by, "comp_id").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))


def keep(labelled: DataFrame, chosen: DataFrame, by: Key = KEY) -> DataFrame:
    return labelled.join(chosen.select(*by, "comp_id"), [*by, "comp_id"], "left_semi")


def _sized(px: DataFrame, by: Key, connectivity: int, band: int) -> DataFrame:
    """Labelled runs with the area of their component."""
    return _with_area(label(px, by, connectivity, band), by)


def _with_area(labelled: DataFrame, by: Key) -> DataFrame:
    size = F.sum(F.col("x1") - F.col("x0") + 1).over(Window.partitionBy(*by, "comp_id"))
    return labelled.withColumn("area", size)


def remove_small_runs(runs: DataFrame, min_size: int, by: Key = KEY, connectivity: int = 4, band: int = BAND) -> DataFrame:
    """As remove_small, from and to runs (merged ones)."""
    return _with_area(label_runs(runs, by, connectivity, band), by).filter(F.col("area") >= min_size).select(*by, "y", "x0", "x1")


def remove_small(px: DataFrame, min_size: int, by: Key = KEY, connectivity: int = 4, band: int = BAND) -> DataFrame:
    """Pixels of components of at least min_size pixels."""
    return pixels(_sized(px, by, connectivity, band).filter(F.col("area") >= min_size)).select(*by, "y", "x")


def largest(px: DataFrame, k: int, by: Key = KEY, connectivity: int = 4, band: int = BAND) -> DataFrame:
    """Pixels of the k largest components of each slice; ties in scan order; k <= 0: all."""
    if k <= 0:
        return px.select(*by, "y", "x")
    place = F.dense_rank().over(Window.partitionBy(*by).orderBy(F.desc("area"), "comp_id"))
    return pixels(_sized(px, by, connectivity, band).withColumn("_r", place).filter(F.col("_r") <= k)).select(*by, "y", "x")


def top_instances(props: DataFrame, k: int = 4, by: Key = KEY) -> DataFrame:
    """The k largest components with inst_id 1..k by area; ties keep scan order."""
    order = Window.partitionBy(*by).orderBy(F.desc("area"), "comp_id")
    return props.withColumn("inst_id", F.row_number().over(order)).filter(F.col("inst_id") <= k)


def fibres(px: DataFrame, by: Key = KEY, min_area: int = 25, min_major: float = 50, min_ecc: float = 0.8) -> DataFrame:
    """Pixels of long thin 8-connected components."""
    return pixels(fibre_runs(label(px, by, 8), by, min_area, min_major, min_ecc)).select(*by, "y", "x")


def fibre_runs(labelled: DataFrame, by: Key = KEY, min_area: int = 25, min_major: float = 50, min_ecc: float = 0.8) -> DataFrame:
    """Labelled runs of those components that are long and thin."""
    long = properties(labelled, by).filter((F.col("area") >= min_area) & (F.col("major_axis") >= min_major) & (F.col("eccentricity") >= min_ecc))
    return keep(labelled, long, by)


def near_pairs(props: DataFrame, distance: float = 30, by: Key = KEY) -> DataFrame:
    """Pairs i < j of a slice whose centroids are nearer than ``distance``. Centroids are joined by
    grid cells of that size, so only neighbours meet."""
    cell = lambda c: F.floor(F.col(c) / distance).cast("int")
    left = props.select(*by, F.col("comp_id").alias("i"), F.col("cy").alias("_y"), F.col("cx").alias("_x"), cell("cy").alias("_gy"), cell("cx").alias("_gx"))
    around = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    right = props.select(*by, F.col("comp_id").alias("j"), "cy", "cx", F.explode(around).alias("_dy")).withColumn("_dx", F.explode(around))
    right = right.select(*by, "j", "cy", "cx", (cell("cy") + F.col("_dy")).alias("_gy"), (cell("cx") + F.col("_dx")).alias("_gx"))
    dist = F.sqrt((F.col("cx") - F.col("_x")) * (F.col("cx") - F.col("_x")) + (F.col("cy") - F.col("_y")) * (F.col("cy") - F.col("_y")))
    met = left.join(right, [*by, "_gy", "_gx"]).filter(F.col("i") < F.col("j"))
    return met.withColumn("dist", dist).filter(F.col("dist") < distance).select(*by, "i", "j", "dist")


def merge_near(props: DataFrame, distance: float = 30, by: Key = KEY) -> DataFrame:
    """(by, comp_id, inst): in scan order each unused component takes in every later unused one
    that is near it (its own centroid stays as it was)."""
    pairs = near_pairs(props, distance, by)
    near = props.select(*by, F.col("comp_id").alias("i")).join(pairs, [*by, "i"], "left").groupBy(*by, "i").agg(F.collect_list("j").alias("js"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        owner: dict[int, int] = {}
        for i, js in sorted(zip(pdf["i"], pdf["js"], strict=True)):
            if i not in owner:
                owner[i] = i
                for j in js:
                    owner.setdefault(j, i)
        key = {n: pdf[n].iloc[0] for n in by}
        return pd.DataFrame({**key, "comp_id": list(owner), "inst": list(owner.values())})

    return near.groupBy(*by).applyInPandas(one, f"{_fields(props, by)}, comp_id bigint, inst bigint")


def touched(labelled: DataFrame, mask: DataFrame, by: Key = KEY) -> DataFrame:
    """(by, comp_id, overlap): components with pixels in the mask, and how many. Runs meet runs of
    the same row, so no pixel is expanded."""
    return touched_runs(labelled, px_ops.runs(mask, by), by)


def touched_runs(labelled: DataFrame, mask: DataFrame, by: Key = KEY, key: Key | None = None) -> DataFrame:
    """The same with the mask as runs that do not overlap; ``key``: the columns of by that the mask has."""
    key = by if key is None else key
    other = mask.select(*key, "y", F.col("x0").alias("_a"), F.col("x1").alias("_b"))
    shared = F.least("x1", "_b") - F.greatest("x0", "_a") + 1
    met = labelled.join(other, [*key, "y"]).filter((F.col("x0") <= F.col("_b")) & (F.col("_a") <= F.col("x1")))
    return met.groupBy(*by, "comp_id").agg(F.sum(shared).alias("overlap"))


def overlaps(labelled: DataFrame, every: DataFrame, subject: Key = ("subject",), order: str = "z", sizes: DataFrame | None = None) -> DataFrame:
    """(by, comp_id, area, _met): the components of each slice and the pixels that they share with those of the slice before
    (prev, shared); a slice of ``every`` without components is one row of nulls. ``sizes``: see continuity."""
    by = (*subject, order)
    steps = every.withColumn("_next", F.lead(order).over(Window.partitionBy(*subject).orderBy(order)))
    earlier = labelled.join(steps, [*by]).filter(F.col("_next").isNotNull())
    if sizes is not None:
        own, its = (sizes.select(*subject, F.col(order).alias(o), F.col("h").alias(f"_h{n}"), F.col("w").alias(f"_w{n}")) for o, n in ((order, 0), ("_next", 1)))
        earlier = sampled(earlier.join(own, [*by]).join(its, [*subject, "_next"]), ("_h0", "_w0"), ("_h1", "_w1"))
    earlier = earlier.select(*subject, F.col("_next").alias(order), "y", F.col("x0").alias("_a"), F.col("x1").alias("_b"), F.col("comp_id").alias("prev"))
    met = labelled.join(earlier, [*by, "y"]).filter((F.col("x0") <= F.col("_b")) & (F.col("_a") <= F.col("x1")))
    shared = met.groupBy(*by, "comp_id", "prev").agg(F.sum(F.least("x1", "_b") - F.greatest("x0", "_a") + 1).alias("shared"))
    shared = shared.groupBy(*by, "comp_id").agg(F.collect_list(F.struct("prev", "shared")).alias("_met"))
    return every.join(areas(labelled, by).join(shared, [*by, "comp_id"], "left"), [*by], "left")


def continuity(
    px: DataFrame, subject: Key = ("subject",), order: str = "z", min_share: float = 0.02, min_area: int = 1000,
    slices: DataFrame | None = None, labelled: DataFrame | None = None, sizes: DataFrame | None = None,
) -> DataFrame:
    """Per component (8-connected) of each slice: area and whether it stays.

    A component goes if it shares less than min_share of its pixels with what stayed in the slice
    before and is smaller than min_area; nothing goes where that slice kept nothing. ``slices``: the
    slices that were processed; one without pixels keeps nothing, one that is not in the table was
    skipped and does not count (without the table: those that have pixels). ``labelled``: the mask's
    labelled runs, if they are known. ``sizes`` (subject, order, h, w): slices have frames of their own, and what
    stayed before is brought to the slice's size by nearest places. Overlaps between all components of consecutive slices are
    joined first; the chain along z then runs over this small table, one group a subject.
    """
    by = (*subject, order)
    labelled = saved(label(px, by, 8)) if labelled is None else labelled
    every = (labelled if slices is None else slices).select(*by).distinct()
    table = overlaps(labelled, every, subject, order, sizes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        stays, before = {}, None
        for z, now in pdf.sort_values([order, "comp_id"]).groupby(order):
            now, kept = now[now["comp_id"].notna()], set()
            for comp, area, met in zip(now["comp_id"], now["area"], now["_met"], strict=True):
                both = sum(m["shared"] for m in (met if met is not None else ()) if m["prev"] in (before or ()))
                if not before or both / area >= min_share or area >= min_area:
                    kept.add(comp)
                stays[z, comp] = comp in kept
            before = kept
        out = pdf[pdf["comp_id"].notna()].drop(columns="_met")
        out["stays"] = [stays[k] for k in zip(out[order], out["comp_id"], strict=True)]
        return out.astype({"comp_id": "int64", "area": "int64", "stays": bool})

    fields = _fields(px, by)
    return table.select(*by, "comp_id", F.col("area").cast("bigint").alias("area"), "_met").groupBy(*subject).applyInPandas(
        one, f"{fields}, comp_id bigint, area bigint, stays boolean"
    )


def removed(before: DataFrame, after: DataFrame, by: Key = KEY) -> DataFrame:
    """How many components of ``before`` (labelled) are not in ``after``."""
    n = lambda df, c: df.select(*by, "comp_id").distinct().groupBy(*by).agg(F.count("*").alias(c))
    both = n(before, "n_before").join(n(after, "n_after"), [*by], "left").fillna(0)
    return both.withColumn("n_removed", F.col("n_before") - F.col("n_after"))
