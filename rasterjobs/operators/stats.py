"""Percentiles, statistics inside a region, counters, histograms, samples and normalisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, ShortType
from pyspark.sql.window import Window

from ..functions.columns import EPSILON, clip, shuffled
from .graph import few, saved
from .pixels import pixels_of, within

KEY = ("subject", "z")
Key = tuple[str, ...]


#: Distinct values of a group, or of what is left of it, that one task may order.
GATHERED = 65_536
#: Values that cut an interval in a round of selection.
CUTS = 63


def percentiles(px: DataFrame, ps: dict[str, float], value: str = "v", by: Key = KEY, gathered: int = GATHERED, times: str | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, one column for each name in ps (0..100).

    Equal values are counted first. Of 8- and 16-bit pixels at most 65,536 values a group are left, and so the percentiles
    are taken at once. Of other kinds, where a group has more than ``gathered`` distinct values all go through ``selected``, so
    no task orders a group. Nulls do not count; a NaN is greater than all numbers; groups of nulls alone have null percentiles.
    ``times``: the column that tells how many values a row stands for."""
    counted = px.groupBy(*by, value).agg((F.count("*") if times is None else F.sum(times)).alias("_n"))
    plain = lambda df: df.groupBy(*by).agg(*[F.percentile(value, p / 100, F.col("_n")).alias(n) for n, p in ps.items()])
    if isinstance(px.schema[value].dataType, ByteType | ShortType):
        return plain(counted)
    counted = saved(counted)
    sizes = counted.groupBy(*by).agg(F.count(value).alias("_m"), F.sum(F.when(F.col(value).isNotNull(), F.col("_n"))).alias("_rows"))
    if sizes.filter(F.col("_m") > gathered).isEmpty():
        return plain(counted)
    return selected(counted.filter(F.col(value).isNotNull()), sizes, ps, value, by, gathered)


def same(a: DataFrame, b: DataFrame, by: Key) -> Column:
    """Keys are equal, nulls too."""
    cond = F.lit(True)
    for n in by:
        cond = cond & a[n].eqNullSafe(b[n])
    return cond


def selected(counted: DataFrame, sizes: DataFrame, ps: dict[str, float], value: str, by: Key, gathered: int = GATHERED) -> DataFrame:
    """Percentiles of counted values (by, value, _n) of groups of _rows rows, by rounds of selection.

    Each rank that is asked for has an interval of values. A round cuts it at CUTS approximate quantiles of its distinct
    values, counts rows between the cuts (partial counts meet, never values), and keeps the piece that holds the rank,
    from its own least to its own greatest value. Pieces of no more than ``gathered`` values are ordered in a window."""
    at = lambda p: (F.col("_rows") - 1) * (p / 100)
    asked = F.array(*[f(at(p)).cast("bigint") for p in ps.values() for f in (F.floor, F.ceil)])
    ranks = saved(sizes.filter(F.col("_rows").isNotNull()).select(*[F.col(n).alias(f"_b{i}") for i, n in enumerate(by)], F.explode(F.array_distinct(asked)).alias("_rank")))
    keys = tuple(f"_b{i}" for i in range(len(by)))
    rows = counted.select(*[F.col(n).alias(k) for k, n in zip(keys, by, strict=True)], F.col(value).alias("_v"), "_n")
    ends = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    first = ends.join(ranks, same(ends, ranks, keys)).select(*[ranks[k] for k in keys], "_rank", "_lo", "_hi", F.lit(0).cast("bigint").alias("_below"))
    own, todo = (*keys, "_rank"), saved(first)
    upto = lambda *on: Window.partitionBy(*on).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    holds = (F.col("_cum") > F.col("_rank") - F.col("_below")) & (F.col("_cum") - F.col("_s") <= F.col("_rank") - F.col("_below"))
    cuts = F.percentile_approx("_v", [i / (CUTS + 1) for i in range(1, CUTS + 1)], 1_000)
    while True:
        there = rows.alias("r").join(few(todo).alias("t"), F.expr(" and ".join(f"r.{k} <=> t.{k}" for k in keys) + " and r._v >= t._lo and r._v <= t._hi"))
        held = there.select(*[F.col(f"t.{k}").alias(k) for k in keys], "_rank", "_below", "_v", "_n")
        cut = held.groupBy(*own).agg(F.count("*").alias("_m"), cuts.alias("_cuts"))
        cut = saved(cut.select(*[F.col(k).alias(f"_c{k}") for k in own], "_m", "_cuts"))
        if cut.filter(F.col("_m") > gathered).isEmpty():
            break
        met = held.join(few(cut), F.expr(" and ".join(f"{k} <=> _c{k}" for k in own)))
        # what is small enough stays one piece
        piece = F.when(F.col("_m") > gathered, F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).otherwise(0)
        pieces = met.groupBy(*own, "_below", piece.alias("_piece")).agg(F.sum("_n").alias("_s"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        pieces = pieces.withColumn("_cum", F.sum("_s").over(upto(*own).orderBy("_piece"))).filter(holds)
        todo = saved(pieces.select(*own, "_lo", "_hi", (F.col("_below") + F.col("_cum") - F.col("_s")).alias("_below")))
    found = held.withColumnRenamed("_n", "_s").withColumn("_cum", F.sum("_s").over(upto(*own).orderBy("_v"))).filter(holds)
    pair = F.struct("_rank", F.col("_v").cast("double").alias("_v"))
    told = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(pair)).alias("_at"))
    both = sizes.join(told, F.expr(" and ".join(f"`{n}` <=> {k}" for n, k in zip(by, keys, strict=True))), "left")

    def between(p: float) -> Column:
        low, high = F.floor(at(p)).cast("bigint"), F.ceil(at(p)).cast("bigint")
        a, b = F.col("_at")[low], F.col("_at")[high]
        return F.when((low == high) | (a == b), a).otherwise((high - at(p)) * a + (at(p) - low) * b)

    return both.select(*[F.col(f"`{n}`") for n in by], *[between(p).alias(n) for n, p in ps.items()])


def roi_stats(image: DataFrame, roi: DataFrame, by: Key = KEY) -> DataFrame:
    """Per channel v_min, v_max, v_mean, v_std (population) inside the region, and n_roi; where the
    region is empty those of the whole channel, with n_roi 0."""
    inside = F.when(F.col("_in"), F.col("v"))
    marked = image.join(roi.select(*by, "y", "x", F.lit(True).alias("_in")), [*by, "y", "x"], "left")
    sums = marked.groupBy(*by, "c").agg(
        F.count(inside).alias("n_roi"), F.min(inside).alias("_a"), F.max(inside).alias("_b"), F.avg(inside).alias("_m"),
        F.stddev_pop(inside).alias("_s"), F.min("v").alias("_wa"), F.max("v").alias("_wb"), F.avg("v").alias("_wm"), F.stddev_pop("v").alias("_ws"),
    )
    pick = lambda a, b: F.coalesce(F.col(a), F.col(b))
    return sums.select(
        *by, "c", "n_roi", pick("_a", "_wa").alias("v_min"), pick("_b", "_wb").alias("v_max"),
        pick("_m", "_wm").alias("v_mean"), pick("_s", "_ws").alias("v_std"),
    )


def histogram(prob: DataFrame, bins: int = 50, value: str = "p") -> DataFrame:
    """bin, bin_left, bin_right, count of the non-zero values in 0..1; the last bin holds 1."""
    spark = prob.sparkSession
    place = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    found = prob.filter((F.col(value) > 0) & (F.col(value) <= 1)).groupBy(place.alias("bin")).agg(F.count("*").alias("count"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select(
        "bin", (F.col("bin") / bins).alias("bin_left"), ((F.col("bin") + 1) / bins).alias("bin_right"), F.coalesce("count", F.lit(0)).alias("count")
    )


def sample(px: DataFrame, k: int, seed: int, by: Key = KEY, also: Key = ("y", "x")) -> DataFrame:
    """At most k rows a group in an order fixed by md5 of seed and key: the same under any
    partitioning. Adds ord from 1. Spark keeps k rows a group in each partition before they meet."""
    order = Window.partitionBy(*by).orderBy(shuffled(seed, *by, *also), *also)
    return px.withColumn("ord", F.row_number().over(order)).filter(F.col("ord") <= k)


def sample_runs(runs: DataFrame, k: int, seed: int, by: Key = KEY, spare: float = 6) -> DataFrame:
    """As sample, of the pixels of runs (by, y, x0, x1) that do not overlap: (by, y, x, ord).

    Hashes are evenly spread, so the k least of n lie below about k / n of their range: what is below a limit with ``spare``
    deviations to spare is kept as pixels are made, and only that is ordered. Groups of which fewer than k lie there are
    ordered whole, so the result is exact."""
    size = Window.partitionBy(*by)
    low = k + spare * (k**0.5 + 3)
    share = F.lit(low) / F.col("_n")
    limit = F.when(share < 1, F.lower(F.lpad(F.hex((share * 2.0**32).cast("bigint")), 8, "0"))).otherwise("g")
    limited = runs.select(*by, "y", "x0", "x1", F.sum(F.col("x1") - F.col("x0") + 1).over(size).alias("_n")).withColumn("_limit", limit)
    px = pixels_of(limited).withColumn("_h", shuffled(seed, *by, "y", "x"))
    held = saved(px.filter(F.col("_h") < F.col("_limit")).select(*by, "y", "x", "_h"))
    out = held.withColumn("ord", F.row_number().over(size.orderBy("_h", "y", "x"))).filter(F.col("ord") <= k).select(*by, "y", "x", "ord")
    none = F.lit(0).cast("bigint")
    sizes = runs.groupBy(*by).agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("_n"), none.alias("_have"))
    both = sizes.unionByName(held.groupBy(*by).agg(none.alias("_n"), F.count("*").alias("_have"))).groupBy(*by).agg(F.sum("_n").alias("_n"), F.sum("_have").alias("_have"))
    short = saved(both.filter(F.col("_have") < F.least(F.col("_n"), F.lit(k))).select(*by))
    if short.isEmpty():
        return out
    rest = runs.select(*by, "y", "x0", "x1")
    whole = sample(pixels_of(rest.join(short, same(rest, short, by), "left_semi")), k, seed, by)
    return out.join(short, same(out, short, by), "left_anti").unionByName(whole.select(*by, "y", "x", "ord"))


def counters(slices: DataFrame, tables: dict[str, DataFrame | tuple[DataFrame, Column]], by: Key = KEY) -> DataFrame:
    """Rows of each table by slice, or a table and a column of its rows to sum, 0 where there are none. The tables meet in one sum."""
    counted = []
    for name, table in tables.items():
        df, n = table if isinstance(table, tuple) else (table, F.lit(1))
        counted.append(df.groupBy(*by).agg(F.sum(n.cast("bigint")).alias("_n")).select(*by, F.lit(name).alias("_of"), "_n"))
    sums = [F.coalesce(F.sum(F.when(F.col("_of") == name, F.col("_n"))), F.lit(0).cast("bigint")).alias(name) for name in tables]
    every = slices.select(*by, F.lit(None).cast("string").alias("_of"), F.lit(None).cast("bigint").alias("_n"))
    found = reduce(DataFrame.unionByName, counted, every).groupBy(*by).agg(*sums)
    return slices.select(*by).join(found, [*by], "left")


def _scaled(image: DataFrame, stats: DataFrame, value: Column, on: list[str], used: list[str]) -> DataFrame:
    return image.join(stats.select(*on, *used), on).withColumn("v", value).drop(*used)


def min_max_roi(image: DataFrame, stats: DataFrame, by: Key = KEY, strict: bool = False) -> DataFrame:
    """(v - min) / (max - min + eps) with the region's extremes; strict: no eps, flat channels are 0."""
    span = F.col("v_max") - F.col("v_min")
    plain = (F.col("v") - F.col("v_min")) / (span + EPSILON)
    exact = F.when(span > 0, (F.col("v") - F.col("v_min")) / F.when(span > 0, span)).otherwise(0.0)
    return _scaled(image, stats, exact if strict else plain, [*by, "c"], ["v_min", "v_max"])


def z_score_roi(image: DataFrame, stats: DataFrame, by: Key = KEY, limit: float = 3.0) -> DataFrame:
    """z-scores clipped to +-limit and brought to 0..1; channels without a region stay as they are,
    then clipped and brought likewise."""
    z = F.when(F.col("n_roi") > 0, (F.col("v") - F.col("v_mean")) / (F.col("v_std") + EPSILON)).otherwise(F.col("v").cast("double"))
    value = clip((clip(z, -limit, limit) + limit) / (2 * limit), 0.0, 1.0)
    return _scaled(image, stats, value, [*by, "c"], ["n_roi", "v_mean", "v_std"])


def robust(image: DataFrame, by: Key = KEY, low: float = 1, high: float = 99, per_channel: bool = True) -> DataFrame:
    """clip((v - p_low) / (p_high - p_low + eps), 0, 1), by channel or over all channels."""
    on = (*by, "c") if per_channel else by
    limits = percentiles(image, {"_lo": low, "_hi": high}, by=on)
    value = clip((F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + EPSILON), 0.0, 1.0)
    return _scaled(image, limits, value, [*on], ["_lo", "_hi"])


def min_max(gray: DataFrame, by: Key = KEY) -> DataFrame:
    limits = gray.groupBy(*by).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    return _scaled(gray, limits, (F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + EPSILON), [*by], ["_lo", "_hi"])


def by_max(px: DataFrame, by: Key = KEY, guarded: bool = False) -> DataFrame:
    """v / (max + eps); guarded: v / max, and unchanged where the max is not positive."""
    top = px.groupBy(*by).agg(F.max("v").alias("_hi"))
    safe = F.when(F.col("_hi") > 0, F.col("v") / F.when(F.col("_hi") > 0, F.col("_hi"))).otherwise(F.col("v"))
    return _scaled(px, top, safe if guarded else F.col("v") / (F.col("_hi") + EPSILON), [*by], ["_hi"])


def above_percentile(px: DataFrame, mask: DataFrame, p: float, strict: bool, by: Key = KEY) -> DataFrame:
    """Pixels of px in the mask at or (strict) above the percentile of its values there."""
    inside = within(px, mask, by)
    limit = percentiles(inside, {"_t": p}, by=by)
    cond = F.col("v") > F.col("_t") if strict else F.col("v") >= F.col("_t")
    return inside.join(limit, [*by]).filter(cond).drop("_t")
