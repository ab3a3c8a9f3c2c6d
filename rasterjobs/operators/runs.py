"""Algebra of masks as row runs (by, y, x0, x1 inclusive), without a pixel.

``segments`` sweeps over the ends of several layers' runs in a row and cuts it where any layer begins or ends. Union,
intersection, difference and class maps are choices among the segments; sums of their lengths are pixel
counts. A row of a slice is the unit of work; a sweep takes many rows of a partition at once in numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ("subject", "z")
Key = tuple[str, ...]


def length() -> Column:
    return F.col("x1") - F.col("x0") + 1


Layer = DataFrame | tuple[DataFrame, Column]
#: Runs of whole groups that a task takes at once.
HELD = 1 << 16


def changes(columns: list[pa.Array]) -> np.ndarray:
    """Numbers of groups of equal neighbours."""
    moved = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        code = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        moved |= np.diff(code) != 0
    return np.concatenate([[0], np.cumsum(moved)])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of batches in which equal values of the first ``keys`` columns follow each other, with the
    number of each row's group; about HELD rows at once, or a group."""
    held, rows, least = [], 0, HELD
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        group = changes([table.column(i).combine_chunks() for i in range(keys)])
        cut = int(np.searchsorted(group, group[-1]))  # the last group may go on in the next batch
        if cut:
            yield table.slice(0, cut), group[:cut]
        held, rows = table.slice(cut).to_batches(), table.num_rows - cut
        least = max(HELD, 2 * rows)
    if rows:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, changes([table.column(i).combine_chunks() for i in range(keys)])


def _swept(keys: int, layers: int, code: Callable[[np.ndarray], np.ndarray] | None):
    """Batches (keys, x0, x1, _held: a bit for each layer) sorted by the keys to segments (keys, x0, x1, _held). ``code``: what
    becomes of _held; segments of 0 go, and those of equal codes that touch are made one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, keys):
            x0, x1, held = (table.column(keys + i).to_numpy().astype(np.int64) for i in range(3))
            least = x0.min()
            wide = x1.max() - least + 3
            at = np.concatenate([x0, x1 + 1]) - least + wide * np.concatenate([group, group])
            order = np.argsort(at, kind="stable")
            at, inside = at[order], np.zeros(len(order), np.int64)
            for k in range(layers):
                bit = (held >> k) & 1
                inside |= (np.cumsum(np.concatenate([bit, -bit])[order]) > 0).astype(np.int64) << k
            inside = inside if code is None else code(inside)
            kept = np.flatnonzero((np.diff(at) > 0) & (inside[:-1] != 0))
            a, b, inside = at[kept], at[kept + 1], inside[kept]
            if code is not None and len(a):
                new = np.concatenate([[True], (a[1:] != b[:-1]) | (inside[1:] != inside[:-1])])
                a, b, inside = a[new], b[np.concatenate([new[1:], [True]])], inside[new]
            row = pa.array(np.searchsorted(group, a // wide))
            out = [table.column(i).combine_chunks().take(row) for i in range(keys)]
            out += [pa.array(v.astype(np.int32)) for v in (a % wide + least, b - 1 - a // wide * wide + least, inside)]
            yield pa.RecordBatch.from_arrays(out, [*table.schema.names[:keys], "x0", "x1", "_held"])

    return run


def _sweep(layers: dict[str, Layer], by: Key, code: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(by, y, x0, x1, _held): a run is one row, whatever the number of its layers."""
    tables: dict[int, tuple[DataFrame, dict[str, Column]]] = {}
    for name, layer in layers.items():
        df, cond = layer if isinstance(layer, tuple) else (layer, F.lit(True))
        tables.setdefault(id(df), (df, {}))[1][name] = cond
    place = {n: 1 << k for k, n in enumerate(layers)}
    bits = lambda held: reduce(Column.__add__, [F.when(c, place[n]).otherwise(0) for n, c in held.items()]).cast("int")
    events = reduce(DataFrame.unionByName, [df.select(*by, "y", "x0", "x1", bits(held).alias("_held")) for df, held in tables.values()])
    events = events.filter("_held <> 0 and x0 <= x1")
    names = [*by, "y"]
    fields = ", ".join(f"`{n}` {events.schema[n].dataType.simpleString()}" for n in names)
    dealt = events.repartition(*names).sortWithinPartitions(*names)
    return dealt.mapInArrow(_swept(len(names), len(layers), code), f"{fields}, x0 int, x1 int, _held int")


def segments(layers: dict[str, Layer], by: Key = KEY) -> DataFrame:
    """(by, y, x0, x1) and a boolean for each layer: the stretches of rows that some layer holds, cut where any
    changes. Runs of a layer may overlap, repeat and come in any order. A layer is a table of runs, or such a table
    and a condition on its rows; a table that serves several layers is read once."""
    inside = [(F.col("_held").bitwiseAND(1 << k) != 0).alias(n) for k, n in enumerate(layers)]
    return _sweep(layers, by).select(*by, "y", "x0", "x1", *inside)


def merged(runs: DataFrame, by: Key = KEY, same: Key = ()) -> DataFrame:
    """Runs of a row that touch or overlap made one, where the columns ``same`` are equal; (by, y, x0, x1, same).
    Runs of different ``same`` must not overlap."""
    row = Window.partitionBy(*by, "y").orderBy("x0", "x1")
    reach = F.max("x1").over(row.rowsBetween(Window.unboundedPreceding, -1))
    other = reduce(Column.__or__, [~F.lag(n).over(row).eqNullSafe(F.col(n)) for n in same], F.lit(False))
    marked = runs.select(*by, "y", "x0", "x1", *same, F.when(reach.isNull() | (F.col("x0") > reach + 1) | other, 1).otherwise(0).alias("_new"))
    numbered = marked.withColumn("_g", F.sum("_new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "y", "_g", *same).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).select(*by, "y", "x0", "x1", *same)


def sampled(runs: DataFrame, source: tuple[str, str], target: tuple[str, str], names: tuple[str, str, str] = ("y", "x0", "x1")) -> DataFrame:
    """Runs of frames brought to another size by nearest places, target i from the floor of i * source / target; sizes are
    columns (height, width), ``names`` the run's own. A run stays one: its ends are where the first and last such i lie.
    Rows are repeated or left out, runs that no place falls on go, and runs may come to touch (see merged)."""
    y, a, b = names
    first = lambda c, n, to: F.expr(f"cast((cast({c} as bigint) * {to} + {n} - 1) div {n} as int)")
    ends = runs.withColumns({
        "_ya": first(y, source[0], target[0]), "_yb": first(f"({y} + 1)", source[0], target[0]) - 1,
        a: first(a, source[1], target[1]), b: first(f"({b} + 1)", source[1], target[1]) - 1,
    })
    # a sequence would count down
    held = ends.filter(f"_ya <= _yb and {a} <= {b}")
    return held.withColumn(y, F.explode(F.sequence("_ya", "_yb"))).drop("_ya", "_yb")


def union(*masks: DataFrame, by: Key = KEY) -> DataFrame:
    return merged(reduce(DataFrame.unionByName, [m.select(*by, "y", "x0", "x1") for m in masks]), by)


def within(runs: DataFrame, mask: DataFrame, by: Key = KEY, key: Key = KEY) -> DataFrame:
    """What of merged runs (by) lies in a mask of merged runs (key, some or all of by): runs of a row meet."""
    other = mask.select(*key, "y", F.col("x0").alias("_a"), F.col("x1").alias("_b"))
    met = runs.select(*by, "y", "x0", "x1").join(other, [*key, "y"]).filter("x0 <= _b and _a <= x1")
    return met.select(*by, "y", F.greatest("x0", "_a").alias("x0"), F.least("x1", "_b").alias("x1"))


def intersection(a: DataFrame, b: DataFrame, by: Key = KEY) -> DataFrame:
    return merged(segments({"a": a, "b": b}, by).filter("a and b"), by)


def difference(a: DataFrame, b: DataFrame, by: Key = KEY) -> DataFrame:
    return merged(segments({"a": a, "b": b}, by).filter("a and not b"), by)


def class_of(names: tuple[str, ...] = ("light", "moderate", "dense")) -> Column:
    """The class of a segment of layers of these names: the last that holds it, from 1; null where none does."""
    return F.coalesce(*[F.when(F.col(n), F.lit(k)) for k, n in reversed(list(enumerate(names, 1)))])


def class_map(light: Layer, moderate: Layer, dense: Layer, by: Key = KEY, within: DataFrame | None = None) -> DataFrame:
    """(by, y, x0, x1, cls): class-coded runs of three masks that may overlap; dense goes before moderate before
    light. ``within``: only inside this mask."""
    layers = {"light": light, "moderate": moderate, "dense": dense} | ({} if within is None else {"inside": within})
    held = 0 if within is None else 8

    def code(bits: np.ndarray) -> np.ndarray:
        return np.where(bits & held == held, np.array([0, 1, 2, 2, 3, 3, 3, 3])[bits & 7], 0)

    return _sweep(layers, by, code).withColumnRenamed("_held", "cls")


def by_class(masks: DataFrame, names: tuple[str, ...] = ("light", "moderate", "dense")) -> dict[str, Layer]:
    """The layers of one table of runs with cls 1, 2, ..."""
    return {n: (masks, F.col("cls") == k) for k, n in enumerate(names, 1)}
