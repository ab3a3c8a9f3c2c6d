"""Images as tiles of bytes: neighbourhood operators that never make a row a pixel.

A tile row has the slice key, the frame's size (fh, fw), its place and size (y0, x0, h, w) and its values as doubles in C
order, packed (data; see kernels.packed). Tiles lie on a regular grid and cover the frame. A target tile needs a window of the source frame (its own
place with a halo, or what it is resampled from); each source tile sends the part of itself that lies in the window,
so neighbours get strips, and the parts meet by target tile. What lies outside the frame is mirrored. Maxima of a slice
are numbers of a small table that are joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels
from .components import _fields
from .graph import few, saved, wide
from .pixels import crop_of, downsampled_dims
from .runs import merged, sampled

KEY = ("subject", "z")
Key = tuple[str, ...]
TILE = 512
PLACE = ("fh", "fw", "y0", "x0", "h", "w")
_PLACE = ", ".join(f"{n} int" for n in PLACE)
#: Of an axis' size and target size: first and past the last place of each target tile, and of the window it needs.
Windows = Callable[[int, int], list[tuple[int, int, int, int]]]


#: Rows of a batch that are Python objects at once.
HELD = 8


def array_of(row: dict) -> np.ndarray:
    return planes_of(row)[0]


def planes_of(row: dict) -> np.ndarray:
    """All planes of a tile that has several, plane after plane, in its data."""
    return kernels.unpacked(row["data"]).reshape(-1, row["h"], row["w"])


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows as dicts, few at once; a list of runs stays an Arrow array, or None."""
    at = batch.schema.get_field_index("_runs")
    held = None if at < 0 else batch.column(at)
    plain = batch if at < 0 else batch.drop_columns(["_runs"])
    for first in range(0, batch.num_rows, HELD):
        for i, row in enumerate(plain.slice(first, HELD).to_pylist(), first):
            yield row if held is None else row | {"_runs": held[i].values if held[i].is_valid else None}


def _with_halo(halo: int, tile: int) -> Windows:
    return lambda n, _: [(a, min(n, a + tile), max(0, a - halo), min(n, a + tile + halo)) for a in range(0, n, tile)]


def _sampled(tile: int) -> Windows:
    """Windows of bilinear samples: half-pixel centres, clamped edges."""
    at = lambda i, n, to: int(np.floor((i + 0.5) * n / to - 0.5))
    return lambda n, to: [(a, b := min(to, a + tile), max(0, at(a, n, to)), min(n, at(b - 1, n, to) + 2)) for a in range(0, to, tile)]


def _gathered(tiles: DataFrame, windows: Windows, make: Callable, by: Key, fields: str, also: Key = (), runs: DataFrame | None = None) -> DataFrame:
    """Target tiles of frames of th x tw (columns of tiles) from the source windows that they need. make(place, window,
    window's y and x) gives the columns after the place; place also has the source frame's size (sh, sw) and the columns ``also``,
    which are the same for all tiles of a frame, and those of ``runs`` (see _by_tile) that cross the tile (_runs), or None."""
    keys, place = _fields(tiles, by), f"_ty int, _tx int, th int, tw int, {_PLACE}, {''.join(f'{_fields(tiles, (c,))}, ' for c in also)}data binary"
    schema, out_schema = _arrow(tiles, by, place), _arrow(tiles, by, f"{_PLACE}, {fields}")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                a, spans, out = array_of(row), [], []
                for n, to, at, size in ((row["fh"], row["th"], row["y0"], row["h"]), (row["fw"], row["tw"], row["x0"], row["w"])):
                    met = [(k, max(s, at), min(e, at + size)) for k, (_, _, s, e) in enumerate(windows(n, to))]
                    spans.append([m for m in met if m[1] < m[2]])
                for ty, ya, yb in spans[0]:
                    for tx, xa, xb in spans[1]:
                        part = a[ya - row["y0"] : yb - row["y0"], xa - row["x0"] : xb - row["x0"]]
                        out.append(row | {"_ty": ty, "_tx": tx, "y0": ya, "x0": xa, "h": yb - ya, "w": xb - xa, "data": kernels.packed(part)})
                yield from _batches(out, schema)

    def assemble(table: pa.Table, crossing: pa.Table | None = None) -> pa.Table:
        rows = table.to_pylist()
        if not rows:
            return out_schema.empty_table()
        one = rows[0]
        (ya, yb, sy, ey), (xa, xb, sx, ex) = windows(one["fh"], one["th"])[one["_ty"]], windows(one["fw"], one["tw"])[one["_tx"]]
        window = np.zeros((ey - sy, ex - sx))
        for r in rows:
            window[r["y0"] - sy : r["y0"] - sy + r["h"], r["x0"] - sx : r["x0"] - sx + r["w"]] = array_of(r)
        at = {"fh": one["th"], "fw": one["tw"], "y0": ya, "x0": xa, "h": yb - ya, "w": xb - xa}
        held = None if crossing is None or not crossing.num_rows else crossing.column("_runs").combine_chunks()[0].values
        made = make(at | {"sh": one["fh"], "sw": one["fw"], "_runs": held} | {c: one[c] for c in also}, window, sy, sx)
        return pa.Table.from_pylist([{**{n: one[n] for n in by}, **at, **made}], schema=out_schema)

    sent = tiles.select(*by, "th", "tw", *PLACE, *also, "data").mapInArrow(send, f"{keys}, {place}")
    target = sent.groupBy(*by, "_ty", "_tx")
    if runs is not None:
        return wide(target.cogroup(runs.groupBy(*by, "_ty", "_tx")).applyInArrow(lambda a, b: assemble(a, b), f"{keys}, {_PLACE}, {fields}"))
    return wide(target.applyInArrow(lambda a: assemble(a), f"{keys}, {_PLACE}, {fields}"))


def _arrow(df: DataFrame, by: Key, fields: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(f"{_fields(df, by)}, {fields}"))


def _batches(rows: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield from pa.Table.from_pylist(rows, schema=schema).to_batches()


def from_pixels(image: DataFrame, dims: DataFrame, by: Key = KEY, tile: int = TILE) -> DataFrame:
    """Tiles of pixel rows (by, y, x, v); absent pixels are 0, and every frame of dims is covered."""
    place = lambda c: F.expr(f"cast({c} div {tile} as int)")
    held = image.select(*by, place("y").alias("_ty"), place("x").alias("_tx"), F.struct("y", "x", F.col("v").cast("double").alias("v")).alias("_p"))
    held = held.groupBy(*by, "_ty", "_tx").agg(F.collect_list("_p").alias("_p"))
    every = dims.select(*by, F.col("h").alias("fh"), F.col("w").alias("fw"), F.explode(F.sequence(F.lit(0), F.expr(f"cast((h - 1) div {tile} as int)"))).alias("_ty"))
    every = every.withColumn("_tx", F.explode(F.sequence(F.lit(0), F.expr(f"cast((fw - 1) div {tile} as int)"))))
    rows = every.join(held, [*by, "_ty", "_tx"], "left")
    schema = _arrow(rows, by, f"{_PLACE}, data binary")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            px = batch.column(batch.schema.get_field_index("_p"))
            for i, row in enumerate(_rows(batch.drop_columns(["_p"]))):
                y0, x0 = row["_ty"] * tile, row["_tx"] * tile
                a = np.zeros((min(tile, row["fh"] - y0), min(tile, row["fw"] - x0)))
                if px[i].is_valid:
                    y, x, v = (px[i].values.field(n).to_numpy() for n in ("y", "x", "v"))
                    inside = (y < row["fh"]) & (x < row["fw"])
                    a[y[inside] - y0, x[inside] - x0] = v[inside]
                yield from _batches([{**{n: row[n] for n in by}, "fh": row["fh"], "fw": row["fw"], "y0": y0, "x0": x0, "h": a.shape[0], "w": a.shape[1], "data": kernels.packed(a)}], schema)

    return wide(rows.mapInArrow(build, f"{_fields(rows, by)}, {_PLACE}, data binary"))


def from_volume(tiles: DataFrame, dims: DataFrame, by: Key = KEY) -> DataFrame:
    """Tiles of a chunked volume (dense, one channel; see sources.volumes) as tiles of doubles; no pixel is a row."""
    sized = tiles.join(dims.select(*by, F.col("h").alias("fh"), F.col("w").alias("fw")), [*by]).select(*by, *PLACE, "dtype", "data")
    schema = _arrow(sized, by, f"{_PLACE}, data binary")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                row["data"] = kernels.packed(np.frombuffer(row["data"], row.pop("dtype")))
                yield from _batches([row], schema)

    return wide(sized.mapInArrow(build, f"{_fields(sized, by)}, {_PLACE}, data binary"))


def pixels(tiles: DataFrame, by: Key = KEY) -> DataFrame:
    """A row for each pixel (by, y, x, v)."""
    schema = _arrow(tiles, by, "y int, x int, v double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                y, x = np.mgrid[row["y0"] : row["y0"] + row["h"], row["x0"] : row["x0"] + row["w"]].reshape(2, -1).astype(np.int32)
                keys = [pa.array([row[n]] * len(y), schema.field(n).type) for n in by]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(y), pa.array(x), pa.array(array_of(row).ravel())], schema=schema)

    return wide(tiles.select(*by, *PLACE, "data").mapInArrow(run, f"{_fields(tiles, by)}, y int, x int, v double"))


def mapped(tiles: DataFrame, change: Callable[[np.ndarray, dict], np.ndarray], by: Key = KEY) -> DataFrame:
    """Each tile's values changed in place; change gets the values and the row (with any further columns)."""
    schema = _arrow(tiles, by, f"{_PLACE}, data binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                made = change(array_of(row), row)
                yield from _batches([{n: row[n] for n in (*by, *PLACE)} | {"data": kernels.packed(made)}], schema)

    return wide(tiles.mapInArrow(run, f"{_fields(tiles, by)}, {_PLACE}, data binary"))


def numbers(tiles: DataFrame, measure: Callable[[np.ndarray, dict], dict], fields: str, by: Key = KEY) -> DataFrame:
    """A row of numbers for each tile."""
    schema = _arrow(tiles, by, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches([{n: row[n] for n in by} | measure(array_of(row), row) for row in _rows(batch)], schema)

    return tiles.mapInArrow(run, f"{_fields(tiles, by)}, {fields}")


def by_max(tiles: DataFrame, by: Key = KEY, guarded: bool = False) -> DataFrame:
    """v / (the slice's maximum + eps); guarded: v / maximum, and unchanged where that is not positive."""
    from .stats import EPSILON

    top = saved(numbers(tiles, lambda a, _: {"_hi": float(a.max())}, "_hi double", by).groupBy(*by).agg(F.max("_hi").alias("_hi")))

    def scale(a: np.ndarray, row: dict) -> np.ndarray:
        if guarded:
            return a / row["_hi"] if row["_hi"] > 0 else a
        return a / (row["_hi"] + EPSILON)

    return mapped(tiles.join(few(top), [*by]), scale, by)


def min_max(tiles: DataFrame, by: Key = KEY) -> DataFrame:
    """(v - min) / (max - min + eps) of a slice."""
    from .stats import EPSILON

    ends = numbers(tiles, lambda a, _: {"_lo": float(a.min()), "_hi": float(a.max())}, "_lo double, _hi double", by)
    ends = saved(ends.groupBy(*by).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")))
    return mapped(tiles.join(few(ends), [*by]), lambda a, row: (a - row["_lo"]) / (row["_hi"] - row["_lo"] + EPSILON), by)


def split(tiles: DataFrame, by: Key = KEY, name: str = "c") -> DataFrame:
    """Tiles of several planes as tiles of one, numbered from 0."""
    schema = _arrow(tiles, by, f"{name} int, {_PLACE}, data binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                yield from _batches([row | {name: c, "data": kernels.packed(a)} for c, a in enumerate(planes_of(row))], schema)

    return wide(tiles.select(*by, *PLACE, "data").mapInArrow(run, f"{_fields(tiles, by)}, {name} int, {_PLACE}, data binary"))


def joined(channels: DataFrame, by: Key = KEY, name: str = "c") -> DataFrame:
    """Tiles of one plane (by, name) as tiles of all, in the order of the name."""
    held = channels.groupBy(*by, *PLACE).agg(F.sort_array(F.collect_list(F.struct(name, "data"))).alias("_p"))
    data = F.aggregate("_p", F.lit(b""), lambda a, p: F.concat(a, p["data"]))
    return wide(held.select(*by, *PLACE, data.alias("data")))


def inside(tiles: DataFrame, runs: DataFrame, name: str, by: Key = KEY, tile: int = TILE) -> DataFrame:
    """(by, name, y, x, v): the values in each mask of a slice, of runs (by, name, y, x0, x1)."""
    placed = tiles.withColumn("_ty", F.expr(f"cast(y0 div {tile} as int)")).withColumn("_tx", F.expr(f"cast(x0 div {tile} as int)"))
    rows = placed.join(_by_tile(runs.withColumnRenamed(name, "cls"), ("y", "x0", "x1", "cls"), by, tile), [*by, "_ty", "_tx"]).drop("_ty", "_tx")
    fields = f"`{name}` {runs.schema[name].dataType.simpleString()}, y int, x int, v double"
    schema = _arrow(tiles, by, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                a = array_of(row)
                for k in np.unique(row["_runs"].field("cls").to_numpy(zero_copy_only=False)):
                    y, x = np.nonzero(_inside(row, k))
                    keys = [pa.repeat(pa.scalar(v, schema.field(n).type), len(y)) for n, v in [*((n, row[n]) for n in by), (name, k.item())]]
                    places = [pa.array((i + row[n]).astype(np.int32)) for i, n in ((y, "y0"), (x, "x0"))]
                    yield pa.RecordBatch.from_arrays([*keys, *places, pa.array(a[y, x])], schema=schema)

    return wide(rows.mapInArrow(run, f"{_fields(tiles, by)}, {fields}"))


def whole_bytes(tiles: DataFrame, change: Callable[[np.ndarray], np.ndarray], by: Key = KEY) -> DataFrame:
    """(by, h, w, data): whole frames of tiles of planes, changed to 0..255 and bytes with the planes last, for what needs a slice at once."""
    fields = "h int, w int, data binary"
    schema = _arrow(tiles, by, fields)

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                data = kernels.squeezed(np.moveaxis(change(planes_of(row)), 0, 2).astype(np.uint8).tobytes())
                yield from _batches([{n: row[n] for n in (*by, *PLACE)} | {"data": data}], part_schema)

    def assemble(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [np.frombuffer(kernels.unsqueezed(r["data"]), np.uint8).reshape(r["h"], r["w"], -1) for r in rows]
        a = np.zeros((rows[0]["fh"], rows[0]["fw"], parts[0].shape[2]), np.uint8)
        for r, part in zip(rows, parts, strict=True):
            a[r["y0"] : r["y0"] + r["h"], r["x0"] : r["x0"] + r["w"]] = part
        return pa.Table.from_pylist([{n: rows[0][n] for n in by} | {"h": a.shape[0], "w": a.shape[1], "data": a.tobytes()}], schema=schema)

    part_schema = _arrow(tiles, by, f"{_PLACE}, data binary")
    sent = tiles.select(*by, *PLACE, "data").mapInArrow(small, f"{_fields(tiles, by)}, {_PLACE}, data binary")
    return wide(sent.groupBy(*by).applyInArrow(assemble, f"{_fields(tiles, by)}, {fields}"))


def counted(tiles: DataFrame, by: Key = KEY) -> DataFrame:
    """(by, v, _n): the values of each tile (where it has _runs, those inside) and how often they occur, a row for each."""
    schema = _arrow(tiles, by, "v double, _n bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                v, n = np.unique(array_of(row)[_inside(row)] if "_runs" in row else array_of(row), return_counts=True)
                keys = [pa.array([row[k]] * len(v), schema.field(k).type) for k in by]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(v), pa.array(n.astype(np.int64))], schema=schema)

    held = [c for c in ("_runs",) if c in tiles.columns]
    return wide(tiles.select(*by, *PLACE, "data", *held).mapInArrow(run, f"{_fields(tiles, by)}, v double, _n bigint"))


#: Values of a tile that tell the others where its ranks lie.
MARKS = 64


def percentiles(tiles: DataFrame, ps: dict[str, float], by: Key = KEY, gathered: int | None = None, marks: int = MARKS) -> DataFrame:
    """As stats.percentiles, of the values of tiles (where they have _runs, those inside), without a row for each value.

    A tile tells some of its values and how many lie below each. Between which values a rank lies follows for a slice from those of
    its tiles; then tiles send what lies between these, and the result is exact. Where more than ``gathered`` values may be
    left of a rank, tiles are asked again between them."""
    from . import stats

    gathered = stats.GATHERED if gathered is None else gathered
    held = tiles.select(*by, *PLACE, "data", *[c for c in ("_runs",) if c in tiles.columns])
    told = "_rank bigint, _total bigint, _below bigint, _n bigint, _v binary, _lt binary"
    between = "_rank bigint, _total bigint, _lo double, _hi double, _left bigint"
    sent, out = _arrow(held, by, told), _arrow(held, by, between)

    def values(row: dict) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values, and how many lie below each; the number of all at its end."""
        a = array_of(row)
        v, n = np.unique(a[_inside(row)] if "_runs" in row else a, return_counts=True)
        return v, np.concatenate([[0], np.cumsum(n)])

    def tell(whole: bool):
        """Values of each tile, or marks among them, between the ends of each rank; at first there are no ends."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in _rows(batch):
                    v, lt = values(row)
                    rows = []
                    for r in row.get("_ends") or ([] if "_ends" in row else [{"_rank": -1, "_total": -1, "_lo": None, "_hi": None}]) if len(v) else []:
                        a, b = (0, len(v)) if r["_lo"] is None else (int(np.searchsorted(v, r["_lo"], "left")), int(np.searchsorted(v, r["_hi"], "right")))
                        at = np.arange(a, b) if whole or b - a <= marks else np.unique(np.linspace(a, b - 1, marks).astype(np.int64))
                        below = int(lt[a])
                        lower = np.append(lt[at], lt[b]) - below
                        rows.append({n: row[n] for n in by} | {"_rank": r["_rank"], "_total": r["_total"], "_below": below, "_n": int(lt[-1]),
                                    "_v": v[at].tobytes(), "_lt": np.concatenate([lower, np.append(lt[at + 1] - below, 0), [b - a]]).tobytes()})
                    yield from _batches(rows, sent)

        return run

    def of(parts: list[dict]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """Of each tile its values, how many of those asked for lie below each and not above it, and all distinct ones."""
        got = []
        for r in parts:
            v, lt = np.frombuffer(r["_v"], np.float64), np.frombuffer(r["_lt"], np.int64)
            got.append((v, lt[: len(v) + 1], lt[len(v) + 1 : 2 * len(v) + 1], int(lt[-1])))
        return got

    def ranks(n: int) -> list[int]:
        at = [(n - 1) * (p / 100) for p in ps.values()]
        return sorted({int(f(i)) for i in at for f in (np.floor, np.ceil)})

    def narrow(table: pa.Table) -> pa.Table:
        parts = table.to_pylist()
        marked, rows = of(parts), []
        first = parts[0]["_rank"] < 0
        total = sum(r["_n"] for r in parts) if first else parts[0]["_total"]
        below = 0 if first else sum(r["_below"] for r in parts)
        every = np.unique(np.concatenate([v for v, _, _, _ in marked]))
        # surely as many are at or below a value; no more than so many are below it
        least, most = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
        for v, lt, le, _ in marked:
            least += np.concatenate([[0], le])[np.searchsorted(v, every, "right")]
            most += lt[np.searchsorted(v, every, "left")]
        for rank in ranks(total) if first else [parts[0]["_rank"]]:
            lo, hi = every[np.flatnonzero(most <= rank - below)[-1]], every[np.flatnonzero(least >= rank - below + 1)[0]]
            left = 0
            for v, _, _, n in marked:
                a, b = np.searchsorted(v, lo, "left"), np.searchsorted(v, hi, "right")
                left += n if len(v) == 0 else int(np.ceil((b - a + 1) * n / len(v)))
            rows.append({n: parts[0][n] for n in by} | {"_rank": rank, "_total": total, "_lo": float(lo), "_hi": float(hi), "_left": left})
        return pa.Table.from_pylist(rows, schema=out)

    def joined_to(ends: DataFrame) -> DataFrame:
        return held.join(few(ends.groupBy(*by).agg(F.collect_list(F.struct("_rank", "_total", "_lo", "_hi")).alias("_ends"))), [*by])

    def pick(table: pa.Table) -> pa.Table:
        parts, at = table.to_pylist(), {}
        total = parts[0]["_total"]
        for rank in {r["_rank"] for r in parts}:
            mine = [r for r in parts if r["_rank"] == rank]
            marked, below = of(mine), sum(r["_below"] for r in mine)
            v = np.concatenate([v for v, _, _, _ in marked])
            n = np.concatenate([le - lt[:-1] for _, lt, le, _ in marked])
            order = np.argsort(v, kind="stable")
            at[rank] = float(v[order][np.searchsorted(np.cumsum(n[order]), rank - below, "right")])
        row = {n: parts[0][n] for n in by}
        for name, p in ps.items():
            i = (total - 1) * (p / 100)
            low, high = int(np.floor(i)), int(np.ceil(i))
            a, b = at[low], at[high]
            row[name] = a if low == high or a == b else (high - i) * a + (i - low) * b
        return pa.Table.from_pylist([row], schema=result)

    fields = ", ".join(f"`{n}` double" for n in ps)
    result, keys, key = _arrow(held, by, fields), _fields(held, by), (*by, "_rank")
    ends = saved(held.mapInArrow(tell(False), f"{keys}, {told}").groupBy(*key).applyInArrow(narrow, f"{keys}, {between}"))
    for _ in range(8):
        if (ends.agg(F.max("_left")).first()[0] or 0) <= gathered:
            break
        ends = saved(joined_to(ends).mapInArrow(tell(False), f"{keys}, {told}").groupBy(*key).applyInArrow(narrow, f"{keys}, {between}"))
    return joined_to(ends).mapInArrow(tell(True), f"{keys}, {told}").groupBy(*by).applyInArrow(pick, f"{keys}, {fields}")


def above_percentile(tiles: DataFrame, p: float, strict: bool, by: Key = KEY, runs: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """Pixels (by, y, x) at or (strict) above the percentile of a slice's values, inside the runs only where they are given."""
    held = tiles if runs is None else saved(_only_inside(tiles, runs, by, tile))
    del tiles
    rows = held.join(few(saved(percentiles(held, {"_t": p}, by))), [*by])
    schema = _arrow(held, by, "y int, x int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                a = array_of(row)
                high = a > row["_t"] if strict else a >= row["_t"]
                y, x = (i.astype(np.int32) for i in np.nonzero(high & _inside(row) if "_runs" in row else high))
                keys = [pa.array([row[n]] * len(y), schema.field(n).type) for n in by]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(y + row["y0"], pa.int32()), pa.array(x + row["x0"], pa.int32())], schema=schema)

    return wide(rows.mapInArrow(run, f"{_fields(held, by)}, y int, x int"))


def runs_where(tiles: DataFrame, test: Callable[[np.ndarray, dict], np.ndarray], by: Key = KEY) -> DataFrame:
    """Runs (by, y, x0, x1) of the places of each tile that pass a test of its values and row; runs that touch across a border
    of tiles stay two (see runs.merged)."""
    schema = _arrow(tiles, by, "y int, x0 int, x1 int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                _, y, x0, x1 = kernels.runs_of(test(array_of(row), row)[None])
                keys = [pa.repeat(pa.scalar(row[n], schema.field(n).type), len(y)) for n in by]
                places = [pa.array((i + row[n]).astype(np.int32)) for i, n in ((y, "y0"), (x0, "x0"), (x1, "x0"))]
                yield pa.RecordBatch.from_arrays([*keys, *places], schema=schema)

    return wide(tiles.mapInArrow(run, f"{_fields(tiles, by)}, y int, x0 int, x1 int"))


def above_percentile_runs(tiles: DataFrame, p: float, strict: bool, by: Key = KEY, runs: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """As above_percentile, as merged runs."""
    held = tiles if runs is None else saved(_only_inside(tiles, runs, by, tile))
    del tiles
    rows = held.join(few(saved(percentiles(held, {"_t": p}, by))), [*by])

    def high(a: np.ndarray, row: dict) -> np.ndarray:
        above = a > row["_t"] if strict else a >= row["_t"]
        return above & _inside(row) if "_runs" in row else above

    return merged(runs_where(rows, high, by), by)


def _only_inside(tiles: DataFrame, runs: DataFrame, by: Key, tile: int) -> DataFrame:
    """Tiles that runs cross, with _runs; values outside these are 0, which packs to nothing."""
    rows = _with_runs(tiles, runs, by, tile).filter(F.col("_runs").isNotNull()).select(*by, *PLACE, "_runs", "data")
    held = "_runs array<struct<y:int,x0:int,x1:int>>"
    schema = _arrow(rows, by, f"{_PLACE}, {held}, data binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [kernels.packed(np.where(_inside(row), array_of(row), 0.0)) for row in _rows(batch)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in schema.names[:-1]], pa.array(data, pa.binary())], names=schema.names)

    return wide(rows.mapInArrow(run, f"{_fields(tiles, by)}, {_PLACE}, {held}, data binary"))


def cut(tiles: DataFrame, patches: DataFrame, change: Callable[[np.ndarray], np.ndarray], dtype: type, by: Key = KEY, tile: int = TILE) -> DataFrame:
    """(by, patch_id, y0, x0, h, w, data): what ``change`` makes of the planes of tiles, as numbers of a type, cut to patches (by,
    patch_id, y0, y1, x0, x1), planes last; further columns of patches stay. A tile is changed once and sends each patch its part; a
    task holds a patch at once."""
    extra = [c for c in patches.columns if c not in (*by, "patch_id", "y0", "y1", "x0", "x1")]
    more = "".join(f", `{c}` {patches.schema[c].dataType.simpleString()}" for c in extra)
    cover = lambda a, b: F.explode(F.expr(f"sequence(cast({a} div {tile} as int), cast(({b} - 1) div {tile} as int))"))
    box = F.struct("patch_id", *[F.col(n).alias(f"p{n}") for n in ("y0", "y1", "x0", "x1")], *extra)
    asked = patches.select(*by, "patch_id", "y0", "y1", "x0", "x1", *extra, cover("y0", "y1").alias("_ty")).withColumn("_tx", cover("x0", "x1"))
    asked = asked.groupBy(*by, "_ty", "_tx").agg(F.collect_list(box).alias("_patches"))
    placed = tiles.withColumn("_ty", F.expr(f"cast(y0 div {tile} as int)")).withColumn("_tx", F.expr(f"cast(x0 div {tile} as int)"))
    rows, key = placed.select(*by, *PLACE, "_ty", "_tx", "data").join(asked, [*by, "_ty", "_tx"]), (*by, "patch_id")
    parts = f"py0 int, py1 int, px0 int, px1 int, y0 int, x0 int, h int, w int, data binary{more}"
    fields = f"{_fields(patches, key)}, {parts}"
    part_schema, schema = _arrow(patches, key, parts), _arrow(patches, key, f"y0 int, x0 int, h int, w int, data binary{more}")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                a, out = np.moveaxis(change(planes_of(row)).astype(dtype), 0, 2), []
                for p in row["_patches"]:
                    ya, yb = max(row["y0"], p["py0"]), min(row["y0"] + row["h"], p["py1"])
                    xa, xb = max(row["x0"], p["px0"]), min(row["x0"] + row["w"], p["px1"])
                    part = np.ascontiguousarray(a[ya - row["y0"] : yb - row["y0"], xa - row["x0"] : xb - row["x0"]])
                    out.append({n: row[n] for n in by} | p | {"y0": ya, "x0": xa, "h": yb - ya, "w": xb - xa, "data": kernels.squeezed(part.tobytes())})
                yield from _batches(out, part_schema)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, a = None, None
        told = lambda: _batches([{n: now[n] for n in key} | {"y0": now["py0"], "x0": now["px0"], "h": a.shape[0], "w": a.shape[1], "data": a.tobytes()} | {c: now[c] for c in extra}], schema)
        for batch in batches:
            for row in _rows(batch):
                part = np.frombuffer(kernels.unsqueezed(row["data"]), dtype).reshape(row["h"], row["w"], -1)
                if now is None or any(now[n] != row[n] for n in key):
                    if now is not None:
                        yield from told()
                    now, a = row, np.zeros((row["py1"] - row["py0"], row["px1"] - row["px0"], part.shape[2]), dtype)
                y, x = row["y0"] - row["py0"], row["x0"] - row["px0"]
                a[y : y + row["h"], x : x + row["w"]] = part
        if now is not None:
            yield from told()

    sent = rows.mapInArrow(send, fields).repartition(*key).sortWithinPartitions(*key)
    return wide(sent.mapInArrow(assemble, f"{_fields(patches, key)}, y0 int, x0 int, h int, w int, data binary{more}"))


def by_plane(tiles: DataFrame, known: DataFrame, change: Callable[[np.ndarray, dict], np.ndarray], by: Key = KEY, name: str = "c") -> DataFrame:
    """Tiles of several planes, each changed by its own row of a small table of numbers (by, name, ...)."""
    each = saved(known.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(name, *[c for c in known.columns if c not in (*by, name)]))).alias("_k")))
    return mapped(tiles.join(few(each), [*by]), lambda _, row: np.stack([change(a, k) for a, k in zip(planes_of(row), row["_k"], strict=True)]), by)


def robust(tiles: DataFrame, by: Key = KEY, on: Key = KEY, low: float = 1, high: float = 99) -> DataFrame:
    """clip((v - p_low) / (p_high - p_low + eps), 0, 1) with the percentiles of each ``on``, some or all of by."""
    from .stats import EPSILON

    limits = saved(percentiles(tiles, {"_lo": low, "_hi": high}, on))
    return mapped(tiles.join(few(limits), [*on]), lambda a, row: np.clip((a - row["_lo"]) / (row["_hi"] - row["_lo"] + EPSILON), 0, 1), by)


def roi_stats(tiles: DataFrame, runs: DataFrame, by: Key = KEY, key: Key = KEY, tile: int = TILE) -> DataFrame:
    """As stats.roi_stats (by, n_roi, v_min, v_max, v_mean, v_std), of a region's runs (key, y, x0, x1)."""
    names = ("n", "lo", "hi", "mean", "m2")

    def of(v: np.ndarray) -> tuple:
        return (v.size, float(v.min()), float(v.max()), float(v.mean()), float(((v - v.mean()) ** 2).sum())) if v.size else (0, None, None, None, None)

    def measure(a: np.ndarray, row: dict) -> dict:
        return dict(zip([f"{p}_{n}" for p in "rw" for n in names], of(a[_inside(row)]) + of(a.ravel()), strict=True))

    fields = ", ".join(f"{p}_{n} {'bigint' if n == 'n' else 'double'}" for p in "rw" for n in names)
    found = numbers(_with_runs(tiles, runs, key, tile), measure, fields, by)
    group = Window.partitionBy(*by)
    for p in "rw":
        found = found.withColumn(f"_{p}", F.sum(F.col(f"{p}_n") * F.col(f"{p}_mean")).over(group) / F.nullif(F.sum(f"{p}_n").over(group), F.lit(0)))
    off = lambda p: F.col(f"{p}_m2") + F.col(f"{p}_n") * F.pow(F.col(f"{p}_mean") - F.col(f"_{p}"), 2)
    sums = found.groupBy(*by).agg(
        F.sum("r_n").alias("n_roi"), *[f(f"{p}_{n}").alias(f"_{p}{n}") for p in "rw" for n, f in (("lo", F.min), ("hi", F.max))],
        *[F.first(f"_{p}").alias(f"_{p}mean") for p in "rw"], *[F.sqrt(F.sum(off(p)) / F.nullif(F.sum(f"{p}_n"), F.lit(0))).alias(f"_{p}std") for p in "rw"],
    )
    pick = lambda a, b: F.coalesce(F.col(f"_r{a}"), F.col(f"_w{a}")).alias(b)
    return sums.select(*by, "n_roi", pick("lo", "v_min"), pick("hi", "v_max"), pick("mean", "v_mean"), pick("std", "v_std"))


def between_extremes(a: np.ndarray, known: dict, strict: bool = False) -> np.ndarray:
    """(v - min) / (max - min + eps); strict: no eps, and what is flat is 0."""
    from .stats import EPSILON

    span = known["v_max"] - known["v_min"]
    if strict:
        return (a - known["v_min"]) / span if span > 0 else np.zeros_like(a)
    return (a - known["v_min"]) / (span + EPSILON)


def z_scored(a: np.ndarray, known: dict, limit: float = 3.0) -> np.ndarray:
    """z-scores clipped to +-limit and brought to 0..1; without a region only clipped and brought."""
    from .stats import EPSILON

    z = (a - known["v_mean"]) / (known["v_std"] + EPSILON) if known["n_roi"] > 0 else a
    return np.clip((np.clip(z, -limit, limit) + limit) / (2 * limit), 0, 1)


def min_max_roi(tiles: DataFrame, known: DataFrame, by: Key = KEY) -> DataFrame:
    """(v - min) / (max - min + eps) with the region's extremes (see roi_stats)."""
    return mapped(tiles.join(known.select(*by, "v_min", "v_max"), [*by]), between_extremes, by)


def z_score_roi(tiles: DataFrame, known: DataFrame, by: Key = KEY, limit: float = 3.0) -> DataFrame:
    """As stats.z_score_roi."""
    return mapped(tiles.join(known.select(*by, "n_roi", "v_mean", "v_std"), [*by]), lambda a, row: z_scored(a, row, limit), by)


def tight_crop_bounds(tiles: DataFrame, dims: DataFrame, by: Key = KEY) -> DataFrame:
    """As pixels.tight_crop_bounds; tiles may have several planes."""

    def ends(_: np.ndarray, row: dict) -> dict:
        held = (planes_of(row) > 0).any(axis=0)
        ys, xs = (np.flatnonzero(held.any(axis=k)) for k in (1, 0))
        if not len(ys):
            return dict.fromkeys(("_ya", "_yb", "_xa", "_xb"))
        return {n: int(i) for n, i in (("_ya", row["y0"] + ys[0]), ("_yb", row["y0"] + ys[-1]), ("_xa", row["x0"] + xs[0]), ("_xb", row["x0"] + xs[-1]))}

    return crop_of(numbers(tiles, ends, "_ya int, _yb int, _xa int, _xb int", by), dims, by)


def _padded(place: dict, window: np.ndarray, sy: int, sx: int, halo: int) -> np.ndarray:
    """The tile's place with its halo on all sides, mirrored at the frame's edges."""
    y = kernels.reflect(np.arange(place["y0"] - halo, place["y0"] + place["h"] + halo), place["sh"]) - sy
    x = kernels.reflect(np.arange(place["x0"] - halo, place["x0"] + place["w"] + halo), place["sw"]) - sx
    return window[y[:, None], x[None, :]]


def _same_size(tiles: DataFrame) -> DataFrame:
    return tiles.withColumn("th", F.col("fh")).withColumn("tw", F.col("fw"))


def stencil(tiles: DataFrame, halo: int, kernel: Callable[[np.ndarray], np.ndarray], by: Key = KEY, tile: int = TILE) -> DataFrame:
    """Tiles by a kernel that uses up a margin of ``halo`` on all sides."""
    make = lambda place, window, sy, sx: {"data": kernels.packed(kernel(_padded(place, window, sy, sx, halo)))}
    return _gathered(_same_size(tiles), _with_halo(halo, tile), make, by, "data binary")


def resampled(tiles: DataFrame, target: DataFrame, by: Key = KEY, tile: int = TILE) -> DataFrame:
    """Bilinear samples at the target's (by, h, w): half-pixel centres, clamped edges."""

    def sample(n: int, to: int, a: int, b: int, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(a, b) + 0.5) * n / to - 0.5
        low = np.floor(at)
        clamp = lambda i: np.clip(i, 0, n - 1).astype(int) - start
        return clamp(low), clamp(low + 1), at - low

    def make(place: dict, window: np.ndarray, sy: int, sx: int) -> dict:
        lo, hi, k = sample(place["sh"], place["fh"], place["y0"], place["y0"] + place["h"], sy)
        tall = window[lo] * (1 - k)[:, None] + window[hi] * k[:, None]
        lo, hi, k = sample(place["sw"], place["fw"], place["x0"], place["x0"] + place["w"], sx)
        return {"data": kernels.packed(tall[:, lo] * (1 - k) + tall[:, hi] * k)}

    sized = tiles.join(target.select(*by, F.col("h").alias("th"), F.col("w").alias("tw")), [*by])
    return _gathered(sized, _sampled(tile), make, by, "data binary")


def gaussian(tiles: DataFrame, sigma: float, by: Key = KEY, tile: int = TILE) -> DataFrame:
    """Blur with weights cut at 4 sigma and mirrored edges."""
    weights = kernels.gaussian_weights(sigma)
    return stencil(tiles, len(weights) // 2, lambda a: kernels.correlate(kernels.correlate(a, weights, 0), weights, 1), by, tile)


def sobel(tiles: DataFrame, by: Key = KEY, tile: int = TILE) -> DataFrame:
    """Edge magnitude: sqrt((gy^2 + gx^2) / 2), [1 2 1] / 4 across and [1 0 -1] / 2 along."""
    return stencil(tiles, 1, kernels.edges, by, tile)


def masked(tiles: DataFrame, runs: DataFrame, by: Key = KEY, tile: int = TILE, rest: float = 0.0) -> DataFrame:
    """Values outside the runs (by, y, x0, x1) are ``rest``. Runs are sent to the tiles that they cross."""
    return mapped(_with_runs(tiles, runs, by, tile), lambda a, row: np.where(_inside(row), a, rest), by)


def _with_runs(tiles: DataFrame, runs: DataFrame, key: Key, tile: int) -> DataFrame:
    placed = tiles.withColumn("_ty", F.expr(f"cast(y0 div {tile} as int)")).withColumn("_tx", F.expr(f"cast(x0 div {tile} as int)"))
    return placed.join(_by_tile(runs, ("y", "x0", "x1"), key, tile), [*key, "_ty", "_tx"], "left")


def _inside(row: dict, cls: int | None = None) -> np.ndarray:
    """Which places of a tile its runs, or those of a class, hold. Runs may overlap."""
    wide = row["w"] + 1
    if row["_runs"] is None:
        return np.zeros((row["h"], row["w"]), bool)
    y, x0, x1 = (row["_runs"].field(n).to_numpy(zero_copy_only=False) for n in ("y", "x0", "x1"))
    if cls is not None:
        y, x0, x1 = (n[row["_runs"].field("cls").to_numpy(zero_copy_only=False) == cls] for n in (y, x0, x1))
    line = (y - row["y0"]).astype(np.int64) * wide
    starts = np.bincount(line + np.maximum(x0 - row["x0"], 0), minlength=row["h"] * wide)
    ends = np.bincount(line + np.minimum(x1 - row["x0"] + 1, row["w"]), minlength=row["h"] * wide)
    return np.cumsum((starts - ends).reshape(row["h"], wide), axis=1)[:, :-1] > 0


def places(dims: DataFrame, by: Key = KEY, tile: int = TILE) -> DataFrame:
    """(by, PLACE): the tiles of frames (by, h, w)."""
    corner = lambda n: F.explode(F.sequence(F.lit(0), F.expr(f"cast(({n} - 1) div {tile} * {tile} as int)"), F.lit(tile)))
    at = dims.select(*by, F.col("h").cast("int").alias("fh"), F.col("w").cast("int").alias("fw")).withColumn("y0", corner("fh")).withColumn("x0", corner("fw"))
    return wide(at.withColumn("h", F.least(F.lit(tile), F.col("fh") - F.col("y0"))).withColumn("w", F.least(F.lit(tile), F.col("fw") - F.col("x0"))))


def classes(
    places: DataFrame, runs: DataFrame, by: Key = KEY, tile: int = TILE, change: Callable[[np.ndarray, dict], np.ndarray] | None = None, rest: float = 0.0
) -> DataFrame:
    """Tiles of the greatest class, or other number, of the runs (by, y, x0, x1, cls), which may overlap, at places (by, fh, fw, y0, x0,
    h, w and further columns, which stay); ``rest`` where no run is. ``change``: what is made of them, as in mapped; further columns go."""
    extra = [c for c in places.columns if c not in (*by, *PLACE)]
    placed = places.withColumn("_ty", F.expr(f"cast(y0 div {tile} as int)")).withColumn("_tx", F.expr(f"cast(x0 div {tile} as int)"))
    rows = placed.join(_by_tile(runs, ("y", "x0", "x1", "cls"), by, tile), [*by, "_ty", "_tx"], "left").drop("_ty", "_tx")
    fields = "".join(f"`{c}` {places.schema[c].dataType.simpleString()}, " for c in extra if change is None)
    schema = _arrow(rows, by, f"{_PLACE}, {fields}data binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                a = np.full((row["h"], row["w"]), rest)
                for k in () if row["_runs"] is None else np.unique(row["_runs"].field("cls").to_numpy(zero_copy_only=False)):
                    a[_inside(row, k)] = k
                made = a if change is None else change(a, row)
                yield from _batches([{n: row[n] for n in schema.names[:-1]} | {"data": kernels.packed(made)}], schema)

    return wide(rows.mapInArrow(run, f"{_fields(rows, by)}, {_PLACE}, {fields}data binary"))


def from_runs(runs: DataFrame, height: int, width: int, by: Key = KEY, tile: int = TILE) -> DataFrame:
    """Tiles of 0 and 1 that runs (by, y, x0, x1) cross, of frames that are all height x width; other tiles have no row.
    Keys may be null."""
    cut = runs.withColumn("_tx", F.explode(F.sequence(F.expr(f"cast(x0 div {tile} as int)"), F.expr(f"cast(x1 div {tile} as int)"))))
    held = cut.groupBy(*by, F.expr(f"cast(y div {tile} as int)").alias("_ty"), "_tx").agg(F.collect_list(F.struct("y", "x0", "x1")).alias("_runs"))
    schema = _arrow(held, by, f"{_PLACE}, data binary")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                y0, x0 = row["_ty"] * tile, row["_tx"] * tile
                a = np.zeros((min(tile, height - y0), min(tile, width - x0)))
                a[_inside({"y0": y0, "x0": x0, "h": a.shape[0], "w": a.shape[1], "_runs": row["_runs"]})] = 1
                yield from _batches([{n: row[n] for n in by} | {"fh": height, "fw": width, "y0": y0, "x0": x0, "h": a.shape[0], "w": a.shape[1], "data": kernels.packed(a)}], schema)

    return wide(held.mapInArrow(build, f"{_fields(held, by)}, {_PLACE}, data binary"))


def bits(runs: DataFrame, dims: DataFrame, by: Key = KEY, key: Key = KEY, tile: int = TILE) -> DataFrame:
    """(by, PLACE, bits): the tiles that a mask's runs (by, y, x0, x1) cross, a bit a pixel; runs may overlap. key: that of dims."""
    held = _by_tile(runs, ("y", "x0", "x1"), by, tile).join(dims.select(*key, F.col("h").alias("fh"), F.col("w").alias("fw")), [*key])
    schema = _arrow(held, by, f"{_PLACE}, bits binary")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                at = {"fh": row["fh"], "fw": row["fw"], "y0": row["_ty"] * tile, "x0": row["_tx"] * tile}
                at |= {"h": min(tile, row["fh"] - at["y0"]), "w": min(tile, row["fw"] - at["x0"])}
                held = np.packbits(_inside(at | {"_runs": row["_runs"]})).tobytes()
                yield from _batches([{n: row[n] for n in by} | at | {"bits": held}], schema)

    return wide(held.mapInArrow(build, f"{_fields(held, by)}, {_PLACE}, bits binary"))


def stacked(masks: DataFrame, by: Key, fields: tuple[str, ...]) -> DataFrame:
    """(by, PLACE, _masks): the bits of several masks at a place, with the fields that each has."""
    return masks.groupBy(*by, *PLACE).agg(F.sort_array(F.collect_list(F.struct(*fields, "bits"))).alias("_masks"))


def mask_of(held: dict, row: dict) -> np.ndarray:
    """Which places of a tile (row) one of its masks holds."""
    return np.unpackbits(np.frombuffer(held["bits"], np.uint8), count=row["h"] * row["w"]).reshape(row["h"], row["w"]).astype(bool)


def overlaid(stacks: DataFrame, join: Callable[[dict], np.ndarray], by: Key) -> DataFrame:
    """Tiles of doubles of what ``join`` makes of a stack's row."""
    schema = _arrow(stacks, by, f"{_PLACE}, data binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                yield from _batches([{n: row[n] for n in (*by, *PLACE)} | {"data": kernels.packed(join(row))}], schema)

    return wide(stacks.mapInArrow(run, f"{_fields(stacks, by)}, {_PLACE}, data binary"))


def overlaid_pixels(stacks: DataFrame, join: Callable[[dict], np.ndarray], by: Key, value: str | None = None) -> DataFrame:
    """(by, y, x, maybe value): a row for each place where what ``join`` makes of a stack's row is a number."""
    fields = "y int, x int" + (f", {value} double" if value else "")
    schema = _arrow(stacks, by, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                made = join(row)
                y, x = np.nonzero(~np.isnan(made))
                keys = [pa.repeat(pa.scalar(row[n], schema.field(n).type), len(y)) for n in by]
                out = [pa.array((y + row["y0"]).astype(np.int32)), pa.array((x + row["x0"]).astype(np.int32)), *([pa.array(made[y, x])] if value else [])]
                yield pa.RecordBatch.from_arrays([*keys, *out], schema=schema)

    return wide(stacks.mapInArrow(run, f"{_fields(stacks, by)}, {fields}"))


def greatest_score(row: dict) -> np.ndarray:
    """The greatest score of a stack's masks over a pixel; not a number where there is none."""
    top = np.full((row["h"], row["w"]), np.nan)
    for held in row["_masks"]:
        np.fmax(top, held["score"], out=top, where=mask_of(held, row))
    return top


def foreground(tiles: DataFrame, by: Key = KEY) -> DataFrame:
    """A row for each pixel that is not 0 (by, y, x)."""
    schema = _arrow(tiles, by, "y int, x int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                y, x = (i.astype(np.int32) for i in np.nonzero(array_of(row)))
                keys = [pa.array([row[n]] * len(y), schema.field(n).type) for n in by]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(y + row["y0"]), pa.array(x + row["x0"])], schema=schema)

    return wide(tiles.select(*by, *PLACE, "data").mapInArrow(run, f"{_fields(tiles, by)}, y int, x int"))


def thinned(tiles: DataFrame, by: Key = KEY, tile: int = TILE, passes: int = 32) -> DataFrame:
    """Zhang-Suen centre lines of tiles of 0 and 1; tiles without a row are 0, and those that become empty go.

    A pass sees a pixel's neighbours, so a halo of ``passes`` pixels keeps a tile right for that many: each round sends
    strips once, does so many passes in every tile, and is computed once; it ends with a round that changes nothing. Rounds
    grow with the masks' thickness, not with their extent, and no task holds more than a tile and its halo."""
    if passes < 2 or passes % 2:
        raise ValueError("passes must be even: a round begins with the first of two kinds of pass")

    def few_passes(place: dict, window: np.ndarray, sy: int, sx: int) -> dict:
        at = np.s_[place["y0"] - sy : place["y0"] - sy + place["h"], place["x0"] - sx : place["x0"] - sx + place["w"]]
        before, after = window[at], kernels.thin(window, passes)[at]
        return {"data": kernels.packed(after), "gone": int(before.sum() - after.sum()), "left": int(after.sum())}

    while True:
        found = saved(_gathered(_same_size(tiles), _with_halo(passes, tile), few_passes, by, "data binary, gone bigint, `left` bigint"))
        tiles = found.filter("`left` > 0").drop("gone", "left")
        if not found.agg(F.sum("gone")).first()[0]:
            return tiles


def _by_tile(runs: DataFrame, fields: tuple[str, ...], by: Key, tile: int) -> DataFrame:
    """(by, _ty, _tx, _runs): runs listed by the tiles that they cross."""
    band = F.expr(f"cast(y div {tile} as int)").alias("_ty")
    cut = runs.select(*by, band, *fields, F.explode(F.sequence(F.expr(f"cast(x0 div {tile} as int)"), F.expr(f"cast(x1 div {tile} as int)"))).alias("_tx"))
    return cut.groupBy(*by, "_ty", "_tx").agg(F.collect_list(F.struct(*fields)).alias("_runs"))


def combined(a: DataFrame, b: DataFrame, how: Callable[[np.ndarray, np.ndarray], np.ndarray], by: Key = KEY) -> DataFrame:
    """Two images on the same grid made one, tile by tile."""
    other = b.select(*by, "y0", "x0", F.col("data").alias("_other"))
    return mapped(a.join(other, [*by, "y0", "x0"]), lambda v, row: how(v, kernels.unpacked(row["_other"]).reshape(v.shape)), by)


def _important(sigma: float) -> tuple[int, Callable]:
    """A halo, and what makes the blurred values and the edges of a place of a window with it."""
    weights = kernels.gaussian_weights(sigma)
    halo = max(1, len(weights) // 2)

    def fields(place: dict, window: np.ndarray, sy: int, sx: int) -> tuple[np.ndarray, np.ndarray]:
        whole = _padded(place, window, sy, sx, halo)
        inner = lambda by: whole[halo - by : len(whole) - halo + by, halo - by : whole.shape[1] - halo + by]
        return kernels.correlate(kernels.correlate(inner(len(weights) // 2), weights, 0), weights, 1), kernels.edges(inner(1))

    return halo, fields


def importance(gray: DataFrame, make: Callable[[np.ndarray, dict], dict], columns: str, by: Key = KEY, sigma: float = 2, tile: int = TILE, runs: DataFrame | None = None) -> DataFrame:
    """What ``make`` gives (columns) of 0.4 of the blurred values and 0.6 of the edges of gray tiles, each divided by its frame's
    maximum; it also gets the place and the ``runs`` that cross it (see _by_tile). Maxima come from a first exchange of the gray values,
    and only these are sent again: neither field is kept."""
    halo, fields = _important(sigma)

    def tops(*at) -> dict:
        soft, edge = fields(*at)
        return {"soft": float(soft.max()), "edge": float(edge.max())}

    def of(place: dict, *at) -> dict:
        soft, edge = fields(place, *at)
        share = lambda a, top: a / top if top > 0 else a
        return make(0.4 * share(soft, place["_soft"]) + 0.6 * share(edge, place["_edge"]), place)

    found = _gathered(_same_size(gray), _with_halo(halo, tile), tops, by, "soft double, edge double")
    top = saved(found.groupBy(*by).agg(F.max("soft").alias("_soft"), F.max("edge").alias("_edge")))
    del found
    return _gathered(_same_size(gray.join(top, [*by])), _with_halo(halo, tile), of, by, columns, ("_soft", "_edge"), runs)


def important_inside(gray: DataFrame, runs: DataFrame, name: str, by: Key = KEY, tile: int = TILE) -> DataFrame:
    """(by, name, PLACE, data, _at, _wide): the importance of the places of each mask of a slice, of runs (by, name, y, x0, x1): a row a
    mask and tile, of one line (h = 1) that begins at the tile's y0 and x0. See places_where."""
    kind = runs.schema[name].dataType.simpleString()

    def make(a: np.ndarray, row: dict) -> dict:
        out = []
        for k in () if row["_runs"] is None else np.unique(row["_runs"].field("cls").to_numpy(zero_copy_only=False)):
            at = np.flatnonzero(_inside(row, k)).astype(np.int32)
            out.append({"k": k.item(), "n": len(at), "at": kernels.squeezed(np.diff(at, prepend=np.int32(0)).tobytes()), "v": kernels.packed(a.reshape(-1)[at])})
        return {"_of": out}

    crossing = _by_tile(runs.withColumnRenamed(name, "cls"), ("y", "x0", "x1", "cls"), by, tile)
    made = importance(gray, make, f"_of array<struct<k:{kind},n:int,at:binary,v:binary>>", by, tile=tile, runs=crossing)
    each = made.select(*by, *PLACE, F.explode("_of").alias("_m"))
    line = {"h": F.lit(1), "w": F.col("_m.n"), "data": F.col("_m.v"), "_at": F.col("_m.at"), "_wide": F.col("w")}
    return wide(each.select(*by, F.col("_m.k").alias(name), *[line.pop(c).alias(c) if c in line else F.col(c) for c in PLACE], *[c.alias(n) for n, c in line.items()]))


def places_where(lines: DataFrame, test: Callable[[np.ndarray, dict], np.ndarray], by: Key) -> DataFrame:
    """Pixels (by, y, x) of lines of important_inside whose values pass a test."""
    schema = _arrow(lines, by, "y int, x int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                at = np.cumsum(np.frombuffer(kernels.unsqueezed(row["_at"]), np.int32), dtype=np.int32)[test(array_of(row)[0], row)]
                keys = [pa.repeat(pa.scalar(row[n], schema.field(n).type), len(at)) for n in by]
                places = [pa.array((i + row[n]).astype(np.int32)) for i, n in ((at // row["_wide"], "y0"), (at % row["_wide"], "x0"))]
                yield pa.RecordBatch.from_arrays([*keys, *places], schema=schema)

    return wide(lines.mapInArrow(run, f"{_fields(lines, by)}, y int, x int"))


def ridges(tiles: DataFrame, sigmas: tuple[float, ...] = (1, 2, 4, 8), beta: float = 0.5, by: Key = KEY, tile: int = TILE) -> DataFrame:
    """Bright ridges (Frangi 1998) at several scales, divided by the slice's maximum.

    Half the slice's greatest norm is the scale of the response: a first exchange gives the greatest norms of each tile, a few
    numbers, and a second one, with the slice's, the response. Hessians are taken twice, since those of all scales are many times what
    the image is, and so would be their files."""
    reach = lambda s: int(4 * s + 0.5) + 2
    halo = max(map(reach, sigmas))

    def hessians(place: dict, window: np.ndarray, sy: int, sx: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        whole = _padded(place, window, sy, sx, halo)
        for sigma in sigmas:
            spare = halo - reach(sigma)
            small, large = kernels.hessian_eigenvalues(whole[spare : len(whole) - spare, spare : whole.shape[1] - spare], sigma)
            yield np.sqrt(small**2 + large**2), small, large

    def tops(*at) -> dict:
        return {"tops": [float(norm.max()) for norm, _, _ in hessians(*at)]}

    def response(place: dict, *at) -> dict:
        out = np.zeros((place["h"], place["w"]))
        for (norm, small, large), top in zip(hessians(place, *at), place["_tops"], strict=True):
            if top > 0:
                shape = np.where(large < 0, np.exp(-((np.abs(small) / np.maximum(np.abs(large), 1e-10)) ** 2) / (2 * beta**2)), 0)
                np.maximum(out, shape * (1 - np.exp(-(norm**2) / (2 * (top / 2) ** 2))), out=out)
        return {"data": kernels.packed(out)}

    found = _gathered(_same_size(tiles), _with_halo(halo, tile), tops, by, "tops array<double>")
    top = saved(found.groupBy(*by).agg(F.array(*[F.max(F.col("tops")[i]) for i in range(len(sigmas))]).alias("_tops")))
    del found
    return by_max(saved(_gathered(_same_size(tiles.join(top, [*by])), _with_halo(halo, tile), response, by, "data binary", ("_tops",))), by)


def ridges_at(
    tiles: DataFrame, dims: DataFrame, factor: int = 2, sigmas: tuple[float, ...] = (1, 2, 4, 8), by: Key = KEY, tile: int = TILE, inside: DataFrame | None = None
) -> DataFrame:
    """Ridges of frames (dims: by, h, w) sampled down by a whole factor, and back at full size. ``inside``: runs of full
    size; what lies outside them is 0 before the slice's maximum is taken, at the small size."""
    target = downsampled_dims(dims, factor, by)
    small = tiles if factor <= 1 else resampled(tiles, target, by, tile)
    found = ridges(small, sigmas, by=by, tile=tile)
    if inside is not None:
        sizes = dims.select(*by, F.col("h").alias("_h"), F.col("w").alias("_w")).join(target, [*by])
        found = by_max(saved(masked(found, sampled(inside.join(sizes, [*by]), ("_h", "_w"), ("h", "w")), by, tile)), by, True)
    return found if factor <= 1 else resampled(found, dims, by, tile)
