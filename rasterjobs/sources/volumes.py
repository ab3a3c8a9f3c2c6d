"""Chunked volumes and mask images as tables, and results as files.

Stores are listed and read by the data sources of ``chunks``.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import chunks
from . import images as images_of


def list_store_arrays(spark: SparkSession, *roots: str) -> DataFrame:
    """The arrays of stores (one row each) without reading any data: only metadata is opened, one task a store."""
    spark.dataSource.register(chunks.StoreArrays)
    return spark.read.format("store_arrays").option("stores", json.dumps([r.rstrip("/") for r in roots])).load().orderBy("store", "path")


def read_zarr_tiles(
    spark: SparkSession, root: str, level: str, subject: str, modality: str, z_range: tuple[int, int] | None = None, axes: str | None = None,
    y_range: tuple[int, int] | None = None, x_range: tuple[int, int] | None = None, channels: tuple[int, int] | None = None, dense: bool = False,
) -> DataFrame:
    """One row a chunk, z and channel (dense bytes in C order), of the tiles that meet the ranges (first, past the
    last). Absent chunks have the store's fill value; where that is 0 they are absent rows unless ``dense``.

    Chunks outside the ranges are not opened, nor are those that filters on z, c, y0 and x0 leave out, where the
    session has spark.sql.python.filterPushdown.enabled. Of a time axis the first step is read."""
    spark.dataSource.register(chunks.ChunkedVolume)
    meta = list_store_arrays(spark, root).filter(F.col("level") == level).first()
    if meta is None:
        raise ValueError(f"{root} has no array {level!r}")
    axes = axes or chunks.axes_of(meta["shape"])
    size = dict(zip(axes, meta["chunks"], strict=True))
    # a tile meets a range of pixels from one chunk before it
    near = lambda r, axis: [r[0] - size[axis] + 1, r[1]]
    ranges = {"z": z_range, "c": channels, "y0": y_range and near(y_range, "Y"), "x0": x_range and near(x_range, "X")}
    options = {
        "array": json.dumps(meta.asDict()), "axes": axes, "subject": subject, "modality": modality, "dense": str(dense).lower(),
        "ranges": json.dumps({k: r for k, r in ranges.items() if r}), "pushdown": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"),
    }
    return spark.read.format("chunked_volume").options(**options).load()


def tile_pixels(tiles: DataFrame) -> DataFrame:
    """The non-zero pixels of tiles: subject, modality, z, c, y, x, v."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                a = np.frombuffer(r.data, r.dtype).reshape(r.h, r.w)
                y, x = np.nonzero(a)
                yield pd.DataFrame({"subject": r.subject, "modality": r.modality, "z": r.z, "c": r.c, "y": y + r.y0, "x": x + r.x0, "v": a[y, x].astype(float)})

    return tiles.mapInPandas(run, "subject string, modality string, z int, c int, y int, x int, v double")


def read_pred_masks(
    spark: SparkSession, path: str, pattern: str = r"slice_(\d+)_pred", threshold: int = 127, keys: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """(slices, runs): the size of each image whose name fits, and the runs of its pixels above the threshold.
    All-black images keep their row in slices.

    ``keys``: columns such as model and subject, from folders ``<key>=<value>`` in the path (percent-encoded, as
    write_mask_files lays them out); images outside such folders have null keys."""
    reader = spark.read.format("image").option("dropInvalid", True)
    images = (reader.option("recursiveFileLookup", True) if keys else reader).load(path).select("image.*")
    images = images.withColumn("z", F.regexp_extract("origin", pattern, 1)).filter("z <> ''").withColumn("z", F.col("z").cast("int"))

    def of_path(key: str) -> Column:
        # the origin is a URI, whose % of the file name is encoded once more
        found = F.url_decode(F.url_decode(F.replace(F.regexp_extract("origin", rf"/{key}=([^/]*)/", 1), F.lit("+"), F.lit("%2B"))))
        return F.when(~found.isin("", images_of.NO_VALUE), found).alias(key)

    images = images.select(*[of_path(k) for k in keys], "z", "height", "width", "nChannels", "data")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.to_dict("records"):
                on = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])[:, :, 0] > threshold
                edge = np.diff(np.pad(on, ((0, 0), (1, 1))).astype(np.int8), axis=1)
                y, x0 = np.nonzero(edge == 1)
                own = {k: np.full(len(y), r[k], object) for k in keys}
                yield pd.DataFrame({**own, "z": r["z"], "y": y, "x0": x0, "x1": np.nonzero(edge == -1)[1] - 1})

    fields = "".join(f"`{k}` string, " for k in keys)
    runs = images.mapInPandas(run, f"{fields}z int, y int, x0 int, x1 int")
    return images.select(*keys, "z", F.col("height").alias("h"), F.col("width").alias("w")), runs


def grey_png(a: np.ndarray) -> bytes:
    """An 8-bit grey PNG."""
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 0, 0, 0, 0)
    raw = np.pad(a.astype(np.uint8), ((0, 0), (1, 0))).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def mask_pngs(runs: DataFrame, dims: DataFrame, by: tuple[str, ...] = ("subject", "z")) -> DataFrame:
    """(by, png): each slice's mask as 0 and 255; slices without runs are black."""
    rows = dims.select(*by, "h", "w").join(runs, [*by], "left").select(*by, "h", "w", "y", "x0", "x1")
    fields = ", ".join(f"`{n}` {dims.schema[n].dataType.simpleString()}" for n in by)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(pdf["h"].iloc[0]), int(pdf["w"].iloc[0])), np.uint8)
        for y, x0, x1 in pdf[["y", "x0", "x1"]].dropna().astype(int).itertuples(index=False):
            a[y, x0 : x1 + 1] = 255
        return pd.DataFrame({**{n: [pdf[n].iloc[0]] for n in by}, "png": [grey_png(a)]})

    return rows.groupBy(*by).applyInPandas(one, f"{fields}, png binary")


def write_mask_files(runs: DataFrame, dims: DataFrame, path: str, by: tuple[str, ...] = ("subject", "z"), overwrite: bool = False) -> None:
    """One PNG a slice of dims, black where it has no runs, in folders of the keys beside z; ``images`` says how."""
    runs.sparkSession.dataSource.register(images_of.MaskFiles)
    keys = [n for n in by if n != "z"]
    writer = mask_pngs(runs, dims, by).write.format("mask_files").option("keys", ",".join(keys))
    writer.mode("overwrite" if overwrite else "append").save(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One CSV with a header; nulls are empty cells. A row a slice, so one file is small."""
    metrics.coalesce(1).write.mode("overwrite").csv(path, header=True)


def histogram_rows(histogram: DataFrame) -> DataFrame:
    """bin_left and bin_right with six decimals, as the histogram file has them."""
    six = lambda c: F.format_string("%.6f", c).alias(c)
    return histogram.orderBy("bin").select(six("bin_left"), six("bin_right"), "count")


def _first(rows: DataFrame, group: str, order: list[Column], keep: Column | None = None) -> DataFrame:
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.filter(F.col("_r") == 1).drop("_r")


def pick_level(arrays: DataFrame, level: str, rule: str, shape: list[int] | None = None) -> DataFrame:
    """The array of each store that a preferred level stands for. Rules: ``strict`` (that key or
    none), ``preferred`` (key, "0", first), ``nested`` (key, "0", "0/key", "0/0", first), ``sized``
    (key, first whose last two axes are ``shape``, first)."""
    key = F.col("level")
    ranks = {
        "strict": [key == level], "preferred": [key == level, key == "0"],
        "nested": [key == level, key == "0", key == f"0/{level}", key == "0/0"],
        "sized": [key == level, F.slice("shape", -2, 2) == F.array(*map(F.lit, shape or [0, 0]))],
    }[rule]
    prio = F.lit(len(ranks))
    for i in range(len(ranks) - 1, -1, -1):
        prio = F.when(ranks[i], i).otherwise(prio)
    ranked = arrays.withColumn("_p", prio)
    if rule == "strict":
        ranked = ranked.filter("_p = 0")
    return _first(ranked, "store", [F.col("_p"), F.col("path")]).drop("_p")


def find_histology(paths: DataFrame, stain: str = "LY_DF") -> DataFrame:
    """(subject, path): the first store of each subject with that stain."""
    subject = F.regexp_extract("path", rf"sub-([^/]+)/micr/sub-[^/]*_stain-{stain}\.ome\.zarr$", 1)
    return paths.select(subject.alias("subject"), "path").filter("subject <> ''").groupBy("subject").agg(F.min("path").alias("path"))


def pick_outline(paths: DataFrame, prefer_mask: bool = True) -> DataFrame:
    """(subject, path): the outline store, with or without the suffix as preferred, else the other."""
    subject, name = (F.regexp_extract("path", r"sub-([^/]+)/micr/masks/(Outline(?:_mask)?)\.ome\.zarr$", i) for i in (1, 2))
    rows = paths.select(subject.alias("subject"), "path", name.alias("_n")).filter("subject <> ''")
    first = (F.col("_n") == "Outline_mask") == F.lit(prefer_mask)
    return _first(rows, "subject", [F.when(first, 0).otherwise(1), F.col("path")]).drop("_n")


def subject_catalog(subjects: DataFrame) -> DataFrame:
    """(subject, pos, slide, slice_idx) from arrays ``slides`` and ``slices`` that may differ in
    length: the slides decide, a missing index is null."""
    at = subjects.select("subject", "slices", F.posexplode("slides").alias("pos", "slide"))
    return at.select("subject", "pos", "slide", F.get("slices", F.col("pos")).alias("slice_idx"))
