"""Python data sources for chunked volumes: ``store_arrays`` lists arrays, ``chunked_volume`` reads one as tiles.

Listing has one input partition a store. Reading plans its partitions from the metadata alone: ranges of chunk
numbers, after the chunks that filters on z, c, y0 and x0 leave out are gone; no folder is listed, and a task opens
the files of its own chunks only. Paths may be local or of any scheme that pyarrow's file systems know.
"""

from __future__ import annotations

import gzip
import json
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType

from ..schemas import STORE_ARRAYS, TILES

METADATA = (".zarray", "zarr.json")


def opened(root: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(root) if "://" in root else (pa.fs.LocalFileSystem(), root)


def read_file(fs: pa.fs.FileSystem, path: str) -> bytes | None:
    """A file's bytes, or None where there is no such file."""
    try:
        with fs.open_input_stream(path) as stream:
            return stream.read()
    except FileNotFoundError:
        return None


def _fill(value, dtype: np.dtype) -> float:
    """A fill value as a number: null is 0; a hexadecimal text has the value's bytes, the highest first."""
    if isinstance(value, str) and value.startswith("0x"):
        return float(np.frombuffer(bytes.fromhex(value[2:]), dtype.newbyteorder(">"))[0])
    return float(value or 0)


def described(meta: dict) -> dict | None:
    """Shape, chunks and how chunks are stored, of version 2 or 3 metadata; None if it is not an array's."""
    if meta.get("zarr_format") == 3:
        if meta.get("node_type") != "array":
            return None
        dtype, order, squeezed = np.dtype(meta["data_type"]), "C", []
        for codec in meta.get("codecs", []):
            name, given = codec["name"], codec.get("configuration", {})
            if name == "transpose":
                order = ",".join(map(str, given["order"]))
            elif name == "bytes":
                dtype = dtype.newbyteorder(">") if given.get("endian") == "big" else dtype
            elif name != "crc32c":
                squeezed.append(name)
        if len(squeezed) > 1:
            raise ValueError(f"no decoder for {' and '.join(squeezed)} together")
        how = meta.get("chunk_key_encoding", {"name": "default"})
        plain = how.get("name", "default") != "v2"
        return {
            "shape": meta["shape"], "chunks": meta["chunk_grid"]["configuration"]["chunk_shape"], "dtype": dtype.str,
            "compressor": squeezed[0] if squeezed else None, "order": order, "separator": how.get("configuration", {}).get("separator", "/" if plain else "."),
            "fill": _fill(meta.get("fill_value"), dtype), "version": 3 if plain else 2,
        }
    if "chunks" not in meta:
        return None
    if meta.get("filters"):
        raise ValueError(f"no decoder for filters {meta['filters']}")
    dtype = np.dtype(meta["dtype"])
    return {
        "shape": meta["shape"], "chunks": meta["chunks"], "dtype": dtype.str, "compressor": (meta.get("compressor") or {}).get("id"),
        "order": meta.get("order", "C"), "separator": meta.get("dimension_separator", "."), "fill": _fill(meta.get("fill_value"), dtype), "version": 2,
    }


def arrays_of(root: str) -> Iterator[dict]:
    """The arrays below a store's root. Folders of chunks (named by numbers, without metadata) are not entered."""
    fs, top = opened(root.rstrip("/"))
    stack = [top]
    while stack:
        folder = stack.pop()
        if (found := next((m for n in METADATA if (m := read_file(fs, f"{folder}/{n}")) is not None), None)) is not None:
            if array := described(json.loads(found)):
                level = folder[len(top) :].strip("/")
                yield {"store": root.rstrip("/"), "path": "/".join(filter(None, [root.rstrip("/"), level])), "level": level, **array}
                continue
        elif folder.rsplit("/", 1)[-1].isdigit():
            continue
        stack += [i.path for i in fs.get_file_info(pa.fs.FileSelector(folder)) if i.type == pa.fs.FileType.Directory]


class _Listing(DataSourceReader):
    def __init__(self, stores: list[str]):
        self.stores = stores

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(s) for s in self.stores]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        names = [f.split()[0] for f in STORE_ARRAYS.split(", ")]
        for row in arrays_of(partition.value):
            yield tuple(row[n] for n in names)


class StoreArrays(DataSource):
    """Option ``path``: a store, or ``stores``: a JSON list of them."""

    @classmethod
    def name(cls) -> str:
        return "store_arrays"

    def schema(self) -> str:
        return STORE_ARRAYS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Listing(json.loads(self.options["stores"]) if "stores" in self.options else [self.options["path"]])


def decoded(body: bytes, codec: str | None) -> bytes:
    if not codec:
        return body
    if codec in ("gzip", "zlib"):
        return gzip.decompress(body) if body[:2] == b"\x1f\x8b" else zlib.decompress(body)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(body)
    if codec == "lz4":
        (size,) = struct.unpack("<I", body[:4])
        return pa.decompress(body[4:], size, codec="lz4_raw", asbytes=True)
    if codec == "blosc":
        try:
            import numcodecs
        except ImportError as e:
            raise ValueError("blosc chunks need the numcodecs package") from e
        return bytes(numcodecs.Blosc().decode(body))
    raise ValueError(f"no decoder for {codec}")


def axes_of(shape: Sequence[int]) -> str:
    """Which axes an array has: see functions.columns.axis_order."""
    if len(shape) == 4:
        return "CZYX" if 1 <= shape[0] <= 4 else "ZYXC"
    return {2: "YX", 3: "ZYX", 5: "TCZYX"}[len(shape)]


#: The tile column that stands for an axis.
COLUMNS = {"z": "Z", "c": "C", "y0": "Y", "x0": "X"}


class ChunkReader(DataSourceReader):
    """Tiles of one array. ``wanted``: per axis (column, test, value) that a tile's place must meet."""

    def __init__(self, array: dict, axes: str, subject: str, modality: str, dense: bool, partition_bytes: int):
        self.array, self.axes, self.subject, self.modality, self.dense = array, axes, subject, modality, dense
        self.partition_bytes, self.wanted = partition_bytes, []

    def want(self, column: str, test: str, value) -> None:
        self.wanted.append((column, test, value))

    def _fits(self, column: str, places: np.ndarray) -> np.ndarray:
        keep = np.ones(len(places), bool)
        for name, test, value in self.wanted:
            if name == column:
                keep &= np.isin(places, value) if test == "in" else {"<": places < value, "<=": places <= value, ">": places > value, ">=": places >= value}[test]
        return keep

    def _chosen(self) -> list[np.ndarray]:
        """The chunk numbers along each axis that hold a wanted tile."""
        out = []
        for axis, n, c in zip(self.axes, self.array["shape"], self.array["chunks"], strict=True):
            column = next((k for k, a in COLUMNS.items() if a == axis), None)
            numbers = np.arange(-(-n // c))
            if axis == "T":
                numbers = numbers[:1]  # of several times the first is read
            elif column in ("y0", "x0"):
                numbers = numbers[self._fits(column, numbers * c)]
            else:
                numbers = np.unique(np.flatnonzero(self._fits(column, np.arange(n))) // c)
            out.append(numbers)
        return out

    def partitions(self) -> Sequence[InputPartition]:
        total = int(np.prod([len(x) for x in self._chosen()], dtype=object))
        size = int(np.prod(self.array["chunks"], dtype=object)) * np.dtype(self.array["dtype"]).itemsize
        step = max(1, self.partition_bytes // max(1, size))
        # Spark reads a source without partitions as one with an unknown partition
        return [InputPartition((a, min(a + step, total))) for a in range(0, total, step)] or [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        chosen, (fs, root) = self._chosen(), opened(self.array["path"])
        shape = [len(x) for x in chosen]
        for k in range(*partition.value):
            at = [int(x[i]) for x, i in zip(chosen, np.unravel_index(k, shape), strict=True)]
            body = read_file(fs, f"{root}/{self._name(at)}")
            if body is not None or self.dense or self.array["fill"] != 0:
                yield from self._tiles(at, body)

    def _name(self, at: list[int]) -> str:
        name = self.array["separator"].join(map(str, at))
        return name if self.array["version"] == 2 else self.array["separator"].join(["c", name])

    def _tiles(self, at: list[int], body: bytes | None) -> Iterator[pa.RecordBatch]:
        chunks, order = self.array["chunks"], self.array["order"]
        if body is None:
            a = np.full(chunks, self.array["fill"], np.dtype(self.array["dtype"]))
        else:
            flat = np.frombuffer(decoded(body, self.array["compressor"]), self.array["dtype"])
            if "," in order:
                turn = [int(i) for i in order.split(",")]
                a = flat.reshape([chunks[i] for i in turn]).transpose(np.argsort(turn))
            else:
                a = flat.reshape(chunks, order=order)
        base = {axis: i * c for axis, i, c in zip(self.axes, at, chunks, strict=True)}
        end = dict(zip(self.axes, self.array["shape"], strict=True))
        missing = [axis for axis in "TCZ" if axis not in self.axes]
        for axis in missing:
            a, base, end = a[None], base | {axis: 0}, end | {axis: 1}
        now = "".join(reversed(missing)) + self.axes
        a = np.transpose(a, [now.index(x) for x in "TCZYX"])[0]
        a = a[: end["C"] - base["C"], : end["Z"] - base["Z"], : end["Y"] - base["Y"], : end["X"] - base["X"]]
        level = self.array["level"].rsplit("/", 1)[-1]
        for c in np.flatnonzero(self._fits("c", base["C"] + np.arange(a.shape[0]))):
            zs = np.flatnonzero(self._fits("z", base["Z"] + np.arange(a.shape[1])))
            if not len(zs):
                continue
            same = lambda v, kind: pa.array([v] * len(zs), kind)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [
                    same(self.subject, pa.string()), same(self.modality, pa.string()), same(int(level) if level.isdigit() else 0, pa.int32()),
                    pa.array((base["Z"] + zs).astype(np.int32)), same(base["C"] + int(c), pa.int32()), same(base["Y"], pa.int32()), same(base["X"], pa.int32()),
                    same(a.shape[2], pa.int32()), same(a.shape[3], pa.int32()), same(self.array["dtype"], pa.string()),
                    pa.array([np.ascontiguousarray(a[c, z]).tobytes() for z in zs], pa.binary()),
                ],
                names=[f.split()[0] for f in TILES.split(", ")],
            )


class PushedChunkReader(ChunkReader):
    """The same with Spark's filters on z, c, y0 and x0, all of which it meets exactly."""

    TESTS = {LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">="}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in COLUMNS:
                yield f
            elif isinstance(f, EqualTo):
                self.want(column, "in", [f.value])
            elif isinstance(f, In):
                self.want(column, "in", list(f.value))
            elif type(f) in self.TESTS:
                self.want(column, self.TESTS[type(f)], f.value)
            elif not isinstance(f, IsNotNull):
                yield f


class ChunkedVolume(DataSource):
    """Options: ``array`` (a row of store_arrays as JSON), or ``path`` and ``level``; ``subject``, ``modality``, ``axes``;
    ``ranges`` (JSON: tile column to [first, past the last]); ``dense`` (absent chunks of fill value 0 are tiles too);
    ``partitionBytes``; ``pushdown`` (Spark's filters; needs spark.sql.python.filterPushdown.enabled)."""

    @classmethod
    def name(cls) -> str:
        return "chunked_volume"

    def schema(self) -> str:
        return TILES

    def reader(self, schema: StructType) -> ChunkReader:
        o = self.options
        if "array" in o:
            array = json.loads(o["array"])
        else:
            array = next((a for a in arrays_of(o["path"]) if a["level"] == o.get("level", "")), None)
            if array is None:
                raise ValueError(f"{o['path']} has no array {o.get('level', '')!r}")
        kind = PushedChunkReader if o.get("pushdown", "false").lower() == "true" else ChunkReader
        reader = kind(array, o.get("axes") or axes_of(array["shape"]), o.get("subject", ""), o.get("modality", ""), o.get("dense", "false").lower() == "true", int(o.get("partitionbytes", 64 << 20)))
        for column, (low, high) in json.loads(o.get("ranges", "{}")).items():
            reader.want(column, ">=", low)
            reader.want(column, "<", high)
        return reader
