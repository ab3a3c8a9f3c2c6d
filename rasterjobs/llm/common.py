"""Helpers that the text operators share: words, hashes, checkpoints, folds."""

from __future__ import annotations

import functools
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SEPARATORS = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
#: A-Z become a-z; every other ASCII byte that is no digit or letter becomes a blank.
ALNUM = bytes(
    c + 32 if 0x41 <= c <= 0x5A else 0x20 if c in _SEPARATORS else c for c in range(256)
)
U64 = np.uint64


def plain_words(text: bytes | None) -> list[bytes]:
    """Runs of anything but ASCII white space; ``bytes.split`` knows no other blanks."""
    return text.split() if text else []


def lower_words(text: bytes | None) -> list[bytes]:
    """As plain_words, with A-Z lower-cased (``bytes.lower`` touches ASCII only)."""
    return text.lower().split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of all non-ASCII bytes."""
    return text.translate(ALNUM).split() if text else []


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def byte_slices(batches: Iterable[pa.RecordBatch], place: int, rows: int = 2_000, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``most`` bytes in the text or binary column at ``place``
    (one row at least), so that what is made of a slice stays bounded."""
    for batch in batches:
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            n = min(rows, max(1, int(np.searchsorted(ends, before + most, "right")) - begin))
            yield batch.slice(begin, n)
            begin += n


class WordHashes(dict):
    """word -> place in ``values``, an array of 64-bit hashes that grows on demand.

    The cache is emptied by ``trim`` so that a worker's memory stays bounded."""

    def __init__(self, seed: int = 0, most: int = 1_000_000):
        self.seed, self.most, self._new, self._known = seed, most, [], np.empty(0, U64)

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        self._new.append(xxhash.xxh3_64_intdigest(word, self.seed))
        return place

    def hashes(self, words: Iterable[bytes], count: int) -> np.ndarray:
        places = np.fromiter(map(self.__getitem__, words), np.int64, count)
        if self._new:
            self._known = np.concatenate([self._known, np.array(self._new, U64)])
            self._new = []
        out = self._known[places]
        if len(self) > self.most:
            self.clear()
            self._known = np.empty(0, U64)
        return out


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising mixer of 64-bit hashes (the constants are those of SplitMix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def rolling(values: np.ndarray, n: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Mixed hashes of every n consecutive values; one per start, len(values)-n+1 of them."""
    size = len(values) - n + 1
    if size <= 0:
        return np.empty(0, U64)
    h = np.full(size, n, U64)
    for i in range(n):
        h = h * U64(seed | 1) + values[i : i + size]
        h ^= h >> U64(29)
    return mix(h)


@functools.lru_cache(maxsize=8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for factor in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, factor, U64)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        out.append(p)
    return out[0], out[1]


def powers(size: int, base: int = 0x9E3779B97F4A7C15) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2**64, for i below size at least; base is odd."""
    return _powers(base, 1 << max(16, (size - 1).bit_length()))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of the stretches start to end of values, at a cost that does not grow with their length: a
    polynomial modulo 2**64, from one running sum. values are hashes, so chance equality has probability 2**-64."""
    forth, back = powers(len(values) + 1, base)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * forth[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(U64))


def window_hashes(values: np.ndarray, n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """As rolling, at a cost that does not grow with n."""
    start = np.arange(max(0, len(values) - n + 1))
    return span_hashes(values, start, start + n, base)


def planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then all second bytes and so on, which compress better."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplanes(body: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(size, -1).T).view(kind).ravel()


def fold(id_col: str, parts: int, out: int) -> tuple[Column, Column]:
    """(held out, trains): crc32 of the id as text, modulo ``parts``, is ``out``.

    A null id is neither held out nor trained on."""
    rest = F.crc32(F.col(id_col).cast("string").cast("binary")) % parts
    return F.coalesce(rest == out, F.lit(False)), F.coalesce(rest != out, F.lit(False))


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder of spark.checkpoint.dir.

    That folder is read from the session. Only a session on one machine (master local, as in tests) gets a
    temporary one where none is set; on a cluster that is an error, as machines share no such folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of steps whose results are checkpointed."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these lengths: the run of each element, and its place in the run."""
    lengths = np.asarray(lengths, np.int64)
    run = np.repeat(np.arange(len(lengths)), lengths)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def list_array(values: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    """values cut into lists of these lengths."""
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values
    )
