"""Approximate nearest neighbours by a hash-prefix forest (largest inner product).

Vectors are dealt to shards of bounded size, one packed row each. In a shard every tree has long
hash strings (the signs of random projections, 64 bits) in a sorted array. A query descends every
tree to its longest matching prefix and then all trees ascend together, bit by bit, until the
prefixes hold enough candidates. Rows that the prefixes of most trees hold come first: of these a
fixed share of the shard is compared exactly. Queries are packed into blocks of bounded size that
meet the shards in a join, and the best of all shards are merged by query; no vector passes through
the driver.

The largest inner product becomes a matter of angles by one more coordinate, sqrt(m^2 - |x|^2)
for vectors (m: the greatest norm) and 0 for queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions

TREES, BITS = 160, 64
#: Vectors of a shard and queries of a block, in expectation.
SHARD, BLOCK = 8_192, 4_000
#: The share of a tree's rows that the ascent gathers, in the mean of all trees, and the share of a
#: shard that is compared exactly (at least LEAST rows for each neighbour that is asked for).
REACH, COMPARED, LEAST = 0.05, 0.15, 8


def usable(vector: Column) -> Column:
    """A vector without null or non-finite components and not all zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _planes(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, TREES * BITS)).astype(np.float32)


def _codes(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(tree, row) hash strings, the first bit highest."""
    out = np.empty((TREES, len(x)), np.uint64)
    weights = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
    for t in range(TREES):
        bits = x.astype(np.float32) @ planes[:, t * BITS : (t + 1) * BITS] > 0
        out[t] = (bits * weights).sum(axis=1, dtype=np.uint64)
    return out


class Forest:
    """The trees of one shard of distinct vectors (rows of x)."""

    def __init__(self, x: np.ndarray, greatest: float, seed: int):
        self.x, self.planes = x, _planes(x.shape[1] + 1, seed)
        rest = np.sqrt(np.maximum(greatest**2 - (x * x).sum(axis=1), 0))
        codes = _codes(np.column_stack([x, rest]), self.planes)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.codes = np.take_along_axis(codes, self.order, axis=1)

    def candidates(self, q: np.ndarray, gathered: int, compared: int) -> Iterator[np.ndarray]:
        """For each query the rows that most trees hold where the ascent ends: ``compared`` of them and those
        that tie with the last."""
        codes = _codes(np.column_stack([q, np.zeros(len(q))]), self.planes)
        low, high = np.zeros((TREES, len(q)), np.int64), np.full((TREES, len(q)), len(self.x), np.int64)
        open_ = np.ones(len(q), bool)
        for depth in range(1, BITS + 1):
            # going down while the prefixes of all trees still hold enough is ascending to here
            keep = np.uint64(((1 << depth) - 1) << (BITS - depth))
            end = np.uint64((1 << (BITS - depth)) - 1)
            todo = np.flatnonzero(open_)
            lo = np.stack([np.searchsorted(self.codes[t], codes[t, todo] & keep) for t in range(TREES)])
            hi = np.stack([np.searchsorted(self.codes[t], codes[t, todo] & keep | end, "right") for t in range(TREES)])
            enough = (hi - lo).sum(axis=0) >= gathered
            low[:, todo[enough]], high[:, todo[enough]] = lo[:, enough], hi[:, enough]
            open_[todo[~enough]] = False
            if not open_.any():
                break
        size = len(self.x)
        for i in range(len(q)):
            spans = [self.order[t, low[t, i] : high[t, i]] for t in range(TREES)]
            held = np.bincount(np.concatenate(spans), minlength=size)
            edge = np.partition(held, size - compared)[size - compared] if compared < size else 0
            yield np.flatnonzero(held >= max(1, edge))


def _packed(by: str):
    """Rows (by, _dim, _id, _v) of one group to one row: by, _dim, ids and vectors as little-endian bytes."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("_id").to_numpy().astype("<i8")
        vectors = table.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8")
        return table.select([by, "_dim"]).slice(0, 1).append_column("ids", pa.array([ids.tobytes()])).append_column("body", pa.array([vectors.tobytes()]))

    return run


class _Shard:
    """Distinct vectors of a shard with their ids, least first, and their forest."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, greatest: float, seed: int):
        # equal vectors are one: nearer ids win ties, so k + 1 of a class are all that can count
        self.x, place = np.unique(x, axis=0, return_inverse=True)
        place = place.ravel()
        order = np.lexsort((ids, place))
        self.members, self.start = ids[order], np.searchsorted(place[order], np.arange(len(self.x) + 1))
        self.forest = Forest(self.x, greatest, seed)

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, reach: float, compared: float) -> Iterator[tuple]:
        """(query ids, ids, scores), k of each query at most."""
        x, members, start, n = self.x, self.members, self.start, len(self.x)
        most = min(n, max(LEAST * k, int(np.ceil(compared * n))))
        for i, met in enumerate(self.forest.candidates(q, int(np.ceil(reach * TREES * n)) + k, most)):
            rough = x[met] @ q[i]
            if len(met) > k + 1:
                edge = np.partition(rough, len(met) - k - 1)[len(met) - k - 1]
                met = met[rough >= edge - 1e-9 * max(1.0, abs(edge))]
            score = (x[met] * q[i]).sum(axis=1)
            size = np.minimum(start[met + 1] - start[met], k + 1)
            near = np.concatenate([members[start[m] : start[m] + s] for m, s in zip(met, size, strict=True)] or [np.empty(0, np.int64)])
            score = np.repeat(score, size)
            live = near != query_ids[i]
            near, score = near[live], score[live]
            best = np.lexsort((near, -score))[:k]
            yield np.full(len(best), query_ids[i]), near[best], score[best]


def _search(greatest: float, k: int, seed: int, reach: float, compared: float):
    """Rows of a block of queries beside a packed shard (sorted by shard) to (query_id, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}
                dim, key = row["_dim"].as_py(), (row["_dim"].as_py(), row["_shard"].as_py())
                numbers = lambda name, kind: np.frombuffer(row[name].as_buffer(), kind)  # noqa: E731, B023
                if key != at:
                    at, shard = key, _Shard(numbers("ids", "<i8"), numbers("body", "<f8").reshape(-1, dim), greatest, seed)
                found = list(shard.search(numbers("asked_ids", "<i8"), numbers("asked", "<f8").reshape(-1, dim), k, reach, compared))
                cols = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=["query_id", "vec_id", "score"])

    return run


def nearest(
    vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
    shard: int = SHARD, block: int = BLOCK, reach: float = REACH, compared: float = COMPARED, seed: int = 7,
) -> DataFrame:
    """query_id, rank from 1, vec_id, score: the k rows of largest inner product found for each query.

    A row is no candidate of the query with its own id. Vectors (of either side) that are null,
    zero or have null or non-finite components take no part, nor do rows with a null id, nor,
    for a query, vectors of another length. Ties go to the smaller id; equal vectors are searched
    as one and expanded exactly. Repeated ids (equal rows) count once. A query without
    candidates has no rows. A shard's forest is built once, in one task; a shard, or a block of
    queries, is one row of bounded size, and a task holds one shard at a time.
    """
    clean = lambda df: (
        df.select(F.col(id_col).cast("bigint").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
        .filter(F.col("_id").isNotNull() & usable(F.col("_v")))
        .dropDuplicates(["_id"])
        .withColumn("_dim", F.size("_v"))
    )
    rows, asked = clean(vectors), clean(queries)
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
    size = rows.agg(F.count("*").alias("n"), F.max(norm).alias("m")).first()
    shards, blocks = max(1, -(-size["n"] // shard)), max(1, -(-asked.count() // block))
    dealt = lambda df, name, n: df.withColumn(name, F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(n)).cast("int"))
    packed = lambda df, name, n: dealt(df, name, n).groupBy(name, "_dim").applyInArrow(
        _packed(name), f"{name} int, _dim int, ids binary, body binary"
    )
    # every block meets every shard; the rows of a shard stay together, whatever their size in bytes
    near, own = partitions(vectors.sparkSession), ["_dim", "_shard"]
    blocked = packed(asked, "_block", blocks).select(
        "_dim", F.col("ids").alias("asked_ids"), F.col("body").alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_shard")
    )
    pairs = blocked.repartition(near, *own).join(packed(rows, "_shard", shards).repartition(near, *own).hint("merge"), own)
    found = pairs.select(*own, "asked_ids", "asked", "ids", "body").mapInArrow(
        _search(size["m"] or 0.0, k, seed, reach, compared), "query_id bigint, vec_id bigint, score double"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
