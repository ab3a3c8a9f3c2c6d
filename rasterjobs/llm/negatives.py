"""Hard negatives of anchors by segment summaries.

Anchors and rows are dealt to blocks of bounded size, and each block of anchors meets each block of
rows in one task (a stated set of queries against all rows). For every block the mean and the
deviation of each vector segment are stored. Over a segment of l components the inner product is
l * mean * mean' up to l * deviation * deviation' either way, so the sums over segments bound a
score from both sides. Segments are refined level by level; a pair whose bounds leave the range
that is asked for, or the best found so far, goes no further; what stays is scored exactly, in
whole numbers.

A first pass finds each anchor's positives, a second one each positive's negatives. Only the best
few of a block leave its task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .vectors import exact, finite, matrix, whole_numbers

#: Anchors and rows of a block, in expectation; rows that are looked at together.
ANCHORS, ROWS, CHUNK = 1_024, 1_024, 512
#: Segments at each level.
LEVELS = (1, 4, 16)
#: Pairs are taken one by one where fewer of them are left; else whole blocks are multiplied.
SPARSE = 0.1


class Summaries:
    """The segments' means and deviations of whole-number vectors, scaled so that plain products of two
    vectors' rows are the centre and the reach of their score."""

    def __init__(self, x: np.ndarray, levels: tuple[int, ...] = LEVELS):
        values, self.levels = x.astype(np.float64), []
        for parts in levels:
            if parts >= x.shape[1]:
                break
            starts = np.arange(parts) * x.shape[1] // parts
            size = np.diff(np.append(starts, x.shape[1]))
            mean = np.add.reduceat(values, starts, axis=1) / size
            spread = np.add.reduceat((values - np.repeat(mean, size, axis=1)) ** 2, starts, axis=1) / size
            self.levels.append((mean * np.sqrt(size), np.sqrt(spread * size)))
        self.norm = np.sqrt((values**2).sum(axis=1))


class Best:
    """The best few (score, id) of each query, best first; ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.query, self.score, self.id = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.edge = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        self.query, self.score, self.id = query[keep], score[keep], ids[keep]
        full = place == self.k - 1
        self.edge[query[full]] = score[full]


class Block:
    """A block of anchors or rows: ids, labels, whole numbers and summaries."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, levels: tuple[int, ...] = LEVELS):
        self.ids, self.labels, self.x, self.seen = ids, labels, x, Summaries(x, levels)


def search(anchors: Block, rows: Block, owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, alike: bool, chunk: int = CHUNK) -> tuple[Best, int]:
    """The best k rows of each query, and how many pairs were scored exactly. Query j asks for rows of an equal
    (or another) label than anchor owner[j] with a score from low[j] to high[j], but not the anchor's own id."""
    best, scored = Best(len(owner), k), 0
    kind = exact(anchors.x, rows.x)
    a, b = anchors.x.astype(kind), rows.x.astype(kind)
    count = len(anchors.ids)
    by_anchor = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[by_anchor], np.arange(count + 1))
    asking = np.flatnonzero(np.diff(starts))
    for begin in range(0, len(rows.ids), chunk):
        part = slice(begin, min(begin + chunk, len(rows.ids)))
        # what an anchor's queries can still use: from the least of their needs to the greatest of their tops
        need, top = np.full(count, np.inf), np.full(count, -np.inf)
        np.minimum.at(need, owner, np.maximum(low, best.edge))
        np.maximum.at(top, owner, high)
        live = ((anchors.labels[asking, None] == rows.labels[part]) == alike) & (anchors.ids[asking, None] != rows.ids[part])
        i, j = np.nonzero(live)
        i = asking[i]
        for (am, ad), (bm, bd) in zip(anchors.seen.levels, rows.seen.levels, strict=True):
            if len(i) > SPARSE * live.size:
                centre, reach = (am @ bm[part].T)[i, j], (ad @ bd[part].T)[i, j]
            else:
                centre, reach = np.einsum("nd,nd->n", am[i], bm[part][j]), np.einsum("nd,nd->n", ad[i], bd[part][j])
            reach += 1e-9 * (1 + anchors.seen.norm[i] * rows.seen.norm[part][j])
            stay = (centre + reach >= need[i]) & (centre - reach <= top[i])
            i, j = i[stay], j[stay]
        scored += len(i)
        score = (a @ b[part].T)[i, j] if len(i) > SPARSE * live.size else (a[i] * b[part][j]).sum(axis=1)
        score = score.astype(np.int64)
        size = starts[i + 1] - starts[i]
        pair = np.repeat(np.arange(len(i)), size)
        query = by_anchor[np.repeat(starts[i], size) + np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)]
        fits = (score[pair] >= np.maximum(low, best.edge)[query]) & (score[pair] <= high[query])
        best.add(query[fits], score[pair[fits]], rows.ids[part][j[pair[fits]]])
    return best, scored


def _block(table: pa.Table, dim: int, scale: float) -> Block:
    number = lambda name: table.column(name).to_numpy().astype(np.int64)
    return Block(number("_id"), number("_label"), whole_numbers(matrix(table.column("_v"), dim), scale, dim))


def _nearest(k: int, scale: float):
    """A block of anchors and one of rows to (anchor_id, positive_id, positive_score)."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        anchors, rows = (_block(t, key[0].as_py(), scale) if t.num_rows else None for t in (left, right))
        found = Best(0, k)
        if anchors and rows:
            every = np.arange(len(anchors.ids))
            found = search(anchors, rows, every, np.full(len(every), -np.inf), np.full(len(every), np.inf), k, True)[0]
        own = anchors.ids[found.query] if len(found.query) else found.query
        return pa.table({"anchor_id": own, "positive_id": found.id, "positive_score": found.score})

    return run


def _ranged(k: int, scale: float, low: int, high: int):
    """A block of anchors with their positives and one of rows to (anchor_id, positive_id, positive_score,
    negative_id, negative_score)."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        anchors, rows = (_block(t, key[0].as_py(), scale) if t.num_rows else None for t in (left, right))
        ids, scores, found = np.empty(0, np.int64), np.empty(0, np.int64), Best(0, k)
        owner = np.empty(0, np.int64)
        if anchors and rows:
            asked = left.column("_positives").combine_chunks()
            owner = np.repeat(np.arange(len(asked)), asked.value_lengths().to_numpy())
            ids, scores = (asked.flatten().field(n).to_numpy().astype(np.int64) for n in ("positive_id", "positive_score"))
            # low * p <= 100 * s <= high * p, in whole numbers
            found = search(anchors, rows, owner, -(-low * scores // 100), high * scores // 100, k, False)[0]
        q = found.query
        own = anchors.ids[owner[q]] if len(q) else q
        return pa.table({"anchor_id": own, "positive_id": ids[q] if len(q) else q, "positive_score": scores[q] if len(q) else q, "negative_id": found.id, "negative_score": found.score})

    return run


def _ranked(df: DataFrame, by: list[str], score: str, ident: str, k: int) -> DataFrame:
    best = Window.partitionBy(*by).orderBy(F.desc(score), ident)
    return df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchors: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256, block: int = ROWS, anchor_block: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score.

    anchors: the rows to mine for (a condition on vectors). A component x counts as floor(scale * x) and a score
    is the inner product. An anchor's positives are its best rows of an equal label; a positive's negatives the
    best rows of another label with low * positive_score <= 100 * negative_score <= high * positive_score. Higher
    scores come first, ties go to the smaller id. label is whole numbers.

    Rows with a null id or label, or with a null or empty vector or one with null or non-finite components, take no
    part; equal ids count once; vectors of different lengths are not compared. Components beyond +-2^29 /
    sqrt(length) after scaling count as that bound. Anchors without positives, and positives without negatives, have
    no rows. Results do not depend on the blocks' sizes."""
    label = F.col(label) if isinstance(label, str) else label
    rows = (
        vectors.select(F.col(id_col).cast("bigint").alias("_id"), label.cast("bigint").alias("_label"), F.col(vector_col).cast("array<double>").alias("_v"), F.coalesce(anchors, F.lit(False)).alias("_anchor"))
        .filter(F.col("_id").isNotNull() & F.col("_label").isNotNull() & finite(F.col("_v")))
        .dropDuplicates(["_id"])
        .withColumn("_dim", F.size("_v"))
    )
    size = rows.agg(F.count("*").alias("n"), F.count_if("_anchor").alias("anchors")).first()
    many, few = max(1, -(-size["n"] // block)), max(1, -(-size["anchors"] // anchor_block))
    dealt = lambda name, n: F.pmod(F.xxhash64("_id", F.lit(n)), F.lit(n)).cast("int").alias(name)
    all_of = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    keys, vector = ["_dim", "_a", "_b"], ["_id", "_label", "_v"]
    asked = rows.filter("_anchor").select(*[F.col(c).alias(c) for c in ("_dim", *vector)])
    row_blocks = rows.select("_dim", *vector, all_of("_a", few), dealt("_b", many)).groupBy(*keys)
    met = asked.select("_dim", *vector, dealt("_a", few), all_of("_b", many)).groupBy(*keys)
    near = met.cogroup(row_blocks).applyInArrow(_nearest(positives, scale), "anchor_id bigint, positive_id bigint, positive_score bigint")
    own = _ranked(near, ["anchor_id"], "positive_score", "positive_id", positives).groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("_positives"))
    with_own = asked.join(own.withColumnRenamed("anchor_id", "_id"), "_id").select("_dim", *vector, "_positives", dealt("_a", few), all_of("_b", many)).groupBy(*keys)
    found = with_own.cogroup(row_blocks).applyInArrow(
        _ranged(negatives, scale, low, high), "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    )
    return _ranked(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
