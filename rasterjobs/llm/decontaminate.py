"""Benchmark decontamination by winnowing.

Documents and benchmark items are cut into words. Of every ``window - gram + 1``
consecutive gram hashes the least is kept as a fingerprint, so any shared span of
``window`` words or more has a fingerprint in common at the same offset. Fingerprints
of documents are joined with those of the items and each hit is extended word by word;
only spans of at least ``window`` equal words count.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, alnum_words, checkpointed, list_array, ragged, rolling, texts_of

#: Item words in one broadcast block; larger benchmarks go in several blocks.
BLOCK_WORDS = 4_000_000


class _Vocabulary(dict):
    """Words of the items, from 1; any other word is 0 and equals nothing."""

    def __missing__(self, word: bytes) -> int:
        return 0


def winnow(h: np.ndarray, width: int) -> np.ndarray:
    """Places of all minima of all ``width`` consecutive hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    low = h[:n].copy()
    for i in range(1, width):
        np.minimum(low, h[i : i + n], out=low)
    kept = np.zeros(len(h), bool)
    for i in range(width):
        kept[i : i + n] |= h[i : i + n] == low
    return np.flatnonzero(kept)


class _Index:
    """Fingerprints of one block of items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int, gram: int):
        self.window, self.gram, self.names = window, gram, [name for name, _ in items]
        self.vocabulary = _Vocabulary()
        for _, words in items:
            for w in words:
                if w not in self.vocabulary:
                    self.vocabulary[w] = len(self.vocabulary) + 1
        rows = [np.array([self.vocabulary[w] for w in words], U64) for _, words in items]
        gap = np.zeros(window, U64)
        self.words = np.concatenate([gap, *(x for row in rows for x in (row, gap))])
        starts = window + np.cumsum([0, *(len(row) + window for row in rows)])[: len(rows)]
        self.owner = np.repeat(np.arange(len(rows)), [len(r) + window for r in rows])
        self.owner = np.concatenate([np.zeros(window, np.int64), self.owner])
        by_length: dict[int, list[np.ndarray]] = defaultdict(list)
        for row, start in zip(rows, starts, strict=True):
            if len(row) >= window:
                by_length[window].append(start + winnow(rolling(row, gram), window - gram + 1))
            elif len(row):
                by_length[len(row)].append(np.array([start]))
        # length of a window -> sorted hashes of what is looked up, and their places
        self.tables = {}
        for length, found in by_length.items():
            at = np.concatenate(found)
            h = rolling(self.words, gram if length == window else length)[at]
            order = np.argsort(h, kind="stable")
            self.tables[length] = h[order], at[order]

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, item) of every occurrence; words: ids, with gaps of zeros at the ends
        and between documents that are at least ``window`` long."""
        out = [(np.empty(0, np.int64),) * 3]
        zeros = np.concatenate([[0], np.cumsum(words == 0)])
        for length, (known, places) in self.tables.items():
            n = self.gram if length == self.window else length
            h = rolling(words, n)
            h[zeros[n:] != zeros[:-n]] = np.iinfo(np.uint64).max
            at = winnow(h, self.window - self.gram + 1) if length == self.window else np.arange(len(h))
            at = at[zeros[at + n] == zeros[at]]
            low = np.searchsorted(known, h[at])
            low[low == len(known)] = 0
            at = at[known[low] == h[at]]
            low, high = np.searchsorted(known, h[at]), np.searchsorted(known, h[at], "right")
            run, within = ragged(high - low)
            p, q = at[run], places[low[run] + within]
            same = np.ones(len(p), bool)
            for i in range(n):
                same &= words[p + i] == self.words[q + i]
            p, q = p[same], q[same]
            left, right = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
            for side, step, begin in ((left, -1, -1), (right, 1, n)):
                going = np.ones(len(p), bool)
                for i in range(self.window - n if length == self.window else 0):
                    x, y = words[p + begin + step * i], self.words[q + begin + step * i]
                    going &= (x == y) & (x > 0)
                    side += going
            enough = left + right + n >= length
            p, q, left, right = p[enough], q[enough], left[enough], right[enough]
            out.append((p - left, p + n + right, self.owner[q]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _laid_out(batch: pa.RecordBatch, text_col: str, index: _Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all words, with gaps; words of each document; where each starts)."""
    gap, lookup = [0] * index.window, index.vocabulary.__getitem__
    ids, counts = list(gap), np.zeros(batch.num_rows, np.int64)
    for i, text in enumerate(texts_of(batch, text_col)):
        words = alnum_words(text)
        counts[i] = len(words)
        ids.extend(map(lookup, words))
        ids.extend(gap)
    start = index.window + np.cumsum(counts + index.window) - counts - index.window
    return np.array(ids, U64), counts, start


def _clean(index: _Index, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, _, start = _laid_out(batch, text_col, index)
            begin, _, _ = index.hits(words)
            kept = np.ones(batch.num_rows, bool)
            kept[np.searchsorted(start, begin, "right") - 1] = False
            yield batch.filter(pa.array(kept))

    return run


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = 10, gram: int = 5, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of any item.

    Cases as for find_contamination; rows without words stay. A map for each block of items; of several
    blocks, one at a time is on the driver, and what it keeps is checkpointed before the next."""
    for items, more in _blocks(benchmark, item_col, item_text_col, block_words):
        docs = docs.mapInArrow(_clean(_Index(items, window, gram), text_col), docs.schema)
        docs = checkpointed(docs) if more else docs
    return docs


def _scan(index: _Index, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(index.names, object)
        for batch in batches:
            words, counts, start = _laid_out(batch, text_col, index)
            begin, end, item = index.hits(words)
            depth = np.zeros(len(words) + 1, np.int64)
            np.add.at(depth, begin, 1)
            np.add.at(depth, end, -1)
            hit = np.concatenate([[False], np.cumsum(depth[:-1]) > 0, [False]])
            edge = np.flatnonzero(hit[1:] != hit[:-1])
            first, last = edge[::2], edge[1::2]
            doc = np.searchsorted(start, first, "right") - 1
            spans = pa.StructArray.from_arrays(
                [pa.array(first - start[doc]), pa.array(last - start[doc])], ["first", "end"]
            )
            pair = np.unique(
                (np.searchsorted(start, begin, "right") - 1) * len(names) + item
            )
            owner, which = (pair // len(names), pair % len(names)) if len(names) else (pair, pair)
            size = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index(id_col)),
                    pa.array(counts),
                    list_array(spans, np.bincount(doc, minlength=size)),
                    list_array(
                        pa.array(names[which].tolist(), pa.string()),
                        np.bincount(owner, minlength=size),
                    ),
                    batch.column(batch.schema.get_field_index("_key")),
                ],
                [id_col, "n_words", "spans", "items", "_key"],
            )

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int):
    """(items, whether there are several blocks); items: a list of (id as text, words), bounded by about
    block_words words. A block is fetched when it is asked for."""
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    items = items.filter("i is not null and t is not null")
    # a word has a byte at least, and a separator
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = max(1, -(-size // (2 * block_words)))
    for b in range(count):
        part = items if count == 1 else items.filter(F.pmod(F.xxhash64("i"), F.lit(count)) == b)
        yield [(r.i, alnum_words(r.t.encode())) for r in part.toLocalIterator()], count > 1


def _merged(spans: Column) -> Column:
    """Overlapping and touching spans made one."""
    return F.aggregate(
        F.array_sort(spans),
        F.expr("cast(array() as array<struct<first:bigint,end:bigint>>)"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["first"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.named_struct(
                        F.lit("first"), F.try_element_at(done, F.lit(-1))["first"],
                        F.lit("end"), F.greatest(F.try_element_at(done, F.lit(-1))["end"], x["end"]),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    gram: int = 5,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document row: id, n_words, spans (first, end: word places, end excluded),
    items (ids of the items met, as sorted strings).

    Null or empty text: no words, no spans. An item of fewer than ``window`` words but not
    none is one window of its own length; null item ids or texts take no part; repeated items
    count once; equal document rows give equal result rows. The benchmark is broadcast in
    blocks of bounded size: one scan of the documents for each block, merged by document. Of several
    blocks, one at a time is on the driver, and its hits are checkpointed before the next.
    """
    rows = docs.select(F.col(id_col), F.col(text_col))
    plain = rows.withColumn("_key", F.lit(None).cast("string"))
    keyed = rows.withColumn("_key", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"`{id_col}` {kind}, n_words bigint, spans array<struct<first:bigint,end:bigint>>, "
        "items array<string>, _key string"
    )
    parts = []
    for items, more in _blocks(benchmark, item_col, item_text_col, block_words):
        hits = (keyed if more else plain).mapInArrow(_scan(_Index(items, window, gram), id_col, text_col), schema)
        parts.append(checkpointed(hits) if more else hits)
    if len(parts) == 1:
        found = parts[0]
        return found.select(
            id_col, "n_words", "spans", F.array_sort(F.array_distinct("items")).alias("items")
        )
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = found.groupBy(id_col, "_key").agg(
        F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.flatten(F.collect_list("items")).alias("items"),
        (F.count(F.lit(1)) / len(parts)).cast("int").alias("copies"),
    )
    return found.select(
        id_col,
        "n_words",
        _merged(F.col("spans")).alias("spans"),
        F.array_sort(F.array_distinct("items")).alias("items"),
        F.explode(F.sequence(F.lit(1), "copies")).alias("_copy"),
    ).drop("_copy")
