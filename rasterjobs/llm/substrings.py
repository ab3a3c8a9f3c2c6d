"""Exact substring dedup over windows of words, by super-k-mer partitioning.

Every window of ``window`` words has a minimiser: the least hash of its ``GRAM`` consecutive
words. Consecutive windows with the same minimiser travel together as one packed string of
words to the bucket of that minimiser, so equal windows meet in one bucket while a text is
moved about three times instead of ``window`` times. Equal strings of a batch travel once,
with the places where they stand. In its bucket every window is hashed to 128 bits and sorted;
the least document of each distinct window tells which places repeat an earlier document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    U64, byte_slices, checkpointed, free_shuffles, list_array, mix, partitions, plain_words, planes, ragged, rolling, span_hashes, texts_of,
    unplanes, window_hashes,
)
from .words import BLOCK, Block, block_of, parts_of

#: Consecutive words whose hash is a candidate for the minimiser.
GRAM = 3
#: Text bytes whose super-k-mers are packed together; it bounds a worker's memory.
PACK = 24 << 20
#: Text bytes to a bucket, on average at most.
BUCKET = 64 << 20
#: All white space made blanks, so that line feeds can stand between strings.
PLAIN = bytes(0x20 if 0x09 <= c <= 0x0D else c for c in range(256))
_RANGES = "id bigint, mark bigint, first bigint, end bigint"


def mark_of(text: bytes) -> int:
    """Tells texts apart that have the same id."""
    return xxhash.xxh32_intdigest(text)


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h) - width + 1
    low = h[:n].copy()
    for i in range(1, width):
        np.minimum(low, h[i : i + n], out=low)
    return low


class _Packer:
    """Super-k-mers of several documents, by bucket."""

    def __init__(self, window: int, buckets: int):
        self.window, self.buckets = window, buckets
        self.clear()

    def clear(self) -> None:
        self.docs: list[tuple[int, int]] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, docs: list[int | None], texts: list[bytes | None]) -> None:
        """Cuts texts of about BLOCK bytes in all, or parts of a longer text."""
        live = [i for i, t in enumerate(texts) if t]
        first = len(self.docs)
        self.docs += [(docs[i], mark_of(texts[i])) for i in live]
        held, size, begin = [], 0, 0
        for k, i in enumerate(live):
            if held and size + len(texts[i]) > BLOCK:
                self._cut(b"\n".join(held), [len(x) for x in held], first + begin, 0)
                held, size, begin = [], 0, k
            if len(texts[i]) > BLOCK:
                self._long(texts[i], first + k)
                begin = k + 1
            else:
                held.append(texts[i])
                size += len(texts[i])
        if held:
            self._cut(b"\n".join(held), [len(x) for x in held], first + begin, 0)

    def _long(self, text: bytes, number: int) -> None:
        """Parts overlap by a window less one word, so each window is in one part."""
        tail, place = b"", 0
        for part in parts_of(text, BLOCK):
            whole = tail + b"\n" + part if tail else part
            words = self._cut(whole, [len(whole)], number, place)
            back = min(self.window - 1, len(words.start))
            tail = whole[words.start[-back] :] if back else b""
            place += len(words.start) - back

    def _cut(self, text: bytes, sizes: list[int], first: int, place: int) -> Block:
        text = text.translate(PLAIN)
        words, w = block_of(text), self.window
        n = len(words.start) - w + 1
        if n <= 0:
            return words
        doc = np.searchsorted(np.cumsum(np.array(sizes) + 1), words.start, "right")
        low = _sliding_min(rolling(words.hashes, GRAM), w - GRAM + 1)
        whole = doc[:n] == doc[w - 1 :]
        new = np.ones(n, bool)
        new[1:] = (low[1:] != low[:-1]) | (doc[1:n] != doc[: n - 1]) | ~whole[:-1]
        starts = np.flatnonzero(new & whole)
        edge = np.flatnonzero(np.append(new | ~whole, True))
        ends = edge[np.searchsorted(edge, starts, "right")]  # the next start, or the end of whole windows
        before = np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1])  # first word of each text that has words
        local = starts - before[np.searchsorted(before, starts, "right") - 1]
        a, b = words.start[starts], words.end[ends + w - 2]
        # strings are told apart by their words' hashes and count
        name = span_hashes(words.hashes, starts, ends + w - 1)
        self.parts.append((text, a, b, low[starts], name, doc[starts] + first, local + place))
        self.size += len(text)
        return words

    def rows(self) -> pa.RecordBatch | None:
        parts, docs = self.parts, self.docs
        self.clear()
        if not parts:
            return None
        base = np.cumsum([0, *(len(p[0]) for p in parts)])
        data = np.frombuffer(b"".join(p[0] for p in parts), np.uint8)
        a, b = (np.concatenate([p[k] + at for p, at in zip(parts, base, strict=False)]) for k in (1, 2))
        low, name, doc, local = (np.concatenate([p[k] for p in parts]) for k in (3, 4, 5, 6))
        del parts
        ids, marks = (np.array(x) for x in zip(*docs, strict=True))
        bucket = (mix(low) % U64(self.buckets)).astype(np.int64)
        order = np.lexsort((name, low, bucket))  # equal strings together, those of a minimiser near each other
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        squeeze = zstandard.ZstdCompressor(level=6).compress
        out = {k: [] for k in ("bucket", "strings", "counts", "places")}
        for k in np.flatnonzero(np.diff(edges)).tolist():
            own = order[edges[k] : edges[k + 1]]
            head = np.flatnonzero(np.concatenate([[True], (name[own][1:] != name[own][:-1]) | (low[own][1:] != low[own][:-1])]))
            x, y = a[own[head]], b[own[head]]
            run, within = ragged(y - x + 1)
            at = x[run] + within
            text = data[np.minimum(at, len(data) - 1)]
            text[np.cumsum(y - x + 1) - 1] = 10
            known, where = np.unique(doc[own], return_inverse=True)
            body = [ids[known].astype(np.int64), marks[known].astype(np.uint32), where.astype(np.uint32), local[own].astype(np.uint32)]
            out["bucket"].append(k)
            out["strings"].append(squeeze(text[:-1].tobytes()))
            out["counts"].append(squeeze(planes(np.diff(np.append(head, len(own))).astype(np.uint32))))
            out["places"].append(squeeze(b"".join([np.array([len(known), len(own)], np.int64).tobytes(), *map(planes, body)])))
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out.values(), kinds, strict=True)], list(out))


def _pack(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(window, buckets)
        for batch in byte_slices(batches, 1):
            packer.add(batch.column(0).to_pylist(), texts_of(batch, "_text"))
            if packer.size >= PACK and (rows := packer.rows()):
                yield rows
        if rows := packer.rows():
            yield rows

    return run


def _repeats(window: int):
    """All rows of a bucket to ranges of words that repeat an earlier document's."""

    def run(table: pa.Table) -> pa.Table:
        grow = zstandard.ZstdDecompressor().decompress
        firsts, seconds, least, kept = [], [], [], []
        for strings, counts, places in zip(*(table.column(k).to_pylist() for k in ("strings", "counts", "places")), strict=True):
            text = grow(strings)
            words = block_of(text)
            ends = np.append(np.flatnonzero(words.data == 10), len(text))
            sizes = np.diff(np.searchsorted(words.start, ends), prepend=0)
            values = words.hashes
            del words, text
            # windows of a string: all but those that run into the next one
            string, within = ragged(sizes - window + 1)
            at = (np.cumsum(sizes) - sizes)[string] + within
            firsts.append(window_hashes(values, window)[at])
            seconds.append(window_hashes(values, window, 0xD6E8FEB86659FD93)[at])
            body = grow(places)
            n_docs, n = np.frombuffer(body, np.int64, 2).tolist()
            cuts = np.cumsum([16, 8 * n_docs, 4 * n_docs, 4 * n, 4 * n]).tolist()
            ids, marks, doc, start = (
                unplanes(body[x:y], kind) for x, y, kind in zip(cuts, cuts[1:], (np.int64, *[np.uint32] * 3), strict=False)
            )
            per = unplanes(grow(counts), np.uint32).astype(np.int64)
            low = np.minimum.reduceat(ids[doc], np.cumsum(per) - per)
            least.append(low[string])
            kept.append((sizes - window + 1, per, ids, marks, doc, start))
        first, second, low = (np.concatenate(x) for x in (firsts, seconds, least))
        firsts.clear(), seconds.clear(), least.clear()
        order = np.argsort(first)
        head = np.concatenate([[True], first[order[1:]] != first[order[:-1]]])
        if (second[order[1:]] != second[order[:-1]])[~head[1:]].any():  # the first 64 bits do not tell them apart
            order = np.lexsort((second, first))
            head = np.concatenate([[True], (first[order[1:]] != first[order[:-1]]) | (second[order[1:]] != second[order[:-1]])])
        head = np.flatnonzero(head)
        del first, second
        best = np.empty(len(order), np.int64)
        best[order] = np.repeat(np.minimum.reduceat(low[order], head), np.diff(np.append(head, len(order))))
        del order, low
        out, begin = [], 0
        for windows, per, ids, marks, doc, start in kept:
            own = best[begin : begin + windows.sum()]
            begin += len(own)
            base = np.cumsum(windows) - windows
            string = np.repeat(np.arange(len(per)), per)
            # a place can repeat something only if its string has an earlier window than its document
            earlier = np.minimum.reduceat(own, base)[string] < ids[doc]
            string, doc, start = string[earlier], doc[earlier], start[earlier].astype(np.int64)
            place, within = ragged(windows[string])
            hit = own[base[string][place] + within] < ids[doc][place]
            place, within = place[hit], within[hit]
            if not len(place):
                continue
            new = np.concatenate([[True], (place[1:] != place[:-1]) | (within[1:] != within[:-1] + 1)])
            last = np.append(np.flatnonzero(new)[1:] - 1, len(place) - 1)
            p = place[new]
            out.append((ids[doc[p]], marks[doc[p]].astype(np.int64), start[p] + within[new], start[p] + within[last] + window))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
        return pa.table([pa.array(c) for c in cols], names=["id", "mark", "first", "end"])

    return run


def _unite(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching ranges made one."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], first[1:] > reach[:-1]])
    return first[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(first) - 1)]


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, removed, kept, spans, per = [], [], [], [], []
        marks, firsts, ends = (batch.column(i).to_pylist() for i in (2, 3, 4))
        for i, text in enumerate(texts_of(batch, "_text")):
            words, gone, own = plain_words(text), 0, []
            counts.append(len(words))
            if marks[i] is not None:
                same = np.array(marks[i]) == mark_of(text or b"")
                if same.any():
                    a, b = _unite(np.array(firsts[i])[same], np.array(ends[i])[same])
                    own = [{"first": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                    gone = int((b - a).sum())
                    edges = [0, *(x for s in own for x in (s["first"], s["end"])), len(words)]
                    words = [w for x, y in zip(edges[::2], edges[1::2], strict=True) for w in words[x:y]]
            removed.append(gone)
            kept.append(b" ".join(words))
            spans += own
            per.append(len(own))
        kind = pa.struct([("first", pa.int64()), ("end", pa.int64())])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                list_array(pa.array(spans, kind), per), pa.array(kept, pa.binary()).cast(pa.string()),
            ],
            ["_id", "n_words", "n_removed", "spans", "kept"],
        )


def drop_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13, buckets: int | None = None
) -> DataFrame:
    """One row per document row: id, n_words, n_removed, spans (first, end: removed words), kept
    (the words left, joined by one blank).

    A word goes if some window of ``window`` words that covers it also starts in a document of
    smaller id; windows are those of the input. Null, empty and short texts have no windows. Of
    rows with the same id none is the earlier one; rows with a null id lose nothing and are no
    source. ids are whole numbers. ``buckets``: if not given, twice spark.sql.shuffle.partitions, or
    more for texts of over BUCKET bytes each.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    packed = rows.filter("_id is not null and _text is not null").select(F.col("_id").cast("bigint"), "_text")
    if buckets is None:
        size = packed.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
        buckets = max(2 * partitions(spark), -(-size // BUCKET))
    packed = packed.mapInArrow(_pack(window, buckets), "bucket bigint, strings binary, counts binary, places binary")
    ranges = packed.groupBy("bucket").applyInArrow(_repeats(window), _RANGES)
    spans = checkpointed(
        ranges.groupBy("id").agg(
            F.collect_list("mark").alias("marks"), F.collect_list("first").alias("firsts"), F.collect_list("end").alias("ends")
        )
    )
    free_shuffles(spark)
    kind = rows.schema["_id"].dataType.simpleString()
    return (
        rows.join(spans, rows["_id"].cast("bigint") == spans["id"], "left")
        .select("_id", "_text", "marks", "firsts", "ends")
        .mapInArrow(
            _apply,
            f"_id {kind}, n_words bigint, n_removed bigint, spans array<struct<first:bigint,end:bigint>>, kept string",
        )
        .withColumnRenamed("_id", id_col)
    )
