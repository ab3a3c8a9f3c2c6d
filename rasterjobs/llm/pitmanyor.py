"""Language-model scoring with a hierarchical Pitman-Yor model over bytes.

A text is its lower-cased words with one blank between them and an end mark. Each byte is a
customer of the restaurant of the ``ORDER`` bytes before it; a table of a restaurant is a
customer of its parent, the restaurant of the context without its first byte, so contexts
with the same end share parents, down to the empty context and a uniform base. The seating is
sampled: in a sweep all customers of a dish are taken out of their restaurant and seated again,
one after another, given all other dishes' tables and the parent's predictive probability
(the first SINGLY one by one, later ones in blocks of an eighth of those seated, in which tables are
as likely as in the block's middle). After the burn-in
the predictive probabilities of several sweeps are averaged.

In Spark: texts are dealt to chunks; each chunk sends its distinct n-grams, with their counts in
training texts, to the bucket of their last two context bytes, where whole subtrees of
restaurants meet. A bucket sums the counts, samples its seating and answers each chunk with the
log-probabilities of its n-grams. Only the restaurants of one context byte or none, 256 x 256
dishes at most, are sampled on the driver. Words travel likewise for the base score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytegrams import Known, Table, chunks, counted, grams
from .common import U64, checkpointed, free_shuffles, lower_words, partitions, planes, unplanes
from .words import hashed

#: Bytes of context, and the discount and strength of restaurants by their context's length.
ORDER = 6
DISCOUNT = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
STRENGTH = (20.0, 10.0, 4.0, 2.0, 1.0, 1.0, 1.0)
#: Sweeps before the first kept one, and kept sweeps.
BURN_IN, KEPT = 3, 4
#: Customers of a dish that are seated one by one.
SINGLY = 64
END_WORD = b"\n"
#: Stands for the end among the hashes of words.
END = U64(xxhash.xxh3_64_intdigest(END_WORD))
#: Steps of a log10 probability in a bucket's answers.
STEP = 2.0**-15
#: Text bytes to a chunk, on average at most.
CHUNK_BYTES = 32 << 20


class Fitted(NamedTuple):
    """The restaurants of at most one context byte: predictive probabilities (sample, byte, byte)."""

    upper: np.ndarray
    seed: int


def _low_bytes(n: int) -> np.uint64:
    return U64((1 << (8 * n)) - 1)


def seat(c: np.ndarray, strength: np.ndarray, discount: float, parent: np.ndarray, draw) -> np.ndarray:
    """Tables of each dish after its c >= 1 customers sat down.

    A new table is taken with weight (strength + discount * tables) * parent, an old one with
    the customers there less a discount."""
    t = np.ones(len(c))
    at = np.flatnonzero(c > 1)
    at = at[np.argsort(-c[at], kind="stable")]  # who has more customers comes first, so the live ones are a prefix
    own, own_t = c[at], np.ones(len(at))
    fixed, grows, rise, seated, live = strength[at] * parent[at], discount * parent[at], -c[at], 1, len(at)
    while live:
        now, step = own_t[:live], 1 if seated < SINGLY else max(1, seated // 8)
        new = fixed[:live] + grows[:live] * now
        if step == 1:
            now += draw.random(live, dtype=np.float32) * (seated - discount * now + new) < new
        else:
            block = np.minimum(step, own[:live] - seated)
            now += draw.binomial(block, np.minimum(new / (seated + block / 2 - discount * now + new), 1))
        seated += step
        live = int(np.searchsorted(rise, -seated))
    t[at] = own_t
    return t


class Restaurants:
    """Those of 2 to ORDER context bytes, for all contexts of a bucket."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.c, self.keys, self.of, self.contexts, self.up = {ORDER: counts.astype(np.int64)}, {ORDER: keys}, {}, {}, {}
        for n in range(ORDER, 1, -1):
            self.contexts[n], self.of[n] = np.unique(self.keys[n] >> U64(8), return_inverse=True)
            if n > 2:
                self.keys[n - 1], self.up[n] = np.unique(self.keys[n] & _low_bytes(n), return_inverse=True)
        self.t = {n: np.ones(len(self.keys[n])) for n in self.keys}
        for n in range(ORDER, 2, -1):
            self._send(n)
        last = self.keys[2]
        self.byte, self.dish = ((last >> U64(8)) & U64(255)).astype(int), (last & U64(255)).astype(int)
        self.samples: list[tuple[dict, dict, np.ndarray]] = []

    def _send(self, n: int) -> None:
        """Tables become the customers of the parents."""
        self.c[n - 1] = np.bincount(self.up[n], self.t[n], minlength=len(self.keys[n - 1])).astype(np.int64)

    def predict(self, upper: np.ndarray) -> tuple[dict, dict]:
        """(probability of each dish, share left to the parent of each context), by level."""
        p, rest, parent = {}, {}, upper[self.byte, self.dish]
        for n in range(2, ORDER + 1):
            if n > 2:
                parent = p[n - 1][self.up[n]]
            size = len(self.contexts[n])
            whole = STRENGTH[n] + np.bincount(self.of[n], self.c[n], minlength=size)
            rest[n] = (STRENGTH[n] + DISCOUNT[n] * np.bincount(self.of[n], self.t[n], minlength=size)) / whole
            own = (self.c[n] - DISCOUNT[n] * self.t[n]) / whole[self.of[n]]
            p[n] = own + rest[n][self.of[n]] * parent
        return p, rest

    def sweep(self, p: dict, upper: np.ndarray, draw) -> None:
        for n in range(ORDER, 1, -1):
            parent = p[n - 1][self.up[n]] if n > 2 else upper[self.byte, self.dish]
            others = np.bincount(self.of[n], self.t[n])[self.of[n]] - self.t[n]
            self.t[n] = seat(self.c[n], STRENGTH[n] + DISCOUNT[n] * others, DISCOUNT[n], parent, draw)
            if n > 2:
                self._send(n)

    def sample(self, upper: np.ndarray, draw) -> None:
        p, _ = self.predict(upper[0])
        for i in range(BURN_IN + KEPT):
            now = upper[max(0, i - BURN_IN) % len(upper)]
            self.sweep(p, now, draw)
            p, rest = self.predict(now)
            if i >= BURN_IN:
                self.samples.append((p, rest, now))

    def log10(self, asked: np.ndarray) -> np.ndarray:
        """log10 of the averaged predictive probability of n-grams (ORDER + 1 bytes each)."""
        out = np.ones((len(self.samples), len(asked)))
        todo = np.arange(len(asked))
        for n in range(ORDER, 1, -1):
            key = asked[todo] & _low_bytes(n + 1)
            at, found = _place(self.keys[n], key)
            for s, (p, _, _) in enumerate(self.samples):
                out[s, todo[found]] *= p[n][at[found]]
            todo, key = todo[~found], key[~found]
            at, found = _place(self.contexts[n], key >> U64(8))
            for s, (_, rest, _) in enumerate(self.samples):
                out[s, todo[found]] *= rest[n][at[found]]
        byte, dish = ((asked[todo] >> U64(8)) & U64(255)).astype(int), (asked[todo] & U64(255)).astype(int)
        for s, (_, _, upper) in enumerate(self.samples):
            out[s, todo] *= upper[byte, dish]
        return np.log10(out.mean(axis=0))


def _place(known: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(key), int), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    return at, known[at] == key


def upper_restaurants(c: np.ndarray, seed: int) -> np.ndarray:
    """Samples of the predictive probabilities (byte, byte) given the customers c (byte, byte)."""
    draw, (u, w) = np.random.default_rng(seed), np.nonzero(c)
    c, t, out = c[u, w].astype(np.int64), np.ones(len(u)), []
    p0, t0 = np.full(256, 1 / 256), np.ones(256)
    for i in range(2 * BURN_IN + KEPT):
        c0 = np.bincount(w, t, minlength=256).astype(np.int64)
        live = c0 > 0
        others = (t0[live].sum() - t0[live])
        t0 = np.zeros(256)
        t0[live] = seat(c0[live], STRENGTH[0] + DISCOUNT[0] * others, DISCOUNT[0], np.full(live.sum(), 1 / 256), draw)
        p0 = (c0 - DISCOUNT[0] * t0 + (STRENGTH[0] + DISCOUNT[0] * t0.sum()) / 256) / (STRENGTH[0] + c0.sum())
        others = np.bincount(u, t, minlength=256)[u] - t
        t = seat(c, STRENGTH[1] + DISCOUNT[1] * others, DISCOUNT[1], p0[w], draw) if len(c) else t
        whole = STRENGTH[1] + np.bincount(u, c, minlength=256)
        rest = (STRENGTH[1] + DISCOUNT[1] * np.bincount(u, t, minlength=256)) / whole
        p1 = rest[:, None] * p0[None, :]
        p1[u, w] += (c - DISCOUNT[1] * t) / whole[u]
        if i >= 2 * BURN_IN:
            out.append(p1)
    return np.stack(out)


def _shrink(body: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(body)


def _grow(body: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(body)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as compressed differences."""
    return _shrink(planes(np.diff(keys, prepend=U64(0))))


def _unpack(body: bytes) -> np.ndarray:
    return np.cumsum(unplanes(_grow(body), U64), dtype=U64)


def _line(text: bytes | None) -> bytes:
    return b" ".join(lower_words(text)) + END_WORD


def _bucket_of(keys: np.ndarray, kind: int, buckets: int) -> np.ndarray:
    """kind 0: n-grams, by their last two context bytes; kind 1: hashes of words."""
    of = (keys >> U64(8)) & U64(0xFFFF) if kind == 0 else keys
    return ((of * U64(0x9E3779B97F4A7C15)) >> U64(33)) % U64(buckets)


def _distinct_grams(lines: list[bytes], weight: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-grams of lines, with their counts times ``weight``."""
    parts = [counted(grams(data, ORDER + 1)[places - ORDER]) for data, places, _ in chunks(lines, ORDER)]
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, U64), np.empty(0, np.int64))
    keys, n = counted(keys, n)
    return keys, n * weight


def _by_bucket(keys: np.ndarray, kind: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts keys by bucket and, within it, as they are; where each bucket begins)."""
    where = _bucket_of(keys, kind, buckets)
    order = np.argsort(where, kind="stable")
    return order, np.searchsorted(where[order], np.arange(buckets + 1))


def _gathered(buckets: int):
    """A chunk's texts to rows (kind, bucket, chunk, keys, n): distinct keys, training counts."""

    def run(table: pa.Table) -> pa.Table:
        chunk, trains = table.column("_chunk")[0].as_py(), table.column("_trains").to_pylist()
        texts = table.column("_text").cast(pa.binary()).to_pylist()
        found: dict[int, list] = {0: [], 1: []}
        for mine in (True, False):
            lines = [_line(t) for t, x in zip(texts, trains, strict=True) if x is mine]
            for group in _groups(lines):
                h, n = counted(hashed(group)[0])
                found[1] += [(h, n * mine), (np.array([END]), np.array([len(group) * mine]))]
            found[0].append(_distinct_grams(lines, int(mine)))
        out = []
        for kind, parts in found.items():
            keys, n = counted(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else (np.empty(0, U64),) * 2
            order, cuts = _by_bucket(keys, kind, buckets)
            for b in range(buckets):
                own = order[cuts[b] : cuts[b + 1]]
                if len(own):
                    out.append((kind, b, chunk, _pack(keys[own]), _shrink(planes(n[own].astype(np.uint32)))))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["kind", "bucket", "chunk", "keys", "n"])

    return run


def _groups(lines: list[bytes], most: int = 1 << 23) -> Iterator[list[bytes]]:
    group, size = [], 0
    for x in lines:
        group.append(x)
        size += len(x)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """(keys seen in training, their counts, keys asked by each chunk)."""
    asked = [(c, _unpack(k)) for c, k in zip(table.column("chunk").to_pylist(), table.column("keys").to_pylist(), strict=True)]
    n = [unplanes(_grow(x), np.uint32).astype(np.int64) for x in table.column("n").to_pylist()]
    keys, n = counted(np.concatenate([k for _, k in asked]), np.concatenate(n))
    return keys[n > 0], n[n > 0], asked


def _tables_up(fitted: Fitted | None, seed: int):
    """A bucket's customers of the restaurants with one context byte: (pair, customers)."""

    def run(table: pa.Table) -> pa.Table:
        keys, n, _ = _summed(table)
        own = Restaurants(keys, n)
        if fitted is not None and len(keys):
            own.sample(fitted.upper, np.random.default_rng([seed, table.column("bucket")[0].as_py()]))
        pair, c = counted(own.keys[2] & _low_bytes(2), own.t[2].astype(np.int64))
        return pa.table([pa.array(pair.astype(np.int64)), pa.array(c)], names=["pair", "c"])

    return run


def _answers(fitted: Fitted):
    """Replies (kind, bucket, chunk, keys, values): counts of words by their keys; log10 probabilities
    of n-grams, in whole steps of STEP, in the order in which the chunk asked, without keys, which
    it can make again."""

    def run(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        keys, n, asked = _summed(table)
        if kind == 0:
            own = Restaurants(keys, n)
            own.sample(fitted.upper, np.random.default_rng([fitted.seed, bucket]))
            values = [planes(np.round(-own.log10(k) / STEP).astype(np.uint32)) for _, k in asked]
        else:
            values = []
            for _, k in asked:
                at, found = _place(keys, k)
                values.append(planes(np.where(found, n[at] if len(n) else 0, 0).astype(np.int64)))
        return pa.table(
            [
                pa.array([kind] * len(asked), pa.int32()), pa.array([bucket] * len(asked), pa.int32()),
                pa.array([c for c, _ in asked], pa.int32()), pa.array([_pack(k) if kind else None for _, k in asked], pa.binary()), pa.array([_shrink(v) for v in values], pa.binary()),
                pa.array([len(n) if i == 0 and kind else 0 for i in range(len(asked))], pa.int64()),
                pa.array([int(n.sum()) if i == 0 and kind else 0 for i in range(len(asked))], pa.int64()),
            ],
            names=["kind", "bucket", "chunk", "keys", "values", "distinct", "total"],
        )

    return run


def _scored(names: list[str], buckets: int):
    """A chunk's texts and its replies to sums for each text."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        size, lines = docs.num_rows, [_line(t) for t in docs.column("_text").cast(pa.binary()).to_pylist()]
        keys, _ = _distinct_grams(lines)
        order, _ = _by_bucket(keys, 0, buckets)
        mine = replies.filter(pa.compute.equal(replies.column("kind"), 0)).sort_by("bucket").column("values").to_pylist()
        values = np.concatenate([np.empty(0, np.uint32), *(unplanes(_grow(v), np.uint32) for v in mine)])
        if len(values) != len(keys):
            raise ValueError("a bucket's answer is missing")
        known = Known(keys[order], (values * -STEP).astype(np.float32))
        mine = replies.filter(pa.compute.equal(replies.column("kind"), 1))
        keys = np.concatenate([np.empty(0, U64), *(_unpack(k) for k in mine.column("keys").to_pylist())])
        counts = Table(keys, np.concatenate([np.empty(0, np.int64), *(unplanes(_grow(v), np.int64) for v in mine.column("values").to_pylist())]))
        del keys, values, mine, order
        end = int(counts.values[counts.find(np.array([END]))][0])
        tokens, n_known, base, score, begin = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size), np.zeros(size), 0
        for group in _groups(lines):
            h, per = hashed(group)
            c = counts.values[counts.find(h)]
            own, ends = slice(begin, begin + len(group)), np.cumsum(per)
            summed = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])  # noqa: B023, E731
            tokens[own], n_known[own] = per + 1, summed(c > 0) + (end > 0)
            base[own] = summed(np.log10(c + 0.5)) + np.log10(end + 0.5)
            for data, places, owner in chunks(group, ORDER):
                p = known.find(grams(data, ORDER + 1)[places - ORDER]).astype(np.float64)
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                score[begin + owner[first]] += np.add.reduceat(p, first)
            begin += len(group)
        lengths = np.array([len(x) for x in lines], np.int64)
        new = [pa.array(x) for x in (tokens, n_known, lengths, base, score)]
        return pa.table(
            [*(docs.column(n) for n in names), *new],
            names=[*names, "n_tokens", "n_known", "n_bytes", "_base", "score"],
        )

    return run


def score(
    docs: DataFrame, trains: Column, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
    chunk_count: int | None = None, seed: int = 11,
) -> DataFrame:
    """One row per document row: ``keep`` columns (the id), n_tokens, n_known (tokens that training
    texts hold), n_bytes, train_tokens, base_score (log10, unigrams with add-a-half) and score
    (log10 probability of the text). 10 ** (-score / n_tokens) is its perplexity.

    ``trains`` tells the rows that are learned from (null: not). Null, empty and blank texts are
    the end token alone. Repeated rows each count. Without training rows the base is uniform over
    bytes. All counts cover all texts; ``chunk_count`` (spark.sql.shuffle.partitions, if not
    given, or more for texts of over CHUNK_BYTES each) sets how many parts the texts are dealt to by
    hash, not what is counted. The same rows give the same result whatever their order.
    """
    spark, keep = docs.sparkSession, keep or [id_col]
    if chunk_count is None:
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        chunk_count = max(partitions(spark), -(-size // CHUNK_BYTES))
    buckets = 2 * chunk_count
    rows = docs.select(
        *keep, F.col(text_col).alias("_text"), F.coalesce(trains, F.lit(False)).alias("_trains"),
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(chunk_count)).cast("int").alias("_chunk"),
    )
    packed = rows.select("_chunk", "_trains", "_text").groupBy("_chunk").applyInArrow(
        _gathered(buckets), "kind int, bucket int, chunk int, keys binary, n binary"
    )
    packed = checkpointed(packed)
    free_shuffles(spark)
    own = packed.filter("kind = 0").groupBy("bucket")
    fitted = pairs = None
    for step in range(2):  # tables at first one a dish, then sampled
        pairs = own.applyInArrow(_tables_up(fitted, seed + step), "pair bigint, c bigint")
        c = np.zeros((256, 256))
        for r in pairs.groupBy("pair").agg(F.sum("c").alias("c")).collect():  # at most 256 * 256
            c[r["pair"] >> 8, r["pair"] & 255] = r["c"]
        fitted = Fitted(upper_restaurants(c, seed + step), seed + 2)
        free_shuffles(spark)
    replies = packed.groupBy("kind", "bucket").applyInArrow(
        _answers(fitted), "kind int, bucket int, chunk int, keys binary, values binary, distinct bigint, total bigint"
    )
    replies = checkpointed(replies)
    del packed, own, pairs
    free_shuffles(spark)
    words = replies.agg(F.sum("distinct").alias("v"), F.sum("total").alias("n")).first()
    n, v = words["n"] or 0, words["v"] or 0
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]]
    sums = rows.drop("_trains").groupBy("_chunk").cogroup(
        replies.select(F.col("chunk").alias("_chunk"), "kind", "bucket", "keys", "values").groupBy("_chunk")
    )
    new = "n_tokens bigint, n_known bigint, n_bytes bigint, _base double, score double"
    found = sums.applyInArrow(_scored(keep, buckets), ", ".join([*fields, new]))
    base = F.col("_base") - F.col("n_tokens") * F.log10(F.lit(n + 0.5 * (v + 1)))
    return found.select(
        *keep, "n_tokens", "n_known", "n_bytes", F.lit(n).cast("bigint").alias("train_tokens"),
        base.alias("base_score"), "score",
    )
