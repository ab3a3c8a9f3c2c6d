"""Near-duplicates by MinHash: banding, verification and connected components.

Documents are sets of hashed word shingles. Equal sets form a class and go on as one. Each
class has ``bands * rows`` minima under universal hashes; classes that agree in all rows of
some band share a bucket. Links are then confirmed, first on the signatures and then on the
full sets, without making all pairs of a bucket:

* every class is compared with the least class of each bucket that it is in;
* what is linked so becomes components; buckets whose members are all in one component are
  done, since nothing more could change there;
* in the other buckets the members outside the largest component are compared with all others,
  blocks of members against blocks, and no pair leaves its task: a first pass over signatures
  tells which members of a block have a partner in another component that they may be similar
  to (each pair counts in the first band that it shares); only their full sets are fetched, and
  a second pass confirms the pairs and returns those links that join something new in the block.
  Nothing is capped.

With 32 bands of 5 rows a pair of similarity 0.8 shares no bucket with probability 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, byte_slices, checkpointed, free_shuffles, mix, rolling, texts_of
from .components import components
from .words import hashed

BANDS, ROWS = 32, 5
#: Signatures may estimate the similarity too low by so much (over 5 standard deviations).
SLACK = 0.18
#: Ids that are broadcast to pick the documents whose sets are compared; beyond, a shuffle join.
BROADCAST_IDS = 1_000_000
#: Members compared with one copy of a pivot's set; a hot pivot is copied to more tasks.
MEMBERS = 256
#: Members of a bucket that meet in one task, those that ask and those that are asked, and their shingles.
ASKING, ASKED, SHINGLES = 2048, 8192, 4_000_000


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def shingles(texts: list[bytes | None], size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of ``size`` consecutive words (lower-cased); fewer
    words are one shingle, none are none."""
    values, counts = hashed(texts, bytes.lower)
    whole, begin = rolling(values, size), 0
    for n in counts.tolist():
        if n >= size:
            yield _distinct(whole[begin : begin + n - size + 1])
        else:
            yield rolling(values[begin : begin + n], n) if n else np.empty(0, U64)
        begin += n


def _multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """(odd multiplier, addend) of each universal hash, from a fixed seed."""
    draw = np.random.default_rng(20_240_607)
    a = draw.integers(0, 1 << 31, count, dtype=np.uint32) << np.uint32(1) | np.uint32(1)
    return a[:, None], draw.integers(0, 1 << 32, count, dtype=np.uint32)[:, None]


def signature(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of a x + b modulo 2**32 over the upper halves x of the items, for each hash."""
    x = (items >> U64(32)).astype(np.uint32)
    low = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(x), 256):
        np.minimum(low, (a * x[k : k + 256] + b).min(axis=1), out=low)
    return low


def class_of(items: np.ndarray) -> int:
    """A signed 64-bit name of a set (two of 1e9 different sets collide with probability 0.03)."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(items.tobytes(), len(items))).astype(np.int64))


def _mapped(size: int, count: int, with_sets: bool):
    """Rows (_id, _text) to (id, class, number of shingles, signature[, set])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _multipliers(count)
        for batch in byte_slices(batches, 1):
            out = [[], [], [], []]
            for items in shingles(texts_of(batch, "_text"), size):
                out[0].append(class_of(items) if len(items) else None)
                out[1].append(len(items))
                out[2].append(signature(items, a, b).tobytes() if len(items) else None)
                if with_sets:
                    out[3].append(items.tobytes())
            arrays = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())]
            names = ["_id", "cls", "n", "sig"]
            if with_sets:
                arrays, names = [*arrays, pa.array(out[3], pa.binary())], [*names, "items"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _buckets(bands: int, rows: int):
    """(cls, sig) to (bucket, band, cls), a row for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cls = np.asarray(batch.column(0))
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, bands, rows)
            h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
            for r in range(rows):
                h = mix(h * U64(0x9E3779B97F4A7C15) + sig[:, :, r])
            band = np.tile(np.arange(bands, dtype=np.int32), n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.ravel().astype(np.int64)), pa.array(band), pa.array(np.repeat(cls, bands))], ["bucket", "band", "cls"]
            )

    return run


def _confirm(threshold: float):
    """Rows sorted by (a, salt), the pivot's own first: links (a, b) that hold on full sets."""
    hundredths = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, sig, items = None, None, None
        for batch in batches:
            a, b, sigs, sets = (batch.column(i).to_pylist() for i in (0, 1, 2, 3))
            left, right = [], []
            for i in range(batch.num_rows):
                own_sig, own = np.frombuffer(sigs[i], np.uint32), np.frombuffer(sets[i], U64)
                if b[i] is None:
                    pivot, sig, items = a[i], own_sig, own
                    continue
                if a[i] != pivot:
                    raise ValueError("a pivot's set is missing")
                small, large = sorted((len(own), len(items)))
                if 100 * small < hundredths * large or (own_sig == sig).mean() < threshold - SLACK:
                    continue
                same = len(np.intersect1d(own, items, assume_unique=True))
                if 100 * same >= hundredths * (len(own) + len(items) - same):
                    left.append(a[i])
                    right.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["u", "v"])

    return run


def _sets(rows: DataFrame, classes: DataFrame, wanted: DataFrame, size: int, count: int) -> DataFrame:
    """(cls, sig, items) of the wanted classes, from the texts of their least documents, or
    of the rows with a null id where a class has no other."""
    ids = classes.join(wanted, "cls").select(F.col("rep").alias("_id"), F.col("cls").alias("_cls"))
    ids = checkpointed(ids)
    n, nulls = ids.agg(F.count("*"), F.count_if(F.col("_id").isNull())).first()
    near = F.broadcast if n <= BROADCAST_IDS else lambda df: df
    chosen = rows.join(near(ids.select("_id").distinct()), "_id", "left_semi")
    if nulls:  # classes of rows with null ids only; a null never meets a null in a join
        chosen = chosen.unionByName(rows.filter("_id is null"))
    made = chosen.mapInArrow(
        _mapped(size, count, True), "_id string, cls bigint, n bigint, sig binary, items binary".replace(
            "_id string", f"_id {rows.schema['_id'].dataType.simpleString()}")
    )
    made = made.join(near(ids.select("_cls")), made["cls"] == F.col("_cls"), "left_semi")
    return checkpointed(made.groupBy("cls").agg(F.first("sig").alias("sig"), F.first("items").alias("items")))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a: pivot, b: member) that are similar, as (u, v)."""
    copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("copies"))
    own = F.col("b")
    members = (
        pairs.join(copies, "a")
        .withColumn("salt", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int"))
        .join(sets.withColumnRenamed("cls", "b"), "b")
        .select("a", own, "sig", "items", "salt")
    )
    pivots = (
        copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .join(sets.withColumnRenamed("cls", "a"), "a")
        .select("a", F.lit(None).cast("bigint").alias("b"), "sig", "items", "salt")
    )
    rows = members.unionByName(pivots).repartition("a", "salt")
    rows = rows.sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_confirm(threshold), "u bigint, v bigint")


def _grown(found: DataFrame, links: DataFrame) -> DataFrame:
    """found (node, component) after more links: only the components that they join are worked on."""
    end = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    between = links.join(end("u"), "u").join(end("v"), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    joined = components(between).select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return found.join(joined, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))


def _partners(table: pa.Table, bands: int, rows: int, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For members that ask, the members of other components that their signatures let them be similar
    to; each pair once in a bucket, and only in the bucket of the first band that it shares."""
    hundredths = round(threshold * 100)
    role, cls, comp, size, band = (np.asarray(table.column(c)) for c in ("role", "cls", "component", "n", "band"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(cls), bands * rows)
    asked = np.flatnonzero(role > 0)
    others, asks = sig[asked], role[asked] == 2
    for i in np.flatnonzero(role == 0).tolist():
        small, large = np.minimum(size[asked], size[i]), np.maximum(size[asked], size[i])
        at = np.flatnonzero((comp[asked] != comp[i]) & (100 * small >= hundredths * large) & (~asks | (cls[asked] > cls[i])))
        same = others[at] == sig[i]
        near = np.count_nonzero(same, axis=1) >= (threshold - SLACK) * bands * rows
        at, same = at[near], same[near]
        if len(at):
            at = at[same.reshape(len(at), bands, rows).all(axis=2).argmax(axis=1) == band[i]]
            if len(at):
                yield i, asked[at]


def _needed(bands: int, rows: int, threshold: float):
    """The rows of a block (without their signatures) that have a partner."""

    def run(table: pa.Table) -> pa.Table:
        live = np.zeros(table.num_rows, bool)
        for i, at in _partners(table, bands, rows, threshold):
            live[i] = live[at] = True
        return table.drop_columns(["sig"]).filter(pa.array(live))

    return run


def _joined(bands: int, rows: int, threshold: float):
    """The links of a block's partners that hold on full sets and join what was not joined before."""
    hundredths = round(threshold * 100)

    def run(table: pa.Table) -> pa.Table:
        cls, comp = np.asarray(table.column("cls")), np.asarray(table.column("component"))
        sets = [np.frombuffer(x, U64) for x in table.column("items").to_pylist()]
        root = {c: c for c in comp.tolist()}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        left, right = [], []
        for i, at in _partners(table, bands, rows, threshold):
            mine = top(int(comp[i]))
            at = [k for k in at.tolist() if top(int(comp[k])) != mine]
            for begin in range(0, len(at), 64):
                some = at[begin : begin + 64]
                sizes = np.array([len(sets[k]) for k in some])
                flat = np.concatenate([sets[k] for k in some])
                place = np.minimum(np.searchsorted(sets[i], flat), len(sets[i]) - 1)
                same = np.add.reduceat((sets[i][place] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
                for k in np.array(some)[100 * same >= hundredths * (sizes + len(sets[i]) - same)].tolist():
                    a, b = top(int(comp[i])), top(int(comp[k]))
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        left.append(int(cls[i]))
                        right.append(int(cls[k]))
        return pa.table([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["u", "v"])

    return run


def _left_over(shared: DataFrame, found: DataFrame, sets: DataFrame, bands: int, rows: int, threshold: float) -> DataFrame:
    """Links (u, v) between members of buckets that hold several components."""
    named = checkpointed(shared.select("bucket", "band", "cls").join(found.withColumnRenamed("node", "cls"), "cls"))
    sizes = named.groupBy("bucket", "component").agg(F.count("*").alias("k"), F.sum("n").alias("s")).groupBy("bucket").agg(
        F.max_by(F.struct("component", "k", "s"), F.struct("k", "component")).alias("big"), F.sum("k").alias("k"), F.sum("s").alias("s")
    ).filter("big.k < k")
    blocks = lambda k, s, most: F.ceil(F.greatest(k / most, s / SHINGLES)).cast("int")
    few = blocks(F.col("k") - F.col("big.k"), F.col("s") - F.col("big.s"), ASKING)
    sizes = sizes.select("bucket", F.col("big.component").alias("big"), few.alias("i"), blocks(F.col("k"), F.col("s"), ASKED).alias("j"))
    held = named.join(sizes, "bucket")
    deal, asks = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int"), F.col("component") != F.col("big")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols, block = ("bucket", "band", "cls", "component", "n", "role"), ("bucket", "_i", "_j")
    asking = held.filter(asks).withColumn("role", F.lit(0)).select(*cols, deal("i").alias("_i"), every("j").alias("_j"))
    asked = held.withColumn("role", F.when(asks, 2).otherwise(1)).select(*cols, every("i").alias("_i"), deal("j").alias("_j"))
    met = asking.unionByName(asked)
    needed = met.join(sets.select("cls", "sig"), "cls").select(*met.columns, "sig").groupBy(*block).applyInArrow(
        _needed(bands, rows, threshold), met.schema
    )
    needed = checkpointed(needed)
    whole = needed.join(sets.select("cls", "sig", "items"), "cls")
    return whole.groupBy(*block).applyInArrow(_joined(bands, rows, threshold), "u bigint, v bigint")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
    threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """One row per document row: id, n_shingles, component_id (the least id reachable by links).

    Texts are compared as lower-cased words. Null, empty or blank texts have no shingles and
    are linked with nothing: their component is their own id. Rows with the same text are one
    class; repeated ids are allowed, a row with a null id takes part and has the component of
    its class (null if it stands alone). Similarity: size of the intersection over that of the
    union, at least ``threshold`` (in hundredths).
    """
    count = bands * rows
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()
    mapped = checkpointed(source.mapInArrow(_mapped(shingle, count, False), f"_id {kind}, cls bigint, n bigint, sig binary"))
    classes = checkpointed(
        mapped.filter("cls is not null").groupBy("cls").agg(F.min("_id").alias("rep"), F.any_value("sig").alias("sig"))
    )
    free_shuffles(docs.sparkSession)
    buckets = classes.select("cls", "sig").mapInArrow(_buckets(bands, rows), "bucket bigint, band int, cls bigint")
    first = buckets.groupBy("bucket").agg(F.min("cls").alias("least"), F.max("cls").alias("most"))
    shared = checkpointed(
        buckets.join(first.filter("least < most").select("bucket", "least"), "bucket").select("bucket", "band", "cls", "least")
    )
    free_shuffles(docs.sparkSession)
    sets = _sets(source, classes, shared.select("cls").distinct(), shingle, count)
    pairs = shared.filter("cls > least").select(F.col("least").alias("a"), F.col("cls").alias("b")).distinct()
    links = checkpointed(_verified(pairs, sets, threshold))
    nodes = sets.select(F.col("cls").alias("node"), (F.length("items") / 8).cast("bigint").alias("n"))
    found = nodes.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    found = checkpointed(found)
    free_shuffles(docs.sparkSession)
    more = checkpointed(_left_over(shared, found, sets, bands, rows, threshold))
    found = _grown(found, more)
    label = (
        classes.select("cls", "rep").join(found.withColumnRenamed("node", "cls"), "cls", "left")
        .select("cls", "rep", F.coalesce("component", "cls").alias("component"))
    )
    label = checkpointed(label)
    least = label.groupBy("component").agg(F.min("rep").alias("component_id"))
    label = label.join(least, "component").select("cls", "component_id")
    free_shuffles(docs.sparkSession)
    out = mapped.select("_id", "cls", "n").join(label, "cls", "left")
    return out.select(
        F.col("_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "_id").alias("component_id"),
    )
