"""Near-duplicate vectors by Euclidean p-stable hashing.

1. Equal vectors of a label are one class.
2. In each of several tables a class' normalised vector is hashed: random projections, quantised to cells of one
   width, make a bucket with the label. At the cosine asked for a pair shares a bucket of some table almost surely
   (see ``chance``).
3. Buckets that many classes share come from groups of near copies. Their least class is a pivot; classes within half
   the angle asked for of a pivot form its ball. All pairs of a ball are links, by the triangle inequality of angles,
   so a ball is never expanded into pairs.
4. Balls and the classes outside (units) meet in their buckets, split into blocks where they are many. A sketch of
   signs leaves out pairs far apart; the others are checked by the exact cosine. A pair with a ball is settled by the
   pivot's angle where the triangle inequality can; else the ball's members are checked one by one.
5. Links between units, solved by large-star and small-star rounds, give the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, erf, exp, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, mix
from .components import components
from .vectors import finite, matrix

#: Tables, projections of a bucket, and the width of a cell.
TABLES, PROJECTIONS, WIDTH = 40, 12, 2.0
#: Classes of a bucket that make it a place for a pivot; units of a block in a bucket.
HEAVY, BLOCK = 64, 1_024
#: Signs of a sketch, and how many deviations beyond its mean a pair's differing signs may lie.
SIGNS, DEVIATIONS = 128, 6.5
SLACK = 1e-7


def chance(cosine: float, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH) -> float:
    """Probability that two vectors of this cosine share a bucket."""
    r = width / sqrt(2 - 2 * cosine)
    one = erf(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))
    return 1 - (1 - one**projections) ** tables


def _hashed(tables: int, projections: int, width: float, seed: int):
    """(cls, _label64, v) to (cls, keys, sketch, w): a 64-bit bucket name a table, the packed signs, and v of length 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple] = {}
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy()
            for dim in np.unique(lengths):
                rows = batch.filter(pa.array(lengths == dim))
                if dim not in planes:
                    draw = np.random.default_rng([seed, int(dim)])
                    planes[dim] = draw.standard_normal((dim, tables * projections)), draw.uniform(0, width, tables * projections), draw.standard_normal((dim, SIGNS))
                along, shift, signs = planes[dim]
                v = matrix(rows.column(2), int(dim))
                v = v / np.abs(v).max(axis=1, keepdims=True)
                v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
                cells = np.floor((v @ along + shift) / width).astype(np.int64).view(np.uint64).reshape(len(v), tables, projections)
                key = mix(rows.column(1).to_numpy().astype(np.int64).view(np.uint64))[:, None] + mix(np.arange(tables, dtype=np.uint64) + np.uint64(int(dim) << 20))
                for p in range(projections):
                    key = mix(key ^ cells[:, :, p])
                sketch = np.packbits(v @ signs > 0, axis=1)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * tables), pa.array(key.view(np.int64).ravel()))
                unit = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * int(dim)), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([rows.column(0), keys, pa.array([s.tobytes() for s in sketch], pa.binary()), unit], names=["cls", "keys", "sketch", "w"])

    return run


def _cosine(x: str, y: str) -> Column:
    """Of two vectors of one length whose norm is 1."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)


def _pairs(most: int):
    """Rows (key, lo, hi, side, unit, sketch) sorted by key and block pair to (u, v), u < v, of the units that share
    one and whose sketches are no further apart than ``most`` signs (a null sketch is never too far)."""
    empty = pa.RecordBatch.from_pydict({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})

    def meet(group: list[np.ndarray], unit: np.ndarray, side: np.ndarray, sketch: np.ndarray, bare: np.ndarray) -> Iterator[pa.RecordBatch]:
        # rows that stand one, two, ... places apart and are still in one group
        here, step = np.arange(len(unit) - 1), 1
        while len(here):
            there = here + step
            same = np.logical_and.reduce([g[here] == g[there] for g in group])
            here, there = here[same], there[same]
            # of two different blocks only pairs across count: pairs within a block meet where it meets itself
            across = (group[1][here] == group[2][here]) | (side[here] != side[there])
            a, b = here[across], there[across]
            apart = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1)
            fine = ((apart <= most) | bare[a] | bare[b]) & (unit[a] != unit[b])
            u, v = unit[a[fine]], unit[b[fine]]
            if len(u):
                yield pa.RecordBatch.from_pydict({"u": np.minimum(u, v), "v": np.maximum(u, v)})
            step += 1
            here = here[here + step < len(unit)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            group = [batch.column(i).to_numpy() for i in range(3)]
            unit, side = batch.column(4).to_numpy(), batch.column(3).to_numpy()
            bare = batch.column(5).is_null().to_numpy(zero_copy_only=False)
            body = b"".join(s if s is not None else bytes(SIGNS // 8) for s in batch.column(5).to_pylist())
            now = [*group, unit, side, np.frombuffer(body, np.uint64).reshape(len(unit), -1), bare]
            if held is not None:
                now = [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
            # the last group may go on in the next batch
            last = np.logical_and.reduce([g == g[-1] for g in now[:3]])
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            held = [x[cut:] for x in now]
            if cut:
                yield from meet([g[:cut] for g in now[:3]], now[3][:cut], now[4][:cut], now[5][:cut], now[6][:cut])
        if held is not None:
            yield from meet(held[:3], *held[3:])
        yield empty

    return run


def _met(keyed: DataFrame, most: int, block: int) -> DataFrame:
    """Distinct pairs (u, v) of the units of keyed (key, unit, sketch) that share a bucket. A bucket of more than
    ``block`` units is cut into blocks by the unit's hash, and each two of its blocks meet in a group of their own."""
    wide = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    wide = checkpointed(wide.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    if wide.isEmpty():
        dealt = keyed.select("key", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("side"), "unit", "sketch")
    else:
        cut = keyed.join(wide, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        cut = cut.withColumn("side", F.pmod(F.xxhash64("unit"), F.col("blocks")).cast("int"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = cut.select("key", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "unit", "sketch")
    together = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return together.mapInArrow(_pairs(most), "u bigint, v bigint").distinct()


def near_duplicates(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93,
    tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, heavy: int = HEAVY, block: int = BLOCK, seed: int = 13,
) -> DataFrame:
    """id, n_links, component_id: one row per row of vectors. n_links counts the other rows of an equal label whose
    cosine is ``cosine`` or more, of those found; component_id is the least id that links reach, the own one included.

    Rows with a null id or label, a null, empty or zero vector or null or non-finite components link with nothing:
    n_links 0, component_id the own id. Vectors of different lengths are not linked. Repeated rows are rows of their
    own and link. Other columns are neither used nor in the way. Needs 0 < cosine < 1."""
    label = F.col(label_col)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("_id"), label.alias("_label"), F.col(vector_col).cast("array<double>").alias("_v"))
    good = F.col("_id").isNotNull() & F.col("_label").isNotNull() & finite(F.col("_v")) & F.coalesce(F.exists("_v", lambda x: x != 0), F.lit(False))
    rows = rows.select("_id", "_label", "_v", F.when(good, F.xxhash64("_v")).alias("_h1"), F.when(good, F.xxhash64(F.lit(seed), F.reverse("_v"))).alias("_h2"))
    same = ["_label", "_h1", "_h2"]
    classes = rows.filter("_h1 is not null").groupBy(*same).agg(F.count("*").alias("n"), F.min("_id").alias("least"), F.first("_v").alias("v"))
    classes = checkpointed(classes.withColumn("cls", F.monotonically_increasing_id()))
    hashed = classes.select("cls", F.xxhash64("_label").alias("_label64"), "v").mapInArrow(_hashed(tables, projections, width, seed), "cls bigint, keys array<bigint>, sketch binary, w array<double>")
    hashed = checkpointed(hashed)
    vector = hashed.select("cls", F.col("w").alias("v"))
    classes = classes.drop("v")

    # balls around the pivots of crowded buckets
    theta = acos(cosine)
    crowded = hashed.select("cls", F.explode("keys").alias("key"))
    pivots = checkpointed(crowded.groupBy("key").agg(F.count("*").alias("n"), F.min("cls").alias("pivot")).filter(F.col("n") > heavy).select("key", "pivot"))
    told = classes.select("cls", "_label", "n").join(vector, "cls")
    centre = told.select(F.col("cls").alias("pivot"), F.col("v").alias("pv"), F.col("_label").alias("pl")).join(pivots.select("pivot").distinct(), "pivot")
    near = crowded.join(pivots, "key").select("cls", "pivot").distinct().join(told, "cls").join(centre, "pivot")
    near = near.filter((F.col("_label") == F.col("pl")) & (F.size("v") == F.size("pv")))
    near = near.withColumn("angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _cosine("v", "pv"))))).filter(F.col("angle") <= theta / 2 - SLACK)
    balls = checkpointed(near.groupBy("cls").agg(F.min(F.struct("pivot", "angle", "n")).alias("b")).select("cls", "b.*"))
    ball = balls.groupBy(F.col("pivot").alias("unit")).agg(F.max("angle").alias("reach"), F.sum("n").alias("weight"))

    # units: balls by their pivot's class (a pivot is never a unit of its own), and the other classes
    alone = classes.join(balls.select("cls"), "cls", "left_anti")
    plain = told.select(F.col("cls").alias("unit"), "v", F.col("_label").alias("label"))
    units = alone.join(vector, "cls").select(F.col("cls").alias("unit"), "v", F.col("_label").alias("label"), F.lit(0.0).alias("reach"), F.col("n").alias("weight"))
    units = checkpointed(units.unionByName(plain.join(ball, "unit")))
    unit_of = checkpointed(alone.select("cls", F.col("cls").alias("unit"), F.lit(0).cast("bigint").alias("inside"), "n", "least").unionByName(
        balls.select("cls", F.col("pivot").alias("unit"), "n").join(ball.select("unit", "weight"), "unit").join(classes.select("cls", "least"), "cls")
        .select("cls", "unit", (F.col("weight") - F.col("n")).alias("inside"), "n", "least")
    ))

    single = hashed.join(balls.select("cls"), "cls", "left_anti").select(F.explode("keys").alias("key"), F.col("cls").alias("unit"), "sketch")
    grouped = hashed.join(balls.select("cls", "pivot"), "cls").select(F.explode("keys").alias("key"), F.col("pivot").alias("unit")).distinct()
    share = theta / pi
    most = int(SIGNS * share + DEVIATIONS * sqrt(SIGNS * share * (1 - share))) + 1
    met = _met(single.unionByName(grouped.withColumn("sketch", F.lit(None).cast("binary"))), most, block)
    side = lambda x: units.select(*[F.col(c).alias(x if c == "unit" else f"{x}_{c}") for c in units.columns])
    met = met.join(side("u"), "u").join(side("v"), "v").filter((F.col("u_label") == F.col("v_label")) & (F.size("u_v") == F.size("v_v")))
    met = met.withColumn("cos", _cosine("u_v", "v_v")).withColumn("reach", F.col("u_reach") + F.col("v_reach"))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cos"))))
    verdict = (
        F.when(F.col("reach") == 0, F.when(F.col("cos") >= cosine, "all").otherwise("none"))
        .when(angle + F.col("reach") <= theta - SLACK, "all").when(angle - F.col("reach") > theta + SLACK, "none").otherwise("some")
    )
    met = checkpointed(met.select("u", "v", "u_weight", "v_weight", verdict.alias("verdict")).filter("verdict <> 'none'"))
    whole, some = met.filter("verdict = 'all'"), met.filter("verdict = 'some'").select("u", "v")
    # the rest of pairs with balls: members against members, where the pivot's angle does not tell
    of = lambda x: unit_of.select(F.col("unit").alias(x), F.col("cls").alias(f"{x}_cls"), F.col("n").alias(f"{x}_n"))
    body = lambda x: vector.select(F.col("cls").alias(f"{x}_cls"), F.col("v").alias(f"{x}_v"))
    links = some.join(of("u"), "u").join(of("v"), "v").join(body("u"), "u_cls").join(body("v"), "v_cls").filter(_cosine("u_v", "v_v") >= cosine)
    links = checkpointed(links.select("u", "v", "u_cls", "v_cls", "u_n", "v_n"))

    both = lambda df, a, b: df.select(F.col(f"u{a}").alias("at"), F.col(f"v{b}").alias("n")).unionByName(df.select(F.col(f"v{a}").alias("at"), F.col(f"u{b}").alias("n")))
    by_unit = both(whole, "", "_weight").groupBy(F.col("at").alias("unit")).agg(F.sum("n").alias("to_units"))
    by_class = both(links, "_cls", "_n").groupBy(F.col("at").alias("cls")).agg(F.sum("n").alias("to_classes"))
    root = components(whole.select("u", "v").unionByName(links.select("u", "v")))
    placed = unit_of.join(root.withColumnRenamed("node", "unit"), "unit", "left").withColumn("component", F.coalesce("component", "unit"))
    lowest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    n_links = F.col("n") - 1 + F.col("inside") + zero("to_units") + zero("to_classes")
    placed = placed.join(lowest, "component").join(by_unit, "unit", "left").join(by_class, "cls", "left").select("cls", n_links.alias("n_links"), "component_id")
    by_row = classes.select("cls", *same).join(placed, "cls").drop("cls")
    linked = rows.filter("_h1 is not null").select("_id", *same).join(by_row, same).select("_id", "n_links", "component_id")
    apart = rows.filter("_h1 is null").select("_id", F.lit(0).cast("bigint").alias("n_links"), F.col("_id").alias("component_id"))
    return linked.unionByName(apart).withColumnRenamed("_id", id_col)
