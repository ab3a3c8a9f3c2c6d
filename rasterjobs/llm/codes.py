"""Vector code compression: product codes whose codebooks are found by rounds of nearest entries and
means, with anchors-hierarchy metric trees.

Rows are packed where they lie, a bounded number to a pack. For each part position a pack holds a
tree of balls over its parts, built middle-out: about sqrt(n) anchors take their nearest points,
each anchor's points are split in the same way, and the balls are merged upwards in pairs. A ball
keeps the sum and the number of its points. In a round the codebook's entries descend each tree: a
ball inherits its parent's list of entries and strikes those that lose to another entry everywhere
in the ball. When one is left it owns the ball, whose cached sum and number are added to it; in
leaves the entries that are left are compared point by point, in whole numbers.

Only sums and counts by entry leave a pack, and they are summed by Spark; the driver sees a codebook
(parts x entries x components) and nothing that grows with the rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .vectors import exact, finite, matrix, whole_numbers

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of a pack at most, and points of a leaf at most.
PACK, LEAF = 8_192, 64


def _anchors(x: np.ndarray, k: int) -> np.ndarray:
    """The anchor of each point: each new anchor is the point farthest from its own, and takes the
    points that are nearer to it. Points within half the way between two anchors are not looked at."""
    pivots, owner = [0], np.zeros(len(x), np.int64)
    far = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    for _ in range(1, k):
        new = int(far.argmax())
        if far[new] == 0:
            break
        gap = np.sqrt(((x[pivots] - x[new]) ** 2).sum(axis=1))
        seen = np.flatnonzero(far > gap[owner] / 2)
        near = np.sqrt(((x[seen] - x[new]) ** 2).sum(axis=1))
        won = near < far[seen]
        owner[seen[won]], far[seen[won]] = len(pivots), near[won]
        pivots.append(new)
    return owner


class BallTree:
    """Balls over the rows of x (whole numbers): members of ball i are order[first[i]:last[i]]."""

    FIELDS = ("x", "order", "first", "last", "left", "right", "centre", "radius", "total")

    def __init__(self, **fields: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, fields[name])

    @classmethod
    def over(cls, x: np.ndarray, leaf: int = LEAF) -> BallTree:
        points, balls = x.astype(np.float64), []

        def ball(members: np.ndarray, left: int, right: int) -> int:
            total = x[members].sum(axis=0)
            centre = total / len(members)
            radius = np.sqrt(((points[members] - centre) ** 2).sum(axis=1).max())
            balls.append([members, left, right, centre, radius, total])
            return len(balls) - 1

        def built(members: np.ndarray) -> int:
            owner = np.zeros(0) if len(members) <= leaf else _anchors(points[members], int(np.ceil(np.sqrt(len(members)))))
            if not owner.any():
                return ball(members, -1, -1)
            return merged([built(members[owner == a]) for a in np.unique(owner)])

        def merged(nodes: list[int]) -> int:
            """Pairs whose common ball is least are merged until one is left."""
            nodes = np.array(nodes)
            centres, radii = np.stack([balls[i][3] for i in nodes]), np.array([balls[i][4] for i in nodes])
            common = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2)) + radii[:, None] + radii[None]
            np.fill_diagonal(common, np.inf)
            for _ in range(len(nodes) - 1):
                a, b = divmod(int(common.argmin()), len(nodes))
                one, two = balls[nodes[a]], balls[nodes[b]]
                nodes[a] = ball(np.concatenate([one[0], two[0]]), nodes[a], nodes[b])
                centres[a], radii[a] = balls[nodes[a]][3], balls[nodes[a]][4]
                common[b], common[:, b], gone = np.inf, np.inf, ~np.isfinite(common[a])
                gone[b] = True
                row = np.sqrt(((centres - centres[a]) ** 2).sum(axis=1)) + radii + radii[a]
                row[gone] = np.inf
                common[a], common[:, a] = row, row
                last = nodes[a]
            return int(last)

        root = built(np.arange(len(x)))
        first, order, at, stack = np.zeros(len(balls), np.int64), [], 0, [root]
        while stack:  # leaves from left to right, so that each ball's members lie together
            i = stack.pop()
            first[i] = at
            if balls[i][1] < 0:
                order.append(balls[i][0])
                at += len(balls[i][0])
            else:
                stack += [balls[i][2], balls[i][1]]
        size = np.array([len(b[0]) for b in balls])
        pick = lambda j: np.array([b[j] for b in balls])
        order = np.concatenate(order)
        return cls(x=x[order], order=order, first=first, last=first + size, left=pick(1), right=pick(2), centre=pick(3), radius=pick(4), total=pick(5))

    def owners(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry of each point in tree order, sums by entry, counts by entry); ties go to the lower entry."""
        code = np.empty(len(self.x), np.int64)
        total, count = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
        kind, entries = exact(self.x, book), book.astype(np.float64)
        square = (entries**2).sum(axis=1)
        slack = 1e-9 * (square.max() + (self.centre**2).sum(axis=1).max() + 1)
        # an entry that stands twice can only win by its first place
        every = np.sort(np.unique(book, axis=0, return_index=True)[1])
        points, whole = self.x.astype(kind), book.astype(kind)
        stack = [(len(self.first) - 1, every)]  # the root is the last ball that was made
        while stack:
            i, left = stack.pop()
            best = left[((entries[left] - self.centre[i]) ** 2).sum(axis=1).argmin()]
            apart = entries[left] - entries[best]
            margin = square[left] - square[best] - 2 * apart @ self.centre[i] - 2 * self.radius[i] * np.sqrt((apart**2).sum(axis=1))
            left = left[margin <= slack]
            span = slice(self.first[i], self.last[i])
            if len(left) == 1:
                code[span] = left[0]
                total[left[0]] += self.total[i]
                count[left[0]] += span.stop - span.start
            elif self.left[i] >= 0:
                stack += [(self.left[i], left), (self.right[i], left)]
            else:
                c = whole[left]
                own = left[((c * c).sum(axis=1) - 2 * points[span] @ c.T).argmin(axis=1)]
                code[span] = own
                np.add.at(total, own, self.x[span])
                count += np.bincount(own, minlength=len(book))
        return code, total, count

    def in_order(self, values: np.ndarray) -> np.ndarray:
        out = np.empty_like(values)
        out[self.order] = values
        return out


def _stored(trees: list[BallTree]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{f"{n}{p}": getattr(t, n).astype(np.int32) if n in ("x", "order", "first", "last", "left", "right") else getattr(t, n) for p, t in enumerate(trees) for n in BallTree.FIELDS})
    return out.getvalue()


def _read(body: bytes, parts: int) -> list[BallTree]:
    held = np.load(io.BytesIO(body))
    return [BallTree(**{n: held[f"{n}{p}"].astype(np.int64) if held[f"{n}{p}"].dtype == np.int32 else held[f"{n}{p}"] for n in BallTree.FIELDS}) for p in range(parts)]


def _packed(parts: int, scale: float, dim: int, rows: int):
    """Batches with the vector last to packs: the other columns as an Arrow stream, and the trees."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        x = whole_numbers(matrix(table.column(table.num_columns - 1), dim), scale, dim)
        sink = pa.BufferOutputStream()
        carried = table.drop_columns(table.schema.names[-1:])
        with pa.ipc.new_stream(sink, carried.schema) as stream:
            stream.write_table(carried)
        body = _stored([BallTree.over(part) for part in np.split(x, parts, axis=1)])
        return pa.RecordBatch.from_pydict({"carried": pa.array([sink.getvalue().to_pybytes()], pa.binary()), "body": pa.array([body], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                take = min(rows - size, batch.num_rows - begin)
                held.append(batch.slice(begin, take))
                begin, size = begin + take, size + take
                if size == rows:
                    yield pack(held)
                    held, size = [], 0
        if size:
            yield pack(held)

    return run


def _sums(books, parts: int):
    """Packs to (part, entry, place, total, n) for the entries that own a point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0):
                for p, tree in enumerate(_read(body.as_py(), parts)):
                    _, total, count = tree.owners(books.value[p])
                    used, width = np.flatnonzero(count), total.shape[1]
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array(np.full(len(used) * width, p, np.int32)), "entry": pa.array(np.repeat(used, width).astype(np.int32)),
                        "place": pa.array(np.tile(np.arange(width, dtype=np.int32), len(used))), "total": pa.array(total[used].ravel()),
                        "n": pa.array(np.repeat(count[used], width)),
                    })

    return run


def _codes(books, parts: int):
    """Packs to their rows, with the codes of the parts and the squared distance to what they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for carried, body in zip(batch.column(0), batch.column(1), strict=True):
                table = pa.ipc.open_stream(carried.as_py()).read_all()
                codes, error = np.empty((table.num_rows, parts), np.int32), np.zeros(table.num_rows, np.int64)
                for p, tree in enumerate(_read(body.as_py(), parts)):
                    code = tree.owners(books.value[p])[0]
                    error += tree.in_order(((tree.x - books.value[p][code]) ** 2).sum(axis=1))
                    codes[:, p] = tree.in_order(code)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(table.num_rows + 1, dtype=np.int32) * parts), pa.array(codes.ravel()))
                yield from table.append_column("codes", lists).append_column("error", pa.array(error)).combine_chunks().to_batches()

    return run


def compress(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", carry: tuple[str, ...] = ("label",),
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE, pack: int = PACK,
) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows, codebooks). Rows: id, the carried columns, codes (array<int>, one a part) and error (bigint).

    A component x counts as floor(scale * x). A codebook starts as that part of the vectors of the ``entries``
    least ids; entries without points stay. Vectors that are null, empty or have null or non-finite components
    take no part, nor do those of another length than the vector of the least id; where that length is not a
    multiple of ``parts``, none does. Rows with a null id count in sums and get codes, and give no entry; without
    any id there are no rows. Equal ids are separate rows; the least vector of an id gives its entry. Components
    beyond +-2^29 / sqrt(length) after scaling count as that bound. Rows and codebooks do not depend on how the
    rows are dealt out. Other columns are neither used nor in the way."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col), *carry, F.col(vector_col).cast("array<double>").alias("_v")).filter(finite(F.col("_v")))
    named = kept.filter(F.col(id_col).isNotNull())
    least = named.orderBy(id_col, "_v").select(F.size("_v")).first()
    dim = least[0] if least else 0
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    if not dim or dim % parts:
        return spark.createDataFrame([], f"{fields}, codes array<int>, error bigint"), []
    kept, named = kept.filter(F.size("_v") == dim), named.filter(F.size("_v") == dim)
    ids = [r[0] for r in named.select(id_col).distinct().orderBy(id_col).limit(entries).collect()]
    first = named.filter(F.col(id_col).isin(ids)).groupBy(id_col).agg(F.min("_v").alias("_v")).orderBy(id_col).collect()
    books = np.split(whole_numbers(np.array([r["_v"] for r in first], np.float64), scale, dim), parts, axis=1)
    packs = checkpointed(kept.mapInArrow(_packed(parts, scale, dim, pack), "carried binary, body binary"))
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(books)
        sums = packs.select("body").mapInArrow(_sums(held, parts), "part int, entry int, place int, total bigint, n bigint")
        books = [b.copy() for b in books]
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            books[r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]
        held.unpersist()
    coded = packs.mapInArrow(_codes(spark.sparkContext.broadcast(books), parts), f"{fields}, codes array<int>, error bigint")
    return coded, books


def hexadecimal(codes: Column) -> Column:
    """Two digits a part, for codebooks of up to 256 entries."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")


def with_group_totals(rows: DataFrame, group: str, value: str, out: str, salts: int = 32) -> DataFrame:
    """rows with ``out``, the sum of ``value`` over rows of an equal group, nulls together. A group's rows
    are dealt over ``salts`` keys, so a hot group is no single task; sums are pre-aggregated."""
    totals = rows.groupBy(group).agg(F.sum(value).alias(out))
    spread = totals.select(F.col(group).alias("_group"), out, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_at"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    on = salted[group].eqNullSafe(spread["_group"]) & (salted["_salt"] == spread["_at"])
    return salted.join(spread, on).drop("_salt", "_at", "_group")
