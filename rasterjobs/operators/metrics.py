"""Agreement of predicted masks and class maps with ground truth, one row a slice and model.

``slices`` lists what is scored (the ``by`` columns), so slices without any pixel keep their row.
``pred`` and ``truth`` are pixel tables inside the region of interest; truth has cls 1, 2, 3. For
objects and centre lines truth may lack columns of ``by`` (the model): it is then labelled and thinned
once a slice, whatever the number of models.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components, runs
from .graph import saved
from .pixels import runs as px_runs

KEY = ("model", "subject", "z")
Key = tuple[str, ...]
#: Names of the classes by their ids.
CLASSES = ((1, "light"), (2, "moderate"), (3, "dense"))


def ratio(part: Column, whole: Column, empty: float | None) -> Column:
    """part / whole, or ``empty`` where whole is 0."""
    return F.when(whole == 0, F.lit(empty).cast("double")).otherwise(part / whole)


def paired(pred: DataFrame, truth: DataFrame, by: Key = KEY) -> DataFrame:
    """A row for each pixel of either side: p (0 or 1, or the predicted class) and cls (0: none)."""
    label = F.col("cls") if "cls" in pred.columns else F.lit(1)
    both = pred.select(*by, "y", "x", label.alias("p"), F.lit(0).alias("cls")).unionAll(
        truth.select(*by, "y", "x", F.lit(0).alias("p"), F.col("cls"))
    )
    return both.groupBy(*by, "y", "x").agg(F.max("p").alias("p"), F.max("cls").alias("cls"))


def pixel_counts(slices: DataFrame, pairs: DataFrame, by: Key = KEY) -> DataFrame:
    """All counts that the pixel metrics need, in one pass."""
    n = lambda cond: F.count(F.when(cond, 1))
    p, t = F.col("p") > 0, F.col("cls") > 0
    sums = [n(p).alias("n_p"), n(t).alias("n_t"), n(p & t).alias("n_both")]
    for k, name in CLASSES:
        mine, its = F.col("p") == k, F.col("cls") == k
        sums += [n(its).alias(f"n_{name}"), n(its & p).alias(f"hit_{name}"), n(its & mine).alias(f"both_{name}"), n(its | mine).alias(f"any_{name}")]
    return slices.select(*by).join(pairs.groupBy(*by).agg(*sums), [*by], "left").fillna(0)


def run_counts(slices: DataFrame, found: DataFrame, by: Key = KEY) -> DataFrame:
    """As pixel_counts, from segments (by, y, x0, x1) with p (predicted, a boolean) and cls (null: none): lengths
    are summed, no pixel is made."""
    n = lambda cond: F.coalesce(F.sum(F.when(cond, runs.length())), F.lit(0)).cast("bigint")
    p, t = F.col("p"), F.col("cls").isNotNull()
    sums = [n(p).alias("n_p"), n(t).alias("n_t"), n(p & t).alias("n_both")]
    for k, name in CLASSES:
        # a prediction without classes counts as the first one
        mine, its = p if k == 1 else F.lit(False), F.col("cls").eqNullSafe(k)
        sums += [n(its).alias(f"n_{name}"), n(its & p).alias(f"hit_{name}"), n(its & mine).alias(f"both_{name}"), n(its | mine).alias(f"any_{name}")]
    return slices.select(*by).join(found.groupBy(*by).agg(*sums), [*by], "left").fillna(0)


def pixel_metrics(counts: DataFrame, by: Key = KEY) -> DataFrame:
    """iou, dice, and per class iou and pixel recall (null without target pixels)."""
    out = [
        ratio(F.col("n_both"), F.col("n_p") + F.col("n_t") - F.col("n_both"), 1.0).alias("iou"),
        ratio(2 * F.col("n_both"), F.col("n_p") + F.col("n_t"), 1.0).alias("dice"),
    ]
    out += [ratio(F.col(f"both_{n}"), F.col(f"any_{n}"), 1.0).alias(f"iou_{n}") for _, n in CLASSES]
    out += [ratio(F.col(f"hit_{n}"), F.col(f"n_{n}"), None).alias(f"pixel_recall_{n}") for _, n in CLASSES]
    return counts.select(*by, *out)


def sides(pred: DataFrame, truth: DataFrame, by: Key = KEY) -> DataFrame:
    """Runs by ``by`` and _side, to be labelled: 0 predictions, 1 to 3 the target's classes, 4 all of them; some may touch.
    Columns of ``by`` that truth lacks are null for it."""
    kinds = dict(pred.select(*by).dtypes)
    target = [F.col(n) if n in truth.columns else F.lit(None).cast(kinds[n]).alias(n) for n in by]
    one = lambda df, cols, side: df.select(*cols, side.alias("_side"), "y", "x0", "x1")
    parts = [one(pred, by, F.lit(0)), one(truth, target, F.col("cls").cast("int")), one(truth, target, F.lit(4))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def _as_runs(pred: DataFrame, truth: DataFrame, by: Key) -> tuple[DataFrame, DataFrame]:
    """Pixel tables as runs."""
    own = tuple(n for n in by if n in truth.columns)
    return px_runs(pred.select(*by, "y", "x").distinct(), by), px_runs(truth.select(*own, "cls", "y", "x"), (*own, "cls"))


def labelled_sides(pred: DataFrame, truth: DataFrame, by: Key = KEY, band: int = 256) -> DataFrame:
    """Labelled runs (8-connected) of ``sides`` of two pixel tables."""
    return components.label_runs(sides(*_as_runs(pred, truth, by), by), (*by, "_side"), 8, band)


class Meetings:
    """What the labelled sides (``labelled_sides``) of predictions and truth share, computed once. ``own``: the columns of ``by``
    that the truth has; where it lacks the model, its runs meet those of all models of a slice and are never repeated.

    sizes: _px and _n, pixels and components by ``by`` and _side. pairs: _shared, the pixels that a component of the predictions
    (comp_id) shares with one of the target (_t, of class _k)."""

    def __init__(self, labelled: DataFrame, by: Key, own: Key):
        self.labelled, self.by, self.own = labelled, by, own
        self.sizes = saved(labelled.groupBy(*by, "_side").agg(F.sum(runs.length()).alias("_px"), F.max("comp_id").alias("_n")))
        target = labelled.filter("_side between 1 and 3").select(*own, "y", "x0", "x1", F.col("_side").alias("_k"), F.col("comp_id").alias("_t"))
        found = labelled.filter("_side = 0").select(*by, "y", "x0", "x1", "comp_id")
        self.pairs = saved(shared(found, target, own, [*by, "comp_id", "_k", "_t"]))

    def of_side(self, side: int, what: str, name: str) -> DataFrame:
        """A column of sizes of one side, by ``by`` or, for the target, ``own``."""
        return self.sizes.filter(F.col("_side") == side).select(*(self.own if side else self.by), F.col(what).alias(name))

    def beside(self, slices: DataFrame, what: str) -> DataFrame:
        """slices with that column of each side, _0 to _4; 0 where there is none."""
        rows = slices.select(*self.by)
        for side in range(5):
            rows = rows.join(self.of_side(side, what, f"_{side}"), [*(self.own if side else self.by)], "left")
        return rows.fillna(0, [f"_{side}" for side in range(5)])

    def counts(self, slices: DataFrame) -> DataFrame:
        """As pixel_counts."""
        hits = self.pairs.groupBy(*self.by).agg(*[F.sum(F.when(F.col("_k") == k, F.col("_shared")).otherwise(0)).alias(f"hit_{n}") for k, n in CLASSES])
        rows = self.beside(slices, "_px").join(hits, [*self.by], "left").fillna(0, [f"hit_{n}" for _, n in CLASSES])
        out = [F.col("_0").alias("n_p"), F.col("_4").alias("n_t"), (F.col("hit_light") + F.col("hit_moderate") + F.col("hit_dense")).alias("n_both")]
        for k, name in CLASSES:
            # a prediction without classes counts as the first one
            its, hit = F.col(f"_{k}"), F.col(f"hit_{name}")
            out += [its.alias(f"n_{name}"), hit, (hit if k == 1 else F.lit(0)).alias(f"both_{name}"), (its + F.col("_0") - hit if k == 1 else its).alias(f"any_{name}")]
        return rows.select(*self.by, *out)


def shared(a: DataFrame, b: DataFrame, on: Key, by: list[str]) -> DataFrame:
    """_shared: pixels that runs of two tables share, by columns of either. Runs of a row meet; those of equal ``by`` must not overlap."""
    other = b.withColumnsRenamed({"x0": "_a", "x1": "_b"})
    met = a.join(other, [*on, "y"]).filter((F.col("x0") <= F.col("_b")) & (F.col("_a") <= F.col("x1")))
    return met.groupBy(*by).agg(F.sum(F.least("x1", "_b") - F.greatest("x0", "_a") + 1).alias("_shared"))


def object_metrics(
    slices: DataFrame, pred: DataFrame | None, truth: DataFrame | None, by: Key = KEY, empty: float | None = 1.0, band: int = 256,
    met: Meetings | None = None,
) -> DataFrame:
    """Per class the share of target components that the prediction touches (``empty`` where there
    are none), and touched (tp), untouched (fp) and all prediction components, 8-connected. Runs meet
    runs of the same row. ``met``: the meetings of the masks, if they are known."""
    met = Meetings(labelled_sides(pred, truth, by, band), by, tuple(n for n in by if n in truth.columns)) if met is None else met
    mine = met.pairs.select(*by, "comp_id").distinct().groupBy(*by).agg(F.count("*").alias("_hit0"))
    its = met.pairs.select(*by, "_k", "_t").distinct().groupBy(*by).agg(*[F.count(F.when(F.col("_k") == k, 1)).alias(f"_hit{k}") for k, _ in CLASSES])
    rows = met.beside(slices, "_n").join(mine, [*by], "left").join(its, [*by], "left").fillna(0, [f"_hit{k}" for k in range(4)])
    recall = [ratio(F.col(f"_hit{k}"), F.col(f"_{k}"), empty).alias(f"sensitivity_{n}") for k, n in CLASSES]
    fp = F.col("_0") - F.col("_hit0")
    return rows.select(
        *by, *recall, F.col("_hit0").alias("tp"), fp.alias("fp"), ratio(fp, F.col("_0"), 0.0).alias("fdr")
    )


def centerline_dice(
    slices: DataFrame, pred: DataFrame | None, truth: DataFrame | None, by: Key = KEY, smooth: float = 1e-6, labelled: DataFrame | None = None,
    own: Key | None = None,
) -> DataFrame:
    """cldice: harmonic mean of the shares of either skeleton that lie in the other mask. ``labelled``:
    labelled_sides of the masks, if they are known, and ``own``, the columns of ``by`` that its truth has. Lines and masks meet
    as runs; the truth's lines meet the masks of all models of a slice."""
    from .stencils import skeleton_runs

    own = tuple(n for n in by if n in truth.columns) if own is None else own
    if labelled is None:
        labelled = labelled_sides(pred, truth if "cls" in truth.columns else truth.withColumn("cls", F.lit(1)), by)
    lines = saved(skeleton_runs(labelled.filter("_side in (0, 4)"), (*by, "_side")))
    found = lambda df: df.filter("_side = 0").select(*by, "y", "x0", "x1")
    target = lambda df: df.filter("_side = 4").select(*own, "y", "x0", "x1")
    size = lambda df, key, name: df.groupBy(*key).agg(F.sum(runs.length()).alias(name))
    rows = slices.select(*by).join(size(found(lines), by, "_s0"), [*by], "left").join(size(target(lines), own, "_s1"), [*own], "left")
    rows = rows.join(shared(found(lines), target(labelled), own, [*by]).withColumnRenamed("_shared", "_h0"), [*by], "left")
    rows = rows.join(shared(found(labelled), target(lines), own, [*by]).withColumnRenamed("_shared", "_h1"), [*by], "left")
    rows = rows.fillna(0, ["_s0", "_s1", "_h0", "_h1"])
    part = lambda k: (F.col(f"_h{k}") + smooth) / (F.col(f"_s{k}") + smooth)
    value = F.when((F.col("_s0") == 0) & (F.col("_s1") == 0), 1.0).otherwise(2 * part(0) * part(1) / (part(0) + part(1)))
    return rows.select(*by, value.alias("cldice"))


def summary(metrics: DataFrame, names: list[str], model: str = "model", subject: str = "subject") -> DataFrame:
    """Mean, deviation and number of each metric by model and subject, by model, and over all."""
    long = metrics.unpivot([model, subject], names, "metric", "value").filter(F.col("value").isNotNull())
    rolled = long.groupBy("metric", model, subject).agg(F.count("*").alias("n"), F.sum("value").alias("_s"), F.sum(F.col("value") * F.col("value")).alias("_q"))
    # the few rows of the finest level are rolled up, not the slices
    out = rolled.rollup("metric", model, subject).agg(F.sum("n").alias("n"), F.sum("_s").alias("_s"), F.sum("_q").alias("_q"))
    out = out.filter(F.col("metric").isNotNull())
    mean = F.col("_s") / F.col("n")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / F.col("n") - mean * mean))
    return out.select("metric", model, subject, "n", mean.alias("mean"), spread.alias("std"))
