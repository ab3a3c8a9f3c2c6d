"""Evaluation of predicted masks: class maps, pixel and object metrics, tables and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import class_rgb, slice_name
from ..operators import components, metrics, pixels, runs, stencils
from ..operators.graph import saved
from .registry import KEY, MKEY, TRUTH, Views, component_sql, query, rounded

EVAL = ("masks", "roi", "pred", "predicted")


def truth_of(v: Views) -> DataFrame:
    """The class map of a slice's three masks."""
    part = lambda k: v.masks.filter(F.col("cls") == k)
    return pixels.class_map(part(1), part(2), part(3))


def truth_runs(v: Views, within: DataFrame | None = None) -> DataFrame:
    """The same as class-coded runs."""
    return runs.class_map(**runs.by_class(v.mask_runs), within=within)


class Sides:
    """Predictions and truth inside the region as runs, for the metrics.

    masks: runs with cls that may overlap, as predictions may; the region's runs do not. pred: the predictions' runs in the
    region; truth: class-coded runs, once a slice whatever the number of models."""

    def __init__(self, slices: DataFrame, pred: DataFrame, masks: DataFrame, roi: DataFrame):
        self.slices, self.truth = slices, runs.class_map(**runs.by_class(masks), within=roi)
        self.pred = runs.within(pred, roi, MKEY, KEY)

    def counts(self) -> DataFrame:
        """For the pixel metrics alone: one sweep, nothing is labelled."""
        truth = self.truth.join(self.slices.select(*MKEY), [*KEY])
        met = runs.segments({"p": self.pred} | runs.by_class(truth), MKEY).withColumn("cls", runs.class_of())
        return metrics.run_counts(self.slices, met)

    def labelled(self) -> DataFrame:
        return components.label_runs(metrics.sides(self.pred, saved(self.truth), MKEY), (*MKEY, "_side"), 8)


def evaluation_sides(v: Views) -> Sides:
    """The slices that have a prediction, with predictions and truth in the region."""
    return Sides(v.predicted.select(*MKEY), v.pred_runs, v.mask_runs, v.roi_runs)


def evaluate_masks(at: Sides) -> DataFrame:
    """One row a slice and model with all pixel, object and centre-line metrics. Nothing but thinning makes pixels."""
    met = metrics.Meetings(at.labelled(), MKEY, KEY)
    pixel = metrics.pixel_metrics(met.counts(at.slices)).select(*MKEY, "dice", "iou", "iou_dense", "iou_moderate", "iou_light")
    objects = metrics.object_metrics(at.slices, None, None, met=met)
    lines = metrics.centerline_dice(at.slices, None, None, labelled=met.labelled, own=KEY)
    out = objects.join(pixel, [*MKEY]).join(lines, [*MKEY])
    return out.select(
        *MKEY, F.col("z").alias("slice"), slice_name(F.col("z")).alias("file"),
        "sensitivity_dense", "sensitivity_moderate", "sensitivity_light", F.col("fp").alias("false_positives_vaan_fun"),
        F.col("tp").alias("true_positives_vaan_fun"), "fdr", F.col("dice").alias("dice_score"), F.col("iou").alias("iou_score"),
        "iou_dense", "iou_moderate", "iou_light", "cldice",
    )


def evaluate_in_box(slices: DataFrame, pred: DataFrame, masks: DataFrame, roi: DataFrame) -> DataFrame:
    """The second table, of runs: cropped to the region's inclusive box; classes without pixels are null."""
    box = roi.groupBy(*KEY).agg(F.min("y").alias("_ya"), F.max("y").alias("_yb"), F.min("x0").alias("_xa"), F.max("x1").alias("_xb"))

    def cropped(df: DataFrame) -> DataFrame:
        held = df.join(box, [*KEY]).filter("y between _ya and _yb").withColumn("x0", F.greatest("x0", "_xa")).withColumn("x1", F.least("x1", "_xb"))
        return held.filter("x0 <= x1").select(*df.columns)

    at = Sides(slices.select(*MKEY).join(box, [*KEY], "left_semi"), cropped(pred), cropped(masks), cropped(roi))
    met = metrics.Meetings(at.labelled(), MKEY, KEY)
    pixel = metrics.pixel_metrics(met.counts(at.slices)).select(*MKEY, F.col("dice").alias("pixel_dice"), F.col("iou").alias("pixel_iou"), *[f"pixel_recall_{n}" for _, n in metrics.CLASSES])
    objects = metrics.object_metrics(at.slices, None, None, empty=None, met=met)
    names = {**{f"sensitivity_{n}": f"obj_sens_{n}" for _, n in metrics.CLASSES}, "tp": "obj_tp", "fp": "obj_fp", "fdr": "obj_fdr"}
    lines = metrics.centerline_dice(at.slices, None, None, labelled=met.labelled, own=KEY).withColumnRenamed("cldice", "pixel_cldice")
    return objects.withColumnsRenamed(names).join(pixel, [*MKEY]).join(lines, [*MKEY])


def skip_report(slices: DataFrame, models: DataFrame, roi: DataFrame, predicted: DataFrame, sizes: DataFrame, brain: DataFrame | None = None) -> DataFrame:
    """status of each slice and model: the first reason for which it is not scored, or ok.

    sizes: (model, subject, z, h, w) of the predictions. brain: pixels of a mask of the whole brain, if
    the predictions are to be cut to it; a slice without any is not scored."""
    every = slices.select(*KEY, "h", "w").crossJoin(F.broadcast(models))  # a handful of models
    have = predicted.select(*MKEY, F.lit(True).alias("_file"))
    mask = roi.select(*KEY).distinct().withColumn("_roi", F.lit(True))
    shape = sizes.select(*MKEY, F.col("h").alias("_h"), F.col("w").alias("_w"))
    rows = every.join(mask, [*KEY], "left").join(have, [*MKEY], "left").join(shape, [*MKEY], "left")
    held = F.lit(True)
    if brain is not None:
        rows = rows.join(brain.select(*KEY).distinct().withColumn("_brain", F.lit(True)), [*KEY], "left")
        held = F.col("_brain").isNotNull()
    status = (
        F.when(F.col("_roi").isNull(), "empty region").when(~held, "brain mask empty").when(F.col("_file").isNull(), "no prediction")
        .when((F.col("_h") != F.col("h")) | (F.col("_w") != F.col("w")), "shape mismatch").otherwise("ok")
    )
    return rows.select(*MKEY, status.alias("status"))


@query("class_map", "masks", sql="SELECT subject, z, y, x, max(cls) AS cls FROM masks GROUP BY subject, z, y, x")
def _(v: Views) -> DataFrame:
    return pixels.pixels_of(truth_runs(v)).select(*KEY, "y", "x", "cls")


_PIXEL = """, pairs AS (
  SELECT model, subject, z, y, x, max(p) AS p, max(cls) AS cls FROM (
    SELECT model, subject, z, y, x, 1 AS p, 0 AS cls FROM pin
    UNION ALL SELECT model, t.subject, t.z, t.y, t.x, 0, cls FROM truth t JOIN scored s ON s.subject = t.subject AND s.z = t.z)
  GROUP BY ALL),
counts AS (
  SELECT model, subject, z, count(*) FILTER (p > 0) AS np, count(*) FILTER (cls > 0) AS nt, count(*) FILTER (p > 0 AND cls > 0) AS nb,
    count(*) FILTER (cls = 1) AS n1, count(*) FILTER (cls = 2) AS n2, count(*) FILTER (cls = 3) AS n3,
    count(*) FILTER (cls = 1 AND p > 0) AS h1, count(*) FILTER (cls = 2 AND p > 0) AS h2, count(*) FILTER (cls = 3 AND p > 0) AS h3,
    count(*) FILTER (cls = 1 OR p = 1) AS a1, count(*) FILTER (cls = 2 OR p = 2) AS a2, count(*) FILTER (cls = 3 OR p = 3) AS a3
  FROM pairs GROUP BY ALL),
pm AS (
  SELECT model, subject, z,
    CASE WHEN coalesce(np + nt - nb, 0) = 0 THEN 1.0 ELSE nb / (np + nt - nb) END AS iou,
    CASE WHEN coalesce(np + nt, 0) = 0 THEN 1.0 ELSE 2 * nb / (np + nt) END AS dice,
    CASE WHEN coalesce(a1, 0) = 0 THEN 1.0 ELSE h1 / a1 END AS iou_light,
    CASE WHEN coalesce(a2, 0) = 0 THEN 1.0 ELSE 0.0 END AS iou_moderate,
    CASE WHEN coalesce(a3, 0) = 0 THEN 1.0 ELSE 0.0 END AS iou_dense,
    h1 / nullif(n1, 0) AS pixel_recall_light, h2 / nullif(n2, 0) AS pixel_recall_moderate,
    h3 / nullif(n3, 0) AS pixel_recall_dense
  FROM scored LEFT JOIN counts USING (model, subject, z))"""


@query("pixel_metrics", *EVAL, sql=TRUTH + _PIXEL + " SELECT * FROM pm")
def pixel_metrics(v: Views) -> DataFrame:
    return metrics.pixel_metrics(evaluation_sides(v).counts())


def _objects(empty: str) -> str:
    """Object metrics: components of each class and of the predictions, and which are touched."""
    return f""",
{component_sql("(SELECT subject, z, cls, y, x FROM truth)", "subject, z, cls", 8, "tc")},
{component_sql("pin", "model, subject, z", 8, "pc")},
tpx AS (SELECT subject, z, cls, comp_id, y, unnest(range(x0, x1 + 1)) AS x FROM tc),
ppx AS (SELECT model, subject, z, comp_id, y, unnest(range(x0, x1 + 1)) AS x FROM pc),
tn AS (SELECT subject, z, cls, count(DISTINCT comp_id) AS n FROM tc GROUP BY ALL),
th AS (SELECT p.model, t.subject, t.z, t.cls, count(DISTINCT t.comp_id) AS n FROM tpx t JOIN pin p USING (subject, z, y, x) GROUP BY ALL),
pn AS (SELECT model, subject, z, count(DISTINCT comp_id) AS n FROM pc GROUP BY ALL),
ph AS (SELECT p.model, p.subject, p.z, count(DISTINCT p.comp_id) AS n FROM ppx p JOIN truth t USING (subject, z, y, x) GROUP BY ALL),
om AS (
  SELECT s.model, s.subject, s.z, coalesce(ph.n, 0) AS tp, coalesce(pn.n, 0) - coalesce(ph.n, 0) AS fp,
    CASE WHEN coalesce(pn.n, 0) = 0 THEN 0.0 ELSE (pn.n - coalesce(ph.n, 0)) / pn.n END AS fdr,
    {", ".join(f"CASE WHEN n{k}.n IS NULL THEN {empty} ELSE coalesce(h{k}.n, 0) / n{k}.n END AS sensitivity_{c}" for k, c in metrics.CLASSES)}
  FROM scored s LEFT JOIN pn USING (model, subject, z) LEFT JOIN ph USING (model, subject, z)
  {" ".join(f"LEFT JOIN tn n{k} ON n{k}.subject = s.subject AND n{k}.z = s.z AND n{k}.cls = {k} LEFT JOIN th h{k} ON h{k}.model = s.model AND h{k}.subject = s.subject AND h{k}.z = s.z AND h{k}.cls = {k}" for k, _ in metrics.CLASSES)})"""


@query("object_metrics", *EVAL, sql=TRUTH + _objects("1.0") + " SELECT * FROM om")
def _(v: Views) -> DataFrame:
    at = evaluation_sides(v)
    return metrics.object_metrics(at.slices, None, None, met=metrics.Meetings(at.labelled(), MKEY, KEY))


def skeleton_sql(source: str, keys: str, name: str, steps: int = 40) -> str:
    """Zhang-Suen thinning: the whole mask is emitted anew in each of a fixed number of passes."""
    around = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    bits = ", ".join(f"max(CASE WHEN a.dy = {dy} AND a.dx = {dx} THEN 1 ELSE 0 END) AS r{i}" for i, (dy, dx) in enumerate(around))
    count = " + ".join(f"r{i}" for i in range(8))
    turns = " + ".join(f"CASE WHEN r{i} = 0 AND r{(i + 1) % 8} = 1 THEN 1 ELSE 0 END" for i in range(8))
    pair = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    cols = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""{name}_all AS (
  SELECT {keys}, y, x, 0 AS step FROM {source}
  UNION ALL
  SELECT {keys}, y, x, step + 1 FROM (
    SELECT {cols}, a.y, a.x, a.step, {bits}
    FROM (SELECT s.*, o.dy, o.dx, s.y + o.dy AS ny, s.x + o.dx AS nx FROM {name}_all s, (SELECT * FROM (VALUES (0), (1), (-1)) p(dy), (VALUES (0), (1), (-1)) q(dx)) o) a
    JOIN {name}_all b ON {pair} AND b.y = a.ny AND b.x = a.nx
    GROUP BY {cols}, a.y, a.x, a.step)
  WHERE step < {steps} AND NOT ({count} BETWEEN 2 AND 6 AND ({turns}) = 1 AND
    CASE WHEN step % 2 = 0 THEN r0 * r2 * r4 = 0 AND r2 * r4 * r6 = 0 ELSE r0 * r2 * r6 = 0 AND r0 * r4 * r6 = 0 END)),
{name} AS (SELECT {keys}, y, x FROM {name}_all WHERE step = {steps})"""


@query("skeleton", "masks", sql=f"m AS (SELECT DISTINCT subject, z, y, x FROM masks), {skeleton_sql('m', 'subject, z', 'sk')} SELECT * FROM sk")
def _(v: Views) -> DataFrame:
    return stencils.skeleton(None, labelled=components.label_runs(runs.merged(v.mask_runs), KEY, 8))


_LINES = f""",
sides AS (SELECT 0 AS side, model, subject, z, y, x FROM pin
  UNION ALL SELECT 1, s.model, t.subject, t.z, t.y, t.x FROM truth t JOIN scored s ON s.subject = t.subject AND s.z = t.z),
{skeleton_sql("sides", "side, model, subject, z", "sk")},
sn AS (SELECT model, subject, z, count(*) FILTER (side = 0) AS s0, count(*) FILTER (side = 1) AS s1 FROM sk GROUP BY ALL),
sh AS (SELECT k.model, k.subject, k.z, count(*) FILTER (k.side = 0) AS h0, count(*) FILTER (k.side = 1) AS h1
  FROM sk k JOIN sides o ON o.side = 1 - k.side AND o.model = k.model AND o.subject = k.subject AND o.z = k.z AND o.y = k.y AND o.x = k.x GROUP BY ALL),
cl AS (SELECT model, subject, z, round(CASE WHEN coalesce(s0, 0) + coalesce(s1, 0) = 0 THEN 1.0 ELSE 2 * a * b / (a + b) END, 6) AS cldice
  FROM (SELECT *, (coalesce(h0, 0) + 1e-6) / (coalesce(s0, 0) + 1e-6) AS a, (coalesce(h1, 0) + 1e-6) / (coalesce(s1, 0) + 1e-6) AS b
        FROM scored LEFT JOIN sn USING (model, subject, z) LEFT JOIN sh USING (model, subject, z)))"""


@query("centerline_dice", *EVAL, sql=TRUTH + _LINES + " SELECT * FROM cl")
def _(v: Views) -> DataFrame:
    at = evaluation_sides(v)
    return rounded(metrics.centerline_dice(at.slices, None, None, labelled=at.labelled(), own=KEY))


@query(
    "evaluation_table", *EVAL,
    sql=TRUTH + _PIXEL + _objects("1.0") + _LINES + """
SELECT model, subject, z, z AS slice, printf('%03d', z) AS file, sensitivity_dense,
  sensitivity_moderate, sensitivity_light, fp AS false_positives_vaan_fun, tp AS true_positives_vaan_fun, fdr, dice AS dice_score, iou AS iou_score,
  iou_dense, iou_moderate, iou_light, cldice FROM om JOIN pm USING (model, subject, z) JOIN cl USING (model, subject, z)""",
)
def evaluation_table(v: Views) -> DataFrame:
    return evaluate_masks(evaluation_sides(v)).withColumn("cldice", F.round("cldice", 6))


@query(
    "evaluation_in_box", *EVAL,
    sql=TRUTH + _PIXEL + _objects("NULL") + _LINES + """
SELECT model, subject, z, sensitivity_light AS obj_sens_light, sensitivity_moderate AS obj_sens_moderate, sensitivity_dense AS obj_sens_dense,
  tp AS obj_tp, fp AS obj_fp, fdr AS obj_fdr, dice AS pixel_dice, iou AS pixel_iou, cldice AS pixel_cldice, pixel_recall_light,
  pixel_recall_moderate, pixel_recall_dense FROM om JOIN pm USING (model, subject, z) JOIN cl USING (model, subject, z)
WHERE (subject, z) IN (SELECT (subject, z) FROM roi)""",
)
def _(v: Views) -> DataFrame:
    return evaluate_in_box(v.predicted, v.pred_runs, v.mask_runs, v.roi_runs).withColumn("pixel_cldice", F.round("pixel_cldice", 6))


_NAMES = ["iou", "dice", "pixel_recall_light", "pixel_recall_moderate", "pixel_recall_dense"]


@query(
    "metric_summary", *EVAL,
    sql=TRUTH + _PIXEL + """, long AS (
  SELECT model, subject, unnest(['iou', 'dice', 'pixel_recall_light', 'pixel_recall_moderate', 'pixel_recall_dense']) AS metric,
    unnest([iou, dice, pixel_recall_light, pixel_recall_moderate, pixel_recall_dense]) AS value FROM pm)
SELECT metric, model, subject, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM long
WHERE value IS NOT NULL GROUP BY GROUPING SETS ((metric, model, subject), (metric, model), (metric))""",
)
def _(v: Views) -> DataFrame:
    return rounded(metrics.summary(pixel_metrics(v), _NAMES), 4)


@query(
    "skip_report", "slices", "roi", "predicted",
    sql="""every AS (SELECT subject, z, CAST(m AS INT) AS model FROM slices, (SELECT unnest(range(0, 4)) AS m))
SELECT e.model, e.subject, e.z, CASE WHEN r.subject IS NULL THEN 'empty region' WHEN p.subject IS NULL THEN 'no prediction'
  WHEN e.model = 3 AND e.z = 5 THEN 'shape mismatch' ELSE 'ok' END AS status
FROM every e LEFT JOIN (SELECT DISTINCT subject, z FROM roi) r ON r.subject = e.subject AND r.z = e.z
LEFT JOIN predicted p ON p.m = e.model AND p.subject = e.subject AND p.z = e.z""",
)
def _(v: Views) -> DataFrame:
    slices = v.slices
    models = v.spark.range(4).select(F.col("id").cast("int").alias("model"))
    odd = (F.col("model") == 3) & (F.col("z") == 5)
    sizes = v.predicted.select(*MKEY, F.when(odd, 64).otherwise(128).alias("h"), F.lit(128).alias("w"))
    return skip_report(slices, models, v.roi, v.predicted, sizes)


@query(
    "model_comparison", "masks", "pred", "predicted",
    sql="""common AS (SELECT subject, z FROM predicted WHERE m IN (0, 1, 2) GROUP BY subject, z HAVING count(*) = 3),
px AS (SELECT subject, z, y, x, max(CASE WHEN m = 0 THEN 1 ELSE 0 END) AS m0, max(CASE WHEN m = 1 THEN 1 ELSE 0 END) AS m1,
         max(CASE WHEN m = 2 THEN 1 ELSE 0 END) AS m2, max(cls) AS cls
       FROM (SELECT m, subject, z, y, x, 0 AS cls FROM pred WHERE m IN (0, 1, 2) UNION ALL SELECT 9, subject, z, y, x, cls FROM masks)
       SEMI JOIN common USING (subject, z) GROUP BY subject, z, y, x)
SELECT *, CASE WHEN cls IN (2, 3) THEN 255 ELSE 0 END AS r, CASE WHEN cls IN (1, 2) THEN 255 ELSE 0 END AS g, 0 AS b FROM px""",
)
def _(v: Views) -> DataFrame:
    """One row a pixel that any of three models or the truth holds, on slices that all have."""
    wanted = (0, 1, 2)
    have = v.predicted.filter(F.col("model").isin(*wanted)).groupBy(*KEY).agg(F.count_distinct("model").alias("n"))
    common = have.filter(F.col("n") == len(wanted)).select(*KEY)
    rows = v.pred.filter(F.col("model").isin(*wanted)).select(*KEY, "y", "x", "model", F.lit(0).alias("cls")).unionAll(
        truth_of(v).select(*KEY, "y", "x", F.lit(-1).alias("model"), "cls")
    )
    rows = rows.join(common, [*KEY], "left_semi")
    held = [F.max((F.col("model") == m).cast("int")).alias(f"m{m}") for m in wanted]
    out = rows.groupBy(*KEY, "y", "x").agg(*held, F.max("cls").alias("cls"))
    return out.select("*", class_rgb(F.col("cls")).alias("_c")).select(*out.columns, "_c.r", "_c.g", "_c.b")


@query(
    "model_agreement", "pred", "predicted",
    sql="""SELECT a.m AS model, b.m AS other, a.subject, a.z, count(*) AS n_both
FROM pred a JOIN pred b ON a.m < b.m AND a.subject = b.subject AND a.z = b.z AND a.y = b.y AND a.x = b.x GROUP BY ALL""",
)
def _(v: Views) -> DataFrame:
    """Pixels that two models share: the models of a pixel are paired, at most six pairs each."""
    sets = v.pred.groupBy(*KEY, "y", "x").agg(F.sort_array(F.collect_set("model")).alias("_m")).filter(F.size("_m") > 1)
    first = sets.select(*KEY, "_m", F.explode("_m").alias("model"))
    pairs = first.select(*KEY, "model", F.explode(F.filter("_m", lambda x: x > F.col("model"))).alias("other"))
    return pairs.groupBy("model", "other", *KEY).agg(F.count("*").alias("n_both"))


for _n in (4, 8):

    @query(f"components_{_n}", *EVAL, sql=TRUTH + f", {component_sql('truth', 'subject, z', _n, 'c')} SELECT * FROM c")
    def _(v: Views, n: int = _n) -> DataFrame:
        return components.label_runs(runs.merged(truth_runs(v, v.roi_runs)), KEY, n, band=32)
