"""Queries of store levels, store discovery and the subject catalogue, over paths that are made
from the suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import volumes
from .registry import Views, query

_ARRAYS = """a AS (SELECT printf('st%04d', s_suppkey // 4) AS store, CASE s_suppkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '2' WHEN 2 THEN 'x/3' ELSE '4' END AS level, s_suppkey % 3 AS r
  FROM supplier), b AS (SELECT *, store || '/' || level AS path FROM a WHERE s_keep), """.replace("a WHERE s_keep", "a WHERE NOT (r = 0 AND level IN ('0', '2'))")


def store_arrays(v: Views) -> DataFrame:
    k = F.col("s_suppkey")
    level = F.when(k % 4 == 0, "0").when(k % 4 == 1, "2").when(k % 4 == 2, "x/3").otherwise("4")
    rows = v.table("supplier").select(F.format_string("st%04d", F.floor(k / 4)).alias("store"), level.alias("level"), (k % 3).alias("r"))
    rows = rows.filter(~((F.col("r") == 0) & F.col("level").isin("0", "2")))
    return rows.select("store", "level", F.concat("store", F.lit("/"), "level").alias("path"))


for _rule in ("strict", "preferred"):

    @query(f"store_level_{_rule}", sql="WITH " + _ARRAYS.rstrip(", ") + f""" SELECT store, level, path FROM (
  SELECT *, row_number() OVER (PARTITION BY store ORDER BY CASE WHEN level = '2' THEN 0 WHEN level = '0' THEN 1 ELSE 2 END, path) AS k FROM b
  {"WHERE level = '2'" if _rule == "strict" else ""}) WHERE k = 1""")
    def _(v: Views, rule: str = _rule) -> DataFrame:
        return volumes.pick_level(store_arrays(v), "2", rule)


@query("histology_stores", sql="""SELECT printf('%03d', s_suppkey // 3) AS subject, min(printf('in/sub-%03d/micr/sub-%03d_acq-%d_stain-LY_DF.ome.zarr', s_suppkey // 3, s_suppkey // 3, s_suppkey % 7)) AS path
FROM supplier WHERE s_suppkey % 5 > 0 GROUP BY 1""")
def _(v: Views) -> DataFrame:
    k = F.col("s_suppkey")
    s = F.format_string("%03d", F.floor(k / 3))
    stain = F.when(k % 5 > 0, "LY_DF").otherwise("OTHER")
    name = F.concat(F.lit("in/sub-"), s, F.lit("/micr/sub-"), s, F.lit("_acq-"), (k % 7).cast("string"), F.lit("_stain-"), stain, F.lit(".ome.zarr"))
    return volumes.find_histology(v.table("supplier").select(name.alias("path")))


@query("outline_stores", sql="""SELECT subject, path FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY CASE WHEN path LIKE '%_mask.ome.zarr' THEN 0 ELSE 1 END, path) AS r FROM (
  SELECT printf('%03d', s_suppkey // 2) AS subject, printf('in/sub-%03d/micr/masks/Outline', s_suppkey // 2) || CASE WHEN s_suppkey % 3 = 0 THEN '_mask' ELSE '' END || '.ome.zarr' AS path FROM supplier)) WHERE r = 1""")
def _(v: Views) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.concat(F.lit("in/sub-"), F.format_string("%03d", F.floor(k / 2)), F.lit("/micr/masks/Outline"), F.when(k % 3 == 0, "_mask").otherwise(""), F.lit(".ome.zarr"))
    return volumes.pick_outline(v.table("supplier").select(name.alias("path")))


@query("subject_catalogue", sql="""SELECT subject, CAST(pos - 1 AS INT) AS pos, slides[pos] AS slide, slices[pos] AS slice_idx FROM (
  SELECT *, unnest(range(1, len(slides) + 1)) AS pos FROM (SELECT 'S' || (s_suppkey // 10) AS subject, list(printf('%03d', s_suppkey) ORDER BY s_suppkey) AS slides,
    coalesce(list(s_suppkey ORDER BY s_suppkey) FILTER (s_suppkey % 3 > 0), []) AS slices FROM supplier GROUP BY ALL))""")
def _(v: Views) -> DataFrame:
    k = F.col("s_suppkey")
    rows = v.table("supplier").groupBy(F.concat(F.lit("S"), F.floor(k / 10).cast("string")).alias("subject")).agg(
        F.transform(F.sort_array(F.collect_list(k)), lambda x: F.format_string("%03d", x)).alias("slides"),
        F.sort_array(F.collect_list(F.when(k % 3 > 0, k))).alias("slices"),
    )
    return volumes.subject_catalog(rows)
