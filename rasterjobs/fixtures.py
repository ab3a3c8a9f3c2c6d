"""Raster views over the star-schema tables, in SQL that Spark and DuckDB both run.

The views define input rasters for the registered queries (frames of 128 x 128, 40 parts a
slice). One text per view serves both engines; only integer division and the row generator
differ. ``views`` gives Spark DataFrames, ``ctes`` the WITH clause of an oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.graph import wide

_KEY = "subject, z"

#: view -> SQL. ``a ~/ b`` is integer division, ``SPAN(a, b)`` a row for each whole number a..b.
VIEWS = {
    "slices": """
        SELECT zg, printf('S%03d', zg ~/ 10) AS subject, CAST(zg % 10 AS INT) AS z, 128 AS h, 128 AS w
        FROM (SELECT DISTINCT p_partkey ~/ 40 AS zg FROM part)""",
    "predicted": """
        SELECT CAST(m AS INT) AS m, zg, subject, z FROM (SELECT *, SPAN(0, 3) AS m FROM slices)
        WHERE zg % (7 + m) <> 0""",
    "box": """
        SELECT p_partkey AS k, p_partkey ~/ 40 AS zg, 1 + p_partkey % 3 AS cls, (p_partkey * 37) % 128 AS y0,
               (p_partkey * 101 + p_size * 7) % 128 AS x0,
               CASE WHEN p_partkey % 2 = 0 THEN 1 + p_partkey % 4 ELSE 2 + p_size END AS h,
               CASE WHEN p_partkey % 2 = 0 THEN 2 + p_size ELSE 1 + p_partkey % 4 END AS w
        FROM part""",
    "masks": """
        SELECT DISTINCT s.subject, s.z, CAST(cls AS INT) AS cls, CAST(y AS INT) AS y, CAST(x AS INT) AS x
        FROM (SELECT zg, cls, y, SPAN(x0, least(x0 + w - 1, 127)) AS x
              FROM (SELECT *, SPAN(y0, least(y0 + h - 1, 127)) AS y FROM box)) p JOIN slices s ON s.zg = p.zg""",
    "roi": """
        SELECT subject, z, CAST(y AS INT) AS y, CAST(x AS INT) AS x
        FROM (SELECT *, SPAN(4, 124) AS x FROM (SELECT *, SPAN(4, 124) AS y FROM slices WHERE zg % 11 <> 10))
        WHERE (y - 64) * (y - 64) + (x - 64) * (x - 64) <= 3600""",
    "pred": """
        SELECT DISTINCT CAST(p.m AS INT) AS m, s.subject, s.z, CAST(y AS INT) AS y, CAST(x AS INT) AS x
        FROM (SELECT m, zg, y, SPAN(greatest(xa, 0), least(xb, 127)) AS x
              FROM (SELECT m, zg, xa, xb, SPAN(greatest(ya, 0), least(yb, 127)) AS y
                    FROM (SELECT m, zg, y0 + k % 3 - 1 AS ya, y0 + k % 3 - 1 + h - 1 AS yb,
                                 x0 + (k * (m + 1)) % 5 - 2 AS xa, x0 + (k * (m + 1)) % 5 - 2 + w - 1 AS xb
                          FROM (SELECT *, SPAN(0, 3) AS m FROM box) WHERE (k + m) % (3 + m) <> 0
                          UNION ALL
                          SELECT m, s_suppkey ~/ 2, (s_suppkey * 53) % 128, (s_suppkey * 53) % 128 + 3,
                                 (s_suppkey * 29 + m * 31) % 128, (s_suppkey * 29 + m * 31) % 128 + 6
                          FROM (SELECT s_suppkey, SPAN(0, 3) AS m FROM supplier)) WHERE greatest(ya, 0) <= least(yb, 127))
              WHERE greatest(xa, 0) <= least(xb, 127)) p
        JOIN predicted s ON s.zg = p.zg AND s.m = p.m""",
    "image": """
        SELECT p.subject, p.z, CAST(c AS INT) AS c, CAST(p.y AS INT) AS y, CAST(p.x AS INT) AS x,
               CAST(CASE WHEN p.y < 3 + zg % 4 OR p.y >= 125 OR p.x < 5 OR p.x >= 124 - zg % 3 THEN 0
                    ELSE (p.y * 7 + p.x * 13 + zg * 29 + c * 41 + (p.y * p.x) % 61) % 97
                         + CASE WHEN k.cls IS NULL THEN 0 ELSE 80 + 20 * k.cls END END AS INT) AS v
        FROM (SELECT *, SPAN(0, 2) AS c FROM (SELECT *, SPAN(0, 127) AS x FROM (SELECT *, SPAN(0, 127) AS y FROM slices))) p
        LEFT JOIN (SELECT subject, z, y, x, max(cls) AS cls FROM masks GROUP BY subject, z, y, x) k
          ON k.subject = p.subject AND k.z = p.z AND k.y = p.y AND k.x = p.x""",
    "candidates": """
        SELECT c.m, p.subject, p.z, c.cand, p.y, p.x, c.score
        FROM (SELECT CAST(m AS INT) AS m, zg, subject, z, CAST(cand AS INT) AS cand,
                     CAST((zg * 37 + m * 11 + cand * 29) % 100 AS DOUBLE) / 100 AS score
              FROM (SELECT *, SPAN(0, 2) AS cand FROM (SELECT *, SPAN(0, 3) AS m FROM slices))) c
        JOIN pred p ON p.subject = c.subject AND p.z = c.z AND p.m = (c.m + c.cand) % 4""",
    "candidate_scores": """
        SELECT CAST(m AS INT) AS m, subject, z, CAST(cand AS INT) AS cand, CAST((zg * 37 + m * 11 + cand * 29) % 100 AS DOUBLE) / 100 AS score
        FROM (SELECT *, SPAN(0, 2) AS cand FROM (SELECT *, SPAN(0, 3) AS m FROM slices))""",
    "outline_half": """
        SELECT subject, z, CAST(y AS INT) AS y, CAST(x AS INT) AS x
        FROM (SELECT *, SPAN(0, 63) AS x FROM (SELECT *, SPAN(0, 63) AS y FROM slices))
        WHERE (y - 32) * (y - 32) + (x - 32) * (x - 32) <= 900""",
    # the same masks as row runs: what the pixel views above hold, before a pixel is made of it
    "mask_runs": """
        SELECT s.subject, s.z, CAST(cls AS INT) AS cls, CAST(y AS INT) AS y, CAST(x0 AS INT) AS x0, CAST(least(x0 + p.w - 1, 127) AS INT) AS x1
        FROM (SELECT *, SPAN(y0, least(y0 + h - 1, 127)) AS y FROM box) p JOIN slices s ON s.zg = p.zg""",
    "roi_runs": """
        SELECT subject, z, CAST(y AS INT) AS y, CAST(64 - r AS INT) AS x0, CAST(64 + r AS INT) AS x1
        FROM (SELECT *, floor(sqrt(3600 - (y - 64) * (y - 64))) AS r FROM (SELECT *, SPAN(4, 124) AS y FROM slices WHERE zg % 11 <> 10))""",
    "outline_half_runs": """
        SELECT subject, z, CAST(y AS INT) AS y, CAST(32 - r AS INT) AS x0, CAST(32 + r AS INT) AS x1
        FROM (SELECT *, floor(sqrt(900 - (y - 32) * (y - 32))) AS r FROM (SELECT *, SPAN(2, 62) AS y FROM slices))""",
    "pred_runs": """
        SELECT CAST(p.m AS INT) AS m, s.subject, s.z, CAST(y AS INT) AS y, CAST(greatest(xa, 0) AS INT) AS x0, CAST(least(xb, 127) AS INT) AS x1
        FROM (SELECT m, zg, xa, xb, SPAN(greatest(ya, 0), least(yb, 127)) AS y
              FROM (SELECT m, zg, y0 + k % 3 - 1 AS ya, y0 + k % 3 - 1 + h - 1 AS yb,
                           x0 + (k * (m + 1)) % 5 - 2 AS xa, x0 + (k * (m + 1)) % 5 - 2 + w - 1 AS xb
                    FROM (SELECT *, SPAN(0, 3) AS m FROM box) WHERE (k + m) % (3 + m) <> 0
                    UNION ALL
                    SELECT m, s_suppkey ~/ 2, (s_suppkey * 53) % 128, (s_suppkey * 53) % 128 + 3,
                           (s_suppkey * 29 + m * 31) % 128, (s_suppkey * 29 + m * 31) % 128 + 6
                    FROM (SELECT s_suppkey, SPAN(0, 3) AS m FROM supplier)) WHERE greatest(ya, 0) <= least(yb, 127)) p
        JOIN predicted s ON s.zg = p.zg AND s.m = p.m
        WHERE greatest(xa, 0) <= least(xb, 127)""",
    "prob": "SELECT subject, z, y, x, max(score) AS p FROM candidates GROUP BY subject, z, y, x",
}
TABLES = {"part": "p_partkey", "supplier": "s_suppkey"}


def _needs(name: str) -> list[str]:
    """The views that a view is made of, itself last."""
    out: list[str] = []
    for other in VIEWS:
        if other != name and re.search(rf"\b{other}\b", VIEWS[name].split("SELECT", 1)[1]):
            if re.search(rf"(FROM|JOIN)\s+{other}\b", VIEWS[name]):
                out += [x for x in _needs(other) if x not in out]
    return [*out, name]


def _spark(text: str) -> str:
    text = re.sub(r"SPAN\(((?:[^()]|\([^()]*\))*)\)", r"explode(sequence(\1))", text)
    return text.replace("~/", "div").replace("printf(", "format_string(")


def _duckdb(text: str) -> str:
    def rows(m: re.Match) -> str:
        depth, parts = 0, [""]
        for ch in m[1]:
            depth += (ch == "(") - (ch == ")")
            if ch == "," and not depth:
                parts.append("")
            else:
                parts[-1] += ch
        return f"unnest(range({parts[0]}, {parts[1]} + 1))"

    return re.sub(r"SPAN\(((?:[^()]|\([^()]*\))*)\)", rows, text).replace("~/", "//")


def ctes(*names: str) -> str:
    """WITH clause of these views and all they need; further CTEs may follow after a comma."""
    order: list[str] = []
    for name in names:
        order += [x for x in _needs(name) if x not in order]
    return "WITH RECURSIVE " + ",\n".join(f"{x} AS ({_duckdb(VIEWS[x])})" for x in order)


def view(spark: SparkSession, sf_dir: str, name: str, block: tuple[int, int] | None = None) -> DataFrame:
    """One raster view as a DataFrame; nothing is registered or computed before it is used.

    The tables are few bytes and would be one task, but what is made of a row is not: rows are dealt before. Views are
    joined by shuffles, since Spark does not see that they are larger than the tables. ``block`` (i, n): of n blocks of subjects
    the one of number i; all views but ``box`` are made of, or joined to, slices."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").repartition(parts, key) for t, key in TABLES.items()}
    for x in _needs(name):
        sql = re.sub(rf"(FROM|JOIN)(\s+)({'|'.join(known)})\b(?!\.)", r"\1\2{\3}", _spark(VIEWS[x]))
        known[x] = wide(spark.sql(sql, **{k: v for k, v in known.items() if f"{{{k}}}" in sql}))
        if x == "slices":
            mine = known[x] if block is None else known[x].filter(F.pmod(F.xxhash64("subject"), F.lit(block[1])) == block[0])
            known[x] = wide(mine.repartition(parts, "subject", "z"))
    return known[name]
