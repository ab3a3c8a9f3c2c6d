"""Where plans register their queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import ctes, view
from ..operators.graph import saved

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEY = ("subject", "z")
MKEY = ("model", "subject", "z")


class Views:
    """The raster views of one folder of tables, by name; ``m`` is called model. ``block``: those of one of several blocks
    of subjects (its number, and how many there are)."""

    def __init__(self, spark: SparkSession, sf_dir: str, block: tuple[int, int] | None = None):
        self.spark, self.sf_dir, self.block = spark, sf_dir, block

    def __getattr__(self, name: str) -> DataFrame:
        df = self.plain(name)
        return df.withColumnRenamed("m", "model").drop("zg") if name != "box" else df

    def plain(self, name: str) -> DataFrame:
        """A view with all its columns as they are called in SQL."""
        return view(self.spark, self.sf_dir, name, self.block)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, *views: str, sql: str | None = None):
    """Registers build(Views) under ``name``; sql may begin with further CTEs."""

    def mark(build: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
        if sql is not None:
            start = sql.lstrip()[:6].upper() == "SELECT"
            ORACLES[name] = (ctes(*views) + ("\n" if start else ",\n") if views else "") + sql
        return build

    return mark


#: Pixels of the frames of a block of subjects.
BLOCK = 1 << 29


def in_blocks(v: Views, build: Callable[[Views], DataFrame], keep: Callable[[DataFrame], DataFrame] = lambda df: df, back: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """What ``build`` makes of all subjects, one block of them after the other where their frames have more than BLOCK pixels: a block's
    files are dropped before the next begins, so disk holds those of one, and the results. Subjects stay whole, as slices are
    compared along z. ``keep``: how a block's result is saved, ``back``: what makes the rows of that again."""
    n = v.slices.agg(F.sum(F.col("h").cast("bigint") * F.col("w"))).first()[0] or 0
    blocks = -(-n // BLOCK)
    if blocks <= 1:
        return build(v)
    return back(reduce(DataFrame.unionAll, [saved(keep(build(type(v)(v.spark, v.sf_dir, (i, blocks))))) for i in range(blocks)]))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, as the oracles do."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def digest(px: DataFrame, *by: str, value: str = "v", digits: int = 3) -> DataFrame:
    """n, total and a place-weighted total of the values of each group: a whole image in a row."""
    place = F.col("y") * 128 + F.col("x") + 1
    return px.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.sum(F.col(value).cast("double")), digits).alias("total"),
        F.round(F.sum(F.col(value).cast("double") * place), max(0, digits - 2)).alias("weighted"),
    )


def digest_sql(source: str, by: str, value: str = "v", digits: int = 3) -> str:
    return (
        f"SELECT {by}, count(*) AS n, round(sum(CAST({value} AS DOUBLE)), {digits}) AS total, "
        f"round(sum(CAST({value} AS DOUBLE) * (y * 128 + x + 1)), {max(0, digits - 2)}) AS weighted FROM {source} GROUP BY {by}"
    )


def component_sql(source: str, keys: str, connectivity: int, name: str) -> str:
    """CTEs <name>_runs ... <name>: labelled runs of the mask in ``source``."""
    reach, pair = {4: 0, 8: 1}[connectivity], " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""{name}_runs AS (
  SELECT *, row_number() OVER (ORDER BY {keys}, y, x0) AS id FROM (
    SELECT {keys}, y, min(x) AS x0, max(x) AS x1
    FROM (SELECT *, x - row_number() OVER (PARTITION BY {keys}, y ORDER BY x) AS g FROM (SELECT DISTINCT {keys}, y, x FROM {source}))
    GROUP BY {keys}, y, g)),
{name}_links AS (
  SELECT a.id AS a, b.id AS b FROM {name}_runs a JOIN {name}_runs b
  ON {pair} AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 + {reach} AND b.x0 <= a.x1 + {reach}),
{name}_reach AS (SELECT id, id AS root FROM {name}_runs UNION SELECT r.id, l.b FROM {name}_reach r JOIN {name}_links l ON r.root = l.a),
{name} AS (
  SELECT {keys}, y, x0, x1, CAST(dense_rank() OVER (PARTITION BY {keys} ORDER BY root) AS BIGINT) AS comp_id
  FROM {name}_runs JOIN (SELECT id, min(root) AS root FROM {name}_reach GROUP BY id) USING (id))"""


#: Truth and predictions inside the region of interest.
TRUTH = """truth AS (
  SELECT subject, z, y, x, max(cls) AS cls FROM masks SEMI JOIN roi USING (subject, z, y, x) GROUP BY subject, z, y, x),
pin AS (SELECT m AS model, subject, z, y, x FROM pred SEMI JOIN roi USING (subject, z, y, x)),
scored AS (SELECT m AS model, subject, z FROM predicted)"""
