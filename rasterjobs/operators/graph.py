"""Steps of a job that are computed once, and connected pieces of link tables."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds of a step after which the files of steps before are dropped.
LONG = 1.0
_CLEANS = "spark.cleaner.referenceTracking.cleanCheckpoints"


def saved(df: DataFrame) -> DataFrame:
    """df, computed once into spark.checkpoint.dir. Only a session on one machine (master local) gets a
    temporary folder where none is set; on a cluster that is an error, as machines share no such folder. It is joined by
    shuffles, as it keeps the size that Spark took its plan to have (see wide). Its files go when no table needs them any more; after
    a step that took long, so do at once those, and the shuffles, of steps that only led to saved ones."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    conf, began = context._jsc.sc().conf(), time.monotonic()
    before = conf.get(_CLEANS, None)
    conf.set(_CLEANS, "true")
    try:
        out = df.checkpoint(eager=True)
    finally:
        conf.remove(_CLEANS) if before is None else conf.set(_CLEANS, before)
    # df's own shuffles are still needed by df
    del df
    if time.monotonic() - began > LONG:
        gc.collect()
        context._jvm.System.gc()
    return wide(out)


def wide(df: DataFrame) -> DataFrame:
    """A table that grows with the input, joined by shuffles. Spark takes what explode and Python make of a few rows to be as
    small as these and would broadcast it through the driver, pixels and images too; few and F.broadcast go before this."""
    return df.hint("merge")


#: Rows of a table that every task may hold beside its own.
FEW = 50_000


def few(df: DataFrame) -> DataFrame:
    """A computed table, broadcast where it has no more than FEW rows; else joins shuffle, and AQE splits skewed keys."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _to_least(pairs: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Each neighbour v of a node u, and u, linked to the least of them."""
    least = pairs.groupBy(*by, "u").agg(F.least(F.min("v"), F.col("u")).alias("_m"))
    return pairs.join(least, [*by, "u"])


def least_reached(links: DataFrame, by: tuple[str, ...], most_rounds: int = 60) -> DataFrame:
    """(by, node, root): the least node that links (by, u, v) reach from each node that has one.

    Alternating large-star and small-star rounds (Kiveris et al. 2014), each computed once; nodes meet in joins and
    pre-aggregated minima only. Ends when a round changes nothing."""
    down = lambda df: df.select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    now, before = saved(down(links)), None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64(*by, "u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.unionByName(now.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        large = down(_to_least(both, by).filter("v > u").select(*by, F.col("v").alias("u"), F.col("_m").alias("v")))
        low = _to_least(large, by)
        small = low.select(*by, F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(low.select(*by, "u", F.col("_m").alias("v")))
        now = saved(down(small))
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return now.select(*by, F.col("u").alias("node"), F.col("v").alias("root"))
