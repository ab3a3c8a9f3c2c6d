"""Continuity over slices that arrive in any order, against the batch form."""

import time

import numpy as np
import pytest

from rasterjobs.operators import components
from rasterjobs.streaming.continuity import continuity_stream, slice_rows

ROW = "subject string, z int, after int, comps array<struct<comp_id:bigint,area:bigint,met:array<struct<prev:bigint,shared:bigint>>>>"


@pytest.fixture(scope="module")
def scene(spark):
    """(slice rows, what the batch form gives): two subjects, a skipped z, an empty slice."""
    draw = np.random.default_rng(3)
    rows, every = [], []
    for s in "AB":
        for z in (0, 1, 2, 4, 5, 6, 7):
            every.append((s, z))
            if (s, z) != ("A", 4):
                rows += [(s, z, int(y), int(x)) for y, x in zip(*np.nonzero(draw.random((14, 14)) < 0.18))]
    px = spark.createDataFrame(rows, "subject string, z int, y int, x int")
    slices = spark.createDataFrame(every, "subject string, z int")
    labelled = components.label(px, ("subject", "z"), 8).cache()
    batch = components.continuity(px, slices=slices, labelled=labelled, min_share=0.3, min_area=8)
    return slice_rows(labelled, slices).collect(), {(r.subject, r.z, r.comp_id, r.area, r.stays) for r in batch.collect()}


def streamed(spark, tmp_path, batches, patience=None, until=None):
    """What the stream gave by the end of each batch; with timers a stream never rests, so it is asked until these z are there."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    name = f"told_{tmp_path.name}"
    source, query, told = tmp_path / "in", None, []
    source.mkdir()
    for i, rows in enumerate(batches):
        if rows:
            spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").json(str(source / f"b{i}"))
        if query is None:
            arriving = spark.readStream.schema(ROW).option("recursiveFileLookup", True).json(str(source))
            found = continuity_stream(arriving, min_share=0.3, min_area=8, patience_ms=patience)
            query = found.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
        if until is None:
            query.processAllAvailable()
        else:
            end = time.monotonic() + 60
            while time.monotonic() < end and {r.z for r in spark.table(name).collect()} != until[i]:
                time.sleep(0.5)
        told.append([tuple(r) for r in spark.table(name).collect()])
    query.stop()
    return told


def test_slices_in_any_order_give_the_batch_result(spark, tmp_path, scene):
    rows, want = scene
    pick = lambda *zs: [r for r in rows if r.z in zs]
    # 7 and 2 wait; 1 releases 2; a repeat of 0 changes nothing
    told = streamed(spark, tmp_path, [pick(7, 2), pick(0), pick(1, 0), pick(6, 5, 4)])
    assert told[0] == [] and {r[1] for r in told[1]} == {0} and {r[1] for r in told[2]} == {0, 1, 2}
    assert len(told[3]) == len(set(told[3])) and set(told[3]) == want and {s for *_, s in want} == {True, False}


def test_a_slice_that_does_not_come_is_given_up(spark, tmp_path, scene):
    """1 does not come: 2 is settled as after nothing, and 4 after 2; then 1 comes, and all of it stays."""
    rows = [r for r in scene[0] if r.subject == "B"]
    pick = lambda *zs: [r for r in rows if r.z in zs]
    told = streamed(spark, tmp_path, [pick(0), pick(2, 4), pick(1)], patience=200, until=[{0}, {0, 2, 4}, {0, 1, 2, 4}])
    assert {r[1] for r in told[0]} == {0}
    assert {r[1] for r in told[1]} == {0, 2, 4} and all(r[4] for r in told[1] if r[1] == 2)
    assert {r[1] for r in told[2]} == {0, 1, 2, 4} and all(r[4] for r in told[2] if r[1] == 1)
