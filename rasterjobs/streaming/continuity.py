"""Continuity along z for slices that arrive over time, in any order: a stream of one row a slice."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..operators import components

_HELD = "z int, comps array<bigint>, areas array<bigint>, places array<int>, prevs array<bigint>, shares array<bigint>"
_OUT = "z int, comp_id bigint, area bigint, stays boolean"
#: What the first slice of a subject waits for.
_FIRST = "first"


def slice_rows(labelled: DataFrame, slices: DataFrame, sizes: DataFrame | None = None, subject: str = "subject") -> DataFrame:
    """(subject, z, after, comps): a row for each processed slice from labelled runs, as the stream takes it. after: the z of
    the processed slice before (null for the first); comps: its components with comp_id, area and met, an array of (prev,
    shared), the pixels that they share with components of that slice."""
    table = components.overlaps(labelled, slices.select(subject, "z").distinct(), (subject,), "z", sizes)
    one = F.when(F.col("comp_id").isNotNull(), F.struct("comp_id", F.col("area").cast("bigint").alias("area"), F.col("_met").alias("met")))
    rows = table.groupBy(subject, "z").agg(F.collect_list(one).alias("comps"))
    return rows.withColumn("after", F.lag("z").over(Window.partitionBy(subject).orderBy("z"))).select(subject, "z", "after", "comps")


class _InTurn(StatefulProcessor):
    """Settles slices in the order of their ``after`` and holds those whose turn has not come.

    State of a subject: the last settled slice and the components that stayed in it; the slices that wait, by the slice that
    they wait for; the slices that were given up. A timer runs while slices wait."""

    def __init__(self, subject: str, min_share: float, min_area: int, patience_ms: int | None):
        self.subject, self.min_share, self.min_area, self.patience = subject, min_share, min_area, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "z int, kept array<bigint>")
        self.waiting = handle.getMapState("waiting", "after string", _HELD)
        self.missed = handle.getMapState("missed", "z int", "missed boolean")

    def _settled(self, held: tuple, before: set[int] | None) -> tuple[list[dict], set[int]]:
        z, comps, areas, places, prevs, shares = held
        both = [0] * len(comps)
        for place, prev, shared in zip(places, prevs, shares, strict=True):
            if prev in (before or ()):
                both[place] += shared
        stays = [bool(not before or n / a >= self.min_share or a >= self.min_area) for n, a in zip(both, areas, strict=True)]
        rows = [{"z": z, "comp_id": c, "area": a, "stays": s} for c, a, s in zip(comps, areas, stays, strict=True)]
        return rows, {c for c, s in zip(comps, stays, strict=True) if s}

    def _chain(self, at: str, before: set[int] | None) -> list[dict]:
        """Settles the slice that waits for ``at``, then the one that waits for that, and so on."""
        out = []
        while self.waiting.containsKey((at,)):
            held = self.waiting.getValue((at,))
            self.waiting.removeKey((at,))
            rows, before = self._settled(held, before)
            out += rows
            at = str(held[0])
            self.last.update((held[0], sorted(before)))
        return out

    def _go_on(self) -> list[dict]:
        if not self.last.exists():
            return self._chain(_FIRST, None)
        z, kept = self.last.get()
        return self._chain(str(z), set(kept))

    def _timed(self, times: Any) -> None:
        if self.patience is None:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if any(True for _ in self.waiting.keys()):
            self.handle.registerTimer(times.getCurrentProcessingTimeInMs() + self.patience)

    def _told(self, key: tuple, rows: list[dict]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows).assign(**{self.subject: key[0]})[[self.subject, "z", "comp_id", "area", "stays"]].astype({"z": "int32"})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        out = []
        for pdf in rows:
            for z, after, comps in zip(pdf["z"], pdf["after"], pdf["comps"], strict=True):
                comps = sorted(comps, key=lambda c: c["comp_id"])
                met = [(k, m["prev"], m["shared"]) for k, c in enumerate(comps) for m in (c["met"] if c["met"] is not None else ())]
                held = (int(z), [int(c["comp_id"]) for c in comps], [int(c["area"]) for c in comps], *([int(m[i]) for m in met] for i in range(3)))
                if self.last.exists() and z <= self.last.get()[0]:
                    if self.missed.containsKey((int(z),)):
                        self.missed.removeKey((int(z),))
                        out += self._settled(held, None)[0]
                    continue
                self.waiting.updateValue((_FIRST if pd.isna(after) else str(int(after)),), held)
        out += self._go_on()
        self._timed(timerValues)
        yield from self._told(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        out = []
        turn = min(((held[0], at[0]) for at, held in self.waiting.iterator()), default=None)
        if turn is not None:
            if turn[1] != _FIRST:
                self.missed.updateValue((int(turn[1]),), (True,))
            out = self._chain(turn[1], None)
        self._timed(timerValues)
        yield from self._told(key, out)


def continuity_stream(
    slices: DataFrame, subject: str = "subject", min_share: float = 0.02, min_area: int = 1000, patience_ms: int | None = None
) -> DataFrame:
    """(subject, z, comp_id, area, stays) for a stream of slice rows (see slice_rows); the rule of components.continuity.

    Slices of a subject may arrive in any order, one row each. A slice is settled when the one that it comes after has been;
    until then it is held in the state. With ``patience_ms`` a timer gives up on a slice that others have waited for that
    long: the least that waits is settled as after a slice that kept nothing (all stay), and those behind it follow; if the
    slice given up comes after all, all of it stays and nothing else changes. Repeats of settled slices are left out.
    The session needs a state store with transactions for this (RocksDB's provider)."""
    mode = "None" if patience_ms is None else "ProcessingTime"
    kind = slices.schema[subject].dataType.simpleString()
    return slices.groupBy(subject).transformWithStateInPandas(_InTurn(subject, min_share, min_area, patience_ms), f"`{subject}` {kind}, {_OUT}", "Append", mode)
