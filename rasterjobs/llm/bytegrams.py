"""Byte n-grams packed into 64-bit integers, and vectors kept under them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Text bytes handled at a time.
CHUNK = 1 << 21


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """The n bytes from each place as one big-endian integer (n up to 8); data holds uint8."""
    size = max(0, len(data) - n + 1)
    key = np.zeros(size, np.uint64)
    for i in range(n):
        key <<= np.uint64(8)
        key |= data[i : i + size]
    return key


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their counts or sums of weights."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    if weights is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[at], np.diff(np.append(at, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(weights, at)


class Table:
    """Rows under distinct 64-bit keys: a hash index that is looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys)).bit_length() + 1)
        h = self._slot(keys)
        order = np.argsort(h, kind="stable")
        self.keys, self.values = keys[order], values[order]
        slots = np.bincount(h, minlength=(1 << self.bits))
        self.start = np.concatenate([[0], np.cumsum(slots)]).astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys) or not len(keys):
            return out
        slot = self._slot(keys)
        at, end = self.start[slot], self.start[slot + 1]
        todo = np.flatnonzero(at < end)
        at, end, keys = at[todo], end[todo], keys[todo]
        while len(todo):
            hit = self.keys[at] == keys
            out[todo[hit]] = at[hit]
            at += 1
            more = ~hit & (at < end)
            todo, at, end, keys = todo[more], at[more], end[more], keys[more]
        return out


class Known:
    """A number under each of distinct 64-bit keys, for looking up keys that are all among them: most
    have a slot of their own, which holds the number itself."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        slot = self._slot(keys)
        self.held = np.zeros(1 << self.bits, np.float32)
        self.held[slot] = values
        often = np.bincount(slot, minlength=1 << self.bits) > 1
        self.held[often] = np.nan
        crowded = often[slot]
        self.rest, self.values = Table(keys[crowded], np.arange(crowded.sum())), values[crowded]

    _slot = Table._slot

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = self.held[self._slot(keys)]
        crowded = np.flatnonzero(np.isnan(out))
        at = self.rest.find(keys[crowded])
        out[crowded] = self.values[self.rest.values[at]] if len(self.values) else np.nan
        return out


def chunks(texts: list[bytes], pad: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes with ``pad`` zero bytes before each text, places, text of each place).

    Several short texts go together; a long text comes in parts, each with the ``pad`` bytes
    before it in front, so every byte of every text is one place once."""
    held, owners, size = [], [], 0
    gap = bytes(pad)

    def together():
        lengths = np.array([len(h) for h in held])
        ends = np.cumsum(lengths)
        places = np.concatenate([np.arange(e - n + pad, e) for e, n in zip(ends, lengths, strict=True)])
        return (
            np.frombuffer(b"".join(held), np.uint8), places,
            np.repeat(np.array(owners), lengths - pad),
        )

    for i, text in enumerate(texts):
        for begin in range(0, len(text), CHUNK):
            part = text[begin : begin + CHUNK]
            before = (gap + text[max(0, begin - pad) : begin])[-pad:] if pad else b""
            if held and size + len(part) > CHUNK:
                yield together()
                held, owners, size = [], [], 0
            held.append(before + part)
            owners.append(i)
            size += len(part)
    if held:
        yield together()
