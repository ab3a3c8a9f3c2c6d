"""Numpy kernels for one tile or crop; Spark brings the data, these hold the arithmetic."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

_CODEC = pa.Codec("zstd", 1)


def squeezed(body: bytes) -> bytes:
    """Bytes made fewer; checkpoints keep rows as they are."""
    return struct.pack("<I", len(body)) + _CODEC.compress(body, asbytes=True)


def unsqueezed(body: bytes) -> bytes:
    return _CODEC.decompress(body[4:], struct.unpack_from("<I", body)[0], asbytes=True)


#: What a packed array is: doubles by their bytes' places, places in a list of values, or whole numbers that small.
_DOUBLES, _LISTED_8, _LISTED_16, _WHOLE_8, _WHOLE_16 = range(5)
_HEAD = struct.Struct("<BII")


def packed(a: np.ndarray) -> bytes:
    """Doubles, bit for bit, in few bytes: images hold small whole numbers, or few values, whatever arithmetic gave them. Packed arrays
    may follow each other (see unpacked)."""
    values = np.ascontiguousarray(a, np.float64).reshape(-1)
    bits = values.view(np.uint64)
    with np.errstate(invalid="ignore"):
        whole = values.astype(np.uint16)
    if np.array_equal(whole.astype(np.float64).view(np.uint64), bits):
        kind, body = (_WHOLE_8, whole.astype(np.uint8)) if not len(whole) or whole.max() < 256 else (_WHOLE_16, whole)
        body = body.tobytes()
    else:
        kind, body = _DOUBLES, None
        probe = bits[:: max(1, len(bits) >> 9)]
        if 2 * len(np.unique(probe)) <= len(probe):
            known, at = np.unique(bits, return_inverse=True)
            if 16 * len(known) <= 8 * len(bits) and len(known) <= 1 << 16:
                kind, small = (_LISTED_8, np.uint8) if len(known) <= 256 else (_LISTED_16, np.uint16)
                body = struct.pack("<I", len(known)) + known.tobytes() + at.astype(small).tobytes()
        if body is None:
            body = np.ascontiguousarray(bits.view(np.uint8).reshape(-1, 8).T).tobytes()
    body = squeezed(body)
    return _HEAD.pack(kind, len(bits), len(body)) + body


def unpacked(body: bytes) -> np.ndarray:
    """The doubles of packed arrays that follow each other."""
    out, at = [], 0
    while at < len(body):
        kind, n, size = _HEAD.unpack_from(body, at)
        at += _HEAD.size
        raw = unsqueezed(body[at : at + size])
        at += size
        if kind == _DOUBLES:
            out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).reshape(-1).view(np.float64))
        elif kind in (_WHOLE_8, _WHOLE_16):
            out.append(np.frombuffer(raw, np.uint8 if kind == _WHOLE_8 else np.uint16).astype(np.float64))
        else:
            k = struct.unpack_from("<I", raw)[0]
            known = np.frombuffer(raw, np.float64, k, 4)
            out.append(known[np.frombuffer(raw, np.uint8 if kind == _LISTED_8 else np.uint16, n, 4 + 8 * k)])
    return out[0] if len(out) == 1 else np.concatenate([np.empty(0), *out])


def gaussian_weights(sigma: float) -> np.ndarray:
    radius = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return w / w.sum()


def reflect(i: np.ndarray, n: int) -> np.ndarray:
    """Places outside 0..n-1 mirrored at the edges, which count twice (d c b a | a b c d)."""
    i = np.mod(i, 2 * n)
    return np.where(i < n, i, 2 * n - 1 - i)


def correlate(a: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """Weighted sums of neighbours along an axis, without the margin of half the weights."""
    size = a.shape[axis] - len(weights) + 1
    part = lambda k: a[k : k + size] if axis == 0 else a[:, k : k + size]
    out = np.zeros(part(0).shape)
    for k, w in enumerate(weights):
        out += w * part(k)
    return out


def edges(a: np.ndarray) -> np.ndarray:
    """Sobel's magnitude: sqrt((gy^2 + gx^2) / 2), without a margin of 1."""
    smooth, slope = np.array([1, 2, 1]) / 4, np.array([1, 0, -1]) / 2
    gy = correlate(correlate(a, slope, 0), smooth, 1)
    gx = correlate(correlate(a, smooth, 0), slope, 1)
    return np.sqrt((gy * gy + gx * gx) / 2)


def _removable() -> np.ndarray:
    """For the two kinds of passes, whether a pixel goes, by its ring of neighbours (bits from the one above, clockwise)."""
    ring = (np.arange(256)[:, None] >> np.arange(8)) & 1
    count, turns = ring.sum(1), ((ring == 0) & (np.roll(ring, -1, 1) == 1)).sum(1)
    n, e, s, w = ring[:, 0], ring[:, 2], ring[:, 4], ring[:, 6]
    free = [(n * e * s == 0) & (e * s * w == 0), (n * e * w == 0) & (n * s * w == 0)]
    return np.array([(count >= 2) & (count <= 6) & (turns == 1) & f for f in free])


REMOVABLE = _removable()


def thin(mask: np.ndarray, passes: int | None = None) -> np.ndarray:
    """Zhang-Suen thinning (1984) until nothing changes in two consecutive passes, or that many were done. A pass looks at
    the pixels that are left, not at the background."""
    a = np.pad(mask.astype(np.uint8), 1)
    wide, flat = a.shape[1], a.reshape(-1)
    steps = (-wide, -wide + 1, 1, wide + 1, wide, wide - 1, -1, -wide - 1)
    left = np.flatnonzero(flat)
    idle = step = 0
    while idle < 2 and step != passes:
        ring = np.zeros(len(left), np.uint8)
        for k, move in enumerate(steps):
            ring |= flat[left + move] << k
        gone = REMOVABLE[step % 2][ring]
        flat[left[gone]] = 0
        idle = 0 if gone.any() else idle + 1
        left = left[~gone]
        step += 1
    return a[1:-1, 1:-1].astype(bool)


def runs_of(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Masks (k, h, w) as row runs: their number, row, and first and last column."""
    held = np.zeros((*masks.shape[:2], masks.shape[2] + 2), np.int8)
    held[:, :, 1:-1] = masks
    turn = np.diff(held, axis=2)
    k, y, x0 = np.nonzero(turn == 1)
    return k, y, x0, np.nonzero(turn == -1)[2] - 1


def percentile(values: np.ndarray, p: float) -> float:
    """As Spark's percentile: between the two values that are nearest to the rank, as near as the rank is."""
    at = (values.size - 1) * (p / 100)
    low, high = int(np.floor(at)), int(np.ceil(at))
    a, b = np.partition(values, [low, high])[[low, high]]
    return a if low == high or a == b else (high - at) * a + (at - low) * b


def widened(mask: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """The union of a mask moved by d rows and widened by r columns for each (d, r)."""
    out, (h, w), most = np.zeros(mask.shape, bool), mask.shape, max(r for _, r in spans)
    sums = np.cumsum(np.pad(mask.astype(np.int32), ((0, 0), (most + 1, most))), axis=1)
    for d, r in spans:
        wide = sums[:, most + r + 1 : most + r + 1 + w] > sums[:, most - r : most - r + w]
        if abs(d) < h:
            out[max(0, d) : h + min(0, d)] |= wide[max(0, -d) : h - max(0, d)]
    return out


def hessian_eigenvalues(a: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Scale-normalised Hessian eigenvalues (by magnitude, small first) of a blurred padded tile.

    ``a`` carries a margin of radius + 2 on all sides, which is used up."""
    w = gaussian_weights(sigma)
    g = correlate(correlate(a, w, 0), w, 1)
    dy, dx = (g[2:] - g[:-2]) / 2, (g[:, 2:] - g[:, :-2]) / 2
    yy, xx, xy = (dy[2:, 2:-2] - dy[:-2, 2:-2]) / 2, (dx[2:-2, 2:] - dx[2:-2, :-2]) / 2, (dy[1:-1, 3:-1] - dy[1:-1, 1:-3]) / 2
    yy, xx, xy = (sigma**2 * v for v in (yy, xx, xy))
    root = np.sqrt(((xx - yy) / 2) ** 2 + xy**2)
    e1, e2 = (xx + yy) / 2 + root, (xx + yy) / 2 - root
    swap = np.abs(e1) > np.abs(e2)
    return np.where(swap, e2, e1), np.where(swap, e1, e2)
