"""Words of many texts at once: boundaries and 64-bit hashes by numpy, without a Python object a word."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import xxhash

from .common import U64, mix, span_hashes

#: Bytes handled at a time; it bounds a worker's memory.
BLOCK = 1 << 20
#: Words of more bytes are hashed one by one.
LONG = 64
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: One number for each byte value.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U64(0xD1B54A32D192ED03))


class Block(NamedTuple):
    """Words of a stretch of bytes."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray


def block_of(text: bytes) -> Block:
    """The words (runs of anything but ASCII white space) of some bytes."""
    data = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    np.logical_not(_WHITE[data], out=inside[1:-1].view(bool))
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    h = span_hashes(_BYTE[data], start, end)
    for i in np.flatnonzero(end - start > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(text[start[i] : end[i]])
    return Block(data, start, end, h)


def parts_of(text: bytes, most: int) -> Iterator[bytes]:
    """text cut before white space into parts of about ``most`` bytes; a longer word is not cut."""
    at = 0
    while at < len(text):
        end = at + most
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            step = text[end : end + 4096].split(None, 1)[0]
            end += len(step)
        yield text[at:end]
        at = end


def hashed(texts: list[bytes | None], change=None, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, number of words of each text).

    ``change`` is applied to texts joined by line feeds (``bytes.lower``, say) and keeps lengths."""
    counts, found, held, size = np.zeros(len(texts), np.int64), [], [], 0

    def flush() -> None:
        nonlocal held, size
        if held:
            whole = b"\n".join(texts[i] for i in held)
            b = block_of(change(whole) if change else whole)
            ends = np.cumsum([len(texts[i]) + 1 for i in held])
            counts[held] = np.diff(np.searchsorted(b.start, ends), prepend=0)
            found.append(b.hashes)
            held, size = [], 0

    for i, text in enumerate(texts):
        if not text:
            continue
        if size + len(text) > block:
            flush()
        if len(text) > block:
            for part in parts_of(text, block):
                b = block_of(change(part) if change else part)
                counts[i] += len(b.hashes)
                found.append(b.hashes)
            continue
        held.append(i)
        size += len(text) + 1
    flush()
    return np.concatenate(found) if found else np.empty(0, U64), counts
