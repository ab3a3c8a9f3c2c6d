"""Byte-level BPE: exact encoding in linear time by backtracking, and decoding.

Bytes are mapped to Latin-1 characters so that a pyahocorasick automaton can hold the
vocabulary. A piece of text is encoded greedily by longest matches; a token is kept only
if it is compatible with the one before it (the two bytes strings joined would be merged
into just these two), else a shorter token is tried, else the token before is taken back.
Compatibility of two adjacent tokens is memoised, and an end from which no encoding goes on
is never tried again, so the work is linear in the text.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices

#: Cached pieces of each of a worker's two generations, and the longest piece (characters) that is cached.
CACHED, CACHED_CHARS = 200_000, 48
#: Texts taken from an Arrow batch at a time.
SLICE = 1_000


@functools.lru_cache(maxsize=2)
def tokens_of(path: str) -> dict[int, bytes]:
    """id -> bytes, from a file of ranks that every machine has."""
    with open(path, "rb") as f:
        pairs = (line.split() for line in f if line.strip())
        return {int(n): base64.b64decode(token) for token, n in pairs}


class Decoder:
    """The bytes of tokens, in one flat array: texts are decoded by gathering their tokens' stretches."""

    def __init__(self, path: str):
        tokens = tokens_of(path)
        known = np.array(sorted(tokens))
        self.size = np.full(int(known[-1]) + 2 if len(known) else 1, -1, np.int64)
        self.size[known] = [len(tokens[n]) for n in known.tolist()]
        self.flat = np.frombuffer(b"".join(tokens[n] for n in known.tolist()), np.uint8)
        self.first = np.cumsum(np.maximum(self.size, 0)) - self.size

    def decode(self, packed: list[bytes | None]) -> pa.BinaryArray:
        """Packed ids to the bytes that they stand for; null to none. An id outside the vocabulary is an error."""
        ids = np.minimum(np.frombuffer(b"".join(p for p in packed if p), "<u4"), len(self.size) - 1).astype(np.int64)
        size = self.size[ids]
        if len(ids) and size.min() < 0:
            raise ValueError("an id is outside the vocabulary")
        ends = np.concatenate([[0], np.cumsum(size)])
        cuts = ends[np.cumsum([0, *(len(p or b"") // 4 for p in packed)])]
        out = np.empty(ends[-1], np.uint8)
        step = 1 << 18
        for k in range(0, len(ids), step):  # the places of a stretch at a time
            part, own = size[k : k + step], slice(ends[k], ends[min(k + step, len(ids))])
            at = np.repeat(self.first[ids[k : k + step]] - ends[k : min(k + step, len(ids))], part)
            at += np.arange(own.start, own.stop)
            out[own] = self.flat[at]
        return pa.BinaryArray.from_buffers(pa.large_binary(), len(packed), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(out)])


class BytePairs(dict):
    """piece (str) -> its ids as packed little-endian 32-bit integers; itself the cache."""

    def __init__(self, path: str, pattern: str):
        self.token, self.older = tokens_of(path), {}
        self.rank = {token: n for n, token in self.token.items()}
        self.split = regex.compile(pattern).findall
        self.fits: dict[int, bool] = {}
        # a token that merging its own bytes does not give stands only for a whole piece
        usable, self.halves = {}, {}
        for t, n in self.rank.items():
            parts = self.merged(t, 2)
            if len(parts) == 1 or len(parts) == 2 and self.rank.get(parts[0] + parts[1]) is not None:
                usable[t] = n
                if len(parts) == 2:
                    self.halves[n] = (self.rank[parts[0]], self.rank[parts[1]])
        self.automaton = ahocorasick.Automaton()
        for token, n in usable.items():
            self.automaton.add_word(token.decode("latin-1"), (n, len(token) - 1))
        self.automaton.make_automaton()
        self.length = {n: len(t) for t, n in usable.items()}
        self.shorter = {
            n: next((usable[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in usable), -1)
            for t, n in usable.items()
        }

    def merged(self, piece: bytes, least: int = 1) -> list[bytes]:
        """BPE by its definition: merge the pair of least rank, leftmost first, until ``least`` parts
        or none that merges are left. For short bytes."""
        parts, rank = [piece[i : i + 1] for i in range(len(piece))], self.rank
        while len(parts) > least:
            ranks = [rank.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
            i = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[i] == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        if len(self.fits) > 4 * CACHED:
            self.fits.clear()
        known = self.fits[a << 32 | b] = self._unmerged(a, b)
        return known

    def _unmerged(self, a: int, b: int) -> bool:
        """Merging the bytes of a and b, joined, gives a and b.

        The two tokens grow on their own unless at some time the parts that meet at the border
        merge. Time is a rank; it is walked backwards: of the two parts at the border the one that
        was made last is taken apart. While both are there, their pair may not have a rank below
        the time at which one of them went into the next part (that merge goes first at the same
        rank only if it is to the left)."""
        rank, token, halves, until = self.rank, self.token, self.halves, 1 << 60
        while True:
            both = rank.get(token[a] + token[b])
            if both is not None and both < until:
                return False
            made_a, made_b = a if a in halves else -1, b if b in halves else -1
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                a, until = halves[a][1], a
            else:
                b, until = halves[b][0], b + 1

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        size, longest, shorter, length, fits = len(piece), [-1] * len(piece), self.shorter, self.length, self.fits
        for end, (n, back) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - back] = n  # ends rise, so the longest match from a place comes last
        out, at, dead, last = [], 0, bytearray(size + 1), -1
        token = longest[0] if piece else -1
        while at < size:
            while token >= 0:
                end = at + length[token]
                if not dead[end]:
                    if last < 0:
                        break
                    fit = fits.get(last << 32 | token)
                    if self.compatible(last, token) if fit is None else fit:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = end, token
                token = longest[at] if at < size else -1
            elif out:
                dead[at] = 1
                token = out.pop()
                last = out[-1] if out else -1
                at -= length[token]
            else:
                raise ValueError("the vocabulary lacks a single byte of the text")
        return out

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            ids = self.encode_piece(piece.encode())
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED:  # pieces that were not asked for since the last turn go
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))


@functools.lru_cache(maxsize=2)
def load(path: str, pattern: str) -> BytePairs:
    """One vocabulary in each Python worker; path is a file that every machine has."""
    return BytePairs(path, pattern)


@functools.lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encode(
    docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", back: bool = False
) -> DataFrame:
    """Adds nothing but replaces the text: (id, ids binary, n_tokens bigint).

    ids are packed little-endian unsigned 32-bit integers (``unpacked`` makes an array).
    Null or empty text has no tokens. Each match of ``pattern`` is encoded separately; strings
    of special tokens are ordinary text. A map over partitions: nothing is shuffled. ``back``
    adds ``decoded``, what the ids decode to, in the same pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = load(path, pattern)
        for batch in byte_slices(batches, 1, SLICE):
            packed = [pairs.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            arrays = [batch.column(0), pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())]
            if back:
                arrays.append(decoder(path).decode(packed).cast(pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "ids", "n_tokens", *["decoded"] * back]
    schema = f"`{id_col}` {kind}, ids binary, n_tokens bigint" + ", decoded binary" * back
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, *, ids_col: str = "ids") -> DataFrame:
    """All columns of ``encoded`` and ``decoded`` binary: the bytes that the ids stand for.

    Null ids decode to empty bytes; an id outside the vocabulary is an error."""
    columns = [*encoded.columns, "decoded"]
    place = columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, place, SLICE):
            text = decoder(path).decode(batch.column(place).to_pylist()).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], columns)

    return encoded.mapInArrow(run, _with_decoded(encoded))


def _with_decoded(encoded: DataFrame) -> str:
    fields = (f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return ", ".join([*fields, "decoded binary"])


def unpacked(encoded: DataFrame, *, ids_col: str = "ids") -> DataFrame:
    """ids as array<bigint>, for those who want them so."""
    hexed = F.hex(ids_col)
    le = lambda i: F.conv(
        F.concat(*[F.substring(hexed, i * 8 + 7 - 2 * k, F.lit(2)) for k in range(4)]), 16, 10
    ).cast("bigint")
    places = F.sequence(F.lit(0), (F.length(ids_col) / 4).cast("int") - 1)
    made = F.when(F.length(ids_col) > 0, F.transform(places, le)).otherwise(F.expr("cast(array() as array<bigint>)"))
    return encoded.withColumn(ids_col, made)
