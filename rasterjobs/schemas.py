"""Schemas of the tables that jobs exchange. Coordinates are always those of the full frame."""

from __future__ import annotations

TILES = (
    "subject string, modality string, level int, z int, c int, y0 int, x0 int, h int, w int, dtype string, data binary"
)
MASK_RUNS = "subject string, z int, y int, x0 int, x1 int"
STORE_ARRAYS = (
    "store string, path string, level string, shape array<bigint>, chunks array<bigint>, dtype string, "
    "compressor string, order string, separator string, fill double, version int"
)
SLICES = "subject string, z int, h int, w int"
