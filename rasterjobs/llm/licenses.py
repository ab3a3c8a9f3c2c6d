"""License scans: short notices found in whole texts with a bounded number of edits.

A notice that may have k edits is split into k + 1 pieces; by the pigeonhole principle one of
them stands in the text unchanged. All pieces of all notices are searched at once (exact
seeds); around each seed the regex library looks for the notice with at most k edits and
reports the span. Texts are compared as lower-cased ASCII letters, digits and non-ASCII bytes,
with one blank between words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import alnum_words, texts_of


class Notice(NamedTuple):
    """``phrase`` with at most ``errors`` edits, then ``tail`` exactly (what must not be mistaken)."""

    phrase: str
    label: str
    errors: int
    tail: str = ""


# Phrases whose exact places are counted, and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# The notices that are searched with edits.
NOTICES = (
    Notice("under the mit license", "mit", 2),
    Notice("permission is hereby granted free of charge", "mit", 4),
    Notice("apache license version", "apache-2", 2, " 2"),
    Notice("licensed under the apache license", "apache-2", 3, " 2"),
    Notice("cc by nc", "cc-by-nc", 0),
    Notice("creative commons attribution noncommercial", "cc-by-nc", 4),
    Notice("gnu general public license", "gpl", 2),
    Notice("gnu lesser general public license", "lgpl", 3),
    Notice("mozilla public license", "mpl", 2),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("released into the public domain", "public-domain", 3),
)
_EDGE = r"[0-9a-z\x80-\xff]"


def pieces(notice: Notice) -> list[tuple[int, str]]:
    """(offset, piece): errors + 1 pieces of nearly equal length."""
    n, size = notice.errors + 1, len(notice.phrase)
    cuts = [size * i // n for i in range(n + 1)]
    return [(a, notice.phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    def __init__(self, base: tuple[tuple[str, str], ...], notices: tuple[Notice, ...]):
        self.base = [(b" %b " % phrase.encode(), label) for phrase, label in base]
        self.notices = notices
        self.patterns = [
            regex.compile(rf"(?b)(?<!{_EDGE})(?:{regex.escape(n.phrase)}){{e<={n.errors}}}{regex.escape(n.tail)}(?!{_EDGE})")
            for n in notices
        ]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(notices):
            for offset, piece in pieces(notice):
                seeds.setdefault(piece, []).append((i, offset))
        self.seeds = ahocorasick.Automaton()
        for piece, owners in seeds.items():
            self.seeds.add_word(piece, (len(piece), owners))
        self.seeds.make_automaton()

    def scan(self, text: bytes | None) -> tuple[int, list[dict], list[dict]]:
        """(words, exact places, spans with edits); places are words from 0, ends excluded."""
        words = alnum_words(text)
        if not words:
            return 0, [], []
        line = b" %b " % b" ".join(words)
        blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
        before = lambda at: int(np.searchsorted(blanks, at))  # noqa: E731  blanks in front of a place
        exact, fuzzy = [], {}
        for phrase, label in self.base:
            at = line.find(phrase)
            while at >= 0:
                exact.append({"label": label, "first": before(at)})
                at = line.find(phrase, at + 1)
        wide, tried = line.decode("latin-1"), set()
        for end, (size, owners) in self.seeds.iter(wide):
            for i, offset in owners:
                notice, start = self.notices[i], end - size + 1 - offset
                if (i, start) in tried:
                    continue
                tried.add((i, start))
                found = self.patterns[i].search(
                    wide, max(0, start - notice.errors),
                    start + len(notice.phrase) + notice.errors + len(notice.tail) + 1,
                )
                if found:
                    # an edit may take in the blanks at the ends
                    a = found.start() + (wide[found.start()] == " ")
                    b = found.end() - (wide[found.end() - 1] == " ")
                    first, last = before(a) - 1, before(b)
                    errors = sum(found.fuzzy_counts)
                    key = (notice.label, first, last)
                    if key not in fuzzy or errors < fuzzy[key]["errors"]:
                        fuzzy[key] = {
                            "label": notice.label, "first": first, "end": last, "errors": errors,
                            "likeness": 1 - errors / len(notice.phrase),
                        }
        return len(words), exact, sorted(fuzzy.values(), key=lambda x: (x["first"], x["end"], x["label"]))


_EXACT = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64())]))
_FUZZY = pa.list_(
    pa.struct(
        [("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("errors", pa.int64()), ("likeness", pa.float64())]
    )
)


def scan_licenses(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    base: tuple[tuple[str, str], ...] = BASE, notices: tuple[Notice, ...] = NOTICES,
) -> DataFrame:
    """id, n_words, exact array<label, first>, spans array<label, first, end, errors, likeness>.

    One row per document row, repeated ones too. Null or empty text: no words, no places.
    Overlapping places all count. A map over partitions: nothing is shuffled, and a text's
    own size bounds the memory."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices)
        for batch in batches:
            found = [scanner.scan(t) for t in texts_of(batch, text_col)]
            counts, exact, fuzzy = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(counts, pa.int64()),
                    pa.array(exact, _EXACT), pa.array(fuzzy, _FUZZY),
                ],
                [id_col, "n_words", "exact", "spans"],
            )

    return docs.select(id_col, text_col).mapInArrow(
        run,
        f"`{id_col}` {kind}, n_words bigint, exact array<struct<label:string,first:bigint>>, "
        "spans array<struct<label:string,first:bigint,end:bigint,errors:bigint,likeness:double>>",
    )
