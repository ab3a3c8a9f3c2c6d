"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts of orders 0 to ``ORDER`` is counted on labelled text
and then frozen. A byte is coded in its longest known context with probability (2c-1)/2n, or,
where the context has not seen it, by an escape of q/2n (q: distinct bytes seen there) and the
next shorter context, down to a uniform order -1. The language with the shortest code wins.

A text's code length is a sum over its bytes, and each term depends on at most ORDER + 1
bytes. So the trees are flattened once into tables from n-grams to vectors with one entry
per language, and scoring looks up whole arrays of n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytegrams import Table, chunks, counted, grams
from .common import fold, texts_of

ORDER = 4
#: Bytes of labelled text, over all languages and in expectation, that trees are counted on.
MAX_TRAIN_BYTES = 16_000_000
_LETTER = regex.compile(r"\p{L}").search


def _prepared(text: bytes | None) -> bytes:
    return b" ".join(text.lower().split()) if text else b""


class Trees:
    """The frozen trees of all languages as tables."""

    def __init__(self, languages: list[str], found: list[tuple[np.ndarray, np.ndarray]]):
        """found: for each language its (ORDER + 1)-grams and their counts."""
        self.languages = languages
        self.symbols, self.escapes = [], []  # by order
        for order in range(ORDER + 1):
            mask = np.uint64((1 << (8 * (order + 1))) - 1)
            rows = [counted(keys & mask, counts) for keys, counts in found]
            contexts = [k >> np.uint64(8) for k, _ in rows]
            totals = []
            for (_, c), ctx in zip(rows, contexts, strict=True):
                place, n = counted(ctx, c)
                _, q = counted(ctx)
                totals.append((place, n, q))
            self.escapes.append(self._table([t[0] for t in totals], [np.log2(2 * n / q) for _, n, q in totals], 0))
            bits = []
            for (_, c), ctx, (place, n, _) in zip(rows, contexts, totals, strict=True):
                bits.append(np.log2(2 * n[np.searchsorted(place, ctx)] / (2 * c - 1)))
            self.symbols.append((rows, bits))
        self.symbols = [self._flat(order) for order in range(ORDER + 1)]

    def _table(self, keys: list[np.ndarray], values: list[np.ndarray], missing: float) -> Table:
        distinct = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.uint64)
        out = np.full((len(distinct), len(self.languages)), missing, np.float32)
        for i, (k, v) in enumerate(zip(keys, values, strict=True)):
            out[np.searchsorted(distinct, k), i] = v
        return Table(distinct, out)

    def _flat(self, order: int) -> Table:
        """n-gram -> bits in every language; where one lacks it, what its shorter contexts take."""
        rows, bits = self.symbols[order]
        keys = [k for k, _ in rows]
        table = self._table(keys, bits, np.nan)
        lacking = np.isnan(table.values)
        if lacking.any():
            other = self._shorter(table.keys, order)
            table.values[lacking] = other[lacking]
        self.symbols[order] = table
        return table

    def _shorter(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Bits of n-grams that are unknown at this order: escape, then the order below."""
        at = self.escapes[order].find(keys >> np.uint64(8))
        out = np.where(at[:, None] >= 0, self.escapes[order].values[at], 0) if len(self.escapes[order].keys) else np.zeros((len(keys), len(self.languages)), np.float32)
        if order == 0:
            return out + np.float32(8)
        return out + self.bits(keys & np.uint64((1 << (8 * order)) - 1), order - 1)

    def bits(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        table = self.symbols[order]
        at = table.find(keys)
        if not len(table.keys):
            return self._shorter(keys, order)
        out = table.values[at]
        lost = np.flatnonzero(at < 0)
        if len(lost):
            out[lost] = self._shorter(keys[lost], order)
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        for data, places, owner in chunks(texts, ORDER):
            bits = self.bits(grams(data, ORDER + 1)[places - ORDER])
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            np.add.at(out, owner[starts], np.add.reduceat(bits.astype(np.float64), starts, axis=0))
        return out


def _count_grams(lang_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts = [_prepared(t) for t in texts_of(batch, text_col)]
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                for data, places, _ in chunks(own, ORDER):
                    keys, counts = counted(grams(data, ORDER + 1)[places - ORDER])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts)],
                        ["lang", "gram", "n"],
                    )

    return run


def train(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_train_bytes: int = MAX_TRAIN_BYTES
) -> Trees:
    """Trees of all non-null languages of docs.

    Each language gets an equal share of max_train_bytes: where it has more, the documents whose
    text hash is below that fraction (whole texts). The counts are summed by Spark; what comes
    to the driver is bounded by max_train_bytes. No rows or no languages: no trees."""
    rows = docs.select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")).dropna()
    size = rows.groupBy("_lang").agg(F.sum(F.octet_length("_text")).alias("_bytes"))
    size = size.orderBy(F.desc("_bytes"), "_lang").collect()
    if not size:
        return Trees([], [])
    share = max_train_bytes / len(size)
    kept = F.lit(False)
    for r in size:
        part = min(1.0, share / max(1, r["_bytes"]))
        most = (1 << 63) - 1
        draw = F.xxhash64("_text").bitwiseAND(F.lit(most)) <= min(int(part * 2.0**63), most)  # never 0 for a rare share
        kept = kept | ((F.col("_lang") == r["_lang"]) & draw)
    found = (
        rows.filter(kept)
        .mapInArrow(_count_grams("_lang", "_text"), "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages, out = sorted(r["_lang"] for r in size), []
    for lang in languages:
        own = found[found["lang"] == lang].sort_values("gram")
        out.append((own["gram"].to_numpy().astype(np.uint64), own["n"].to_numpy()))
    return Trees(languages, out)


def identify(
    docs: DataFrame, trees: Trees, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``keep`` columns (the id), lang_pred and score (the share of 2**-bits a byte that the best
    language has among all: 1/n at worst, towards 1 when it is far ahead).

    Null text, or one without a letter, is `und` with score 0; so is all text without trees.
    Ties go to the language of smaller name. A map: nothing is shuffled; the trees are bounded
    by the bytes they were counted on."""
    keep = keep or [id_col]
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, "und"], object)
        for b in batches:
            raw = texts_of(b, "_text")
            # only text before the first letter has to be decoded
            known = [bool(t) and bool(_LETTER(t[:200].decode("utf-8", "ignore")) or _LETTER(t.decode())) for t in raw]
            best, score = np.full(len(raw), len(names) - 1), np.zeros(len(raw))
            live = np.flatnonzero(known)
            if len(live) and model.languages:
                texts = [_prepared(raw[i]) for i in live]
                bits = model.lengths(texts)
                each = bits / np.array([[max(1, len(t))] for t in texts])
                odds = np.exp2(8 * (each.min(axis=1, keepdims=True) - each))
                best[live], score[live] = bits.argmin(axis=1), 1 / odds.sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(names[best].tolist(), pa.string()), pa.array(score)],
                [*keep, "lang_pred", "score"],
            )

    return rows.mapInArrow(run, ", ".join([*fields, "lang_pred string, score double"]))


def held_out(id_col: str = "doc_id"):
    """(held out, trains) of the quarter of ids that the query op9 sets aside."""
    return fold(id_col, 4, 2)
