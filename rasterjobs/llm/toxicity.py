"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct byte n-grams (ASCII lower-cased, a blank at both ends) it
holds, hashed into ``2**BITS`` buckets. Each bucket has a ratio r = log(share among toxic /
share among clean); logistic regression is fitted on features of value r instead of 1, with
the vector scaled to at most unit length. The model is fitted in one task on a bounded sample
of labelled rows; scoring is a map over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, fold, texts_of

#: Lengths of the n-grams in bytes, and the bits of a bucket.
ORDERS, BITS = (5, 7), 18
#: The length that feature vectors are scaled to, at most.
LENGTH = 4
#: At most so many labelled documents are fitted on (those of least id hash).
MAX_TRAIN = 4_000
#: Bytes (and documents, so that both fit 32 bits) hashed at a time.
CHUNK, MOST_DOCS = 1 << 20, 1 << 13


def _buckets(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each n-gram of bytes, n up to 8."""
    size = len(data) - n + 1
    key = data[:size].astype(np.uint64)
    for i in range(1, n):
        key <<= np.uint64(8)
        key |= data[i : i + size]
    key *= np.uint64(0x9E3779B97F4A7C15 + 2 * n)
    return (key >> np.uint64(64 - BITS)).astype(np.uint32)


def _distinct(h: np.ndarray) -> np.ndarray:
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def _together(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of the distinct features of texts of about CHUNK bytes in all."""
    lengths = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint32), lengths)
    parts = [np.empty(0, np.uint32)]
    for n in ORDERS:
        if len(data) >= n:
            whole = doc[n - 1 :] == doc[: len(doc) - n + 1]
            parts.append((_buckets(data, n) | (doc[: len(whole)] << np.uint32(BITS)))[whole])
    key = _distinct(np.concatenate(parts))
    return (key >> np.uint32(BITS)).astype(np.int32), (key & np.uint32((1 << BITS) - 1)).astype(np.int32)


def features(texts: list[bytes | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, number of documents, document from 0, bucket) for runs of texts.

    Null, empty or very short texts have none. A text beyond CHUNK is cut with an overlap
    and its parts' features united, so memory stays bounded by the buckets."""
    begin, size = 0, 0
    for i, text in enumerate([*texts, None]):
        length = len(text or b"")
        if i == len(texts) or size + length > CHUNK or i - begin >= MOST_DOCS:
            if i > begin:
                yield (begin, i - begin, *_together([b" %b " % t.lower() if t else b"" for t in texts[begin:i]]))
            begin, size = i, 0
        if length > CHUNK:
            over, text = max(ORDERS) - 1, b" %b " % text.lower()
            found = [_together([text[k : k + CHUNK + over]])[1] for k in range(0, len(text), CHUNK)]
            found = _distinct(np.concatenate(found))
            yield i, 1, np.zeros(len(found), np.int32), found
            begin = i + 1
        else:
            size += length


def _weights(found: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n: int, rounds: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(ratio, weight, bias, least norm): logistic loss by Nesterov's steps from 0.

    found: (document, bucket) in pieces; only features with a ratio are put together."""
    size = 1 << BITS
    counts = [1.0 + sum(np.bincount(flat[labels[row] == k], minlength=size) for row, flat in found) for k in (0, 1)]
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[(counts[0] + counts[1] < min(7, 4 + n / 100)) | (np.abs(ratio) < 0.7)] = 0
    live = [ratio[flat] != 0 for _, flat in found]
    row = np.concatenate([row[x] for (row, _), x in zip(found, live, strict=True)])
    flat = np.concatenate([flat[x] for (_, flat), x in zip(found, live, strict=True)])
    del live
    norm = np.sqrt(np.bincount(row, ratio[flat] ** 2, minlength=n))
    least = float(max(np.median(norm), 1e-3))
    value = ratio[flat] * (LENGTH / np.maximum(norm, least))[row]
    w, bias, step, t = np.zeros(size), 0.0, 4 / (LENGTH**2 + 1), 1.0
    look, look_bias = w, bias
    for _ in range(rounds):
        z = np.bincount(row, value * look[flat], minlength=n) + look_bias
        error = (1 / (1 + np.exp(-z)) - labels) / n
        new = look - step * (np.bincount(flat, value * error[row], minlength=size) + 1e-6 * look)
        new_bias = look_bias - step * error.sum()
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look_bias = new + (t - 1) / later * (new - w), new_bias + (t - 1) / later * (new_bias - bias)
        w, bias, t = new, new_bias, later
    return ratio, w, bias, least


def _margins(found: list[tuple[np.ndarray, np.ndarray]], n: int, model: tuple) -> np.ndarray:
    ratio, weight, bias, least = model[:4]
    square, product = ratio**2, ratio * weight
    norm = np.sqrt(sum(np.bincount(row, square[flat], minlength=n) for row, flat in found))
    return sum(np.bincount(row, product[flat], minlength=n) for row, flat in found) * LENGTH / np.maximum(norm, least) + bias


def fit(texts: list[bytes], labels: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """(ratio, weight, bias, least norm, share of label 1). Each half of the texts is also scored by a model of the
    other half; a logistic curve over these margins turns the whole model's into probabilities.

    With one class only (or no rows) all weights are 0 and the bias is the smoothed share."""
    n, half = len(texts), np.arange(len(texts)) % 2
    share = (labels.sum() + 0.5) / (n + 1)
    if not n or any(not labels[half == k].any() or labels[half == k].all() for k in (0, 1)):
        return np.zeros(1 << BITS), np.zeros(1 << BITS), float(np.log(share / (1 - share))), 1.0, float(share)
    found = [(doc + np.int32(first), bucket) for first, _, doc, bucket in features(texts)]
    across = np.empty(n)
    for k in (0, 1):
        own, other = ([(row[x] // 2, flat[x]) for row, flat in found for x in [(half[row] == k) == same]] for same in (True, False))
        across[half != k] = _margins(other, (half != k).sum(), _weights(own, labels[half == k], (half == k).sum(), rounds))
    del own, other
    slope, base = _line(across, labels)
    ratio, weight, bias, least = _weights(found, labels, n, rounds)
    return ratio, weight * slope, float(bias * slope + base), least, float(share)


def _line(z: np.ndarray, labels: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """Slope and bias of a logistic curve over z (Platt's scaling, with his smoothed targets)."""
    ones = labels.sum()
    target = np.where(labels > 0, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    spread = max(z.std(), 1e-9)
    x, line = np.stack([z / spread, np.ones(len(z))]), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(line @ x, -30, 30)))
        curve = (x * (p * (1 - p) + 1e-6)) @ x.T + 1e-6 * np.eye(2)
        move = np.linalg.solve(curve, x @ (p - target))
        line -= move / max(1.0, np.abs(move).max())
    return line[0] / spread, line[1]


def scores(texts: list[bytes | None], model: tuple[np.ndarray, np.ndarray, float, float, float]) -> np.ndarray:
    """Probabilities of label 1; of texts without a weighted feature no more than its share in training."""
    out, live = np.empty(len(texts)), model[0] != 0
    for first, n, doc, bucket in features(texts):
        p = 1 / (1 + np.exp(-np.clip(_margins([(doc, bucket)], n, model), -700, 700)))
        bare = np.bincount(doc[live[bucket]], minlength=n) == 0
        out[first : first + n] = np.where(bare, np.minimum(p, model[4]), p)
    return out


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", max_train: int = MAX_TRAIN,
) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """Fits on at most max_train labelled documents with a text, whatever the size of the tables.

    Rows with a null id or label take no part; an id with several labels is toxic if one is.
    Only the sampled labels are joined with the documents, which are scanned and not shuffled.
    """
    labelled = (
        labels.select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("int").alias("_toxic"))
        .dropna()
        .groupBy("_id")
        .agg(F.max("_toxic").alias("_toxic"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_train)
    )
    sample = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .dropna()
        .join(F.broadcast(labelled), "_id")
        .orderBy(F.xxhash64("_text"), "_id", "_toxic")
        .limit(max_train)
        .select("_text", "_toxic")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for b in batches:  # at most max_train rows
            texts += texts_of(b, "_text")
            marks += b.column(1).to_pylist()
        model = fit(texts, np.array(marks, np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x.astype(np.float64).tobytes()]) for x in model[:2]]
            + [pa.array([x]) for x in model[2:]], ["ratio", "weight", "bias", "least", "share"]
        )

    schema = "ratio binary, weight binary, bias double, least double, share double"
    row = sample.coalesce(1).mapInArrow(run, schema).first()
    if row is None:
        return fit([], np.empty(0, np.int64))
    return np.frombuffer(row.ratio), np.frombuffer(row.weight), row.bias, row.least, row.share


def score(
    docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float, float, float], *, id_col: str = "doc_id",
    text_col: str = "text", keep: list[str] | None = None, score_col: str = "score",
) -> DataFrame:
    """``keep`` columns (the id) and a score from 0 to 1 for each row; null text is an empty one."""
    keep = keep or [id_col]
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, len(keep)):
            out = pa.array(scores(texts_of(b, "_text"), model))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], out], [*keep, score_col])

    return rows.mapInArrow(run, ", ".join([*fields, f"{score_col} double"]))


def rejected(text: Column, model: tuple[np.ndarray, np.ndarray, float, float, float], least: float) -> Column:
    """Whether a text's score is at least ``least``; only the text goes to Python and a flag comes back."""

    @F.arrow_udf("boolean")
    def flag(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            batch = pa.RecordBatch.from_arrays([array], ["_text"])
            parts = [scores(texts_of(b, "_text"), model) >= least for b in byte_slices([batch], 0)]
            yield pa.array(np.concatenate(parts) if parts else np.empty(0, bool))

    return flag(text)


def held_out(id_col: str = "doc_id"):
    """(held out, trains) of the quarter of ids that the query op1 sets aside."""
    return fold(id_col, 4, 2)
