"""Text quality by Bradley-Terry ranking.

A document is a vector of surface features of its whole text. Preference pairs put a document labelled good before one
labelled bad; the Bradley-Terry model makes the chance that one is preferred the logistic function of the difference of
two linear scores, so the weights come from logistic loss on feature differences. The cut is the quantile of the
scores at which the share of labelled documents above it equals the share labelled good, and gets the score 0.7.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm import arrays
from folioframe.operators.ranking import number_rows
from folioframe.session import discard, materialize

CUT = 0.7
# Preference pairs for each row of the rarer label; every row of the other one is in a pair at least.
PAIRS = 10
# The ridge of the weights for a thousand differences.
RIDGE = 1.0

_PUNCTUATION = np.array([*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_HIGH = np.zeros(256, bool)
_HIGH[0x80:] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True
_MARK = np.zeros(256, bool)
_MARK[_PUNCTUATION] = True
_RUN = 3


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float


def _distinct(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of each document."""
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    return np.bincount(doc[new], minlength=n)


def features(piece: arrays.Texts) -> np.ndarray:
    """One row of features for each document."""
    piece.words()
    data, n = piece.data, piece.n
    size = np.maximum(1, np.diff(piece.offsets))
    row = np.repeat(np.arange(n), np.diff(piece.offsets))
    words = np.diff(piece.first)
    count = np.maximum(1, words)

    def share(table: np.ndarray) -> np.ndarray:
        return np.bincount(row[table[data]], minlength=n) / size

    # Shares of single marks: how often each punctuation byte occurs.
    marks = np.flatnonzero(_MARK[data])
    place = np.searchsorted(_PUNCTUATION, data[marks])
    single = np.bincount(row[marks] * len(_PUNCTUATION) + place, minlength=n * len(_PUNCTUATION))
    columns = [np.log1p(200 * c) for c in (single.reshape(n, -1) / size[:, None]).T]
    columns += [np.log1p(20 * share(t)) for t in (_MARK, _UPPER, _DIGIT, _HIGH, _NEWLINE)]
    length = piece.ends - piece.starts
    mean = np.bincount(piece.doc, weights=length, minlength=n) / count
    square = np.bincount(piece.doc, weights=length.astype(float) ** 2, minlength=n) / count
    columns += [mean / 5, np.sqrt(np.maximum(0, square - mean**2)) / 5]
    marked = np.concatenate([[0], np.cumsum(_MARK[data])])
    for few in (1, 2, 3):
        ending = marked[piece.ends] - marked[np.maximum(piece.starts, piece.ends - few)] == few
        columns.append(np.log1p(20 * np.bincount(piece.doc[ending & (length >= few)], minlength=n) / count))
    alone = marked[piece.ends] - marked[piece.starts] == length
    columns.append(np.log1p(20 * np.bincount(piece.doc[alone], minlength=n) / count))
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    shout = upper[piece.ends] - upper[piece.starts] >= np.maximum(2, 0.6 * length)
    columns.append(np.log1p(20 * np.bincount(piece.doc[shout], minlength=n) / count))
    hashes = piece.word_hashes()
    columns.append(_distinct(piece.doc, hashes, n) / count)
    at, runs = piece.windows(hashes, _RUN)
    columns.append(np.log1p(10 * (1 - _distinct(piece.doc[at], runs, n) / np.maximum(1, words - _RUN + 1))) * (words >= _RUN))
    columns += [np.log1p(words), np.log1p(words) ** 2 / 10, (words == 0).astype(float)]
    return np.stack(columns, axis=1)


def _vectors(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(
        pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.reshape(-1))
    )


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(table: DataFrame, measure) -> np.ndarray | None:
    """The sum of what ``measure`` makes of the batches; a task adds up its own, only the sums reach the driver."""

    def add(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = measure(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([_vectors(total[None])], ["total"])

    parts = table.mapInArrow(add, "total array<double>").toArrow()["total"]
    return _matrix(parts.combine_chunks()).sum(axis=0) if len(parts) else None


def _spread(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale of every feature."""
    total = _summed(table, lambda b: np.append(_matrix(b.column("x")).sum(axis=0), b.num_rows))
    mean = total[:-1] / total[-1]
    square = _summed(table, lambda b: ((_matrix(b.column("x")) - mean) ** 2).sum(axis=0))
    return mean, np.sqrt(square / total[-1]) + 1e-6


def _pairs(table: DataFrame, sizes: dict[int, int], scale: np.ndarray) -> DataFrame:
    """(d): differences, good less bad, of preference pairs that every row takes part in.

    Rows are numbered in the order of the hashes of their ids. Row i of the label with more rows meets the rows i, i + 1
    and so on of the other label (counted round), as many as give each of those ``PAIRS`` pairs, and one at least.
    """
    many, few = (1, 0) if sizes[1] >= sizes[0] else (0, 1)
    rounds = max(1, -(-PAIRS * sizes[few] // sizes[many]))
    order = ["hash", "doc_id", "x"]
    ranked = {
        v: number_rows(table.filter(F.col("label") == v).select(F.xxhash64("doc_id").alias("hash"), "doc_id", "x"), order, "n")
        for v in (many, few)
    }
    turns = F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))
    left = ranked[many].select(F.col("x").alias("a"), "n", turns.alias("turn")).select(
        "a", ((F.col("n") + F.col("turn")) % sizes[few] + 1).alias("n")
    )
    met = left.join(ranked[few].select("n", F.col("x").alias("b")), "n").select("a", "b")
    sign = 1 if many == 1 else -1

    def subtract(batches):
        for batch in batches:
            if batch.num_rows:
                gap = sign * (_matrix(batch.column("a")) - _matrix(batch.column("b"))) / scale
                yield pa.RecordBatch.from_arrays([_vectors(gap)], ["d"])

    return materialize(met.mapInArrow(subtract, "d array<double>"))


def _bradley_terry(pairs: DataFrame, size: int) -> np.ndarray:
    """Weights of the logistic loss on all pairs, by Newton steps; each is one pass over the table of pairs.

    A pair stands in both directions, which makes the constant 0 and doubles the sums.
    """
    weights = np.zeros(size)
    for _ in range(40):

        def slopes(batch, weights=weights):
            d = _matrix(batch.column("d"))
            p = 1 / (1 + np.exp(-np.clip(d @ weights, -30, 30)))
            return np.concatenate([[len(d)], (1 - p) @ d, ((d * (p * (1 - p))[:, None]).T @ d).reshape(-1)])

        total = 2 * _summed(pairs, slopes)
        penalty = RIDGE * total[0] / 1000
        gradient, curve = total[1 : size + 1], total[size + 1 :].reshape(size, size)
        step = np.linalg.solve(curve + (penalty + 1e-9) * np.eye(size), gradient - penalty * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def _cut(table: DataFrame, model: Model, below: int) -> float:
    """The worth that ``below`` rows do not exceed, by the place of every row in the order of worths."""

    def worths(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_worth(model, _matrix(batch.column("x"))))], ["worth"])

    numbered = number_rows(table.select("x").mapInArrow(worths, "worth double"), ["worth"], "n")
    return numbered.filter(F.col("n") == below).first()["worth"]


def _worth(model: Model, x: np.ndarray) -> np.ndarray:
    return ((x - model.mean) / model.scale) @ model.weights


def _score(model: Model, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_worth(model, x) - model.cut + np.log(CUT / (1 - CUT)), -30, 30)))


def _feature_rows(batches):
    for batch in batches:
        rows = [features(piece) for piece in arrays.pieces(batch.column("text"))]
        if not rows:
            continue
        lists = _vectors(np.concatenate(rows))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "x"])


def train(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality") -> Model | None:
    """A model from all label rows that ``keep`` selects whose document has a text; None if a label has no rows.

    Features are computed where the texts are; only they meet the labels, and are written once. Means, weights and the cut
    come from passes over all of them; sums of one task each, and sizes of partitions, are all that reaches the driver.
    """
    known = labels.filter(keep & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    known = known.select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    texts = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    texts = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(_feature_rows, "doc_id long, x array<double>")
    # The labels grow with the documents: no broadcast.
    table = materialize(rows.join(known.hint("merge"), "doc_id"))
    sizes = {r["label"]: r["count"] for r in table.groupBy("label").count().collect()}
    if set(sizes) != {0, 1}:
        discard(table)
        return None
    mean, scale = _spread(table)
    pairs = _pairs(table, sizes, scale)
    model = Model(mean, scale, _bradley_terry(pairs, len(mean)), 0.0)
    model.cut = _cut(table, model, sizes[0])
    discard(pairs)
    discard(table)
    return model


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) for every row, over its whole text.

    Score is 0 to 1, 0.7 and more meaning good. Null and empty texts get the score of a text without words; without a
    model (a label has no rows) every score is 0. Rows are independent, so repeated rows repeat their score. Other
    columns are ignored.
    """

    def score(batches):
        for batch in batches:
            values = [np.zeros(0)]
            for piece in arrays.pieces(batch.column("text")):
                values.append(np.zeros(piece.n) if model is None else _score(model, features(piece)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(values), pa.float64())], ["doc_id", "score"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        score, "doc_id long, score double"
    )
