"""Toxicity by compression distance.

Two zstandard dictionaries of ``DICTIONARY`` bytes are trained: one on ordinary documents, one on what is typical of toxic
documents, the stretches made of byte sequences that are many times more frequent there than in ordinary documents
(toxic documents are ordinary text for the most part). The toxic one is used behind the ordinary one, so that ordinary
text costs the same with and without it. A document is cut into windows of ``WINDOW`` words, and each window is
compressed either way; the bytes that the toxic dictionary saves are its gain. How many windows reach
each level of gain, the largest gains and the mean are weighed by a logistic calibration, whose cut is the score 0.7.

The model is fitted on a bounded sample of labelled rows, each with its whole text. Byte sequences are counted, and gains
measured, where the texts are; the driver gets counts of distinct sequences, stretches and a few numbers for each row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm import arrays
from folioframe.llm.fitting import best_cut, logistic, sample_rows, stands_for
from folioframe.session import discard, materialize

WINDOW = 5
GRAM = 5
LIFT = 20
CUT = 0.7
# Both dictionaries end with this mark and every window is compressed behind it, so that the cost of the first match
# of a window is paid either way and the gain is what the toxic content saves.
MARK = bytes([*range(1, 9), *range(14, 22)])
# Bounds of the fit: labelled rows of each label, and the size of a text that is used; longer texts are left out of the
# sample (never shortened), they are scored like all others. The ordinary dictionary is trained on the first ORDINARY_ROWS
# of the ordinary rows.
FIT_ROWS = 4000
FIT_BYTES = 1 << 17
ORDINARY_ROWS = 400
DICTIONARY = 4096
# Fixed value: the repeat offsets 1, 4 and 8 that end the header of a trained dictionary; its content follows.
_HEADER_END = bytes([1, 0, 0, 0, 4, 0, 0, 0, 8, 0, 0, 0])


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    low: np.ndarray
    high: np.ndarray
    weights: np.ndarray
    cut: float


def _spaced(piece: arrays.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words with one space before each and one at the end; where each word starts and ends."""
    sizes = piece.ends - piece.starts
    starts = np.cumsum(sizes + 1) - sizes
    letters = piece.data[~arrays.SPACE[piece.data]]
    out = np.full(len(letters) + len(sizes) + 1, 0x20, np.uint8)
    out[np.arange(len(letters)) + np.repeat(np.arange(1, len(sizes) + 1), sizes)] = letters
    return out, starts, starts + sizes


def windows(piece: arrays.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spaced words, the (offset, length) of each window, and its document."""
    piece.words()
    out, starts, ends = _spaced(piece)
    first = np.flatnonzero((np.arange(len(starts)) - piece.first[piece.doc]) % WINDOW == 0)
    last = np.minimum(first + WINDOW, piece.first[piece.doc[first] + 1]) - 1
    segments = np.stack([starts[first] - 1, ends[last] + 2 - starts[first]], axis=1)
    return out, segments, piece.doc[first]


def _press(dictionary: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, strategy=zstandard.STRATEGY_LAZY2, min_match=6, window_log=16,
        hash_log=14, chain_log=14, search_log=4, target_length=16, write_content_size=False, write_checksum=False,
        write_dict_id=False,
    )
    content = zstandard.ZstdCompressionDict(dictionary + MARK, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=parameters)


def _lengths(press: zstandard.ZstdCompressor, data: np.ndarray, segments: np.ndarray) -> np.ndarray:
    compress, raw = press.compress, data.tobytes()
    return np.fromiter(
        (len(compress(MARK + raw[a : a + n])) for a, n in segments.tolist()), np.int64, count=len(segments)
    )


# The column of the largest gain.
_LARGEST = 9


def _features(gain: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Features of each of ``n`` documents from the gains of its windows."""
    count = np.bincount(doc, minlength=n)
    columns = [np.log1p(np.bincount(doc[gain >= k], minlength=n)) for k in range(1, 7)]
    columns += [np.log1p(np.bincount(doc[gain <= -k], minlength=n)) for k in range(1, 4)]
    order = np.lexsort((-gain, doc))
    place = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
    ranked = gain[order]
    for top in (1, 2, 3):
        use = place < top
        columns.append(np.bincount(doc[use], weights=ranked[use], minlength=n))
    total = np.bincount(doc, weights=gain, minlength=n)
    # A text without windows counts as one window without gain.
    columns += [np.log1p(np.maximum(1, count)), total / np.maximum(1, count), total / np.sqrt(np.maximum(1, count))]
    return np.stack(columns, axis=1)


def _score(model: Model, gain: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    # Features beyond those of all training rows (of a very long text, say) count as the nearest that was seen.
    features = _features(gain, doc, n)
    x = np.clip(features, model.low, model.high)
    margin = ((x - model.mean) / model.scale) @ model.weights[1:] + model.weights[0]
    score = 1 / (1 + np.exp(-np.clip(margin - model.cut + np.log(CUT / (1 - CUT)), -30, 30)))
    # Where the toxic dictionary saves nothing in any window there is nothing toxic to be found.
    return np.where(features[:, _LARGEST] > 0, score, np.minimum(score, 0.5))


def _scores(model: Model | None, first, second, column: pa.Array) -> np.ndarray:
    values = [np.zeros(0)]
    for piece in arrays.pieces(column, lower=True):
        if model is None:
            values.append(np.zeros(piece.n))
            continue
        out, segments, doc = windows(piece)
        gain = _lengths(first, out, segments) - _lengths(second, out, segments)
        values.append(_score(model, gain, doc, piece.n))
    return np.concatenate(values)


def _grams(data: np.ndarray) -> np.ndarray:
    """Every ``GRAM`` bytes as a number; 0 where a space stands inside."""
    n = max(0, len(data) - GRAM + 1)
    value, inner = np.zeros(n, np.uint64), np.zeros(n, bool)
    for i in range(GRAM):
        step = data[i : n + i]
        value = value * np.uint64(256) + step
        if 0 < i < GRAM - 1:
            inner |= step == 0x20
    value[inner] = 0
    return value


def _stretches(data: np.ndarray, typical: np.ndarray) -> list[bytes]:
    found = np.flatnonzero(np.isin(_grams(data), typical))
    if not len(found):
        return []
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, found, 1)
    np.add.at(change, found + GRAM, -1)
    edge = np.diff((np.cumsum(change[:-1]) > 0).astype(np.int8), prepend=0, append=0)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def _gram_rows(batches):
    """(gram, toxic, ordinary): how many toxic and ordinary rows of a batch hold each byte sequence."""
    for batch in batches:
        labels, at = batch.column("label").to_numpy(zero_copy_only=False), 0
        found = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]]
        for piece in arrays.pieces(batch.column("text"), lower=True):
            piece.words()
            for row in range(piece.n):
                words = slice(piece.first[row], piece.first[row + 1])
                found[int(labels[at + row])].append(np.unique(_grams(_row_text(piece, words))))
            at += piece.n
        counted = [np.unique(np.concatenate(f), return_counts=True) for f in found]
        gram = np.union1d(counted[0][0], counted[1][0])
        often = np.zeros((2, len(gram)), np.int64)
        for label, (some, count) in enumerate(counted):
            often[label][np.searchsorted(gram, some)] = count
        yield pa.RecordBatch.from_arrays(
            [pa.array(gram.view(np.int64)), pa.array(often[1]), pa.array(often[0])], ["gram", "toxic", "ordinary"]
        )


def _row_text(piece: arrays.Texts, words: slice) -> np.ndarray:
    """The words of one row of a piece, with one space before each and one at the end."""
    part = arrays.Texts(piece.data, piece.offsets, 0)
    part.starts, part.ends = piece.starts[words], piece.ends[words]
    if not len(part.starts):
        return np.zeros(0, np.uint8)
    first, last = part.starts[0], part.ends[-1]
    part.data, part.starts, part.ends = piece.data[first:last], part.starts - first, part.ends - first
    return _spaced(part)[0]


def _typical(sample: DataFrame, toxic: int, ordinary: int) -> np.ndarray:
    """Byte sequences found in many more toxic than ordinary rows of the sample, sorted.

    A sequence needs ``LIFT`` times the share; with few rows, what chance does not reach. So one that no ordinary row
    holds needs about LIFT * toxic / ordinary toxic rows.
    """
    enough = max(2.0, min(LIFT, np.sqrt(toxic) / 2 * (ordinary + 1) / (toxic + 1)))
    counts = sample.mapInArrow(_gram_rows, "gram long, toxic long, ordinary long").groupBy("gram")
    counts = counts.agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    lift = (F.col("toxic") / (toxic + 1)) / ((F.col("ordinary") + 1) / F.lit(ordinary + 1))
    chosen = counts.filter((F.col("toxic") >= 3) & (lift >= float(enough)) & (F.col("gram") != 0))
    return np.sort(chosen.select("gram").toArrow().column(0).to_numpy().view(np.uint64))


def _stretch_rows(typical: np.ndarray):
    """(doc_id, place, sample): the typical stretches of toxic rows, up to eight of a row to a sample."""

    def find(batches):
        for batch in batches:
            ids, at, found = batch.column("doc_id").to_pylist(), 0, []
            for piece in arrays.pieces(batch.column("text"), lower=True):
                piece.words()
                for row in range(piece.n):
                    some = _stretches(_row_text(piece, slice(piece.first[row], piece.first[row + 1])), typical)
                    found += [(ids[at + row], i, b"".join(some[i : i + 8])) for i in range(0, len(some), 8)]
                at += piece.n
            columns = [pa.array(c, kind) for c, kind in zip(zip(*found) if found else [[]] * 3, (pa.int64(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "place", "sample"])

    return find


def _trained(samples: list[bytes]) -> bytes:
    """A dictionary's content of ``DICTIONARY`` bytes; too few samples to train on stand for themselves."""
    try:
        trained = zstandard.train_dictionary(DICTIONARY + 600, samples, k=24, d=6).as_bytes()
        return trained[trained.index(_HEADER_END) + len(_HEADER_END) :][-DICTIONARY:]
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[:DICTIONARY] or b" "


def _ordinary_samples(texts: pa.Array) -> list[bytes]:
    """Windows of whole ordinary texts, eight to a sample."""
    found = []
    for piece in arrays.pieces(texts, lower=True):
        out, segments, _ = windows(piece)
        raw = out.tobytes()
        found += [raw[a : a + n] for a, n in segments.tolist()]
    return [b"".join(found[i : i + 8]) for i in range(0, len(found), 8)]


def _feature_rows(ordinary: bytes, toxic: bytes):
    def measure(batches):
        first, second = _press(ordinary), _press(toxic)
        for batch in batches:
            rows = []
            for piece in arrays.pieces(batch.column("text"), lower=True):
                out, segments, doc = windows(piece)
                rows.append(_features(_lengths(first, out, segments) - _lengths(second, out, segments), doc, piece.n))
            if rows:
                x = np.concatenate(rows)
                ends = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), lists], ["doc_id", "label", "x"])

    return measure


def train(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "toxic") -> Model | None:
    """A model from at most ``FIT_ROWS`` rows of each label among the label rows that ``keep`` selects.

    None if a label has no rows. Rows of the sample with equal ids and texts count once.
    """
    short = docs.filter(F.octet_length("text") <= FIT_BYTES)
    sample = materialize(sample_rows(short, labels, label, keep, FIT_ROWS).distinct())
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if set(sizes) != {0, 1}:
        return None
    typical = _typical(sample, sizes[1], sizes[0])
    rows = sample.filter("label = 1").mapInArrow(_stretch_rows(typical), "doc_id long, place int, sample binary").toArrow()
    # The trainer depends on the order of its samples.
    toxic_samples = rows.sort_by([("doc_id", "ascending"), ("place", "ascending"), ("sample", "ascending")])["sample"].to_pylist()
    ordinary_texts = sample.filter("label = 0").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(ORDINARY_ROWS).select("text").toArrow()
    ordinary = _trained(_ordinary_samples(ordinary_texts["text"]))
    toxic = ordinary + _trained(toxic_samples)
    measured = sample.mapInArrow(_feature_rows(ordinary, toxic), "doc_id long, label int, x array<double>").toArrow()
    measured = measured.sort_by("doc_id")
    discard(sample)
    y = measured["label"].to_numpy().astype(float)
    x = measured["x"].combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    weights = stands_for(labels, label, keep, FIT_ROWS)
    model = Model(ordinary, toxic, x.mean(axis=0), x.std(axis=0) + 1e-9, x.min(axis=0), x.max(axis=0), np.zeros(2), 0.0)
    x = (x - model.mean) / model.scale
    model.weights = logistic(x, y, ridge=3.0)
    model.cut = best_cut(x @ model.weights[1:] + model.weights[0], y, np.array([weights.get(int(v), 1.0) for v in y]))
    return model


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) for every row, over its whole text.

    Score is 0 to 1, 0.7 and more meaning toxic. Null and empty texts have no windows and get the score of a text
    without gain; without a model (a label has no rows) every score is 0. Rows are independent of each other, so
    repeated rows repeat their score. Other columns are ignored.
    """

    def score(batches):
        first, second = (_press(model.ordinary), _press(model.toxic)) if model else (None, None)
        for batch in batches:
            scores = _scores(model, first, second, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        score, "doc_id long, score double"
    )


def kept(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores less than ``CUT``; rows are judged where they are."""
    names = docs.columns
    schema = docs.select(*[F.col(c).cast("string").alias(c) if c == "text" else F.col(c) for c in names])

    def keep(batches):
        first, second = (_press(model.ordinary), _press(model.toxic)) if model else (None, None)
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, first, second, batch.column("text")) < CUT))

    return schema.mapInArrow(keep, schema.schema)
