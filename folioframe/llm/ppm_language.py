"""Language identification by prediction with partial matching.

For every language a variable-order byte context tree is counted: how often each byte follows each context of up to
``ORDER`` bytes. A byte is coded in its longest known context; a byte not seen there is coded by an escape, whose
probability grows with the number of different bytes seen in the context (method C), and then in the next shorter
context, down to a uniform choice. The statistics are frozen after training, so the code length of a text is a plain sum
over its bytes, and the language with the shortest code wins.

The trees of all languages share one table of contexts, so each byte is looked up once for all languages.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm import arrays

ORDER = 3
# Fit bounds: documents of each language, taken whole, and the longest one that is drawn.
FIT_ROWS = 600
FIT_BYTES = 1 << 16
# Contexts seen less often than this in every language are left to the next shorter one.
SUPPORT = 8
# Code lengths differ by this many bits before the score saturates.
_SCALE = 20.0


@dataclass
class Model:
    languages: list[str]
    alphabet: np.ndarray  # byte -> symbol; 0 stands for all bytes that no context knows
    contexts: list[np.ndarray]  # for each order, symbols of a context as a number -> context, or -1
    bits: np.ndarray  # (context, symbol, language) -> code length


def _symbols(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes lower-cased, white space and digits each as one symbol."""
    out = arrays.LOWER[data].copy()
    out[arrays.SPACE[data]] = 0x20
    out[(data >= 0x30) & (data <= 0x39)] = 0x30
    return out


def _keys(symbols: np.ndarray, place: np.ndarray, order: int, base: int) -> np.ndarray:
    """The ``order`` symbols before each byte as a number; -1 where the document has fewer."""
    n = len(symbols)
    key = np.zeros(n, np.int64)
    for back in range(order, 0, -1):
        key[back:] = key[back:] * base + symbols[: n - back]
    key[place < order] = -1
    return key


def _places(offsets: np.ndarray) -> np.ndarray:
    return np.arange(offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))


def fit(rows: list[tuple[str, bytes]]) -> Model | None:
    """Count the trees of (language, text) rows and freeze their code lengths; None without rows."""
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    seen = np.zeros(256, np.int64)
    texts = {}
    for lang in languages:
        parts = [np.frombuffer(text, np.uint8) for own, text in rows if own == lang]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        data = _symbols(np.concatenate(parts), offsets)
        seen += np.bincount(data, minlength=256)
        texts[lang] = (data, _places(offsets))
    common = np.flatnonzero(seen >= SUPPORT)
    alphabet = np.zeros(256, np.int64)
    alphabet[common] = np.arange(1, len(common) + 1)
    base, count = len(common) + 1, len(languages)
    # Order -1: every symbol alike.
    shorter = np.full((1, base, count), np.log2(base))
    tables, contexts, first = [], [], 0
    parent = {}
    for order in range(ORDER + 1):
        grams = []
        for lang in languages:
            data, place = texts[lang]
            symbols = alphabet[data]
            key = _keys(symbols, place, order, base)
            use = key >= 0
            grams.append(np.unique(key[use] * base + symbols[use], return_counts=True))
        totals = [np.unique(g // base, return_inverse=True) for g, _ in grams]
        kept = [k[np.bincount(inv, weights=c) >= SUPPORT] for (k, inv), (_, c) in zip(totals, grams)]
        keys = np.unique(np.concatenate(kept)) if order else np.zeros(1, np.int64)
        table = np.zeros((len(keys), base, count))
        if order:
            below = contexts[-1][keys % base ** (order - 1)]
            keys, table, below = keys[below >= 0], table[below >= 0], below[below >= 0]
            start = shorter[below - (first - len(shorter))]
        else:
            start = np.repeat(shorter, 1, axis=0)
        for column, (gram, often) in enumerate(grams):
            at = np.searchsorted(keys, gram // base)
            use = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == gram // base) if len(keys) else at < 0
            cells = np.zeros((len(keys), base))
            cells[at[use], gram[use] % base] = often[use]
            total, kinds = cells.sum(axis=1, keepdims=True), (cells > 0).sum(axis=1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                known = np.log2(total + kinds) - np.log2(cells)
                escape = np.where(total > 0, np.log2(total + kinds) - np.log2(np.maximum(kinds, 1)), 0.0)
            table[:, :, column] = np.where(cells > 0, known, escape + start[:, :, column])
        lookup = np.full(base**order, -1, np.int32)
        lookup[keys] = first + np.arange(len(keys))
        contexts.append(lookup)
        tables.append(table.astype(np.float32))
        first, shorter = first + len(keys), table
    return Model(languages, alphabet, contexts, np.concatenate(tables))


def code_lengths(model: Model, piece: arrays.Texts) -> np.ndarray:
    """Bits of each document under each language."""
    total = np.zeros((piece.n, len(model.languages)))
    if not len(piece.data):
        return total
    base = model.bits.shape[1]
    symbols = model.alphabet[_symbols(piece.data, piece.offsets)]
    place = _places(piece.offsets)
    context = np.zeros(len(symbols), np.int32)
    for order in range(1, ORDER + 1):
        key = _keys(symbols, place, order, base)
        longer = np.where(key >= 0, model.contexts[order][key], -1)
        context = np.where(longer >= 0, longer, context)
    row = context.astype(np.int64) * base + symbols
    flat = model.bits.reshape(-1, len(model.languages))
    for column in range(len(model.languages)):
        sums = np.concatenate([[0.0], np.cumsum(flat[row, column], dtype=np.float64)])
        total[:, column] = np.diff(sums[piece.offsets])
    return total


def train(docs: DataFrame, keep: Column) -> Model | None:
    """A model from at most ``FIT_ROWS`` whole texts of each language among the rows that ``keep`` selects.

    Of each language the rows with the smallest hashes of their ids are taken, ties by id, among the texts of at most
    ``FIT_BYTES`` bytes; longer ones are never drawn (but identified whole). The sample, at most ``FIT_ROWS`` times
    ``FIT_BYTES`` for each language, is all that the driver holds. Rows without language, id or text are not drawn; without
    any row there is no model.
    """
    known = docs.filter(
        keep
        & F.col("lang").isNotNull()
        & F.col("doc_id").isNotNull()
        & (F.octet_length(F.col("text").cast("string")) <= FIT_BYTES)
    ).select(
        F.pmod(F.xxhash64("doc_id"), F.lit(2**31)).alias("draw"),
        F.col("doc_id").cast("long").alias("doc_id"),
        "lang",
        F.col("text").cast("string").cast("binary").alias("text"),
    )
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    # A hash threshold for each language spares a sort; a tenth more than needed is drawn, then cut.
    limits = F.create_map(
        *[F.lit(v) for lang, n in counts.items() for v in (lang, int(2**31 * min(1.0, 1.1 * FIT_ROWS / n)))]
    )
    rows: dict[str, list] = {}
    for r in known.filter(F.col("draw") <= F.element_at(limits, F.col("lang"))).toLocalIterator():
        own = rows.setdefault(r["lang"], [])
        own.append((r["draw"], r["doc_id"], bytes(r["text"])))
        if len(own) >= 2 * FIT_ROWS:
            # An id that is repeated very often brings all its rows.
            own[:] = sorted(own)[:FIT_ROWS]
    return fit([(lang, text) for lang, own in sorted(rows.items()) for *_, text in sorted(own)[:FIT_ROWS]])


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row, over its whole text.

    The language with the shortest code wins, ties by name. Score is the share of the winner if every language gets
    2 ** (-bits / scale), 0 to 1. A text that is null or has no letter, and every text if there is no model, is ``und``
    with score 0. Rows are independent, so repeated rows repeat their result. Other columns are ignored.
    """

    def predict(batches):
        for batch in batches:
            names, scores = [], [np.zeros(0)]
            for piece in arrays.pieces(batch.column("text")):
                if model is None:
                    names += ["und"] * piece.n
                    scores.append(np.zeros(piece.n))
                    continue
                bits = code_lengths(model, piece)
                best = np.argmin(bits, axis=1)
                gap = np.minimum((bits - bits.min(axis=1, keepdims=True)) / _SCALE, 60)
                names += [model.languages[i] for i in best]
                scores.append(1 / np.exp2(-gap).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("letters"),
                    pa.array(names, pa.string()),
                    pa.array(np.concatenate(scores), pa.float64()),
                ],
                ["doc_id", "letters", "lang_pred", "score"],
            )

    text = F.col("text").cast("string")
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), letters.alias("letters"), text.alias("text"))
        .mapInArrow(predict, "doc_id long, letters boolean, lang_pred string, score double")
        .select(
            "doc_id",
            F.when(F.col("letters"), F.col("lang_pred")).otherwise("und").alias("lang_pred"),
            F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"),
        )
    )
