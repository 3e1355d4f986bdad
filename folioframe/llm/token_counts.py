"""Token counts of whole texts.

Each Arrow batch is encoded in runs of texts of about equal size, and only counts leave the tokenizer. Long texts, and
the texts of a run, are cut where both sides encode as they would together (``tokenizing``); a short piece that a task
has met before is looked up. A task keeps at most ``KNOWN`` counts of short pieces, so its memory does not depend on
the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm import tokenizing

# Pieces up to this many characters are remembered, at most this many of them.
SHORT = 64
KNOWN = 1 << 18


class Counter:
    def __init__(self, path: str):
        self.tokenizer = tokenizing.load(path)
        self.known: dict[str, int] = {}

    def _parts(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, a slab at a time."""
        cut = self.tokenizer.cut
        for slab in tokenizing.slabs(text, cut):
            if cut is None:
                yield [slab]
                continue
            pieces = []
            for piece in cut.split(slab):
                pieces += tokenizing.slabs(piece, self.tokenizer.finer_cut) if len(piece) > tokenizing.SLAB else [piece]
            yield pieces

    def _encoded(self, pieces: list[str]) -> dict[str, int]:
        found = {}
        for start, end in tokenizing.runs(pieces):
            found.update(zip(pieces[start:end], self.tokenizer.counts(pieces[start:end])))
        return found

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text of a run."""
        totals, waiting, size = [0] * len(texts), [], 0
        for at, text in enumerate(texts):
            for pieces in self._parts(text):
                waiting.append((at, pieces))
                size += sum(map(len, pieces))
                if size > tokenizing.SLAB:
                    self._add(totals, waiting)
                    waiting, size = [], 0
        self._add(totals, waiting)
        return totals

    def _add(self, totals: list[int], waiting: list[tuple[int, list[str]]]) -> None:
        if len(self.known) > KNOWN:
            self.known.clear()
        new = {piece for _, pieces in waiting for piece in pieces if piece not in self.known}
        counts = self._encoded(sorted(new, key=len))
        self.known.update((piece, n) for piece, n in counts.items() if len(piece) <= SHORT)
        rest = {piece: n for piece, n in counts.items() if len(piece) > SHORT}
        for at, pieces in waiting:
            if rest:
                totals[at] += sum(self.known[p] if p in self.known else rest[p] for p in pieces)
            else:
                totals[at] += sum(map(self.known.__getitem__, pieces))


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    Null and empty texts have 0 bytes and 0 tokens. Rows with the same id, or without one, stay rows of their own. No
    special tokens are added; strings of special tokens in a text are handled as the tokenizer's file says. Extra
    columns are not read, whatever their names. An empty table gives an empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").to_pylist()
            totals = []
            for start, end in tokenizing.runs(texts):
                totals += counter.counts(texts[start:end])
            sizes = pc.cast(pc.binary_length(pc.fill_null(batch.column(1), "")), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(totals, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return (
        docs.select("doc_id", "text")
        .mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
