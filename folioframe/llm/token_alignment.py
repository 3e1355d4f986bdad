"""Alignment of two tokenizers over the same text.

Tokenizer A encodes a space and the text, tokenizer B the text behind a space of its own. The cumulative ends of A's and
of B's token bytes are dictionaries from end to index; their common keys, sorted, slice both lists of ids into groups.
Inside a slice no two ends are equal, so its links (pairs of tokens whose bytes overlap) are a path from its first pair
to its last that takes one token at each end.

Texts are cut where both tokenizers encode both sides as they would together, which is a common end, and equal parts of
an Arrow batch are encoded and aligned once. Counts of id pairs over the corpus come from one aggregate, and return to
the documents by block: a block is what one task has read up to ``BLOCK_TEXT`` of text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm import tokenizing
from folioframe.session import materialize

# Characters of text aligned at a time, and characters of text (or rows) whose id pairs are counted together.
RUN = 1 << 20
BLOCK_TEXT = 1 << 24
BLOCK_ROWS = 1 << 16
# Parts up to this many characters are remembered by a task, at most this many of them.
SHORT = 64
KNOWN = 1 << 18

# The lists that make up an alignment, and the id pairs of its links (``a * size of B's vocabulary + b``).
LISTS = ["a_ids", "b_ids", "a_sizes", "b_sizes", "a_links"]
_ALL = [*LISTS, "pairs"]


@dataclass
class Lists:
    """Lists of many parts, one after the other; ``ends[name]`` says where each part's list ends.

    ``a_ids``, ``b_ids``: token ids. ``a_sizes``, ``b_sizes``: tokens of each group. ``a_links``: for each A token, how
    many B tokens its bytes overlap. ``pairs``: the id pair of each link. A part that a side does not give back is not
    ``sound`` and has no tokens.
    """

    values: dict[str, np.ndarray]
    ends: dict[str, np.ndarray]
    sound: np.ndarray

    def take(self, parts: np.ndarray, last: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
        """One list of ``parts`` in that order, and where it ends for each text (text i has the parts up to last[i])."""
        stop = self.ends[name]
        size = np.diff(stop, prepend=0)[parts]
        end = np.cumsum(size)
        at = np.arange(end[-1] if len(end) else 0) + np.repeat(stop[parts] - end, size)
        return self.values[name][at], np.concatenate([[0], end])[last]

    def joined(self, other: Lists) -> Lists:
        return Lists(
            {n: np.concatenate([self.values[n], other.values[n]]) for n in _ALL},
            {n: np.concatenate([self.ends[n], other.ends[n] + len(self.values[n])]) for n in _ALL},
            np.concatenate([self.sound, other.sound]),
        )

    def only(self, parts: np.ndarray) -> Lists:
        last = np.arange(1, len(parts) + 1)
        taken = {n: self.take(parts, last, n) for n in _ALL}
        return Lists({n: v for n, (v, _) in taken.items()}, {n: e for n, (_, e) in taken.items()}, self.sound[parts])


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and how many there are up to each part's end."""
    ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
    return np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]) if len(ends) else 0), ends


def _gives_back(ids: list[list[int]], entries: list[bytes], lengths: np.ndarray, raw: list[bytes]) -> list[bool]:
    """Whether the entries of each part's ids make up its bytes."""
    flat, ends = _flat(ids)
    sizes = np.diff(np.concatenate([[0], np.cumsum(lengths[flat])])[ends], prepend=0)
    if b"".join(map(entries.__getitem__, flat.tolist())) == b"".join(raw) and sizes.tolist() == list(map(len, raw)):
        return [True] * len(raw)
    return [b"".join([entries[i] for i in part]) == text for part, text in zip(ids, raw)]


class Run:
    """Texts, or slabs of long texts, made of aligned parts. ``row``: the place of each one's text in its batch."""

    def __init__(self, row: list[int], parts: np.ndarray, last: np.ndarray, table: Lists, groups: list[str]):
        self.row, self._parts, self._last, self._table, self._groups = np.array(row, np.int64), parts, last, table, groups
        unsound = np.concatenate([[0], np.cumsum(~table.sound[parts])])[last]
        self.sound = np.diff(unsound, prepend=0) == 0

    def list(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        return self._table.take(self._parts, self._last, name)

    def groups(self) -> Iterator[str]:
        """Each one's groups as ``a1,a2|b1;a3|b2,b3``."""
        start, parts, groups = 0, self._parts.tolist(), self._groups
        for end in self._last.tolist():
            yield ";".join([groups[p] for p in parts[start:end]])
            start = end


class Aligner:
    """Aligns texts in one task; equal short parts are encoded and aligned once."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = tokenizing.load(path_a, special=False), tokenizing.load(path_b, special=False)
        if not getattr(self.b, "adds_space", False):
            raise ValueError("tokenizer B must put a space in front of a text and keep the text as it is")
        self.bytes_a, self.bytes_b = self.a.token_bytes(), self.b.token_bytes()
        self.lengths_a = np.fromiter(map(len, self.bytes_a), np.int64)
        self.lengths_b = np.fromiter(map(len, self.bytes_b), np.int64)
        self.pair_values = len(self.bytes_a) * len(self.bytes_b)
        # B leaves out the space that it adds itself; A's rules allow every cut that B's do.
        self.cut = self.b.cut if self.a.cut else None
        nothing = np.zeros(0, np.int32)
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.table = Lists(dict.fromkeys(_ALL, nothing), dict.fromkeys(_ALL, nothing.astype(np.int64)), np.zeros(0, bool))

    def aligned(self, parts: list[str]) -> tuple[Lists, list[str]]:
        """Encode every part with both tokenizers and slice the ids at their common ends; the groups of each as text."""
        texts = [" " + p for p in parts]
        ids_a, ids_b = self.a.ids(texts), self.b.ids(parts)
        raw = [t.encode() for t in texts]
        back_a = _gives_back(ids_a, self.bytes_a, self.lengths_a, raw)
        back_b = _gives_back(ids_b, self.bytes_b, self.lengths_b, raw)
        sound = np.array([x and y for x, y in zip(back_a, back_b)], bool)
        for at in np.flatnonzero(~sound):
            ids_a[at], ids_b[at] = [], []
        (a, parts_a), (b, parts_b) = _flat(ids_a), _flat(ids_b)
        ends_a, ends_b = np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b])
        index_a = dict(zip(ends_a.tolist(), range(len(a))))
        index_b = dict(zip(ends_b.tolist(), range(len(b))))
        common = sorted(index_a.keys() & index_b.keys())
        last_a = np.fromiter(map(index_a.__getitem__, common), np.int64, len(common))
        last_b = np.fromiter(map(index_b.__getitem__, common), np.int64, len(common))
        # The links of a slice: an A token overlaps the B tokens from the one in which its predecessor in the slice has
        # ended (the slice's first one for the slice's first token) to the one that holds its own last byte.
        holds_end = np.searchsorted(ends_b, ends_a, "left")
        opens = np.concatenate([[0], last_a[:-1] + 1])[: len(last_a)]
        from_b = np.concatenate([[0], holds_end[:-1]])[: len(a)]
        from_b[opens] = np.concatenate([[0], last_b[:-1] + 1])[: len(last_b)]
        links = holds_end - from_b + 1
        ends_links = np.cumsum(links)
        to_b = np.arange(ends_links[-1] if len(a) else 0) + np.repeat(from_b - ends_links + links, links)
        pairs = np.repeat(a.astype(np.int64) * len(self.lengths_b), links) + b[to_b]
        parts_groups = np.searchsorted(last_a, parts_a - 1, "right")
        lists = Lists(
            {
                "a_ids": a,
                "b_ids": b,
                "a_sizes": np.diff(last_a, prepend=-1).astype(np.int32),
                "b_sizes": np.diff(last_b, prepend=-1).astype(np.int32),
                "a_links": links.astype(np.int32),
                "pairs": pairs,
            },
            {"a_ids": parts_a, "b_ids": parts_b, "a_sizes": parts_groups, "b_sizes": parts_groups, "a_links": parts_a, "pairs": np.concatenate([[0], ends_links])[parts_a]},
            sound,
        )
        names_a, names_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        cuts_a, cuts_b = [0, *(last_a + 1).tolist()], [0, *(last_b + 1).tolist()]
        groups = [
            names_a[i] + "|" + names_b[k] if j - i == 1 == m - k else ",".join(names_a[i:j]) + "|" + ",".join(names_b[k:m])
            for i, j, k, m in zip(cuts_a, cuts_a[1:], cuts_b, cuts_b[1:])
        ]
        starts = [0, *parts_groups.tolist()]
        return lists, [";".join(groups[i:j]) for i, j in zip(starts, starts[1:])]

    def runs(self, texts: list[str]) -> Iterator[Run]:
        """The texts in order, cut into slabs where they are long, about ``RUN`` characters at a time."""
        row, places, last, size = [], [], [], 0
        for at, text in enumerate(texts):
            for slab in tokenizing.slabs(text, self.cut, RUN):
                row.append(at)
                places += (self.cut.split(slab) if self.cut else [slab]) if slab else []
                last.append(len(places))
                size += len(slab)
                if size >= RUN:
                    yield self._run(row, places, last)
                    row, places, last, size = [], [], [], 0
        if row:
            yield self._run(row, places, last)

    def _run(self, row: list[int], places: list[str], last: list[int]) -> Run:
        known = len(self.known)
        fresh = sorted(set(places).difference(self.known), key=len)
        for start, end in tokenizing.runs(fresh):
            lists, groups = self.aligned(fresh[start:end])
            self.table = self.table.joined(lists)
            self.groups += groups
        self.known.update(zip(fresh, range(known, known + len(fresh))))
        parts = np.fromiter(map(self.known.__getitem__, places), np.int64, len(places))
        run = Run(row, parts, np.array(last, np.int64), self.table, self.groups)
        if len(self.known) > KNOWN:
            # The parts of this run stay; the frequent ones are among them.
            self._keep([p for p in dict.fromkeys(places) if len(p) <= SHORT])
        elif fresh and len(fresh[-1]) > SHORT:
            self._keep([p for p in self.known if len(p) <= SHORT])
        return run

    def _keep(self, parts: list[str]) -> None:
        places = [self.known[p] for p in parts]
        self.table, self.groups = self.table.only(np.array(places, np.int64)), [self.groups[i] for i in places]
        self.known = {p: i for i, p in enumerate(parts)}


def _texts(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_sizes, b_sizes, a_links) for every row of ``docs``: see ``Lists``.

    Null and empty texts, and texts that either tokenizer does not give back byte for byte behind the space, have empty
    lists. Rows with the same id, or without one, stay rows of their own. Extra columns are not read. An empty table
    gives an empty result.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        for batch in batches:
            sound = np.ones(len(batch), bool)
            found = {n: [np.zeros(0, np.int32)] for n in LISTS}
            sizes = {n: np.zeros(len(batch), np.int64) for n in LISTS}
            for run in aligner.runs(_texts(batch.column(1))):
                sound[run.row[~run.sound]] = False
                for n in LISTS:
                    values, ends = run.list(n)
                    found[n].append(values.astype(np.int32))
                    np.add.at(sizes[n], run.row, np.diff(ends, prepend=0))
            columns = []
            for n in LISTS:
                values = np.concatenate(found[n])[np.repeat(sound, sizes[n])]
                ends = np.cumsum(sizes[n] * sound, dtype=np.int64)
                columns.append(pa.LargeListArray.from_arrays(np.concatenate([[0], ends]), pa.array(values)).cast(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *LISTS])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(align, f"doc_id {id_type}, " + ", ".join(f"{n} array<int>" for n in LISTS))


class _Block:
    """The rows of some ``BLOCK_TEXT`` of text: what is known of each, and the id pairs of its links."""

    def __init__(self, number: int):
        self.number, self.ids, self.rows, self.size = number, [], 0, 0
        self.columns = {n: [] for n in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        self.of_row, self.pairs, self.times = [], [], []

    def add(self, ids: pa.Array, texts: list[str], aligner: Aligner) -> None:
        known = len(self.of_row)
        sound, counts = np.ones(len(ids), bool), np.zeros((4, len(ids)), np.int64)
        digests = {}
        for run in aligner.runs(texts):
            sound[run.row[~run.sound]] = False
            for place, name in enumerate(("a_ids", "b_ids", "a_sizes")):
                np.add.at(counts[place], run.row, np.diff(run.list(name)[1], prepend=0))
            pairs, ends = run.list("pairs")
            links = np.diff(ends, prepend=0)
            np.add.at(counts[3], run.row, links)
            key, times = np.unique(np.repeat(run.row, links) * aligner.pair_values + pairs, return_counts=True)
            self.of_row.append(key // aligner.pair_values + self.rows)
            self.pairs.append(key % aligner.pair_values)
            self.times.append(times)
            for row, groups in zip(run.row.tolist(), run.groups()):
                if row in digests:
                    digests[row].update(b";")
                else:
                    digests[row] = sha256()
                digests[row].update(groups.encode())
        counts *= sound
        for place, name in enumerate(("n_a", "n_b", "n_groups", "n_links")):
            self.columns[name].append(counts[place])
        self.columns["groups_sha256"] += [digests[r].hexdigest() if counts[0][r] else "" for r in range(len(ids))]
        if not sound.all():  # links of the sound slabs of a text that is not
            for at in range(known, len(self.of_row)):
                keep = sound[self.of_row[at] - self.rows]
                self.of_row[at], self.pairs[at], self.times[at] = self.of_row[at][keep], self.pairs[at][keep], self.times[at][keep]
        self.ids.append(ids)
        self.rows += len(ids)
        self.size += sum(map(len, texts))

    def batch(self) -> pa.RecordBatch:
        of_row, pairs, times = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (self.of_row, self.pairs, self.times))
        distinct, place = np.unique(pairs, return_inverse=True)
        sums = np.bincount(place, times, len(distinct)).astype(np.int64)
        ends = np.searchsorted(of_row, np.arange(self.rows), "right")
        only_first = np.full(self.rows + 1, len(distinct))
        only_first[0] = 0
        lists = lambda ends, values, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(self.rows, self.number, np.int64)),
                pa.concat_arrays(self.ids),
                *(pa.array(np.concatenate(self.columns[n])) for n in ("n_a", "n_b", "n_groups", "n_links")),
                pa.array(self.columns["groups_sha256"], pa.string()),
                lists(np.concatenate([[0], ends]), place, pa.int32()),
                lists(np.concatenate([[0], ends]), times, pa.int32()),
                lists(only_first, distinct, pa.int64()),
                lists(only_first, sums, pa.int64()),
            ],
            ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "link_pairs", "link_times", "pairs", "times"],
        )


def link_statistics(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row for every row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    An id pair counts how many links of all texts hold it. ``n_best``: links whose pair counts as much as any pair of
    their B id; ``count_sum``: the counts of all links summed. ``groups_sha256``: of the groups written as
    ``a1,a2|b1;a3|b2,b3``. Rows without tokens (see ``alignments``) have zeros and ''.

    The texts are read once. What is written for each is the distinct pairs of its links, as places in its block's list
    of distinct pairs; only those lists are counted, joined with the counts and sent back, one group per block.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        task = TaskContext.get().partitionId() << 32
        block = _Block(task)
        for batch in batches:
            texts = _texts(batch.column(1))
            for start, end in tokenizing.runs(texts, RUN):
                block.add(batch.column(0).slice(start, end - start), texts[start:end], aligner)
                if block.size >= BLOCK_TEXT or block.rows >= BLOCK_ROWS:
                    yield block.batch()
                    block = _Block(block.number + 1)
        if block.rows:
            yield block.batch()

    counts = "n_a long, n_b long, n_groups long, n_links long"
    rows = materialize(
        docs.select("doc_id", "text").mapInArrow(
            align,
            f"block long, doc_id {id_type}, {counts}, groups_sha256 string, link_pairs array<int>, link_times array<int>, "
            "pairs array<long>, times array<long>",
        )
    )
    uses = rows.filter(F.size("pairs") > 0).select(
        F.col("block").alias("of_block"), F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "use")
    )
    uses = uses.select("of_block", "place", F.col("use.pairs").alias("pair"), F.col("use.times").alias("times"))
    totals = materialize(uses.groupBy("pair").agg(F.sum("times").alias("total")))
    size_b = len(tokenizing.load(path_b, special=False).token_bytes())
    b_id = F.col("pair") % size_b
    # One row for each id of B's vocabulary at most.
    highest = totals.groupBy(b_id.alias("b")).agg(F.max("total").alias("highest"))
    known = totals.join(F.broadcast(highest), b_id == F.col("b")).select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    found = uses.join(known, "pair").select("of_block", "place", "total", "best")

    def put_back(block: pa.Table, found: pa.Table) -> pa.Table:
        total = np.zeros(len(found), np.int64)
        best = np.zeros(len(found), np.int64)
        place = found["place"].to_numpy()
        total[place] = found["total"].to_numpy()
        best[place] = found["best"].to_numpy()
        lists, times = block["link_pairs"].combine_chunks(), block["link_times"].combine_chunks().flatten().to_numpy()
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        at = lists.flatten().to_numpy()
        summed = lambda values: np.diff(np.concatenate([[0], np.cumsum(values[at] * times)])[ends], prepend=0)
        return block.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]).append_column(
            "n_best", pa.array(summed(best), pa.int64())
        ).append_column("count_sum", pa.array(summed(total), pa.int64()))

    return (
        rows.drop("pairs", "times")
        .groupBy("block")
        .cogroup(found.groupBy("of_block"))
        .applyInArrow(put_back, f"doc_id {id_type}, {counts}, groups_sha256 string, n_best long, count_sum long")
        .select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    )
