"""Substring deduplication: fixed-block anchors, extended to maximal exact repeats.

Every document is cut into non-overlapping reference blocks of ``BLOCK`` words, which are indexed; every rolling
window of ``BLOCK`` words probes the index. A repeat of ``window >= 2 * BLOCK - 1`` words holds at least one whole
block of the earlier document, so no repeat lacks a hit. Hits are then extended: every run of ``window`` words over a
hit is compared, by 96 hash bits, with all such runs elsewhere, and consecutive repeated runs form the maximal spans.

Documents are dealt to buckets by id, and each bucket sends a hash once however many of its documents hold it. A
passage that a third of all documents share therefore costs one entry for each bucket and hash, no pair of documents
is ever formed, and the answer for a hash (it occurs in an earlier document of another bucket) needs no list of
documents either. There are as many buckets as the session has shuffle partitions, and more where a bucket would hold
over ``BUCKET_BYTES`` of text on average, so that what a task holds does not hang on that setting.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm import arrays

BLOCK = 25
# Text in one bucket, on average.
BUCKET_BYTES = 16 << 20
_LOW = np.uint64(0xFFFFFFFF)


def remove_repeats(
    docs: DataFrame, window: int = 50, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_text): words of repeats of earlier documents are removed.

    A word goes if a window of ``window`` words of its document covers it whose word sequence also starts in a
    document with a smaller id. ``spans`` lists the removed stretches as (first word, words). Windows are judged on
    the input. Null and empty texts have no words and an empty ``kept_text``. A row without id is neither compared
    nor changed. Rows with the same id do not remove each other's words. Other columns are ignored.
    """
    if window < 2 * BLOCK - 1:
        raise ValueError(f"window must be at least {2 * BLOCK - 1} words")
    buckets = _buckets(docs, text_column)
    key = F.coalesce(F.col(id_column).cast("long"), F.lit(0))
    texts = docs.select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"),
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(text_column).alias("text"),
    ).mapInArrow(_packed, "bucket int, doc_id long, packed binary")
    anchors = texts.groupBy("bucket").applyInArrow(
        _probe(buckets), "bucket int, part int, keys binary"
    )
    hits = anchors.groupBy("part").applyInArrow(_match, "bucket int, keys binary")
    runs = (
        texts.groupBy("bucket")
        .cogroup(hits.groupBy("bucket"))
        .applyInArrow(
            _extend(buckets, window), "bucket int, part int, high binary, low binary, docs binary, counts binary"
        )
    )
    repeated = runs.groupBy("part").applyInArrow(_earlier, "bucket int, keys binary")
    return (
        texts.groupBy("bucket")
        .cogroup(repeated.groupBy("bucket"))
        .applyInArrow(
            _remove(window),
            "doc_id long, n_words long, n_removed long, spans array<struct<first:long,words:long>>, kept_text string",
        )
    )


def _buckets(docs: DataFrame, text_column: str) -> int:
    total = docs.agg(F.sum(F.octet_length(F.col(text_column).cast("string")).cast("long"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))


def _packed(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column("bucket"), batch.column("doc_id"), arrays.pack(batch.column("text"))],
            ["bucket", "doc_id", "packed"],
        )


def _documents(table: pa.Table):
    """(ids, has id, piece) over the documents of a bucket, words found."""
    for rows in arrays.batches(table.select(["doc_id", "packed"]), 1 << 22):
        ids = rows.column("doc_id").fill_null(0).to_numpy()
        known = rows.column("doc_id").is_valid().to_numpy()
        for piece in arrays.pieces(arrays.unpack(rows.column("packed"))):
            piece.words()
            span = slice(piece.first_row, piece.first_row + piece.n)
            yield ids[span], known[span], piece


def _table(schema: dict, columns: list) -> pa.Table:
    return pa.table({n: pa.array(v, t) for (n, t), v in zip(schema.items(), columns, strict=True)})


def _probe(buckets: int):
    def probe(table: pa.Table) -> pa.Table:
        """One entry for each distinct probe of the bucket: 30 hash bits, in several documents?, a block?"""
        found, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        base = 0
        for ids, known, piece in _documents(table):
            at, hashes = piece.windows(piece.word_hashes(), BLOCK)
            doc = piece.doc[at]
            use = known[doc]
            block = (at - piece.first[doc]) % BLOCK == 0
            # The lowest bit says whether the probe is a block.
            found.append(((hashes & ~np.uint64(1)) | block.astype(np.uint64))[use])
            owners.append(ids[doc][use])
        hashes, ids = np.concatenate(found), np.concatenate(owners)
        del found, owners
        order = np.argsort(hashes, kind="stable")
        hashes, ids = hashes[order], ids[order]
        group, starts = _groups(hashes >> np.uint64(1))
        if not len(starts):
            return _table(_PARTS, [[], [], []])
        least, most = np.minimum.reduceat(ids, starts), np.maximum.reduceat(ids, starts)
        block = np.maximum.reduceat(hashes & np.uint64(1), starts)
        hashes = hashes[starts]
        part = (hashes >> np.uint64(32)) % np.uint64(buckets)
        keys = (hashes & _LOW & ~np.uint64(3)) | ((least != most).astype(np.uint64) << np.uint64(1)) | block
        number = int(table.column("bucket")[0].as_py())
        order = np.argsort(part, kind="stable")
        part, keys = part[order], keys[order].astype(np.uint32)
        cuts = np.flatnonzero(np.diff(part, prepend=part[:1] + np.uint64(1)))
        ends = np.append(cuts[1:], len(part))
        return _table(
            _PARTS,
            [[number] * len(cuts), part[cuts].astype(np.int32), [keys[a:b].tobytes() for a, b in zip(cuts, ends)]],
        )

    return probe


_PARTS = {"bucket": pa.int32(), "part": pa.int32(), "keys": pa.binary()}
_KEYS = {"bucket": pa.int32(), "keys": pa.binary()}


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each of the sorted values, and the first index of each group."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _by_bucket(bucket: np.ndarray, keys: np.ndarray, schema: dict) -> pa.Table:
    order = np.argsort(bucket, kind="stable")
    bucket, keys = bucket[order], keys[order]
    _, cuts = _groups(bucket)
    ends = np.append(cuts[1:], len(bucket))
    return _table(schema, [bucket[cuts], [keys[a:b].tobytes() for a, b in zip(cuts, ends)]])


def _read(table: pa.Table, name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values of a packed column, and how many each row holds."""
    values = [np.frombuffer(v, kind) for v in table.column(name).to_pylist()]
    return np.concatenate([np.zeros(0, kind), *values]), np.array([len(v) for v in values], np.int64)


def _match(table: pa.Table) -> pa.Table:
    """Probes that meet a block of another document, returned to every bucket that sent them."""
    keys, sizes = _read(table, "keys", np.uint32)
    bucket = np.repeat(table.column("bucket").to_numpy(), sizes)
    order = np.argsort(keys, kind="stable")
    keys, bucket = keys[order], bucket[order]
    group, starts = _groups(keys >> np.uint32(2))
    if not len(starts):
        return _table(_KEYS, [[], []])
    block = np.maximum.reduceat(keys & np.uint32(1), starts) > 0
    several = np.maximum.reduceat(keys & np.uint32(2), starts) > 0
    several |= np.diff(np.append(starts, len(keys))) > 1
    hit = (block & several)[group]
    return _by_bucket(bucket[hit], keys[hit] & ~np.uint32(3), _KEYS)


def _extend(buckets: int, window: int):
    schema = {
        "bucket": pa.int32(), "part": pa.int32(), "high": pa.binary(), "low": pa.binary(),
        "docs": pa.binary(), "counts": pa.binary(),
    }

    def extend(table: pa.Table, hits: pa.Table) -> pa.Table:
        """Runs of ``window`` words over a hit, each with its smallest document of this bucket."""
        sought = np.unique(_read(hits, "keys", np.uint32)[0])
        if not len(table) or not len(sought):
            return _table(schema, [[]] * 6)
        highs, lows, owners = [], [], []
        for ids, known, piece in _documents(table):
            words = piece.word_hashes()
            at, hashes = piece.windows(words, BLOCK)
            hit = np.zeros(len(words) + 1, np.int32)
            hit[at] = _member((hashes & _LOW & ~np.uint64(3)).astype(np.uint32), sought)
            if not hit.any():
                continue
            before = np.concatenate([[0], np.cumsum(hit)])
            start, high = piece.windows(words, window)
            over = (before[start + window - BLOCK + 1] > before[start]) & known[piece.doc[start]]
            start, high = start[over], high[over]
            second = piece.word_hashes(1)
            highs.append(high)
            lows.append(arrays.spans_hash(second, start, start + window, 1).astype(np.uint32))
            owners.append(ids[piece.doc[start]])
        if not highs:
            return _table(schema, [[]] * 6)
        high, low, owner = np.concatenate(highs), np.concatenate(lows), np.concatenate(owners)
        order = np.lexsort((owner, low, high))
        high, low, owner = high[order], low[order], owner[order]
        new = np.ones(len(high), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        high, low, owner = high[new], low[new], owner[new]
        part = ((high >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((owner, part))
        high, low, owner, part = high[order], low[order], owner[order], part[order]
        _, cuts = _groups(part)
        out = []
        number = int(table.column("bucket")[0].as_py())
        for a, b in zip(cuts, np.append(cuts[1:], len(part))):
            docs, counts = np.unique(owner[a:b], return_counts=True)
            out.append((number, part[a], high[a:b].tobytes(), low[a:b].tobytes(), docs.tobytes(), counts.tobytes()))
        return _table(schema, list(zip(*out)))

    return extend


def _member(values: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """Is each value among the sorted ones?"""
    if not len(sought):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sought, values)
    return sought[np.minimum(at, len(sought) - 1)] == values


def _earlier(table: pa.Table) -> pa.Table:
    """Runs for which another bucket has a smaller document, returned to the buckets that have larger ones only."""
    high, sizes = _read(table, "high", np.uint64)
    low = _read(table, "low", np.uint32)[0]
    owner = np.repeat(_read(table, "docs", np.int64)[0], _read(table, "counts", np.int64)[0])
    bucket = np.repeat(table.column("bucket").to_numpy(), sizes)
    order = np.lexsort((owner, low, high))
    high, low, owner, bucket = high[order], low[order], owner[order], bucket[order]
    new = np.ones(len(high), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    starts = np.flatnonzero(new)
    later = owner > owner[starts][np.cumsum(new) - 1]
    return _by_bucket(bucket[later], high[later], _KEYS)


def _remove(window: int):
    def remove(table: pa.Table, repeated: pa.Table) -> pa.Table:
        """Mark the words under repeated runs: runs that another bucket has earlier, or this one in a smaller id."""
        sought = np.unique(_read(repeated, "keys", np.uint64)[0])
        hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for ids, known, piece in _documents(table):
            start, high = piece.windows(piece.word_hashes(), window)
            use = known[piece.doc[start]]
            hashes.append(high[use])
            owners.append(ids[piece.doc[start]][use])
        high, owner = np.concatenate(hashes), np.concatenate(owners)
        order = np.lexsort((owner, high))
        high, owner = high[order], owner[order]
        group, starts = _groups(high)
        least = np.minimum.reduceat(owner, starts) if len(starts) else owner
        twice = (np.maximum.reduceat(owner, starts) if len(starts) else owner) > least
        own, least = high[starts][twice], least[twice]
        del hashes, owners, high, owner, order, group
        parts = []
        for ids, known, piece in _documents(table):
            start, high = piece.windows(piece.word_hashes(), window)
            doc = piece.doc[start]
            gone = _member(high, sought)
            if len(own):
                at = np.minimum(np.searchsorted(own, high), len(own) - 1)
                gone |= (own[at] == high) & (least[at] < ids[doc])
            gone &= known[doc]
            change = np.zeros(len(piece.starts) + 1, np.int32)
            change[start[gone]] += 1
            change[start[gone] + window] -= 1
            removed = np.cumsum(change[:-1]) > 0
            parts.append(_result(ids, known, piece, removed))
        return pa.concat_tables(parts)

    return remove


def _result(ids: np.ndarray, known: np.ndarray, piece: arrays.Texts, removed: np.ndarray) -> pa.Table:
    sums = np.concatenate([[0], np.cumsum(removed)])
    inner = removed.copy()
    inner[1:] &= removed[:-1] & (piece.doc[1:] == piece.doc[:-1])
    inner[:1] = False
    first = np.flatnonzero(removed & ~inner)
    run = np.cumsum(removed & ~inner)[removed] - 1
    length = np.bincount(run, minlength=len(first)) if len(first) else np.zeros(0, np.int64)
    ends = np.searchsorted(first, piece.first)
    spans = pa.ListArray.from_arrays(
        pa.array(ends, pa.int32()),
        pa.StructArray.from_arrays(
            [pa.array(first - piece.first[piece.doc[first]], pa.int64()), pa.array(length, pa.int64())],
            ["first", "words"],
        ),
    )
    return pa.table(
        {
            "doc_id": pa.array(ids, pa.int64(), mask=~known),
            "n_words": pa.array(np.diff(piece.first), pa.int64()),
            "n_removed": pa.array(np.diff(sums[piece.first]), pa.int64()),
            "spans": spans,
            "kept_text": piece.kept_text(removed).cast(pa.string()),
        }
    )
