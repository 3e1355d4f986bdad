"""A posting table for searches: which entities hold which three characters in a row.

Texts are compared as matching keys, so every entity whose text contains a needle also holds all pieces of three characters
of the needle. A row of the stored table has a piece and the ids of one block of texts that hold it, so what is shuffled and
written is lists, not pairs. The table is laid out by hash bucket and piece: a search reads the lists of its own pieces only,
and compares the texts of the entities that have all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions.text import filename, key
from folioframe.operators import views

PIECE = 3
BUCKETS = 256
# Characters of texts in a block, unless a single batch has more.
BLOCK_CHARS = 1 << 20
_SCHEMA = "piece string, ids array<long>, bucket int"


def _pieces(normal: Column) -> Column:
    """Distinct pieces of a matching key; none for a shorter one."""
    starts = F.sequence(F.lit(1), F.length(normal) - (PIECE - 1))
    found = F.array_distinct(F.transform(starts, lambda at: F.substr(normal, at, F.lit(PIECE))))
    return F.when(F.length(normal) >= PIECE, found).otherwise(F.array().cast("array<string>"))


def _bucket(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(BUCKETS)).cast("int")


def _lists(ids: np.ndarray, texts: pa.Array) -> pa.RecordBatch | None:
    """(piece, ids) of a block: every piece once, with the ascending ids that hold it; None without pieces."""
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    n = int(ends[-1]) - (PIECE - 1) if len(ends) else 0
    if n <= 0:
        return None
    characters = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    present = np.zeros(int(characters.max()) + 1, bool)
    present[characters] = True
    alphabet = np.flatnonzero(present)
    letters = (np.cumsum(present) - 1)[characters]
    codes = letters[:n]
    for ahead in range(1, PIECE):
        codes = codes * len(alphabet) + letters[ahead : n + ahead]
    starts = np.ones(n + PIECE - 1, bool)
    for back in range(1, PIECE):
        starts[(ends - back)[lengths >= back]] = False
    starts = starts[:n]
    known, ranks = np.unique(ids, return_inverse=True)
    bits = len(known).bit_length()
    # A pair is one number while it fits; else the pieces are numbered first.
    pieces = None
    if len(alphabet) ** PIECE << bits > 1 << 63:
        pieces, codes = np.unique(codes, return_inverse=True)
    pairs = np.sort((codes << bits | np.repeat(ranks, lengths)[:n])[starts])
    if not len(pairs):
        return None
    pairs = pairs[np.diff(pairs, prepend=-1) > 0]
    codes = pairs >> bits
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    codes = codes[first] if pieces is None else pieces[codes[first]]
    places = [codes // len(alphabet) ** power % len(alphabet) for power in reversed(range(PIECE))]
    spelled = alphabet[np.stack(places, axis=1)].astype("<u4").tobytes().decode("utf-32-le")
    of_piece = known[pairs & ((1 << bits) - 1)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([spelled[i : i + PIECE] for i in range(0, len(spelled), PIECE)], pa.string()),
            pa.ListArray.from_arrays(pa.array(np.append(first, len(pairs)), pa.int32()), pa.array(of_piece, pa.int64())),
        ],
        ["piece", "ids"],
    )


def _blocks(batches):
    held, chars = [], 0

    def block():
        return _lists(
            np.concatenate([b.column("id").to_numpy() for b in held]),
            pa.chunked_array([b.column("normal") for b in held]).combine_chunks(),
        )

    for batch in batches:
        held.append(batch)
        chars += pc.sum(pc.utf8_length(batch.column("normal"))).as_py() or 0
        if chars >= BLOCK_CHARS:
            if (lists := block()) is not None:
                yield lists
            held, chars = [], 0
    if held and (lists := block()) is not None:
        yield lists


def postings(entities: DataFrame, members: DataFrame) -> DataFrame:
    """(piece, ids, bucket) of all texts that ``views.search`` looks at, block by block of texts.

    Null texts and keys of less than three characters have no pieces; files without entity and entities without id are left
    out. A list is ascending and without repeats; an id that has texts in several blocks is in a list of each.
    """
    texts = entities.select("id", F.explode(views.entity_texts()).alias("text")).unionByName(
        members.filter(F.col("book_id").isNotNull()).select(
            F.col("book_id").alias("id"), filename(F.col("path")).alias("text")
        )
    )
    normal = texts.select(F.col("id").cast("long").alias("id"), key(F.col("text")).alias("normal")).dropna()
    return normal.mapInArrow(_blocks, "piece string, ids array<long>").withColumn("bucket", _bucket(F.col("piece")))


def write_index(entities: DataFrame, members: DataFrame, folder: str) -> None:
    """Write the posting table, a folder for each bucket, sorted by piece.

    Tasks have whole buckets, or parts of one where it is large: a piece that most entities hold spreads over tasks, as it
    has a list for each block.
    """
    postings(entities, members).hint("rebalance", "bucket").sortWithinPartitions("bucket", "piece").write.partitionBy(
        "bucket"
    ).parquet(folder, compression="zstd")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """(piece, id, bucket), distinct; a filter by bucket and piece reads the lists of these only."""
    lists = spark.read.schema(_SCHEMA).parquet(folder)
    return lists.select("piece", F.explode("ids").alias("id"), "bucket").distinct()


def candidates(index: DataFrame, pieces: list[str], buckets: list[int]) -> DataFrame:
    """(id): entities that hold all pieces; reads the buckets and pieces named, nothing else."""
    return (
        index.filter(F.col("bucket").isin(buckets) & F.col("piece").isin(pieces))
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") == len(pieces))
        .select("id")
    )


def search(entities: DataFrame, members: DataFrame, index: DataFrame, text: str) -> DataFrame:
    """The rows of ``views.search``, found by the posting table.

    Needles of less than three characters have no pieces and are looked for everywhere. ``index`` must be of the same
    entities and members; an entity that is newer than the index is not found.
    """
    pieces = _pieces(key(F.lit(text)))
    needle = entities.sparkSession.range(1).select(
        pieces.alias("pieces"), F.transform(pieces, _bucket).alias("buckets")
    ).first()
    if not needle["pieces"]:
        return views.search(entities, members, text)
    found = candidates(index, needle["pieces"], sorted(set(needle["buckets"])))
    return views.search(
        entities.join(found, "id", "left_semi"),
        members.join(found.withColumnRenamed("id", "book_id"), "book_id", "left_semi"),
        text,
    )
