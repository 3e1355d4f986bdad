"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

A document's set holds its distinct 5-word shingles as 64-bit hashes. Two permutations make all signature
coordinates: the first one spreads the shingles over the ring of 2**32 places, the second one, turned by ``k`` places,
gives coordinate ``k``; the coordinate is the smallest value over the set. Bands of ``ROWS`` coordinates are the
bucket keys. With 52 bands of 5 rows a pair at similarity 0.75 shares no bucket with probability 8e-7.

Nothing enumerates the pairs of a bucket. Equal sets count once. The members of a bucket are paired with one leader, the
pairs are verified on full sets and what is linked is merged; a bucket whose members are all connected is finished.
What is left lies near the threshold without reaching it. Overlapping buckets are teamed up, their members are dealt
to blocks of a fixed size, and every two blocks give the intersection sizes of all their sets at once, so that no task
holds more than two blocks, only links are output and no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm import arrays
from folioframe.operators.components import connected_components
from folioframe.session import discard, materialize

SHINGLE = 5
BANDS, ROWS = 52, 5


def _spread(x: np.ndarray) -> np.ndarray:
    """First permutation: shingle hashes to places on the ring."""
    return (arrays.mix(x ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)


def _turned(places: np.ndarray, k: int, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Second permutation, a bijection on 32 bits, turned by ``k`` places."""
    np.subtract(places, np.uint32(k), out=out)
    for shift, factor in ((16, 0x85EBCA6B), (15, 0xC2B2AE35)):
        np.right_shift(out, np.uint32(shift), out=spare)
        np.bitwise_xor(out, spare, out=out)
        np.multiply(out, np.uint32(factor), out=out)
    return out


def shingle_sets(piece: arrays.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, sorted: document numbers and hashes.

    A document with fewer than five words has its whole word sequence as its only shingle.
    """
    piece.words()
    hashes = piece.word_hashes()
    at, shingles = piece.windows(hashes, SHINGLE)
    doc = piece.doc[at]
    size = np.diff(piece.first)
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    if len(short):
        whole = arrays.spans_hash(hashes, piece.first[short], piece.first[short + 1])
        doc = np.concatenate([doc, short])
        shingles = np.concatenate([shingles, arrays.mix(whole + size[short].astype(np.uint64))])
    order = np.lexsort((shingles, doc))
    doc, shingles = doc[order], shingles[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (shingles[1:] != shingles[:-1])
    return doc[new], shingles[new]


def band_keys(doc: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents with shingles, and their bucket keys, one row of ``BANDS`` each."""
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    places = _spread(shingles)
    out, spare = np.empty_like(places), np.empty_like(places)
    keys = np.zeros((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(starts), band + 1, np.uint64)
        for row in range(ROWS):
            least = np.minimum.reduceat(_turned(places, band * ROWS + row, out, spare), starts)
            key = arrays.mix(key ^ least.astype(np.uint64))
        keys[:, band] = key
    return doc[starts], keys


def _signatures(batches):
    for batch in batches:
        for piece in arrays.pieces(batch.column("text"), lower=True):
            doc, shingles = shingle_sets(piece)
            sizes = np.bincount(doc, minlength=piece.n)
            digest = np.zeros((piece.n, 2), np.uint64)
            bands = np.zeros((piece.n, 0), np.uint64)
            lists = pa.array([None] * piece.n, pa.list_(pa.int64()))
            if len(doc):
                starts = np.flatnonzero(np.diff(doc, prepend=-1))
                digest[doc[starts], 0] = np.add.reduceat(shingles, starts)
                digest[doc[starts], 1] = np.add.reduceat(arrays.mix(~shingles), starts)
                full, bands = band_keys(doc, shingles)
                offsets = np.zeros(piece.n + 1, np.int32)
                offsets[full + 1] = BANDS
                lists = pa.ListArray.from_arrays(
                    pa.array(np.cumsum(offsets), pa.int32()), pa.array(bands.reshape(-1).view(np.int64))
                )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(piece.first_row, piece.n),
                    pa.array(sizes, pa.int64()),
                    pa.array(digest[:, 0].view(np.int64)),
                    pa.array(digest[:, 1].view(np.int64)),
                    lists,
                ],
                ["doc_id", "n_shingles", "sum_a", "sum_b", "bands"],
            )


def _pack(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), arrays.pack(batch.column("text"))], ["doc_id", "packed"]
        )


def _verify(batches):
    """Keep the pairs with 100 * intersection >= 75 * union."""
    for batch in batches:
        for rows in arrays.batches(pa.Table.from_batches([batch]), 1 << 19):
            sides = []
            for name in ("packed_a", "packed_b"):
                found = [np.zeros((2, 0), np.uint64)]
                for piece in arrays.pieces(arrays.unpack(rows.column(name)), lower=True):
                    doc, shingles = shingle_sets(piece)
                    found.append(np.stack([(doc + piece.first_row).astype(np.uint64), shingles]))
                sides.append(np.concatenate(found, axis=1))
            both = np.concatenate(sides, axis=1)
            order = np.lexsort((both[1], both[0]))
            row, shingles = both[0][order], both[1][order]
            twice = (row[1:] == row[:-1]) & (shingles[1:] == shingles[:-1])
            common = np.bincount(row[1:][twice].astype(np.int64), minlength=len(rows))
            union = np.bincount(row.astype(np.int64), minlength=len(rows)) - common
            linked = (100 * common >= 75 * union) & (union > 0)
            yield from rows.select(["a", "b"]).filter(pa.array(linked)).to_batches()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): near-duplicate components over whole texts.

    Texts are lower-cased in A-Z; words are runs without ASCII white space. Two documents are linked if
    100 * intersection >= 75 * union of their shingle sets. ``component_id`` is the smallest id reachable over links,
    the document itself included, and ``kept`` marks the document with that id. Null, empty and blank texts have no
    shingles and link with nothing. Rows that repeat an id each give a row; if their texts differ, all of them take
    the smallest component found for any. A row without id gives a null component and is kept. Other columns are ignored. An empty
    table gives an empty result.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    signed = materialize(
        source.mapInArrow(
            _signatures, "doc_id long, n_shingles long, sum_a long, sum_b long, bands array<long>"
        )
    )
    known = signed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = materialize(
        known.groupBy("sum_a", "sum_b", "n_shingles").agg(
            F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")
        )
    )
    own = known.drop("bands").join(classes.drop("bands"), ["sum_a", "sum_b", "n_shingles"])
    copies = own.filter(F.col("doc_id") != F.col("rep")).select("doc_id", "rep")
    rows = classes.select(F.explode("bands").alias("key"), F.col("rep").alias("node"), F.col("n_shingles").alias("n"))
    shared = materialize(_within_shared(rows))
    texts = None
    links = None
    if not shared.isEmpty():
        nodes = shared.select("node").distinct().withColumnRenamed("node", "doc_id")
        texts = materialize(
            source.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
            .mapInArrow(_pack, "doc_id long, packed binary")
            .join(nodes, "doc_id", "left_semi")
        )
        links = _links(shared, texts)
    linked = copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    if links is not None:
        components = connected_components(links)
        # A copy's representative may itself have moved to a smaller node.
        linked = linked.join(components, F.col("b") == F.col("node"), "left").select(
            "a", F.coalesce("component", "b").alias("b")
        ).union(components.select("node", "component"))
    result = linked.groupBy("a").agg(F.min("b").alias("component"))
    return (
        signed.select("doc_id", "n_shingles")
        .join(result, F.col("doc_id") == F.col("a"), "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def _within_shared(rows: DataFrame) -> DataFrame:
    """Rows of the buckets with more than one member."""
    shared = rows.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y"))
    return rows.join(shared.filter(F.col("x") < F.col("y")).select("key"), "key", "left_semi")


def _checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar on their full sets."""
    return (
        pairs.join(texts.withColumnsRenamed({"doc_id": "a", "packed": "packed_a"}), "a")
        .join(texts.withColumnsRenamed({"doc_id": "b", "packed": "packed_b"}), "b")
        .select("a", "b", "packed_a", "packed_b")
        .mapInArrow(_verify, "a long, b long")
    )


def _links(shared: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links that connect all that is similar within a bucket."""
    leader = shared.groupBy("key").agg(F.min(F.struct("node", "n")).alias("l"))
    leader = leader.select("key", F.col("l.node").alias("b"), F.col("l.n").alias("m"))
    sized = 100 * F.least("n", "m") >= 75 * F.greatest("n", "m")
    pairs = shared.join(leader, "key").filter((F.col("node") != F.col("b")) & sized)
    links = materialize(_checked(pairs.select(F.col("b").alias("a"), F.col("node").alias("b")).distinct(), texts))
    components = connected_components(links)
    merged = shared.join(components, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("comp")
    )
    split = merged.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
    apart = materialize(merged.join(split.filter(F.col("x") < F.col("y")).select("key"), "key", "left_semi"))
    if apart.isEmpty():
        return links
    blocks = _blocks(apart).join(texts, F.col("node") == F.col("doc_id"))
    found = blocks.groupBy("team", "low", "high").applyInArrow(_compare, "a long, b long")
    return links.union(materialize(found))


# Members of a block; a task compares two blocks at a time.
BLOCK = 256


def _blocks(apart: DataFrame) -> DataFrame:
    """(team, low, high, node, comp, own): every two members of a bucket meet in at least one pair of blocks.

    Buckets that overlap are one team, whose members are dealt to blocks. Where the team would need more copies of its
    members than its buckets one by one (long chains of small buckets), the buckets are the teams.
    """
    first = apart.groupBy("key").agg(F.min("node").alias("head"))
    edges = apart.join(first, "key").filter(F.col("node") != F.col("head")).select("node", "head").distinct()
    chained = connected_components(edges)
    placed = apart.join(chained, "node", "left").withColumn("team", F.coalesce("component", "node")).drop("component")
    pieces = F.ceil(F.col("c") / BLOCK)
    nodes = materialize(placed.select("team", "node", "comp").distinct())
    whole = nodes.groupBy("team").agg(F.count(F.lit(1)).alias("c")).select("team", (F.col("c") * pieces).alias("once"))
    buckets = placed.groupBy("team", "key").agg(F.count(F.lit(1)).alias("c"))
    each = buckets.groupBy("team").agg(F.sum(F.col("c") * pieces).alias("apiece"))
    single = materialize(whole.join(each, "team").filter(F.col("apiece") < F.col("once")).select("team"))
    named = nodes.select(F.struct(F.lit(False).alias("single"), "team").alias("team"), "node", "comp")
    if not single.isEmpty():
        named = (
            nodes.join(single, "team", "left_anti")
            .select(F.struct(F.lit(False).alias("single"), "team").alias("team"), "node", "comp")
            .union(
                placed.join(single, "team", "left_semi")
                .select(F.struct(F.lit(True).alias("single"), F.col("key").alias("team")).alias("team"), "node", "comp")
                .distinct()
            )
        )
    named = materialize(named)
    sizes = named.groupBy("team").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    return (
        named.join(sizes, "team")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("team", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), "node", "comp", "own")
    )


def _compare(table: pa.Table) -> pa.Table:
    """Similar pairs of different components, from intersection sizes of all sets of two blocks at once."""
    node, comp, own = (table.column(c).to_numpy() for c in ("node", "comp", "own"))
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    docs, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    done = 0
    for rows in arrays.batches(table.select(["packed"]), 1 << 20):
        for piece in arrays.pieces(arrays.unpack(rows.column("packed")), lower=True):
            doc, shingles = shingle_sets(piece)
            docs.append(doc + piece.first_row + done)
            found.append(shingles)
        done += len(rows)
    doc, shingles = np.concatenate(docs), np.concatenate(found)
    size = np.bincount(doc, minlength=len(node))
    order = np.argsort(shingles, kind="stable")
    doc, shingles = doc[order], shingles[order]
    new = np.ones(len(doc), bool)
    new[1:] = shingles[1:] != shingles[:-1]
    number = np.cumsum(new) - 1
    several = np.bincount(number)[number] > 1
    doc, number = doc[several], number[several]
    number = np.cumsum(np.diff(number, prepend=-1) != 0) - 1
    first, second = np.flatnonzero(own == low), np.flatnonzero(own == high)
    row_a, row_b = np.full(len(node), -1), np.full(len(node), -1)
    row_a[first], row_b[second] = np.arange(len(first)), np.arange(len(second))
    common = np.zeros((len(first), len(second)), np.float32)
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        span = slice(*np.searchsorted(number, [at, at + 4096]))
        sides = []
        for rows, count in ((row_a, len(first)), (row_b, len(second))):
            side = np.zeros((count, 4096), np.float32)
            use = rows[doc[span]] >= 0
            side[rows[doc[span]][use], number[span][use] - at] = 1
            sides.append(side)
        common += sides[0] @ sides[1].T
    common = common.astype(np.int64)
    union = size[first][:, None] + size[second][None, :] - common
    a, b = np.nonzero((100 * common >= 75 * union) & (comp[first][:, None] != comp[second][None, :]))
    a, b = node[first[a]], node[second[b]]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})
