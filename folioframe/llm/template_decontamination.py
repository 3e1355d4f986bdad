"""Benchmark decontamination on canonical templates.

A text becomes a sequence of tokens (runs without white space and ASCII punctuation, lower-cased in ASCII and Latin-1)
in which numbers, names and units
are replaced by typed placeholders; what a placeholder stands for is its slot value. Windows of five template tokens are
joined by hash between benchmark items and documents. An item is found in a document if at least three quarters of its
distinct windows are, on slots that agree: one slot value of the item always stands for the same value of the document,
so a question with other numbers and names is caught while an accidental run of placeholders is not. Slots are judged for
each place of the document where the item may lie, and over the whole document; the best counts.

A capitalised word may be a name or not, at the start of a sentence as inside it, and a copy in lower case or in capitals
shows no names at all. So such a word has two readings, a name and a plain word (or unit), and a window is joined in every
combination of its readings; inside the item, so has every word that is a name elsewhere in it.

Only the positions of a bitmap of fixed size, set by the item windows, are broadcast; it thins out the document windows
before the join and decides nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm import arrays
from folioframe.session import materialize

WINDOW = 5
SHARE = 0.75
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t oz lb lbs pound pounds ton tons "
    "ml cl dl l liter liters litre litres ms s sec second seconds min minute minutes h hr hour hours day days week weeks "
    "month months year years kb mb gb tb hz khz mhz ghz w kw mw wh kwh v mv a ma j kj cal kcal n pa kpa bar k c f mph kmh "
    "dollar dollars euro euros cent cents usd eur gbp percent pct degree degrees"
).split()
# Bits of the bitmap; the driver and each task hold this many bits, however large the benchmark is.
BITMAP_BITS = 1 << 22

_BREAK = arrays.SPACE.copy()
_BREAK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_END = np.zeros(256, bool)
_END[[0x0A, 0x0D, *b".!?:;"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_SMALL = np.zeros(256, bool)
_SMALL[0x61:0x7B] = True
_NUMBER, _NAME, _UNIT = (np.uint64(v) for v in (0x1F3D5B79, 0x2F3D5B79, 0x3F3D5B79))


def _hash_words(words: list[str]) -> np.ndarray:
    piece = next(arrays.pieces(pa.array([" ".join(words)])))
    piece.words()
    return np.sort(piece.word_hashes())


_UNIT_HASHES = _hash_words(UNITS)


class Templates:
    """Template tokens of a piece: their first reading and, where ``two``, their other one.

    ``readings`` has the hashes of both with placeholders put in, ``filled`` tells which are placeholders; ``values`` is
    what a placeholder stands for, ``doc`` the document. With ``repeats`` a word that is a name elsewhere in its document
    has two readings as well.
    """

    def __init__(self, piece: arrays.Texts, repeats: bool = False):
        data = piece.data
        spaced = np.where(_BREAK[data], np.uint8(0x20), arrays.LOWER[data])
        # Latin-1 capitals are the byte 0xC3 and one of 0x80 to 0x9E, but for the multiplication sign.
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        capital = after[(spaced[after] < 0x9F) & (spaced[after] != 0x97)]
        spaced[capital] += 0x20
        lowered = arrays.Texts(spaced, piece.offsets, piece.first_row)
        lowered.words()
        starts, ends, doc = lowered.starts, lowered.ends, lowered.doc
        values = lowered.word_hashes()
        sums = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        number = sums[ends] > sums[starts]
        sums = np.concatenate([[0], np.cumsum(_END[data])])
        opening = np.ones(len(starts), bool)
        opening[1:] = (doc[1:] != doc[:-1]) | (sums[starts[1:]] > sums[ends[:-1]])
        # A name is a capital and a small letter, which may be Latin-1 (0xC3 and a byte from 0xA0 on).
        second, third = (data[np.minimum(starts + k, max(0, len(data) - 1))] for k in (1, 2))
        small = _SMALL[second] | ((second == 0xC3) & (third >= 0xA0))
        capital = _UPPER[data[starts]] & (ends - starts > 1) & small & ~number
        name = capital & ~opening
        two = capital
        if repeats:
            own = arrays.mix(values) + doc.astype(np.uint64) * _NAME
            two = two | np.isin(own, own[name]) & ~number
        # Numbers that follow each other (a decimal fraction, a grouped number) are one slot.
        again = np.zeros(len(starts), bool)
        again[1:] = number[1:] & number[:-1] & (doc[1:] == doc[:-1])
        unit = np.zeros(len(starts), bool)
        unit[1:] = number[:-1] & (doc[1:] == doc[:-1])
        unit &= np.isin(values, _UNIT_HASHES) & ~number
        first = np.flatnonzero(~again)
        if len(first):
            run = np.add.reduceat(arrays.mix(values), first)
            one = np.diff(np.append(first, len(starts))) == 1
            values_of_slots = np.where(one, values[first], run)
        else:
            values_of_slots = values
        number, name, unit, two, values, doc = (x[first] for x in (number, name, unit, two, values, doc))
        common = np.where(number, _NUMBER, np.where(unit, _UNIT, values))
        other = two & ~name
        self.readings = np.where(name, _NAME, common), np.where(other, _NAME, common)
        self.filled = number | name | unit, number | other | unit
        self.values = values_of_slots | np.uint64(1)
        self.two, self.doc, self.n = two, doc, piece.n

    def windows(self):
        """First token, hash, hash of the first reading and placeholders of every window that holds a plain word.

        The windows come in runs, one for each choice of tokens in their other reading.
        """
        n = len(self.doc)
        at = np.arange(max(0, n - WINDOW + 1))
        at = at[self.doc[at] == self.doc[at + WINDOW - 1]]
        up, down = arrays.powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.readings[0] * up[:n], out=sums[1:])
        change = (self.readings[1] - self.readings[0]) * up[:n]
        span = sums[at + WINDOW] - sums[at]
        choices = sum(self.two[at + i].astype(np.uint8) << i for i in range(WINDOW))
        for choice in range(1 << WINDOW):
            use = np.flatnonzero(choices & choice == choice)
            if not len(use):
                continue
            filled = np.stack([self.filled[choice >> i & 1][at[use] + i] for i in range(WINDOW)], axis=1)
            plain = ~filled.all(axis=1)
            use, filled = use[plain], filled[plain]
            total = span[use]
            for i in range(WINDOW):
                if choice >> i & 1:
                    total = total + change[at[use] + i]
            yield at[use], arrays.mix(total * down[at[use]]), arrays.mix(span[use] * down[at[use]]), filled


def _rows(bitmap: np.ndarray | None):
    """(id, text hash, window, base, place, slot values) of every window of every text; ``place`` is its first token.

    Documents have a bitmap: windows whose bit is set, with the values of their placeholders, ``base`` null. Items have
    none: ``base`` is the window in its first reading, and a token with two readings always has its value.
    """
    item = bitmap is None

    def rows(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            copies = batch.column("copy").to_numpy(zero_copy_only=False)
            for piece in arrays.pieces(batch.column("text")):
                template = Templates(piece, repeats=item)
                found = [(np.zeros(0, np.int64), *np.zeros((2, 0), np.uint64), np.zeros((0, WINDOW), bool))]
                for at, hashes, base, filled in template.windows():
                    if item:
                        # Only windows with a plain word in their first reading count.
                        place = at[:, None] + np.arange(WINDOW)
                        use = ~template.filled[0][place].all(axis=1)
                        filled = filled | template.filled[0][place] | template.two[place]
                    else:
                        bit = hashes & np.uint64(BITMAP_BITS - 1)
                        use = (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    found.append((at[use], hashes[use], base[use], filled[use]))
                at, hashes, base, filled = (np.concatenate(x) for x in zip(*found))
                if len(at):
                    slots = np.where(filled, template.values[at[:, None] + np.arange(WINDOW)], np.uint64(0))
                else:
                    slots = np.zeros((0, WINDOW), np.uint64)
                doc = template.doc[at]
                place = at - np.searchsorted(template.doc, np.arange(template.n))[doc]
                # Windows without slots need no list.
                filled = slots.any(axis=1)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(filled * WINDOW)]), pa.int32()),
                    pa.array(slots[filled].reshape(-1).view(np.int64)),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[piece.first_row + doc], pa.int64()),
                        pa.array(copies[piece.first_row + doc], pa.int64()),
                        pa.array(hashes.view(np.int64)),
                        pa.array(base.view(np.int64)) if item else pa.nulls(len(doc), pa.int64()),
                        pa.array(place, pa.int64()),
                        lists,
                    ],
                    ["id", "copy", "window", "base", "place", "slots"],
                )

    return rows


def _windows(table: DataFrame, id_column: str, text_column: str, bitmap: np.ndarray | None = None) -> DataFrame:
    text = F.col(text_column).cast("string")
    return (
        table.filter(F.col(id_column).isNotNull())
        .select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("copy"), text.alias("text"))
        .mapInArrow(_rows(bitmap), "id long, copy long, window long, base long, place long, slots array<long>")
    )


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    share: float = SHARE,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_windows, n_found, containment, slots_changed) for every item found in a document.

    ``n_windows`` counts the item's distinct windows, ``n_found`` those that the document has with agreeing slots;
    ``containment`` is their ratio, at least ``share``. ``slots_changed`` counts slot values of the item that are others
    in the document: more than 0 means a re-parameterised item. Items shorter than a window, or without a plain word in
    any, have no windows and are never found; so are null and empty texts and rows without id on either side. Rows that
    repeat an id count as one text. Case and punctuation do not matter, but make out names: another name is only known as
    one where both it and the item's are capitalised. Other columns are ignored.
    """
    items = materialize(_windows(benchmark, item_column, item_text_column).withColumnRenamed("id", "item_id").distinct())
    sizes = items.groupBy("item_id").agg(
        F.countDistinct("base").alias("n_windows"), (F.max("place") + WINDOW).alias("length")
    )
    bits = items.select(F.col("window").bitwiseAND(F.lit(BITMAP_BITS - 1)).alias("bit")).distinct().toArrow()
    bitmap = np.zeros(BITMAP_BITS // 8, np.uint8)
    bit = bits.column("bit").to_numpy()
    np.bitwise_or.at(bitmap, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
    found = _windows(docs, id_column, text_column, bitmap).withColumnRenamed("id", "doc_id").drop("base").distinct()
    # A plain word of the document has no slot value: it is the same word as the item's. Pairs in several readings are one.
    asked_and_given = F.transform(
        F.arrays_zip("asked", "slots"),
        lambda s: F.struct(s["asked"].alias("asked"), F.coalesce(F.nullif(s["slots"], F.lit(0)), s["asked"]).alias("given")),
    )
    asked = items.join(sizes, "item_id").select(
        "item_id", "window", "base", "length", F.col("copy").alias("item_copy"), F.col("place").alias("item_place"),
        F.col("slots").alias("asked"),
    )
    # A hit belongs to four groups, each with slots of its own: the whole document, the hits that lie alike, and two
    # grids of the item's length, so that a copy with words put in or left out keeps together and two copies do not.
    shift, length = F.col("place") - F.col("item_place"), F.col("length")
    texts = F.xxhash64("copy", "item_copy")
    half = F.floor(length / 2)
    groups = [(0, F.lit(0), F.lit(0)), (1, shift, texts), (2, F.floor(shift / length), texts), (3, F.floor((shift + half) / length), texts)]
    pairs = materialize(
        found.join(asked, "window")
        .select(
            "doc_id", "item_id", "base", F.filter(asked_and_given, lambda s: s["asked"] != 0).alias("s"),
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("at"), of.cast("long").alias("of"))
                        for kind, at, of in groups
                    ]
                )
            ).alias("g"),
        )
        .distinct()
    )
    group = ["doc_id", "item_id", "g"]
    slots = (
        pairs.select(*group, F.explode("s").alias("s"))
        .groupBy(*group, F.col("s.asked").alias("asked"), F.col("s.given").alias("given"))
        .agg(F.count(F.lit(1)).alias("votes"))
    )
    # A slot value of the item stands for the value that most windows give it.
    chosen = slots.groupBy(*group, "asked").agg(
        F.max(F.struct("votes", (F.col("asked") == F.col("given")).alias("same"), "given")).alias("best")
    )
    mapping = chosen.groupBy(*group).agg(
        F.map_from_entries(F.collect_list(F.struct("asked", "best.given"))).alias("mapping"),
        F.count(F.when(F.col("asked") != F.col("best.given"), 1)).alias("slots_changed"),
    )
    agree = F.forall("s", lambda s: F.element_at("mapping", s["asked"]) == s["given"])
    return (
        pairs.join(mapping, group, "left")
        .filter((F.size("s") == 0) | agree)
        .groupBy(*group)
        .agg(
            F.countDistinct("base").alias("n_found"),
            F.coalesce(F.first("slots_changed"), F.lit(0)).alias("slots_changed"),
        )
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("n_found", (-F.col("slots_changed")).alias("kept"))).alias("best"))
        .select("doc_id", "item_id", "best.n_found", (-F.col("best.kept")).alias("slots_changed"))
        .join(sizes, "item_id")
        .filter(F.col("n_found") >= share * F.col("n_windows"))
        .select(
            "doc_id",
            "item_id",
            "n_windows",
            "n_found",
            (F.col("n_found") / F.col("n_windows")).alias("containment"),
            "slots_changed",
        )
    )
