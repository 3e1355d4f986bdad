"""Exact word-overlap similarity join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.text import key, token_similarity


def title_words(title: Column) -> Column:
    """Sorted distinct words of a title; two titles with equal lists are fully similar."""
    return F.array_sort(F.array_distinct(F.filter(F.split(key(title), " "), lambda w: w != "")))


# Lists up to this size are paired size by size; longer ones share one bucket.
_SIZED = 20


def _frequency(lists: DataFrame) -> DataFrame:
    return (
        lists.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    )


def similar_titles(left: DataFrame, right: DataFrame, minimum: float) -> DataFrame:
    """(left_words, right_words, similarity) for all pairs of word lists at least ``minimum`` alike.

    ``left`` and ``right`` have one column ``words`` with distinct values. Two lists of n and m
    words that are ``minimum`` alike share at least ``minimum / (1 + minimum) * (n + m)`` words. So
    when words are ordered from rare to common they share one among the first few of each list,
    and lists only meet on those: a word used by a large share of all titles is hardly ever a join
    key. Every pair found is verified.
    """
    if not 0 < minimum <= 1:
        raise ValueError("minimum must be in (0, 1]")
    frequency = _frequency(left.unionByName(right))
    # The small allowance keeps floating-point rounding from losing a pair.
    up = lambda x: F.ceil(x - 1e-9).cast("int")
    down = lambda x: F.floor(x + 1e-9).cast("int")

    def signatures(lists: DataFrame, side: str) -> DataFrame:
        # Lists are bounded by the length of one title, so ordering one happens inside a row.
        ranked = (
            lists.select("words", F.explode("words").alias("word"))
            .join(frequency, "word")
            .groupBy("words")
            .agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("ranked"))
            .withColumn("size", F.size("words"))
            .withColumn("low", up(F.col("size") * minimum))
            .withColumn("high", down(F.col("size") / minimum))
        )
        none = F.array().cast("array<int>")
        sized = F.when(
            (F.col("size") <= _SIZED) & (F.col("low") <= F.least("high", F.lit(_SIZED))),
            F.sequence("low", F.least("high", F.lit(_SIZED))),
        ).otherwise(none)
        rest = F.when(F.greatest("high", "size") > _SIZED, F.array(F.lit(0))).otherwise(none)
        shared = F.when(
            F.col("partner") > 0, up((F.col("size") + F.col("partner")) * (minimum / (1 + minimum)))
        ).otherwise(F.col("low"))
        return (
            ranked.withColumn("partner", F.explode(F.concat(sized, rest)))
            .withColumn("own", F.when(F.col("partner") > 0, F.col("size")).otherwise(0))
            .select(
                F.col("words").alias(f"{side}_words"),
                F.col("own" if side == "left" else "partner").alias("left_size"),
                F.col("partner" if side == "left" else "own").alias("right_size"),
                F.explode(F.slice("ranked", F.lit(1), F.col("size") - shared + 1)).alias("r"),
            )
            .withColumn("word", F.col("r.word"))
            .drop("r")
        )

    a, b = F.col("left_words"), F.col("right_words")
    fits = (F.size(a) >= F.size(b) * minimum - 1e-9) & (F.size(b) >= F.size(a) * minimum - 1e-9)
    pairs = (
        signatures(left, "left")
        .join(signatures(right, "right"), ["word", "left_size", "right_size"])
        .filter(fits)
        .select("left_words", "right_words")
        .distinct()
    )
    return pairs.withColumn("similarity", token_similarity(a, b)).filter(
        F.col("similarity") >= minimum
    )


def containing_titles(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_words, right_words, similarity): right lists that have every word of a left list.

    A left list looks only where its rarest word occurs; the number of rows per lookup is the
    frequency of that word, not of the common words around it.
    """
    rarest = (
        left.select("words", F.explode("words").alias("word"))
        .join(_frequency(right), "word")
        .groupBy("words")
        .agg(F.count(F.lit(1)).alias("known"), F.min(F.struct("n", "word")).alias("r"))
        .filter(F.col("known") == F.size("words"))
        .select(F.col("words").alias("left_words"), F.col("r.word").alias("word"))
    )
    places = right.select(F.col("words").alias("right_words"), F.explode("words").alias("word"))
    contained = F.size(F.array_except("left_words", "right_words")) == 0
    return (
        rarest.join(places, "word")
        .filter((F.size("left_words") <= F.size("right_words")) & contained)
        .select("left_words", "right_words", (F.size("left_words") / F.size("right_words")).alias("similarity"))
    )
