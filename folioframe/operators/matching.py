"""Match entities with external catalogs, decide, and apply what was decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.fields import has_items
from folioframe.functions.identifiers import lookup_query
from folioframe.functions.text import author_sort_key, similarity, title_sort_key, tokens
from folioframe.operators.overrides import status_column
from folioframe.operators.provenance import as_records
from folioframe.operators.similarity import containing_titles, similar_titles, title_words
from folioframe.schemas import (
    CANDIDATE_FIELDS,
    CANDIDATES_PER_SOURCE,
    CONFIDENCE_MARGIN,
    CONFIDENCE_THRESHOLD,
    DEFAULT_PROVIDER_ORDER,
)
from folioframe.session import materialize


def needs_resolution(entities: DataFrame) -> DataFrame:
    return entities.filter(F.col("metadata_status") != "complete")


def provider_order(setting: str, providers: list[str] = DEFAULT_PROVIDER_ORDER) -> list[str]:
    """Configured order without unknown names; providers that are not listed follow."""
    wanted = [name.strip() for name in setting.split(",")]
    known = [name for name in dict.fromkeys(wanted) if name in providers]
    return known + [name for name in providers if name not in known]


def source_rank(source: Column, order: list[str]) -> Column:
    """Position of a source in the provider order; unknown sources are null."""
    place = F.array_position(F.array(*[F.lit(name) for name in order]), source)
    return F.nullif(place, F.lit(0)).cast("int")


def queries(entities: DataFrame) -> DataFrame:
    """(entity_id, isbn, title, author) of every entity that can be looked up."""
    query = lookup_query(*[F.col(c) for c in ("isbn13", "isbn10", "title", "authors")])
    return (
        entities.select(F.col("id").alias("entity_id"), query.alias("q"))
        .select("entity_id", "q.isbn", "q.title", "q.author", "q.is_empty")
        .filter(~F.col("is_empty"))
        .drop("is_empty")
    )


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key; Spark limits every group before it is shuffled."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= n).drop("_n")


def find_candidates(
    queries: DataFrame, catalog: DataFrame, per_source: int = CANDIDATES_PER_SOURCE
) -> DataFrame:
    """Candidate rows (entity_id, candidate columns, similarity), at most ``per_source`` each.

    ``catalog`` has candidate_id, source, title, authors, isbn10, isbn13 and other fields.
    Entities with an ISBN are looked up by it; entities without one by title and, when they have
    an author, by at least one shared author word. A title search returns the records that have
    every word of the title, as the search of an external catalog does, and those whose word
    overlap (``similarity``) reaches the decision threshold.

    Titles are matched as distinct word lists, and a list keeps only its first ``per_source``
    candidates per author word before it is joined, so neither a title nor an identifier shared
    by a third of all rows multiplies the join. The limit is exact: it never removes a row that
    could be among an entity's first ``per_source``.
    """
    by_isbn = _isbn_candidates(queries.filter(F.col("isbn").isNotNull()), catalog, per_source)
    by_title = _title_candidates(queries.filter(F.col("isbn").isNull()), catalog, per_source)
    return by_isbn.unionByName(by_title)


def _isbn_candidates(queries: DataFrame, catalog: DataFrame, per_source: int) -> DataFrame:
    records = catalog.withColumn(
        "isbn", F.explode(F.array_compact(F.array("isbn13", "isbn10")))
    )
    bounded = first_per_group(records, ["isbn", "source"], [F.col("candidate_id")], per_source)
    return (
        queries.join(bounded.withColumnRenamed("title", "_title"), "isbn")
        .withColumn(
            "similarity",
            F.when(F.col("title").isNull(), 1.0).otherwise(
                similarity(F.col("title"), F.col("_title"))
            ),
        )
        .withColumn("title", F.col("_title"))
        .select("entity_id", *catalog.columns, "similarity")
    )


def _title_candidates(queries: DataFrame, catalog: DataFrame, per_source: int) -> DataFrame:
    # Entities that ask the same (title and author words) get the same answer, so only different questions are worked on.
    # Every question asks with each of its author words, or with "" when it has no author. Candidates
    # answer to each of their author words and to "". All candidates of one title are equally
    # similar, so the first few per (title, author word, source) hold every possible answer.
    asked = (
        queries.withColumn("left_words", title_words(F.col("title")))
        .filter(F.size("left_words") > 0)
        .select("entity_id", "left_words", tokens(F.coalesce("author", F.lit(""))).alias("author_words"))
        .distinct()
        .withColumn("_asks", F.count(F.lit(1)).over(Window.partitionBy("entity_id")))
    )
    asked = materialize(asked)
    words = F.when(F.size("author_words") > 0, F.col("author_words")).otherwise(F.array(F.lit("")))
    kinds = materialize(asked.select("left_words", "author_words").distinct())
    spoken = kinds.withColumn("author_word", F.explode(words))
    answers_to = F.array_append(tokens(F.coalesce(F.array_join("authors", " "), F.lit(""))), "")
    offered = (
        catalog.withColumn("right_words", title_words(F.col("title")))
        .filter(F.size("right_words") > 0)
        .withColumn("author_word", F.explode(answers_to))
    )
    # Each is read several times below.
    index = materialize(
        first_per_group(offered, ["right_words", "author_word", "source"], [F.col("candidate_id")], per_source)
    )
    questions = materialize(spoken.select("left_words", "author_word").distinct())
    titles = materialize(index.select(F.col("right_words").alias("words")).distinct())
    wanted = questions.select(F.col("left_words").alias("words")).distinct()
    # A title that is found both ways is left to the containment search.
    alike = similar_titles(wanted, titles, CONFIDENCE_THRESHOLD).filter(
        F.size(F.array_except("left_words", "right_words")) > 0
    )
    several = containing_titles(wanted.filter(F.size("words") > 1), titles)
    pairs = several.unionByName(alike)
    best_first = [F.col("similarity").desc(), F.col("candidate_id")]
    # A word by itself may stand in any share of the titles. The first few records of each word, shortest title first,
    # are all that a title of one word can be answered with.
    by_word = first_per_group(
        index.withColumn("word", F.explode("right_words")).withColumn("similarity", 1 / F.size("right_words")),
        ["word", "author_word", "source"],
        best_first,
        per_source,
    )
    single = (
        questions.filter(F.size("left_words") == 1)
        .withColumn("word", F.col("left_words")[0])
        .join(by_word, ["word", "author_word"])
        .drop("word")
    )
    met = questions.join(pairs, "left_words").join(index, ["right_words", "author_word"])
    answers = first_per_group(
        met.unionByName(single), ["left_words", "author_word", "source"], best_first, per_source
    ).drop("right_words")
    kind = ["left_words", "author_words"]
    offers = (
        spoken.join(answers, ["left_words", "author_word"])
        .select(*kind, *catalog.columns, "similarity")
        .dropDuplicates([*kind, "source", "candidate_id"])
    )
    offers = materialize(first_per_group(offers, [*kind, "source"], best_first, per_source))
    found = asked.join(offers, kind).select("entity_id", *catalog.columns, "similarity", "_asks")
    # Only an id that stands for several questions has more offers than it may keep, or one of them twice.
    several = found.filter(F.col("_asks") > 1).dropDuplicates(["entity_id", "source", "candidate_id"])
    several = first_per_group(several, ["entity_id", "source"], best_first, per_source)
    return found.filter(F.col("_asks") == 1).unionByName(several).drop("_asks")


def first_answering_source(candidates: DataFrame, order: list[str]) -> DataFrame:
    """Candidates of the first source in ``order`` that returned any; sources are not blended.

    ``candidates`` may hold error rows (``error`` set); they are no candidates. Candidates are at
    most ``CANDIDATES_PER_SOURCE`` per source, so a window per entity is small.
    """
    ranked = candidates.withColumn("source_rank", source_rank(F.col("source"), order)).filter(
        F.col("source_rank").isNotNull() & F.col("error").isNull()
    )
    best = F.min("source_rank").over(Window.partitionBy("entity_id"))
    return ranked.withColumn("_best", best).filter(F.col("source_rank") == F.col("_best")).drop("_best")


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """Add ``rank`` (1 is best) and ``margin`` to the next candidate of the entity."""
    window = Window.partitionBy("entity_id").orderBy(F.col("similarity").desc(), "candidate_id")
    following = F.coalesce(F.lead("similarity").over(window), F.lit(0.0))
    return candidates.withColumn("rank", F.row_number().over(window)).withColumn(
        "margin", F.col("similarity") - following
    )


def decide(
    queries: DataFrame,
    candidates: DataFrame,
    order: list[str] = DEFAULT_PROVIDER_ORDER,
    threshold: float = CONFIDENCE_THRESHOLD,
    margin: float = CONFIDENCE_MARGIN,
) -> DataFrame:
    """(entity_id, outcome, candidate_id, source, similarity, n_candidates) per queried entity.

    applied: the best candidate is similar enough and either alone, clearly ahead, or found by
    identifier. needs_confirmation: candidates, but none of them sure. failed: only errors.
    """
    ranked = rank_candidates(first_answering_source(candidates, order))
    best = ranked.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.min_by(F.struct("candidate_id", "source", "similarity", "margin"), "rank").alias("top"),
    )
    errors = candidates.groupBy("entity_id").agg(F.bool_or(F.col("error").isNotNull()).alias("erred"))
    sure = (F.col("top.similarity") >= threshold) & (
        (F.col("n_candidates") == 1) | (F.col("top.margin") >= margin) | F.col("isbn").isNotNull()
    )
    outcome = (
        F.when(sure, "applied")
        .when(F.col("n_candidates") > 0, "needs_confirmation")
        .when(F.col("erred"), "failed")
        .otherwise("no_match")
    )
    return (
        queries.join(best, "entity_id", "left")
        .join(errors, "entity_id", "left")
        .select(
            "entity_id",
            outcome.alias("outcome"),
            "top.candidate_id",
            "top.source",
            "top.similarity",
            F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"),
        )
    )


def outcome_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def apply_candidates(
    entities: DataFrame,
    chosen: DataFrame,
    manual_fields: DataFrame,
    policy: str = "fill_empty",
    now: Column | None = None,
) -> DataFrame:
    """Entities with the chosen candidate applied; ``changed`` names the fields that were set.

    ``chosen`` has one row per entity (entity_id, candidate columns). ``fill_empty`` sets empty
    fields only; ``overwrite`` sets every field the candidate has. Fields set by a person are
    never touched. Title and authors count as changed only when they differ.
    """
    if policy not in ("fill_empty", "overwrite"):
        raise ValueError(f"unknown policy {policy!r}")
    overwrite = F.lit(policy == "overwrite")
    offered = [c for c in ("title", "authors", "source", *CANDIDATE_FIELDS) if c in chosen.columns]
    new = chosen.select(F.col("entity_id").alias("id"), *[F.col(c).alias(f"new_{c}") for c in offered])
    joined = entities.join(new, "id", "left").join(manual_fields, "id", "left")
    free = lambda f: ~F.coalesce(F.array_contains("manual_fields", f), F.lit(False))

    sets = {}
    if "title" in offered:
        sets["title"] = (
            F.col("new_title").isNotNull()
            & (overwrite | (F.col("title") == ""))
            & (F.col("title") != F.col("new_title"))
        )
    if "authors" in offered:
        sets["authors"] = (
            has_items(F.col("new_authors"))
            & (overwrite | ~has_items(F.col("authors")))
            & ~F.col("authors").eqNullSafe(F.col("new_authors"))
        )
    for f in CANDIDATE_FIELDS:
        if f in offered:
            sets[f] = F.col(f"new_{f}").isNotNull() & (overwrite | F.col(f).isNull())
    sets = {f: free(f) & condition for f, condition in sets.items()}
    result = joined.withColumn(
        "changed", F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in sets.items()]))
    ).withColumn("changed_source", F.when(F.size("changed") > 0, F.col("new_source")))
    touched = F.size("changed") > 0
    result = result.withColumns(
        {
            f: F.when(F.array_contains("changed", f), F.col(f"new_{f}")).otherwise(F.col(f))
            for f in sets
        }
    ).drop(*[f"new_{c}" for c in offered], "manual_fields")
    derived = {
        "title_sort": F.when(
            F.array_contains("changed", "title"), title_sort_key(F.col("title"))
        ).otherwise(F.col("title_sort")),
        "author_sort": F.when(
            F.array_contains("changed", "authors"), author_sort_key(F.col("authors"))
        ).otherwise(F.col("author_sort")),
        "metadata_status": F.when(touched, status_column()).otherwise(F.col("metadata_status")),
        "updated_at": F.when(touched, F.current_timestamp() if now is None else now).otherwise(
            F.col("updated_at")
        ),
    }
    return result.withColumns({c: v for c, v in derived.items() if c in entities.columns})


def applied_provenance(applied: DataFrame, now: Column | None = None) -> DataFrame:
    """Provenance records of ``apply_candidates``: one for every field that it set."""
    touched = applied.select("id", F.col("changed").alias("fields"), "changed_source")
    return as_records(
        touched, F.col("changed_source"), F.current_timestamp() if now is None else now
    )


def apply_decisions(
    entities: DataFrame,
    decisions: DataFrame,
    candidates: DataFrame,
    manual_fields: DataFrame,
    policy: str = "fill_empty",
    now: Column | None = None,
) -> DataFrame:
    """``apply_candidates`` with the candidates a person chose from the review queue.

    ``decisions`` has entity_id and candidate_id; a null candidate_id is a rejection and changes
    nothing, nor does a candidate that was never offered to the entity. Of several decisions on one
    entity the one with the largest candidate_id counts.
    """
    chosen = (
        decisions.filter(F.col("candidate_id").isNotNull())
        .groupBy("entity_id")
        .agg(F.max("candidate_id").alias("candidate_id"))
    )
    offered = candidates.filter(F.col("error").isNull()).dropDuplicates(["entity_id", "candidate_id"])
    rows = offered.drop("error").join(chosen, ["entity_id", "candidate_id"], "left_semi")
    return apply_candidates(entities, rows, manual_fields, policy, now)


def review_queue(
    entities: DataFrame, decisions: DataFrame, candidates: DataFrame, order: list[str] = DEFAULT_PROVIDER_ORDER
) -> DataFrame:
    """Entities that need confirmation, one row per candidate in rank order, beside local values."""
    open_ = decisions.filter(F.col("outcome") == "needs_confirmation").select("entity_id")
    ranked = rank_candidates(
        first_answering_source(candidates.join(open_, "entity_id", "left_semi"), order)
    )
    local = entities.select(
        F.col("id").alias("entity_id"),
        F.col("title").alias("local_title"),
        F.col("authors").alias("local_authors"),
    )
    return ranked.join(local, "entity_id").withColumn(
        "similarity_percent", F.round(F.col("similarity") * 100).cast("int")
    )
