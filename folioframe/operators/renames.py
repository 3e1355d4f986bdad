"""Plan collision-free names, journal them, and undo a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import text as X
from folioframe.functions.naming import counted, render, suffix, token_values, trim_to_bytes, with_legal_name
from folioframe.operators.ranking import number_rows, rank_in_group
from folioframe.schemas import DEFAULT_TEMPLATE, NAME_BYTES
from folioframe.session import materialize

# A counter takes at most this many bytes; a name with less room than that may be cut for one.
_COUNTER_BYTES = 22
_SLOT_BLOCK = 100_000
# Counters have at most this many digits.
_COUNTER_DIGITS = 9


def rendered_names(
    entities: DataFrame, members: DataFrame, template: str = DEFAULT_TEMPLATE
) -> DataFrame:
    """Members with ``proposed`` name and the ``tokens`` the template misses."""
    entity = entities.select(
        F.col("id").alias("book_id"), "title", "authors", "year", "series", "series_index",
        "isbn13", "isbn10", "language", "publisher",
    )
    ext = X.extension(F.col("path"))
    values = token_values(
        *[
            F.col(c)
            for c in (
                "title", "authors", "year", "series", "series_index", "isbn13", "isbn10",
                "language", "publisher",
            )
        ],
        ext=ext,
    )
    text, missing = render(template, values)
    rows = members.join(entity, "book_id").select(
        F.col("id").alias("file_id"),
        "book_id",
        "title",
        F.col("path").alias("current_path"),
        X.directory(F.col("path")).alias("dir"),
        X.filename(F.col("path")).alias("current_name"),
        F.coalesce("missing", F.lit(False)).alias("missing"),
        missing.alias("tokens"),
        text.alias("_text"),
        ext.alias("_ext"),
    )
    return with_legal_name(rows, F.col("_text"), F.col("_ext"), "proposed").drop("_text", "_ext")


def plan_renames(
    entities: DataFrame,
    members: DataFrame,
    listing: DataFrame,
    template: str = DEFAULT_TEMPLATE,
) -> DataFrame:
    """Rename plan (file_id, book_id, title, current_path, proposed_name, status, reason, included).

    ``listing`` names every file that is present. Files are named in path order inside their
    directory, case-insensitively: a taken name gets `` (2)``, `` (3)`` and so on. Names that stay
    where they are (nothing to do, excluded, or a change of case only) count as taken.
    """
    named = rendered_names(entities, members, template)
    same_key = F.lower("proposed") == F.lower("current_name")
    tokens = F.array_join(F.transform("tokens", lambda t: F.concat(F.lit("{"), t, F.lit("}"))), ", ")
    # Names are read by several joins below; render them once.
    status = (
        F.when(F.col("missing") | (F.size("tokens") > 0), "excluded")
        .when(same_key & (F.col("proposed") == F.col("current_name")), "no_op")
        .when(same_key, "ready")
        .otherwise("move")
    )
    reason = F.when(F.col("missing"), "File is missing on disk").when(
        F.size("tokens") > 0, F.concat(F.lit("Missing value for "), tokens)
    )
    named = materialize(named.withColumns({"status": status, "reason": reason}).drop("tokens"))
    stays = named.filter(F.col("status") != "move")
    moves = named.filter(F.col("status") == "move")
    assigned = assign_names(moves, occupied_names(listing, moves, stays))
    plan = ["file_id", "book_id", "title", "current_path", "proposed_name", "status", "reason"]
    kept_name = F.when(F.col("status") == "excluded", F.col("current_name")).otherwise(F.col("proposed"))
    rows = stays.withColumn("proposed_name", kept_name).select(*plan)
    status = F.when(F.col("proposed_name") == F.col("proposed"), "ready").otherwise("collision")
    moved = assigned.withColumn("status", status).select(*plan)
    return rows.unionByName(moved).withColumn(
        "included", F.col("status").isin("ready", "collision")
    )


def occupied_names(listing: DataFrame, moves: DataFrame, stays: DataFrame) -> DataFrame:
    """(dir, taken): lower-case names present in a directory that do not move away."""
    path = F.col("path")
    present = listing.select(X.directory(path).alias("dir"), F.lower(X.filename(path)).alias("taken"))
    leaving = moves.select("dir", F.lower("current_name").alias("taken"))
    staying = stays.filter(~F.col("missing")).select("dir", F.lower("current_name").alias("taken"))
    return present.join(leaving, ["dir", "taken"], "left_anti").union(staying).distinct()


def _with_family(df: DataFrame, name: str) -> DataFrame:
    """Add ``family``: names that can get in each other's way have one family.

    A family is a name without its counters, cut to the room that the longest counter leaves. What
    a name is cut to for a shorter counter is a longer run of the same graphemes, so it is cut to
    the same family; what the cut may leave of a counter is dropped.
    """
    parts = df.withColumns({"_stem": X.stem(F.col(name)), "_suffix": suffix(F.col(name))})
    room = F.lit(NAME_BYTES - _COUNTER_BYTES) - F.octet_length("_suffix")
    uncounted = F.regexp_replace(trim_to_bytes(F.col("_stem"), room), r"[ ()0-9]+$", "")
    return parts.withColumn("family", F.concat(uncounted, F.lit("/"), "_suffix")).drop("_stem", "_suffix")


def _may_be_cut(name: str) -> Column:
    return F.octet_length(name) > NAME_BYTES - _COUNTER_BYTES


def _with_parent(df: DataFrame, name: str, text: str = "_text") -> DataFrame:
    """Add ``parent``, ``slot`` and the ``text`` before them of names that are a counter; drop the others."""
    pattern = r"^(.*) \(([1-9][0-9]{0,8})\)$"
    parts = df.withColumns({"_stem": X.stem(F.col(name)), "_suffix": suffix(F.col(name))})
    return (
        parts.withColumn(text, F.regexp_extract("_stem", pattern, 1))
        .withColumns(
            {
                "parent": F.concat(F.col(text), F.col("_suffix")),
                "slot": F.regexp_extract("_stem", pattern, 2).try_cast("long"),
            }
        )
        .filter(F.col("slot") >= 2)
        .drop("_stem", "_suffix")
    )


def assign_names(moves: DataFrame, occupied: DataFrame) -> DataFrame:
    """Add ``proposed_name``: the proposed name, or its first free counter in path order.

    A name and its counters are slots: slot 1 is the name, slot k its counter k. The i-th file of a
    name takes the i-th slot that nothing blocks, so all that is needed are ranks and the blocked
    slots: those of names that are present, and those that another proposed name gets first.
    """
    moves = materialize(_with_family(moves.withColumn("base", F.lower("proposed")), "base"))
    taken = materialize(_with_family(occupied, "taken"))
    columns = [*[c for c in moves.columns if c not in ("base", "family")], "proposed_name"]
    bases = materialize(
        moves.groupBy("dir", "family", "base").agg(
            F.min("current_path").alias("first_path"), F.count(F.lit(1)).alias("files")
        )
    )
    # Different long names can be cut to the same text, and so can names that pile up counters;
    # such families share pools of counters.
    key = ["dir", "family"]
    several = (
        bases.groupBy(*key)
        .agg(F.min("base").alias("low"), F.max("base").alias("high"), F.bool_or(_may_be_cut("base")).alias("cut"))
        .filter(F.col("cut") & (F.col("low") != F.col("high")))
        .select(*key, F.lit(True).alias("several"))
    )
    in_order = not several.isEmpty()
    simple = bases
    if in_order:
        simple = bases.join(several, key, "left_anti")
    present = _present_slots(taken, simple)
    contests = _contests(simple)
    if contests.isEmpty():
        blocked = present
    else:
        blocked = _resolve_contests(moves, materialize(contests), materialize(present))
    blocked = materialize(blocked.join(simple.select("dir", "base", "files"), ["dir", "base"]))
    if not in_order:
        return _take_slots(moves, blocked).select(*columns)
    marked = moves.join(several, key, "left")
    return (
        _take_slots(marked.filter(F.col("several").isNull()), blocked)
        .select(*columns)
        .unionByName(
            _share_counters(marked.filter("several"), taken.join(several, key, "left_semi")).select(*columns)
        )
    )


def _present_slots(taken: DataFrame, bases: DataFrame) -> DataFrame:
    """(dir, base, slot): slots of proposed names that are blocked by names that are present."""
    names = bases.select("dir", "base")
    same = taken.withColumnRenamed("taken", "base").join(names, ["dir", "base"], "left_semi")
    counters = _with_parent(taken, "taken").withColumnRenamed("parent", "base")
    # A name that may be cut is the only one of its family; its counters are cut forms of it.
    cut = (
        taken.join(bases.filter(_may_be_cut("base")).select("dir", "family", "base"), ["dir", "family"])
        .filter(F.col("taken") != F.col("base"))
        .withColumns(
            {
                "slot": F.regexp_extract(X.stem(F.col("taken")), r" \(([1-9][0-9]{0,8})\)$", 1).try_cast("long"),
                "_stem": X.stem(F.col("base")),
                "_suffix": suffix(F.col("base")),
            }
        )
        .filter(F.col("slot") >= 2)
        .filter(F.lower(counted(F.col("_stem"), F.col("_suffix"), F.col("slot"))) == F.col("taken"))
    )
    slots = ["dir", "base", "slot"]
    return (
        same.withColumn("slot", F.lit(1).cast("long"))
        .select(*slots)
        .unionByName(counters.select(*slots).join(names, ["dir", "base"], "left_semi"))
        .unionByName(cut.select(*slots))
        .distinct()
    )


def _contests(bases: DataFrame) -> DataFrame:
    """(dir, base, slot, child, first_path): proposed names that are a counter of another one."""
    children = _with_parent(bases, "base").select(
        "dir", "parent", "slot", F.col("base").alias("child"), "first_path"
    )
    return children.join(
        bases.select("dir", F.col("base").alias("parent")), ["dir", "parent"]
    ).withColumnRenamed("parent", "base")


def _resolve_contests(moves: DataFrame, contests: DataFrame, present: DataFrame) -> DataFrame:
    """Blocked slots (dir, base, slot) when proposed names compete for a slot.

    The slot goes to the first file of its own name or to the file of the parent name that gets
    there, whichever has the smaller path. What a parent gets depends on its own slot, so names are
    settled level by level from the outside in. Per contested slot one number is needed: how many
    files of the parent come before the first file of the name itself.
    """
    key = ["dir", "base"]
    marks = contests.select(*key, "slot", F.col("first_path").alias("current_path"))
    before = _files_before(moves.join(contests.select(*key).distinct(), key, "left_semi"), marks)
    fixed = present.select(*key, "slot", F.lit(-1).cast("long").alias("before"))
    open_ = materialize(
        contests.join(present, [*key, "slot"], "left_anti")
        .join(before, [*key, "slot"])
        .select(*key, "slot", "before", "child")
    )
    blocked = [present]
    parents = contests.select(*key).distinct()
    level = parents.join(contests.select("dir", F.col("child").alias("base")), key, "left_anti")
    own_taken = present.limit(0)
    while not level.isEmpty():
        rows = (
            open_.drop("child")
            .unionByName(fixed.unionByName(own_taken.withColumn("before", F.lit(-1).cast("long"))).distinct())
            .join(level, key, "left_semi")
        )
        settled = materialize(_settle(rows))
        lost = settled.filter("lost").select(*key, "slot")
        won = (
            settled.filter(~F.col("lost"))
            .join(open_, [*key, "slot"])
            .select("dir", F.col("child").alias("base"), F.lit(1).cast("long").alias("slot"))
        )
        blocked += [lost, won]
        own_taken = won
        level = materialize(
            contests.join(level, key, "left_semi")
            .select("dir", F.col("child").alias("base"))
            .distinct()
            .join(parents, key, "left_semi")
        )
    out = blocked[0]
    for part in blocked[1:]:
        out = out.unionByName(part)
    return out.distinct()


def _files_before(files: DataFrame, marks: DataFrame) -> DataFrame:
    """(dir, base, slot, before): how many files of a name come before the path of each mark."""
    key = ["dir", "base"]
    together = files.select(*key, "current_path", F.lit(None).cast("long").alias("slot")).unionByName(marks)
    among_all = rank_in_group(together, key, ["current_path"], "n").filter(F.col("slot").isNotNull())
    among_marks = rank_in_group(marks, key, ["current_path"], "m")
    return among_all.join(among_marks.select(*key, "slot", "m"), [*key, "slot"]).select(
        *key, "slot", (F.col("n") - F.col("m")).alias("before")
    )


def _settle(rows: DataFrame) -> DataFrame:
    """(dir, base, slot, before) -> (dir, base, slot, lost): slots a name cannot have.

    Slots are passed in order with a running count of the lost ones; rows stream through, and only
    that count is kept. ``before`` is -1 for slots that are taken anyway.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, missed = None, 0
        for batch in batches:
            lost = []
            for row in batch.itertuples(index=False):
                if current != (row.dir, row.base):
                    current, missed = (row.dir, row.base), 0
                gone = row.before < 0 or row.slot - missed > row.before
                missed += gone
                lost.append(gone)
            yield batch[["dir", "base", "slot"]].assign(lost=lost)

    return (
        rows.repartition("dir", "base")
        .sortWithinPartitions("dir", "base", "slot")
        .mapInPandas(scan, "dir STRING, base STRING, slot BIGINT, lost BOOLEAN")
    )


def _take_slots(moves: DataFrame, blocked: DataFrame) -> DataFrame:
    """The i-th file of a name takes its i-th slot outside ``blocked`` (dir, base, slot, files)."""
    ranked = rank_in_group(moves, ["dir", "base"], ["current_path"], "rank")
    ranked = ranked.withColumns({"_stem": X.stem(F.col("proposed")), "_suffix": suffix(F.col("proposed"))})
    return _place(_nth_free(ranked, blocked))


def _nth_free(ranked: DataFrame, blocked: DataFrame) -> DataFrame:
    """Add ``_slot``: the ``rank``-th slot outside ``blocked`` (dir, base, slot, files)."""
    key = ["dir", "base"]
    if blocked.isEmpty():
        return ranked.withColumn("_slot", F.col("rank"))
    # Slots past files + blocked ones are never reached. They are generated in blocks, so that a
    # name with very many files is spread over tasks.
    reach = blocked.groupBy(*key).agg((F.max("files") + F.count(F.lit(1))).alias("last"))
    blocks = reach.select(
        *key,
        "last",
        F.explode(F.sequence(F.lit(0), F.floor((F.col("last") - 1) / _SLOT_BLOCK))).alias("block"),
    ).repartition(*key, "block")
    first = F.col("block") * _SLOT_BLOCK + 1
    slots = blocks.select(
        *key, F.explode(F.sequence(first, F.least("last", first + _SLOT_BLOCK - 1))).alias("slot")
    ).join(blocked.select(*key, "slot"), [*key, "slot"], "left_anti")
    free = rank_in_group(slots, key, ["slot"], "rank")
    placed = ranked.join(free, [*key, "rank"], "left")
    return placed.withColumn("_slot", F.coalesce("slot", "rank"))


def _place(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn(
        "proposed_name",
        F.when(F.col("_slot") == 1, F.col("proposed")).otherwise(
            counted(F.col("_stem"), F.col("_suffix"), F.col("_slot"))
        ),
    )


def _share_counters(moves: DataFrame, taken: DataFrame) -> DataFrame:
    """Name the files of families whose long names are cut to the same text.

    Files whose names are cut alike for a counter of so many digits draw from one pool of names, in path
    order; who finds it used up goes on to the pool with one digit more. The first file of a name keeps
    the name itself, unless a pool gets there with an earlier file: then that file draws, too, and all
    is drawn again. A name once lost stays lost, so rounds end; without names that are counters of
    others there is one.
    """
    key, file = ["dir", "base"], ["dir", "current_path"]
    free = taken.select("dir", F.col("taken").alias("base"))
    first = materialize(
        moves.groupBy(*key).agg(F.min("current_path").alias("current_path")).join(free, key, "left_anti")
    )
    present = materialize(_as_counters(taken, "taken").select(*key, "digits", "slot").distinct())
    contested = materialize(
        _as_counters(first.withColumnRenamed("base", "child"), "child").select(
            *key, "digits", "slot", "child", "current_path"
        )
    )
    lost = first.select(*key).limit(0)
    while True:
        kept = first.join(lost, key, "left_anti")
        rivals = contested.join(lost.withColumnRenamed("base", "child"), ["dir", "child"], "left_anti")
        waiting = moves.select(*file, "proposed").join(kept, file, "left_anti")
        decided = moves.select(*file, "proposed").join(kept.select(*file), file, "left_semi")
        decided, beaten = decided.withColumn("proposed_name", F.col("proposed")), lost.limit(0)
        for digits in range(1, _COUNTER_DIGITS + 1):
            drawing = materialize(_in_pools(waiting, digits))
            if drawing.isEmpty():
                break
            of_pool = F.col("digits") == digits
            drawn, won = _draw(drawing, present.filter(of_pool), rivals.filter(of_pool), digits)
            decided = decided.unionByName(drawn.filter(F.col("proposed_name").isNotNull()))
            beaten = beaten.unionByName(won)
            waiting = drawn.filter(F.col("proposed_name").isNull()).drop("proposed_name")
        beaten = materialize(beaten)
        if beaten.isEmpty():
            return moves.join(decided.drop("proposed"), file)
        lost = materialize(lost.unionByName(beaten))


def _in_pools(files: DataFrame, digits: int) -> DataFrame:
    """Add ``base``: the pool of a file, as the lower-case name with its least counter of ``digits`` digits."""
    stem, end = X.stem(F.col("proposed")), suffix(F.col("proposed"))
    return files.withColumns({"_stem": stem, "_suffix": end}).select(
        "dir",
        "current_path",
        "proposed",
        F.lower(counted(F.col("_stem"), F.col("_suffix"), F.lit(10 ** (digits - 1)))).alias("base"),
    )


def _as_counters(df: DataFrame, name: str) -> DataFrame:
    """Names that are a counter, with the pool that holds them: (base, digits, slot); drops the others."""
    return _with_parent(df, name, "_text").withColumns(
        {
            "digits": F.length(F.col("slot").cast("string")),
            "base": F.concat(
                "_text", F.lit(" (1"), F.repeat(F.lit("0"), F.col("digits") - 1), F.lit(")"), suffix(F.col(name))
            ),
        }
    )


def _draw(
    drawing: DataFrame, present: DataFrame, rivals: DataFrame, digits: int
) -> tuple[DataFrame, DataFrame]:
    """Files with ``proposed_name`` (null where the pool is used up), and the names that pools win.

    Slots are counted from the least counter of so many digits; 1 is no counter.
    """
    key = ["dir", "base"]
    least = max(2, 10 ** (digits - 1))
    from_one = F.col("slot") - (least - 1)
    pools = drawing.groupBy(*key).agg(F.count(F.lit(1)).alias("files"))
    fixed = present.join(pools, key, "left_semi").select(
        *key, from_one.alias("slot"), F.lit(-1).cast("long").alias("before")
    )
    rivals = materialize(
        rivals.join(pools, key, "left_semi").select(*key, from_one.alias("slot"), "child", "current_path")
    )
    marks = fixed
    if not rivals.isEmpty():
        marks = fixed.unionByName(_files_before(drawing, rivals.select(*key, "slot", "current_path")))
    settled = materialize(_settle(marks))
    won = (
        settled.filter(~F.col("lost")).join(rivals, [*key, "slot"]).select("dir", F.col("child").alias("base"))
    )
    blocked = materialize(settled.filter("lost").select(*key, "slot").join(pools, key))
    placed = _nth_free(rank_in_group(drawing, key, ["current_path"], "rank"), blocked)
    placed = placed.withColumns({"_stem": X.stem(F.col("proposed")), "_suffix": suffix(F.col("proposed"))})
    name = counted(F.col("_stem"), F.col("_suffix"), F.col("_slot") + (least - 1))
    return placed.select(
        "dir",
        "current_path",
        "proposed",
        F.when(F.col("_slot") <= 10**digits - least, name).alias("proposed_name"),
    ), won


def plan_summary(plan: DataFrame) -> DataFrame:
    """Rows per status and reason."""
    return plan.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))


def actionable(plan: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Rows that will be applied; ``excluded`` (file_id) takes rows out by hand."""
    rows = plan.filter(F.col("included") & F.col("status").isin("ready", "collision"))
    return rows if excluded is None else rows.join(excluded.select("file_id"), "file_id", "left_anti")


def recheck_plan(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """Name the rows again whose target has been taken since the plan was made."""
    path = F.col("path")
    present = listing.select(X.directory(path).alias("dir"), F.lower(X.filename(path)).alias("taken")).distinct()
    keyed = rows.withColumn("dir", X.directory(F.col("current_path"))).withColumn(
        "taken", F.lower("proposed_name")
    )
    leaving = keyed.select("dir", F.lower(X.filename(F.col("current_path"))).alias("taken"))
    now_taken = present.join(leaving, ["dir", "taken"], "left_anti")
    # The other rows of the batch keep their names, so these are taken as well.
    stale = keyed.join(now_taken, ["dir", "taken"], "left_semi").select("file_id")
    kept = keyed.join(stale, "file_id", "left_anti")
    again = keyed.join(stale, "file_id", "left_semi")
    renamed = assign_names(
        again.select(
            "file_id", "dir", "current_path", F.col("proposed_name").alias("proposed")
        ),
        now_taken.unionByName(kept.select("dir", "taken")).distinct(),
    ).select("file_id", "proposed_name")
    fresh = (
        again.drop("proposed_name")
        .join(renamed, "file_id")
        .withColumn("status", F.lit("collision"))
    )
    return kept.select(*rows.columns).unionByName(fresh.select(*rows.columns))


def target_path() -> Column:
    """Path of a plan row after the rename."""
    name = F.col("proposed_name")
    has_dir = F.col("current_path").contains("/")
    return F.when(has_dir, F.concat_ws("/", X.directory(F.col("current_path")), name)).otherwise(name)


def apply_plan(
    members: DataFrame,
    journal: DataFrame,
    rows: DataFrame,
    batch_id: str,
    now: Column,
) -> tuple[DataFrame, DataFrame]:
    """(members, journal) after the actionable ``rows`` of a plan; no file is moved here."""
    moves = rows.select("file_id", F.col("current_path").alias("old_path"), target_path().alias("new_path"))
    moved = (
        members.join(moves.select(F.col("file_id").alias("id"), "new_path"), "id", "left")
        .withColumn("path", F.coalesce("new_path", "path"))
        .select(*members.columns)
    )
    last = journal.agg(F.max("id")).first()[0] or 0
    entries = number_rows(moves, ["old_path"], "id", start=last).withColumns(
        {"batch_id": F.lit(batch_id), "executed_at": now, "reverted": F.lit(False)}
    )
    return moved, journal.unionByName(entries.select(*journal.columns))


def open_batches(journal: DataFrame) -> DataFrame:
    """Batches that can be undone: (batch_id, executed_at, last_id, file_count)."""
    return (
        journal.filter(~F.col("reverted"))
        .groupBy("batch_id")
        .agg(
            F.max(F.struct("executed_at", "id")).alias("last"),
            F.count(F.lit(1)).alias("file_count"),
        )
        .select("batch_id", "last.executed_at", F.col("last.id").alias("last_id"), "file_count")
    )


def last_batch(journal: DataFrame) -> DataFrame:
    """The batch an undo would revert: the latest by time, then by journal id."""
    return open_batches(journal).orderBy(F.col("executed_at").desc(), F.col("last_id").desc()).limit(1)


def undo_targets(journal: DataFrame) -> DataFrame:
    """(file_id, old_path, new_path) of the last batch, chains of renames collapsed per file."""
    batch = F.broadcast(last_batch(journal).select("batch_id"))  # exactly one row or none
    return (
        journal.filter(~F.col("reverted"))
        .join(batch, "batch_id")
        .groupBy("file_id")
        .agg(F.min_by("old_path", "id").alias("old_path"), F.max_by("new_path", "id").alias("new_path"))
    )


def undo_last_batch(members: DataFrame, journal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, journal) with the last open batch reverted; a second undo takes the one before."""
    targets = undo_targets(journal).select(F.col("file_id").alias("id"), "old_path")
    restored = (
        members.join(targets, "id", "left")
        .withColumn("path", F.coalesce("old_path", "path"))
        .select(*members.columns)
    )
    batch = F.broadcast(last_batch(journal).select("batch_id", F.lit(True).alias("_undone")))
    flagged = (
        journal.join(batch, "batch_id", "left")
        .withColumn("reverted", F.col("reverted") | F.coalesce("_undone", F.lit(False)))
        .select(*journal.columns)
    )
    return restored, flagged
