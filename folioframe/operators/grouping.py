"""Resolve member records to entities with identifier, metadata, file-name and manual evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.identifiers import isbn_is_plausible
from folioframe.functions.text import stem_key
from folioframe.operators.components import connected_components
from folioframe.session import discard, materialize


def identity(
    path: Column,
    format: Column,
    stem: Column,
    isbn: Column,
    title_key: Column,
    author_key: Column,
    manual_group_id: Column,
) -> list[Column]:
    """Columns of an identity row: implausible identifiers and empty keys count as absent."""
    return [
        path.alias("path"),
        format.alias("format"),
        stem.alias("stem"),
        F.when(isbn_is_plausible(isbn), isbn).alias("isbn"),
        F.nullif(title_key, F.lit("")).alias("title_key"),
        F.nullif(author_key, F.lit("")).alias("author_key"),
        manual_group_id.alias("manual_group_id"),
    ]


def _node(kind: str, text: Column) -> Column:
    """A 128-bit digest stands for a key of any length; null stays null."""
    return F.unhex(F.md5(F.concat(F.lit(kind + ":"), text)))


def stem_conflicts(identities: DataFrame) -> DataFrame:
    """Stem keys under which more than one known author appears."""
    return (
        identities.groupBy("stem_key")
        .agg(F.min("author_key").alias("a"), F.max("author_key").alias("b"))
        .filter(F.col("a") != F.col("b"))
        .select("stem_key", F.lit(True).alias("conflict"))
    )


def member_keys(identities: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(path, token, isbn_node, meta_node, stem_node): the evidence each member carries.

    Members with a manual token carry only that. In a stem with conflicting authors the author is
    part of the key, and members without an author share one key of their own. ``carry`` names
    further columns to keep.
    """
    automatic = F.col("manual_group_id").isNull()
    keyed = identities.withColumn("stem_key", F.nullif(stem_key(F.col("stem")), F.lit("")))
    conflicts = stem_conflicts(keyed.filter(automatic & F.col("stem_key").isNotNull()))
    stem_part = F.when(
        F.col("conflict"),
        F.concat_ws("/", F.lit("split"), "stem_key", F.coalesce("author_key", F.lit(""))),
    ).otherwise(F.concat_ws("/", F.lit("whole"), "stem_key"))
    return keyed.join(conflicts, "stem_key", "left").select(
        "path",
        F.col("manual_group_id").alias("token"),
        F.when(automatic, _node("isbn", F.col("isbn"))).alias("isbn_node"),
        F.when(
            automatic, _node("meta", F.concat("title_key", F.lit("::"), "author_key"))
        ).alias("meta_node"),
        F.when(automatic & F.col("stem_key").isNotNull(), _node("stem", stem_part)).alias(
            "stem_node"
        ),
        *carry,
    )


def _link(members: DataFrame, first: str, second: str, out: str) -> DataFrame:
    """Add ``out``: the component of the member's first key, else of its second, else null.

    Returns a new table in place of ``members``.
    """
    edges = (
        members.filter(F.col(first).isNotNull() & F.col(second).isNotNull())
        .select(first, second)
        .distinct()
    )
    components = connected_components(edges)
    linked = materialize(
        members.withColumn("_key", F.coalesce(first, second))
        .join(components.withColumnRenamed("node", "_key"), "_key", "left")
        .withColumn(out, F.coalesce("component", "_key"))
        .drop("_key", "component")
    )
    discard(components)
    discard(members)
    return linked


def resolve_groups(identities: DataFrame) -> DataFrame:
    """(path, component, method): the logical entity of every member.

    ``component`` is the smallest path of the entity. Keys, not members, are the graph: an edge
    links two keys that one member carries, so a key shared by a third of all members is one node.
    The identifier stage needs no graph; the metadata stage links identifier and metadata keys;
    the file-name stage links the resulting components with stem keys.

    ``method`` is the weakest evidence that was needed: more than one metadata-stage component
    inside an entity means file names joined it, more than one identifier-stage component means
    metadata did.
    """
    return _resolve(materialize(member_keys(identities)))


def resolve_touched(identities: DataFrame) -> DataFrame:
    """``resolve_groups`` of those members alone whose entity may become another one.

    ``identities`` has two columns more: ``owner``, the entity a member belongs to (null: none yet), and ``changed``,
    true if what the member says of itself is new. An entity is touched if one of its members is new or changed, or holds
    a key that such a member or a member of another entity holds as well. All keys of any other entity are its own, so a
    full run would give its members to it again: one aggregate over keys decides that, without any graph, whatever has
    been done to the catalog since it was last resolved. Members of touched entities are resolved whole, with the author
    conflicts of all members.
    """
    keys = materialize(member_keys(identities, ("owner", "changed")))
    nodes = F.array_compact(F.array(_node("token", F.col("token")), "isbn_node", "meta_node", "stem_node"))
    # One row per key and owner: a key that a third of all members hold is reduced before the shuffle.
    held = (
        keys.select("owner", "changed", F.explode(nodes).alias("key"))
        .groupBy("key", "owner")
        .agg(F.bool_or("changed").alias("changed"))
    )
    contested = (
        held.groupBy("key")
        .agg(F.bool_or("changed").alias("changed"), F.min("owner").alias("a"), F.max("owner").alias("b"))
        .filter(F.col("changed") | (F.col("a") != F.col("b")))
    )
    owners = (
        held.join(contested.select("key"), "key", "left_semi")
        .select("owner")
        .unionByName(keys.filter("changed").select("owner"))
        .filter(F.col("owner").isNotNull())
        .distinct()
    )
    known = keys.filter(F.col("owner").isNotNull()).join(owners, "owner", "left_semi")
    touched = materialize(known.unionByName(keys.filter(F.col("owner").isNull())).drop("owner", "changed"))
    discard(keys)
    return _resolve(touched)


def _resolve(members: DataFrame) -> DataFrame:
    """``resolve_groups`` of a written table of member keys."""
    staged = _link(members, "isbn_node", "meta_node", "meta_component")
    linked = _link(staged, "meta_component", "stem_node", "group")
    own = _node("path", F.col("path"))
    linked = linked.select(
        "path",
        F.coalesce(_node("token", F.col("token")), "group", own).alias("group"),
        F.coalesce("meta_component", own).alias("meta_component"),
        F.coalesce("isbn_node", own).alias("isbn_component"),
        F.col("token").isNotNull().alias("manual"),
    )
    method = (
        F.when(F.col("manual"), "manual")
        .when(F.col("size") == 1, "single")
        .when(F.col("meta_low") != F.col("meta_high"), "filename")
        .when(F.col("isbn_low") != F.col("isbn_high"), "metadata")
        .otherwise("isbn")
    )
    groups = (
        linked.groupBy("group")
        .agg(
            F.min("path").alias("component"),
            F.count(F.lit(1)).alias("size"),
            F.bool_or("manual").alias("manual"),
            F.min("meta_component").alias("meta_low"),
            F.max("meta_component").alias("meta_high"),
            F.min("isbn_component").alias("isbn_low"),
            F.max("isbn_component").alias("isbn_high"),
        )
        .select("group", "component", method.alias("method"))
    )
    return linked.select("path", "group").join(groups, "group").select(
        "path", "component", "method"
    )


def group_by_stem(files: DataFrame) -> DataFrame:
    """(path, stem_key, format, size_bytes) -> one row per stem key: the file-name rule alone."""
    return (
        files.withColumn("stem_key", stem_key(F.col("stem")))
        .filter(F.col("stem_key") != "")
        .groupBy("stem_key")
        .agg(
            F.min("path").alias("first_path"),
            F.count(F.lit(1)).alias("n_files"),
            F.array_sort(F.collect_set("format")).alias("formats"),
            F.sum("size_bytes").alias("total_size"),
        )
    )


def group_members(groups: DataFrame) -> DataFrame:
    """Size of every entity, ordered by its first path."""
    return (
        groups.groupBy("component")
        .agg(F.count(F.lit(1)).alias("size"), F.max("method").alias("method"))
        .orderBy("component")
    )
