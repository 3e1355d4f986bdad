"""Catalog-shaped views over the given tables; every view keeps all rows of its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions import text as X
from folioframe.functions.fields import metadata_status
from folioframe.operators.grouping import identity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def null(type_: str) -> Column:
    return F.lit(None).cast(type_)


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: three versions of one work share a stem."""
    doc = F.col("doc_id")
    digits = F.lpad(F.floor(doc / 4).cast("string"), 9, "0")
    version = (doc % 3).cast("int")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.format_string(
            "/lib/%s/doc%d_v%d.%s",
            "lang",
            F.floor(doc / 3),
            version + 1,
            F.element_at(F.array(F.lit("epub"), F.lit("pdf"), F.lit("mobi")), version + 1),
        ).alias("path"),
        F.col("text").alias("title"),
        F.when(doc % 4 == 0, null("string"))
        .when(doc % 5 == 0, "b")
        .otherwise(F.concat(F.lit("a"), (F.floor(doc / 6) % 7).cast("string")))
        .alias("author_key"),
        F.concat(F.lit("978"), digits, (F.floor(doc / 4) % 10).cast("string")).alias("isbn"),
        F.col("n_chars").alias("size_bytes"),
    )


def document_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return document_files(spark, sf_dir).select(
        *identity(
            path,
            X.extension(path),
            X.stem(path),
            F.col("isbn"),
            X.key(F.col("title")),
            F.col("author_key"),
            null("string"),
        )
    )


def listings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(new listing, known members): toxic documents have moved, low-quality ones have grown.

    All other files are half a second younger, which does not count as a change.
    """
    docs = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels"), "doc_id", "left"
    )
    seconds = F.lit(1_700_000_000) + F.col("doc_id")
    name = F.format_string("doc%d.epub", "doc_id")
    toxic, poor = F.col("toxic") == 1, F.col("quality") == 0
    home = F.concat(F.lit("/lib/"), "lang", F.lit("/"), name)
    new = docs.select(
        F.when(toxic, F.concat(F.lit("/lib/moved/"), name)).otherwise(home).alias("path"),
        F.lit("epub").alias("format"),
        (F.col("n_chars") + F.when(poor, 1).otherwise(0)).alias("size_bytes"),
        F.timestamp_micros(seconds * 1_000_000 + 500_000).alias("modified_at"),
    )
    known = docs.select(
        home.alias("path"),
        F.col("n_chars").alias("size_bytes"),
        F.timestamp_micros(seconds * 1_000_000).alias("modified_at"),
        F.coalesce(poor, F.lit(False)).alias("missing"),
    )
    return new, known


def order_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entities, their customers as authors."""
    order = F.col("o_orderkey")
    title = F.concat(F.lit("The "), "o_orderpriority", F.lit(" "), order.cast("string"))
    authors = F.when((order % 5 == 0) | F.col("c_name").isNull(), F.array().cast("array<string>")).otherwise(
        F.array("c_name")
    )
    year = F.when(order % 3 != 0, F.year("o_orderdate"))
    joined = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left"
    )
    return joined.select(
        order.alias("id"),
        title.alias("title"),
        X.title_sort_key(title).alias("title_sort"),
        authors.alias("authors"),
        X.author_sort_key(authors).alias("author_sort"),
        F.when(F.col("o_orderstatus") == "P", F.col("c_mktsegment")).alias("series"),
        F.when(F.col("o_orderstatus") == "P", (order % 7) / 2).alias("series_index"),
        F.col("c_mktsegment").alias("publisher"),
        year.alias("year"),
        null("string").alias("language"),
        null("string").alias("isbn10"),
        null("string").alias("isbn13"),
        null("string").alias("description"),
        F.when(order % 2 == 0, F.concat(F.lit("covers/"), "o_custkey")).alias("cover_path"),
        metadata_status(title, authors, year, null("string"), null("string")).alias("metadata_status"),
        F.when(F.col("o_orderstatus") == "F", "filename")
        .when(F.col("o_orderstatus") == "O", "single")
        .otherwise("isbn")
        .alias("group_method"),
        F.when(F.col("o_totalprice") > 450000, F.lit("truncated")).alias("parse_error_note"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
    )


def line_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as member files of their orders."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    kinds = {"A": "epub", "N": "pdf", "R": "mobi"}
    format = F.element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), F.col("l_returnflag"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("book_id"),
        F.concat(
            F.concat_ws("/", F.lit("/lib"), "l_orderkey", F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", cents)),
            F.lit("."),
            format,
        ).alias("path"),
        format.alias("format"),
        cents.alias("size_bytes"),
        F.col("l_shipdate").cast("timestamp").alias("modified_at"),
        (F.col("l_linestatus") == "F").alias("missing"),
    )


def event_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as provenance records: one field per event type."""
    k = F.get_json_object("props", "$.k").cast("int")
    sources = ["embedded", "google_books", "open_library", "manual", "filename"]
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("book_id"),
        F.col("event_type").alias("field"),
        F.element_at(F.array(*[F.lit(s) for s in sources]), k % 5 + 1).alias("source"),
        F.col("ts").cast("timestamp").alias("fetched_at"),
        "event_id",
    )


def event_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a rename journal: one batch per user and day, chains of renames per file."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("/"), F.col("user_id").cast("string")).alias("batch_id"),
        k.cast("long").alias("file_id"),
        F.concat(F.lit("/lib/"), k, F.lit("/"), F.col("event_id").cast("string")).alias("old_path"),
        F.concat(F.lit("/lib/"), k, F.lit("/"), (F.col("event_id") + 1).cast("string")).alias("new_path"),
        F.col("ts").cast("timestamp").alias("executed_at"),
        (F.col("event_type") == "error").alias("reverted"),
    )


def page_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as entities: the page title, the site as author; every third has an identifier."""
    page = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        page.alias("id"),
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
        F.array(F.regexp_extract("url", "://([^/?#]+)", 1)).alias("authors"),
        F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("language"),
        F.when(page % 3 == 0, F.format_string("978%010d", F.floor(page / 6))).alias("isbn13"),
        null("string").alias("isbn10"),
        F.when(F.col("url").startswith("https"), "google_books").otherwise("open_library").alias("source"),
        "url",
        "html",
    )


def page_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages as an external catalog with two sources."""
    return page_entities(spark, sf_dir).select(
        F.format_string("c%09d", "id").alias("candidate_id"),
        "source", "title", "authors", "language", "isbn13", "isbn10",
    )


def part_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities with gaps: few titles, many entities per title."""
    key, size = F.col("p_partkey"), F.col("p_size")
    authors = F.when(size % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand"))
    return table(spark, sf_dir, "part").select(
        key.alias("id"),
        F.col("p_name").alias("title"),
        X.title_sort_key(F.col("p_name")).alias("title_sort"),
        authors.alias("authors"),
        X.author_sort_key(authors).alias("author_sort"),
        F.when(size > 25, F.col("p_type")).alias("series"),
        F.when(size > 25, size / 2).alias("series_index"),
        F.when(size % 2 == 0, F.col("p_brand")).alias("publisher"),
        F.when(size % 4 != 0, size + 1970).alias("year"),
        F.when(size % 3 == 0, F.lower("p_type")).alias("language"),
        null("string").alias("isbn10"),
        F.when(size % 7 == 0, F.format_string("978%010d", key)).alias("isbn13"),
        F.when(size % 6 == 0, F.concat_ws(" ", "p_brand", "p_name", "p_type")).alias("description"),
        F.when(size % 8 == 0, F.concat(F.lit("covers/"), key)).alias("cover_path"),
        F.lit("unresolved").alias("metadata_status"),
        F.lit("single").alias("group_method"),
        null("string").alias("parse_error_note"),
        F.timestamp_seconds(F.lit(1_700_000_000) + key).alias("created_at"),
        F.timestamp_seconds(F.lit(1_700_000_000) + key).alias("updated_at"),
        "p_type",
        "p_brand",
        "p_size",
        "p_retailprice",
    )


def turn_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as metadata of member files; each role knows different fields."""
    role, text = F.col("role"), F.col("text")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("entity_id"),
        F.col("turn"),
        F.when(role == "user", text).alias("title"),
        F.when(role == "assistant", F.array("role", "text"))
        .otherwise(F.array().cast("array<string>"))
        .alias("authors"),
        null("string").alias("series"),
        F.when(role == "system", F.col("turn") / 2).alias("series_index"),
        F.when(role == "assistant", text).alias("publisher"),
        F.when(role != "system", F.col("turn") + 2000).cast("int").alias("year"),
        F.when(role == "system", text).alias("language"),
        null("string").alias("isbn10"),
        null("string").alias("isbn13"),
        F.when(role != "user", text).alias("description"),
        F.when(role == "assistant", F.concat(F.lit("note "), F.col("turn"))).alias("parse_error_note"),
    )
