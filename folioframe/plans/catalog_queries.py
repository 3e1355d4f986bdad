"""Registered queries over the given tables, each with the SQL that checks its values."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe import schemas
from folioframe.functions import fields, identifiers, naming
from folioframe.functions import text as X
from folioframe.operators import (
    grouping,
    maintenance,
    matching,
    merge,
    overrides,
    provenance,
    renames,
    search_index,
    similarity,
    snapshot,
    views,
)
from folioframe.operators.ranking import number_in_order
from folioframe.plans import sql_text as S
from folioframe.plans import stand_ins as V
from folioframe.plans.refresh import Catalog, refresh_catalog
from folioframe.session import materialize, work_folder
from folioframe.sources import export, member_log, providers, store, tagged
from folioframe.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def joined(array: str, separator: str = "|"):
    return F.array_join(F.col(array), separator).alias(array)


def stamp(column: str, name: str):
    return F.date_format(F.col(column), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


STAMP = "'%Y-%m-%d %H:%M:%S.%f'"


# ---- text and identifier rules -------------------------------------------------------------


@query(f"SELECT doc_id, {S.key('text')} AS text_key FROM documents")
def normalize_key(spark, d):
    return V.table(spark, d, "documents").select("doc_id", X.key(F.col("text")).alias("text_key"))


@query(f"SELECT doc_id, {S.key('text')} AS text_key FROM documents")
def normalize_key_unicode(spark, d):
    text = F.col("text")
    return V.table(spark, d, "documents").select(
        "doc_id", X.key(text, X.fold_unicode(text)).alias("text_key")
    )


LETTERS = "doc_id * 37 % 11172"


@query(
    f"SELECT doc_id, trim({S.key('text')} || ' ' || chr((4352 + {LETTERS} // 588)::INTEGER) || chr((4449 + {LETTERS} % 588 // "
    f"28)::INTEGER) || CASE WHEN {LETTERS} % 28 > 0 THEN chr((4519 + {LETTERS} % 28)::INTEGER) ELSE '' END || ' viii 1 2') AS "
    "text_key FROM documents WHERE text IS NOT NULL"
)
def fold_letters(spark, d):
    """Letters that become several: ligatures all over the texts, a Hangul syllable, a numeral and a fraction behind them."""
    number = (F.lit(0xAC00) + F.col("doc_id") * 37 % 11172).cast("long")
    syllable = F.decode(F.unhex(F.hex(number)), "UTF-16BE")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "ff", "ﬀ"), "fi", "ﬁ"), "st", "ﬆ")
    return (
        V.table(spark, d, "documents")
        .filter("text IS NOT NULL")
        .select("doc_id", X.key(F.concat(text, F.lit(" "), syllable, F.lit(" Ⅷ ½"))).alias("text_key"))
    )


STEM = "'(' || p_type || ') ' || p_name || '_v' || (p_size % 9) || '.[ocr] Final-' || p_brand"


def part_stem():
    return F.concat(
        F.lit("("), "p_type", F.lit(") "), "p_name", F.lit("_v"), F.col("p_size") % 9,
        F.lit(".[ocr] Final-"), "p_brand",
    )


@query(f"SELECT p_partkey, {S.stem_key(STEM)} AS stem_key FROM part")
def stem_key(spark, d):
    return V.table(spark, d, "part").select("p_partkey", X.stem_key(part_stem()).alias("stem_key"))


@query(f"SELECT doc_id, {S.clean_stem('text')} AS display FROM documents")
def clean_stem(spark, d):
    return V.table(spark, d, "documents").select(
        "doc_id", X.clean_stem_for_display(F.col("text")).alias("display")
    )


AUTHORS = "[p_brand, p_name, 'Ḑüné ' || p_type, ' ']"


@query(
    f"SELECT p_partkey, array_to_string(list_sort(list_filter(list_transform({AUTHORS}, "
    f"lambda a: {S.key('a')}), lambda k: k <> '')), '|') AS author_key FROM part"
)
def author_set_key(spark, d):
    authors = F.array("p_brand", "p_name", F.concat(F.lit("Ḑüné "), "p_type"), F.lit(" "))
    return V.table(spark, d, "part").select(
        "p_partkey", X.author_set_key(authors).alias("author_key")
    )


ISBN_RAW = (
    "CASE WHEN p_partkey % 2 = 0 THEN 'urn:isbn:978-' || lpad(p_partkey::VARCHAR, 9, '0') || '-' || "
    "(p_size % 10) ELSE lpad(p_partkey::VARCHAR, 9, '0') || CASE WHEN p_size % 11 = 10 THEN 'x' "
    "ELSE (p_size % 11)::VARCHAR END END"
)


@query(
    f"WITH raw AS (SELECT p_partkey, {ISBN_RAW} AS raw FROM part), "
    f"n AS (SELECT p_partkey, {S.isbn_normalize('raw')} AS isbn FROM raw) "
    f"SELECT p_partkey, isbn, {S.isbn_plausible('isbn')} AS plausible FROM n"
)
def isbn_check(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    digits = F.lpad(key.cast("string"), 9, "0")
    check = F.when(size % 11 == 10, "x").otherwise((size % 11).cast("string"))
    raw = F.when(
        key % 2 == 0, F.concat(F.lit("urn:isbn:978-"), digits, F.lit("-"), size % 10)
    ).otherwise(F.concat(digits, check))
    isbn = F.col("isbn")
    return (
        V.table(spark, d, "part")
        .select("p_partkey", identifiers.isbn_normalize(raw).alias("isbn"))
        .withColumn("plausible", identifiers.isbn_is_plausible(isbn))
    )


@query(
    f"WITH n AS (SELECT p_brand, p_name, list(raw ORDER BY p_partkey) AS ids "
    f"FROM (SELECT *, {ISBN_RAW} AS raw FROM part) GROUP BY ALL) "
    f"SELECT p_brand, p_name, list_filter(list_transform(ids, lambda r: {S.isbn_normalize('r')}), "
    "lambda i: length(i) = 10)[1] AS isbn10, "
    f"list_filter(list_transform(ids, lambda r: {S.isbn_normalize('r')}), "
    "lambda i: length(i) = 13)[1] AS isbn13 FROM n"
)
def isbn_slots(spark, d):
    """First valid identifier per slot, here over all parts of one brand and name."""
    key, size = F.col("p_partkey"), F.col("p_size")
    digits = F.lpad(key.cast("string"), 9, "0")
    check = F.when(size % 11 == 10, "x").otherwise((size % 11).cast("string"))
    raw = F.when(
        key % 2 == 0, F.concat(F.lit("urn:isbn:978-"), digits, F.lit("-"), size % 10)
    ).otherwise(F.concat(digits, check))
    isbn = F.col("isbn")
    rows = V.table(spark, d, "part").withColumn("isbn", identifiers.isbn_normalize(raw))
    return rows.groupBy("p_brand", "p_name").agg(
        merge.first_known(isbn, key, F.length(isbn) == 10).alias("isbn10"),
        merge.first_known(isbn, key, F.length(isbn) == 13).alias("isbn13"),
    )


ID_TEXT = (
    "CASE p_size % 4 WHEN 0 THEN 'urn:uuid:' || md5(p_name) WHEN 1 THEN 'ISBN ' || p_partkey "
    "WHEN 2 THEN lpad(p_partkey::VARCHAR, 10, '0') ELSE '97-80-00-' || p_name || '-' || p_partkey END"
)


@query(
    f"WITH t AS (SELECT p_partkey, {ID_TEXT} AS id_text FROM part), "
    f"n AS (SELECT *, {S.isbn_normalize('id_text')} AS n, "
    f"length({S.replace('id_text', '[^0-9Xx]', '')}) AS digits FROM t) "
    "SELECT p_partkey, id_text, contains(lower(id_text), 'isbn') OR (n IS NOT NULL AND NOT "
    "(contains(lower(id_text), 'uuid') OR (contains(id_text, '-') AND length(id_text) > 20)) "
    "AND digits IN (10, 13)) AS is_isbn FROM n"
)
def isbn_guard(spark, d):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    text = (
        F.when(size % 4 == 0, F.concat(F.lit("urn:uuid:"), F.md5("p_name")))
        .when(size % 4 == 1, F.concat(F.lit("ISBN "), key))
        .when(size % 4 == 2, F.lpad(key, 10, "0"))
        .otherwise(F.concat(F.lit("97-80-00-"), "p_name", F.lit("-"), key))
    )
    return (
        V.table(spark, d, "part")
        .select("p_partkey", text.alias("id_text"))
        .withColumn("is_isbn", identifiers.looks_like_isbn(F.col("id_text")))
    )


YEAR_TEXT = (
    "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN 'June ' || "
    "year(o_orderdate) WHEN 2 THEN 'no ' || o_orderkey ELSE o_orderpriority || '/' || o_custkey END"
)


@query(
    f"WITH t AS (SELECT o_orderkey, {YEAR_TEXT} AS raw FROM orders) "
    f"SELECT o_orderkey, raw, {S.parse_year('raw')} AS year FROM t"
)
def parse_year(spark, d):
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    raw = (
        F.when(key % 4 == 0, F.date_format(date, "yyyy-MM-dd"))
        .when(key % 4 == 1, F.concat(F.lit("June "), F.year(date)))
        .when(key % 4 == 2, F.concat(F.lit("no "), key))
        .otherwise(F.concat("o_orderpriority", F.lit("/"), "o_custkey"))
    )
    return (
        V.table(spark, d, "orders")
        .select("o_orderkey", raw.alias("raw"))
        .withColumn("year", identifiers.parse_year(F.col("raw")))
    )


GUESS_STEM = (
    "CASE p_size % 3 WHEN 0 THEN p_brand || '_-_' || p_name || ' (' || p_type || ')' "
    "WHEN 1 THEN p_name || ' ' || p_type || ' – part - final ' ELSE p_name || '_' || p_type END"
)


@query(
    f"WITH c AS (SELECT p_partkey, {S.clean_stem(GUESS_STEM)} AS s FROM part), "
    "p AS (SELECT p_partkey, s, strpos(s, ' - ') AS pos, trim(substr(s, 1, strpos(s, ' - ') - 1)) AS a, "
    "trim(substr(s, strpos(s, ' - ') + 3)) AS b FROM c), "
    "q AS (SELECT *, len(list_filter(string_split(a, ' '), lambda w: w <> '')) <= 4 "
    "AND NOT regexp_matches(a, '[0-9]') AS is_author FROM p) "
    "SELECT p_partkey, CASE WHEN pos = 0 THEN s WHEN is_author THEN b ELSE a END AS title, "
    "CASE WHEN pos = 0 THEN NULL WHEN is_author THEN a ELSE b END AS author FROM q"
)
def filename_guess(spark, d):
    size = F.col("p_size")
    stem = (
        F.when(size % 3 == 0, F.concat("p_brand", F.lit("_-_"), "p_name", F.lit(" ("), "p_type", F.lit(")")))
        .when(size % 3 == 1, F.concat("p_name", F.lit(" "), "p_type", F.lit(" – part - final ")))
        .otherwise(F.concat("p_name", F.lit("_"), "p_type"))
    )
    return (
        V.table(spark, d, "part")
        .select("p_partkey", identifiers.filename_guess(stem).alias("g"))
        .select("p_partkey", "g.title", "g.author")
    )


TITLE_TEXT = "' A ' || p_name"
PERSON = "p_name || ' ' || p_brand || ' ' || p_type"


@query(
    f"SELECT p_partkey, {S.title_sort(TITLE_TEXT)} AS title_sort, "
    f"{S.last_first(PERSON)} AS last_first, lower({S.last_first(PERSON)}) AS author_sort, "
    f"{S.last_first('p_type')} AS single FROM part"
)
def sort_keys(spark, d):
    person = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    return V.table(spark, d, "part").select(
        "p_partkey",
        X.title_sort_key(F.concat(F.lit(" A "), "p_name")).alias("title_sort"),
        X.last_first(person).alias("last_first"),
        X.author_sort_key(F.array(person, F.lit("x"))).alias("author_sort"),
        X.last_first(F.col("p_type")).alias("single"),
    )


@query(
    f"WITH e AS ({S.PARTS}), t AS (SELECT id, CASE p_size % 4 WHEN 0 THEN ' Un-titled ' WHEN 1 THEN "
    "'UNKNOWN' WHEN 2 THEN 'No  Title!' ELSE title END AS raw, "
    "[' Unknown ', '', title, 'unknown author', p_brand || ' '] AS names FROM e) "
    f"SELECT id, CASE WHEN {S.key('raw')} IN ('', 'untitled', 'unknown', 'no title', 'title', 'document', "
    "'book') THEN NULL ELSE raw END AS title, array_to_string(list_filter(list_transform(names, "
    f"lambda a: {S.trim_space('a')}), lambda a: {S.key('a')} NOT IN ('', 'unknown', 'unknown author')), '|') "
    "AS authors FROM t"
)
def clean_metadata(spark, d):
    size = F.col("p_size")
    raw = (
        F.when(size % 4 == 0, " Un-titled ")
        .when(size % 4 == 1, "UNKNOWN")
        .when(size % 4 == 2, "No  Title!")
        .otherwise(F.col("title"))
    )
    names = F.array(
        F.lit(" Unknown "), F.lit(""), "title", F.lit("unknown author"), F.concat("p_brand", F.lit(" "))
    )
    return V.part_entities(spark, d).select(
        "id",
        X.clean_title(raw).alias("title"),
        F.array_join(X.clean_authors(names), "|").alias("authors"),
    )


@query(
    "SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(p_name || ' & ' || "
    f"p_brand || '; ;' || p_type || ', x', '[;&]|, '), lambda a: {S.trim_space('a')}), lambda a: a <> ''), '|') "
    "AS authors FROM part"
)
def split_authors(spark, d):
    text = F.concat("p_name", F.lit(" & "), "p_brand", F.lit("; ;"), "p_type", F.lit(", x"))
    return V.table(spark, d, "part").select(
        "p_partkey", F.array_join(X.split_authors(text), "|").alias("authors")
    )


@query(
    "WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?:/', '') AS path "
    "FROM pages), n AS (SELECT *, string_split(path, '/')[-1] AS name FROM p) "
    "SELECT page_id, name, regexp_replace(name, '^(.+)\\.[^.\\s]+$', '\\1') AS stem, "
    "regexp_extract(name, '^.+\\.([^.\\s]+)$', 1) AS ext, regexp_replace(path, '/[^/]*$', '') AS dir FROM n"
)
def path_parts(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "^https?:/", "")
    return (
        V.table(spark, d, "pages")
        .select("page_id", path.alias("path"))
        .select(
            "page_id",
            X.filename(F.col("path")).alias("name"),
            X.stem(F.col("path")).alias("stem"),
            X.extension(F.col("path")).alias("ext"),
            X.directory(F.col("path")).alias("dir"),
        )
    )


@query(
    "SELECT o_orderkey, CASE WHEN (o_orderkey % 7) / 2 = floor((o_orderkey % 7) / 2) THEN "
    "((o_orderkey % 7) // 2)::VARCHAR ELSE ((o_orderkey % 7) / 2)::VARCHAR END AS number, "
    "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, year(o_orderdate)::INTEGER AS year FROM orders"
)
def scalar_text(spark, d):
    """Numbers, timestamps and the year of a timestamp as exports and metadata show them."""
    date = F.col("o_orderdate").cast("timestamp")
    return V.table(spark, d, "orders").select(
        "o_orderkey",
        X.number_text((F.col("o_orderkey") % 7) / 2).alias("number"),
        X.iso_timestamp(date).alias("iso"),
        F.year(date).alias("year"),
    )


CSV = "doc_id || ', \"' || text || '\"'"


@query(
    f"SELECT doc_id, '\"' || replace({CSV}, '\"', '\"\"') || '\"' AS field, "
    f"CASE WHEN regexp_matches(text, '[;\"\\n\\r]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' "
    "ELSE text END AS semicolon FROM documents"
)
def csv_quoting(spark, d):
    text = F.concat(F.col("doc_id").cast("string"), F.lit(', "'), "text", F.lit('"'))
    return V.table(spark, d, "documents").select(
        "doc_id",
        X.csv_field(text).alias("field"),
        X.csv_field(F.col("text"), ";").alias("semicolon"),
    )


# ---- metadata rules ------------------------------------------------------------------------


@query(
    f"WITH e AS ({S.PARTS}) SELECT id, "
    + S.status("title", "authors", "(year IS NOT NULL OR isbn13 IS NOT NULL)")
    + " AS metadata_status, CASE WHEN len(authors) > 0 THEN 2 ELSE 0 END + "
    "CASE WHEN year IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN isbn13 IS NOT NULL THEN 2 ELSE 0 END + "
    "CASE WHEN cover_path IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN description IS NOT NULL THEN 1 ELSE 0 END "
    "AS completeness, array_to_string(list_filter([CASE WHEN title IS NOT NULL THEN 'title' END, "
    "CASE WHEN len(authors) > 0 THEN 'authors' END, CASE WHEN series IS NOT NULL THEN 'series' END, "
    "CASE WHEN series_index IS NOT NULL THEN 'series_index' END, CASE WHEN publisher IS NOT NULL THEN "
    "'publisher' END, CASE WHEN year IS NOT NULL THEN 'year' END, CASE WHEN language IS NOT NULL THEN "
    "'language' END, CASE WHEN isbn13 IS NOT NULL THEN 'isbn13' END, CASE WHEN description IS NOT NULL "
    "THEN 'description' END], lambda f: f IS NOT NULL), '|') AS populated FROM e"
)
def metadata_rules(spark, d):
    names = ["title", "authors", "series", "series_index", "publisher", "year", "language", "isbn10", "isbn13", "description"]
    return V.part_entities(spark, d).select(
        "id",
        overrides.status_column().alias("metadata_status"),
        overrides.entity_completeness().alias("completeness"),
        F.array_join(fields.populated_fields({n: F.col(n) for n in names}), "|").alias("populated"),
    )


@query(
    f"WITH e AS ({S.PARTS}) SELECT id, isbn13 AS isbn, title, authors[1] AS author FROM e "
    "WHERE isbn13 IS NOT NULL OR coalesce(title, '') <> ''"
)
def lookup_queries(spark, d):
    return matching.queries(V.part_entities(spark, d)).withColumnRenamed("entity_id", "id")


# ---- snapshots -----------------------------------------------------------------------------


@query(
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'epub' WHEN 2 THEN 'pdf' END AS format, "
    "n_chars AS size_bytes FROM documents WHERE doc_id % 4 <> 3 AND doc_id % 4 <> 2"
)
def select_listing(spark, d):
    """Known formats only, without the ignored ones (here: pdf)."""
    kind = F.element_at(F.array(*[F.lit(e) for e in ("TXT", "epub", "Pdf", "exe")]), (F.col("doc_id") % 4 + 1).cast("int"))
    files = V.table(spark, d, "documents").select(
        F.concat(F.lit("/lib/"), F.col("doc_id").cast("string"), F.lit("."), kind).alias("path"),
        F.col("n_chars").alias("size_bytes"),
        F.lit(None).cast("timestamp").alias("modified_at"),
    )
    return snapshot.select_listing(files, ignore=" PDF , ,mobi").select(
        X.stem(F.col("path")).cast("long").alias("doc_id"), "format", "size_bytes"
    )


def document_diff(spark, d):
    new, known = V.listings(spark, d)
    return snapshot.snapshot_diff(new, known)


@query(f"WITH {S.LISTINGS} SELECT path, size_bytes, known_size_bytes, known_missing, change FROM diff")
def snapshot_diff(spark, d):
    return document_diff(spark, d).select(
        "path", "size_bytes", "known_size_bytes", "known_missing", "change"
    )


@query(f"WITH {S.LISTINGS} SELECT path, size_bytes, known_size_bytes, known_missing, change FROM diff")
def member_log_diff(spark, d):
    """The difference to members that were written in two versions, the second with what the first did not hold."""
    new, known = V.listings(spark, d)
    had = set(known.columns)
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], schemas.MEMBER).schema}
    members = known.select(*[(F.col(c) if c in had else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])
    folder = f"{work_folder(spark)}/log-{uuid.uuid4().hex}"
    member_log.create(spark, folder)
    early = F.coalesce(F.col("size_bytes") % 3 > 0, F.lit(False))
    member_log.write(members.filter(early).withColumn("size_bytes", F.col("size_bytes") + F.col("size_bytes") % 2), folder, 1)
    member_log.write(members, folder, 2)
    diff = snapshot.snapshot_diff(new, member_log.read(spark, folder))
    return diff.select("path", "size_bytes", "known_size_bytes", "known_missing", "change")


@query(
    f"WITH {S.LISTINGS} SELECT count_if(change = 'added')::BIGINT AS added, "
    "count_if(change = 'updated')::BIGINT AS updated, count_if(change = 'unchanged')::BIGINT AS unchanged, "
    "count_if(change = 'missing' AND NOT coalesce(known_missing, false))::BIGINT AS marked_missing, "
    "count_if(change <> 'missing')::BIGINT AS total_files FROM diff"
)
def scan_summary(spark, d):
    return snapshot.scan_summary(document_diff(spark, d))


@query(f"WITH {S.LISTINGS} SELECT path, change FROM diff WHERE change IN ('added', 'updated')")
def to_extract(spark, d):
    return snapshot.to_extract(document_diff(spark, d)).select("path", "change")


@query(
    f"WITH {S.LISTINGS} SELECT path, 'vanished' AS side FROM known WHERE path NOT IN (SELECT path FROM listing) "
    "UNION ALL SELECT path, 'appeared' FROM listing WHERE path NOT IN (SELECT path FROM known)"
)
def listing_differences(spark, d):
    new, known = V.listings(spark, d)
    gone = snapshot.paths_only_in(known, new).withColumn("side", F.lit("vanished"))
    return gone.unionByName(snapshot.paths_only_in(new, known).withColumn("side", F.lit("appeared")))


# ---- grouping ------------------------------------------------------------------------------


@query(
    f"WITH f AS ({S.DOCUMENT_FILES}), k AS (SELECT *, {S.stem_key('stem')} AS stem_key FROM f) "
    "SELECT stem_key, min(path) AS first_path, count(*) AS n_files, "
    "string_agg(DISTINCT format, ';' ORDER BY format) AS formats, sum(size_bytes)::BIGINT AS total_size "
    "FROM k WHERE stem_key <> '' GROUP BY stem_key"
)
def group_by_stem(spark, d):
    path = F.col("path")
    files = V.document_files(spark, d).select(
        "path", X.stem(path).alias("stem"), X.extension(path).alias("format"), "size_bytes"
    )
    return grouping.group_by_stem(files).withColumn("formats", F.array_join("formats", ";"))


RESOLVED = f"""
WITH RECURSIVE f AS ({S.DOCUMENT_FILES}),
ident AS (
  SELECT path, {S.stem_key('stem')} AS stem_key, nullif({S.key('title')}, '') AS title_key, author_key,
         CASE WHEN {S.isbn_plausible('isbn')} THEN isbn END AS isbn FROM f),
guard AS (SELECT stem_key, count(DISTINCT author_key) > 1 AS conflict FROM ident GROUP BY stem_key),
keys AS (
  SELECT path, 1 AS stage, 'i' || isbn AS k FROM ident WHERE isbn IS NOT NULL
  UNION ALL SELECT path, 2, 'm' || md5(title_key || '::' || author_key) FROM ident
            WHERE title_key IS NOT NULL AND author_key IS NOT NULL
  UNION ALL SELECT path, 3, CASE WHEN conflict THEN 's' || stem_key || '/' || coalesce(author_key, '')
                                 ELSE 'w' || stem_key END
            FROM ident JOIN guard USING (stem_key) WHERE stem_key <> ''),
pairs AS (
  SELECT DISTINCT a.path AS p, b.path AS q, a.stage FROM keys a JOIN keys b ON a.k = b.k),
reach1 AS (SELECT path AS p, path AS q FROM ident UNION
           SELECT r.p, e.q FROM reach1 r JOIN pairs e ON r.q = e.p AND e.stage <= 1),
reach2 AS (SELECT path AS p, path AS q FROM ident UNION
           SELECT r.p, e.q FROM reach2 r JOIN pairs e ON r.q = e.p AND e.stage <= 2),
reach3 AS (SELECT path AS p, path AS q FROM ident UNION
           SELECT r.p, e.q FROM reach3 r JOIN pairs e ON r.q = e.p AND e.stage <= 3),
c1 AS (SELECT p, min(q) AS c FROM reach1 GROUP BY p),
c2 AS (SELECT p, min(q) AS c FROM reach2 GROUP BY p),
c3 AS (SELECT p, min(q) AS c FROM reach3 GROUP BY p),
evidence AS (
  SELECT c3.c AS component, count(*) AS size, count(DISTINCT c2.c) AS n2, count(DISTINCT c1.c) AS n1
  FROM c3 JOIN c2 USING (p) JOIN c1 USING (p) GROUP BY c3.c),
resolved AS (
  SELECT p AS path, component, size, CASE WHEN size = 1 THEN 'single' WHEN n2 > 1 THEN 'filename'
         WHEN n1 > 1 THEN 'metadata' ELSE 'isbn' END AS method
  FROM c3 JOIN evidence ON c3.c = component)
"""


@query(RESOLVED + "SELECT path, component, method FROM resolved")
def resolve_entities(spark, d):
    return grouping.resolve_groups(V.document_identities(spark, d))


@query(RESOLVED + "SELECT DISTINCT component, size, method FROM resolved")
def group_sizes(spark, d):
    return grouping.group_members(grouping.resolve_groups(V.document_identities(spark, d)))


@query(
    f"WITH f AS ({S.DOCUMENT_FILES}) SELECT {S.stem_key('stem')} AS stem_key, true AS conflict FROM f "
    "GROUP BY 1 HAVING count(DISTINCT author_key) > 1"
)
def stem_conflicts(spark, d):
    rows = V.document_files(spark, d).withColumn("stem_key", X.stem_key(X.stem(F.col("path"))))
    return grouping.stem_conflicts(rows)


# ---- merging -------------------------------------------------------------------------------

TURN_FIELDS = ["title", "series_index", "publisher", "year", "language", "description"]


@query(
    f"WITH m AS ({S.TURNS}) SELECT entity_id, "
    + ", ".join(f"arg_min({f}, turn) FILTER ({f} IS NOT NULL) AS {f}" for f in TURN_FIELDS)
    + ", array_to_string(arg_min(authors, turn) FILTER (len(authors) > 0), '|') AS authors "
    "FROM m GROUP BY entity_id"
)
def merge_metadata(spark, d):
    merged = merge.merge_metadata(V.turn_metadata(spark, d), ["entity_id"], ["turn"])
    return merged.select("entity_id", *TURN_FIELDS, joined("authors"))


@query(
    f"WITH m AS ({S.TURNS}) SELECT entity_id, string_agg(parse_error_note, '; ' ORDER BY turn) AS notes "
    "FROM m WHERE parse_error_note IS NOT NULL GROUP BY entity_id"
)
def concat_notes(spark, d):
    return merge.concat_notes(V.turn_metadata(spark, d), ["entity_id"], "parse_error_note", ["turn"])


@query(
    "WITH v AS (SELECT l_partkey AS component, l_suppkey AS owner, count(*) AS votes FROM lineitem GROUP BY ALL) "
    "SELECT component, owner, votes FROM v QUALIFY row_number() OVER (PARTITION BY component "
    "ORDER BY votes DESC, owner) = 1"
)
def owner_election(spark, d):
    lines = V.table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("component"), F.col("l_suppkey").alias("owner")
    )
    return merge.elect_owner(lines, "component", "owner")


FILL = ["series", "series_index", "publisher", "year", "language", "isbn13", "description"]


@query(
    f"WITH e AS ({S.PARTS}), found AS (SELECT e.*, e.p_brand AS other FROM e), "
    "f AS (SELECT id, [p_type] AS authors, p_type AS series, NULL::DOUBLE AS series_index, p_name2 AS publisher, "
    "2024 AS year, 'xx' AS language, NULL AS isbn13, title AS description FROM (SELECT *, title || '!' AS p_name2 "
    "FROM e)) SELECT e.id, array_to_string(CASE WHEN len(e.authors) = 0 THEN f.authors ELSE e.authors END, '|') "
    "AS authors, "
    + ", ".join(f"coalesce(e.{f}, f.{f}) AS {f}" for f in FILL)
    + ", array_to_string(list_filter([CASE WHEN len(e.authors) = 0 THEN 'authors' END, "
    + ", ".join(f"CASE WHEN e.{f} IS NULL AND f.{f} IS NOT NULL THEN '{f}' END" for f in FILL)
    + "], lambda x: x IS NOT NULL), '|') AS filled FROM e JOIN f USING (id)"
)
def fill_empty(spark, d):
    entity = V.part_entities(spark, d)
    found = entity.select(
        "id",
        F.array("p_type").alias("authors"),
        F.col("p_type").alias("series"),
        F.lit(None).cast("double").alias("series_index"),
        F.concat("title", F.lit("!")).alias("publisher"),
        F.lit(2024).alias("year"),
        F.lit("xx").alias("language"),
        F.lit(None).cast("string").alias("isbn10"),
        F.lit(None).cast("string").alias("isbn13"),
        F.col("title").alias("description"),
    )
    return merge.fill_empty(entity, found).select("id", joined("authors"), *FILL, joined("filled"))


# ---- manual decisions ----------------------------------------------------------------------

MERGE_FIELDS = [*FILL, "cover_path"]
SCORED = (
    f"e AS ({S.PARTS}), s AS (SELECT *, title || '/' || p_type AS merge_id, "
    "CASE WHEN len(authors) > 0 THEN 2 ELSE 0 END + CASE WHEN year IS NOT NULL THEN 1 ELSE 0 END + "
    "CASE WHEN isbn13 IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN cover_path IS NOT NULL THEN 1 ELSE 0 END + "
    "CASE WHEN description IS NOT NULL THEN 1 ELSE 0 END AS score FROM e), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY merge_id ORDER BY score DESC, id) AS place FROM s)"
)


def part_merges(spark, d):
    entity = V.part_entities(spark, d)
    requests = entity.select("id", F.concat_ws("/", "title", "p_type").alias("merge_id"))
    return entity, requests


@query(
    f"WITH {SCORED} SELECT merge_id, arg_min(id, place) AS id, count(*) AS n_entities, "
    "array_to_string(coalesce(arg_min(authors, place) FILTER (len(authors) > 0), []), '|') AS authors, "
    + ", ".join(f"arg_min({f}, place) FILTER ({f} IS NOT NULL) AS {f}" for f in MERGE_FIELDS)
    + ", 'manual' AS group_method FROM r GROUP BY merge_id HAVING count(*) > 1"
)
def merge_survivor(spark, d):
    entity, requests = part_merges(spark, d)
    rows = overrides.merge_survivors(entity, requests)
    return rows.select(
        "merge_id", "id", "n_entities", joined("authors"), *MERGE_FIELDS, "group_method"
    )


@query(
    f"WITH {SCORED}, t AS (SELECT merge_id, arg_min(id, place) AS survivor, count(*) AS n FROM r GROUP BY merge_id) "
    "SELECT r.id AS member_id, CASE WHEN n > 1 THEN survivor ELSE r.id END AS book_id, CASE WHEN n > 1 THEN "
    "'manual-' || md5('merge:' || merge_id || ':' || survivor) END AS manual_group_id FROM r JOIN t USING (merge_id)"
)
def merge_entities(spark, d):
    entity, requests = part_merges(spark, d)
    members = entity.select(
        F.col("id").alias("member_id"), F.col("id").alias("book_id"), V.null("string").alias("manual_group_id")
    )
    _, moved = overrides.merge_entities(
        entity.drop("p_type", "p_brand", "p_size", "p_retailprice"), members, requests, F.current_timestamp()
    )
    return moved


@query(
    f"WITH {SCORED}, t AS (SELECT merge_id, arg_min(id, place) AS survivor FROM r GROUP BY merge_id), p AS ({S.PROVENANCE}) "
    "SELECT event_id, book_id, field, source FROM p WHERE book_id IN (SELECT survivor FROM t)"
)
def merge_provenance(spark, d):
    """What is left of the provenance when the absorbed entities are gone."""
    entity, requests = part_merges(spark, d)
    members = entity.select("id", F.col("id").alias("book_id"), V.null("string").alias("manual_group_id"))
    kept, _ = overrides.merge_entities(
        entity.drop("p_type", "p_brand", "p_size", "p_retailprice"), members, requests, F.current_timestamp()
    )
    return provenance.of_entities(V.event_provenance(spark, d), kept).select("event_id", "book_id", "field", "source")


def detached_members(spark, d):
    """Orders as entities to take apart, their line items as members with own metadata."""
    entity = V.order_entities(spark, d)
    members = V.line_members(spark, d).withColumn("manual_group_id", V.null("string"))
    found = members.select(
        "path",
        F.when(F.col("format") == "epub", F.concat(F.lit("Own "), F.col("size_bytes"))).alias("title"),
        F.when(F.col("format") == "pdf", F.array("format")).otherwise(F.array().cast("array<string>")).alias("authors"),
        V.null("string").alias("series"),
        V.null("double").alias("series_index"),
        F.when(F.col("missing"), F.lit("publisher")).alias("publisher"),
        F.year("modified_at").alias("year"),
        V.null("string").alias("language"),
        V.null("string").alias("isbn10"),
        V.null("string").alias("isbn13"),
        V.null("string").alias("description"),
        V.null("string").alias("parse_error_note"),
    )
    return entity, members, found


UNGROUPED = (
    f"{S.CATALOG}, files AS (SELECT * FROM member), "
    "g AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY path) AS place, "
    "count(*) OVER (PARTITION BY book_id) AS n FROM files), "
    "last AS (SELECT max(id) AS top FROM entity), "
    "moved AS (SELECT path, top + row_number() OVER (ORDER BY path) AS new_id FROM g, last WHERE n > 1 AND place > 1) "
)


@query(
    UNGROUPED + "SELECT g.path, coalesce(new_id, book_id) AS book_id, CASE WHEN n > 1 THEN 'manual-' || md5(g.path) "
    "END AS manual_group_id FROM g LEFT JOIN moved USING (path)"
)
def ungroup_members(spark, d):
    entity, members, found = detached_members(spark, d)
    last = entity.agg(F.max("id")).first()[0]
    _, moved, _ = overrides.ungroup(
        entity, members, found, entity.select("id"), last + 1, F.current_timestamp()
    )
    return moved.select("path", "book_id", "manual_group_id")


@query(
    UNGROUPED + ", files2 AS (SELECT m.new_id AS id, f.*, string_split(string_split(f.path, '/')[-1], '.')[1] AS stem "
    "FROM moved m JOIN files f USING (path)) "
    f"SELECT id, CASE WHEN format = 'epub' THEN 'Own ' || size_bytes ELSE {S.clean_stem('stem')} END AS title, "
    "CASE WHEN format = 'pdf' THEN 'pdf' ELSE '' END AS authors, CASE WHEN missing THEN 'publisher' END AS publisher, "
    "CASE WHEN format = 'pdf' THEN 'complete' ELSE 'unresolved' END AS metadata_status FROM files2"
)
def ungroup_entities(spark, d):
    entity, members, found = detached_members(spark, d)
    last = entity.agg(F.max("id")).first()[0]
    rows, _, _ = overrides.ungroup(
        entity, members, found, entity.select("id"), last + 1, F.current_timestamp()
    )
    new = rows.filter(F.col("id") > last)
    return new.select("id", "title", joined("authors"), "publisher", "metadata_status")


@query(
    f"{S.CATALOG}, files AS (SELECT * FROM member), "
    "ask AS (SELECT *, count(*) OVER (PARTITION BY book_id) AS n, count_if(format = 'pdf') OVER (PARTITION BY book_id) "
    "AS asked, min(CASE WHEN format = 'pdf' THEN path END) OVER (PARTITION BY book_id) AS first_asked FROM files), "
    "last AS (SELECT max(id) AS top FROM entity), "
    "moved AS (SELECT path, top + row_number() OVER (ORDER BY path) AS new_id FROM ask, last WHERE format = 'pdf' "
    "AND n > 1 AND (asked < n OR path <> first_asked)) "
    "SELECT path, coalesce(new_id, book_id) AS book_id, CASE WHEN new_id IS NOT NULL THEN 'manual-' || md5(path) END "
    "AS manual_group_id FROM files LEFT JOIN moved USING (path)"
)
def split_members(spark, d):
    entity, members, found = detached_members(spark, d)
    last = entity.agg(F.max("id")).first()[0]
    asked = members.filter(F.col("format") == "pdf").select("path")
    _, moved, _ = overrides.split_members(entity, members, found, asked, last + 1, F.current_timestamp())
    return moved.select("path", "book_id", "manual_group_id")


@query(
    f"WITH e AS ({S.PARTS}), n AS (SELECT id, upper(title) || '' AS title, authors, CASE WHEN p_size % 2 = 0 THEN "
    "p_brand ELSE 'none' END AS publisher, CASE WHEN p_size % 4 <> 0 THEN p_size + 1970 ELSE 1970 END AS year FROM e), "
    "c AS (SELECT e.id, list_filter([CASE WHEN n.title <> e.title THEN 'title' END, CASE WHEN n.publisher IS DISTINCT "
    "FROM e.publisher THEN 'publisher' END, CASE WHEN n.year IS DISTINCT FROM e.year THEN 'year' END], "
    "lambda x: x IS NOT NULL) AS fields FROM e JOIN n USING (id)) "
    "SELECT id, array_to_string(fields, '|') AS fields FROM c WHERE len(fields) > 0"
)
def edit_diff(spark, d):
    original = V.part_entities(spark, d)
    edited = original.withColumns(
        {
            "title": F.upper("title"),
            "publisher": F.coalesce("publisher", F.lit("none")),
            "year": F.coalesce("year", F.lit(1970)),
        }
    )
    return provenance.edit_diff(edited, original).withColumn("fields", F.array_join("fields", "|"))


EDITED_TITLE = "CASE WHEN p_size % 3 = 0 THEN 'The ' || upper(title) ELSE title END"


@query(
    f"WITH e AS ({S.PARTS}), n AS (SELECT id, p_size, {EDITED_TITLE} AS title, CASE WHEN p_size % 15 = 0 THEN ['Ann Lee'] "
    "ELSE authors END AS authors FROM e) "
    f"SELECT id, title, {S.title_sort('title')} AS title_sort, array_to_string(authors, '|') AS authors, "
    f"CASE WHEN len(authors) = 0 THEN '' ELSE lower({S.last_first('authors[1]')}) END AS author_sort, "
    "CASE WHEN p_size % 3 = 0 THEN 'complete' ELSE 'unresolved' END AS metadata_status, p_size % 3 = 0 AS edited FROM n"
)
def apply_edits(spark, d):
    original = V.part_entities(spark, d)
    edited = original.filter("p_size % 3 = 0").withColumns(
        {
            "title": F.concat(F.lit("The "), F.upper("title")),
            "authors": F.when(F.col("p_size") % 15 == 0, F.array(F.lit("Ann Lee"))).otherwise(F.col("authors")),
            "year": F.coalesce("year", F.lit(1970)),
        }
    )
    rows = overrides.apply_edits(original, edited, F.timestamp_seconds(F.lit(2_000_000_000)))
    return rows.select(
        "id",
        "title",
        "title_sort",
        joined("authors"),
        "author_sort",
        "metadata_status",
        (F.col("updated_at") > F.col("created_at")).alias("edited"),
    )


# ---- provenance ----------------------------------------------------------------------------


@query(
    f"WITH p AS ({S.PROVENANCE}) SELECT book_id, field, source, strftime(fetched_at, {STAMP}) AS fetched_at FROM p "
    "QUALIFY row_number() OVER (PARTITION BY book_id, field ORDER BY fetched_at DESC, event_id DESC) = 1"
)
def provenance_latest(spark, d):
    rows = provenance.latest(V.event_provenance(spark, d), ["event_id"])
    return rows.select("book_id", "field", "source", stamp("fetched_at", "fetched_at"))


LATEST = (
    f"p AS ({S.PROVENANCE}), latest AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY book_id, field "
    "ORDER BY fetched_at DESC, event_id DESC) = 1)"
)


@query(
    f"WITH {LATEST} SELECT book_id, string_agg(field || '=' || source || '@' || "
    "strftime(fetched_at, '%Y-%m-%dT%H:%M:%SZ'), '|' ORDER BY field) AS provenance FROM latest GROUP BY book_id"
)
def provenance_map(spark, d):
    records = provenance.latest(V.event_provenance(spark, d), ["event_id"])
    entries = F.array_sort(F.map_entries("provenance"))
    text = F.transform(
        entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]["source"], F.lit("@"), e["value"]["fetched_at"])
    )
    return provenance.field_map(records).select(
        "book_id", F.array_join(text, "|").alias("provenance")
    )


@query(
    f"WITH {LATEST} SELECT book_id AS id, string_agg(field, '|' ORDER BY field) AS manual_fields FROM latest "
    "WHERE source = 'manual' GROUP BY book_id"
)
def manual_fields(spark, d):
    records = provenance.latest(V.event_provenance(spark, d), ["event_id"])
    return provenance.manual_fields(records).withColumn("manual_fields", F.array_join("manual_fields", "|"))


@query(
    f"WITH {LATEST}, c AS (SELECT DISTINCT book_id, 'click' AS field FROM latest UNION SELECT book_id, 'title' FROM "
    "latest) SELECT book_id, field, 'manual' AS source FROM c UNION ALL SELECT book_id, field, source FROM latest "
    "WHERE (book_id, field) NOT IN (SELECT (book_id, field) FROM c)"
)
def provenance_upsert(spark, d):
    current = provenance.latest(V.event_provenance(spark, d), ["event_id"])
    edits = current.select(F.col("book_id").alias("id")).distinct().withColumn(
        "fields", F.array(F.lit("click"), F.lit("title"))
    )
    changes = provenance.as_records(edits, F.lit("manual"), F.current_timestamp())
    return provenance.upsert(current, changes).select("book_id", "field", "source")


@query(
    f"WITH {LATEST}, c AS (SELECT DISTINCT book_id, 'click' AS field FROM latest UNION SELECT book_id, 'title' FROM "
    "latest) SELECT book_id, field, source FROM latest UNION ALL SELECT book_id, field, 'embedded' FROM c "
    "WHERE (book_id, field) NOT IN (SELECT (book_id, field) FROM latest)"
)
def provenance_insert(spark, d):
    current = provenance.latest(V.event_provenance(spark, d), ["event_id"])
    found = current.select(F.col("book_id").alias("id")).distinct().withColumn(
        "fields", F.array(F.lit("click"), F.lit("title"))
    )
    records = provenance.as_records(found, F.lit("embedded"), F.current_timestamp())
    return provenance.insert_if_absent(current, records).select("book_id", "field", "source")


# ---- upkeep --------------------------------------------------------------------------------


@query(S.CATALOG + " SELECT id, title FROM entity WHERE id NOT IN (SELECT book_id FROM member)")
def orphans(spark, d):
    return maintenance.orphans(V.order_entities(spark, d), V.line_members(spark, d)).select("id", "title")


@query(
    S.CATALOG + ", kept AS (SELECT * FROM member WHERE NOT missing), ids AS (SELECT DISTINCT book_id FROM kept), "
    "e AS (SELECT id FROM entity WHERE id IN (SELECT book_id FROM ids)) "
    "SELECT book_id, count(*) AS n_files, sum(size_bytes)::BIGINT AS bytes FROM kept WHERE book_id IN "
    "(SELECT id FROM e) GROUP BY book_id"
)
def purge_missing(spark, d):
    entities, members = maintenance.purge_missing(V.order_entities(spark, d), V.line_members(spark, d))
    rest = maintenance.cascade(members, entities)
    return rest.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").alias("bytes")
    )


@query(
    "SELECT page_id, CASE WHEN starts_with(url, 'https://m.') THEN url WHEN starts_with(url, 'https://') THEN "
    "'/mnt//' || substr(url, 9) ELSE url END AS path FROM (SELECT page_id, replace(url, 'https://m.', 'https:x//m.') "
    "AS url FROM pages)"
)
def rebase_paths(spark, d):
    # The old root is "https:", so what follows its slash starts with another one.
    url = F.replace("url", F.lit("https://m."), F.lit("https:x//m."))
    return V.table(spark, d, "pages").select(
        "page_id", maintenance.rebase_path(url, "https:/", "/mnt").alias("path")
    )


@query(
    S.CATALOG + ", assets AS (SELECT 'covers/' || c_custkey AS path FROM customer WHERE c_acctbal > 0) "
    "SELECT id, CASE WHEN cover_path IN (SELECT path FROM assets) THEN cover_path END AS cover_path FROM entity"
)
def clear_dangling(spark, d):
    assets = (
        V.table(spark, d, "customer")
        .filter("c_acctbal > 0")
        .select(F.concat(F.lit("covers/"), "c_custkey").alias("path"))
    )
    return maintenance.clear_dangling(V.order_entities(spark, d), assets).select("id", "cover_path")


# ---- matching ------------------------------------------------------------------------------


def page_words(spark, d):
    return (
        V.page_entities(spark, d)
        .select(similarity.title_words(F.col("title")).alias("words"))
        .filter(F.size("words") > 0)
        .distinct()
    )


@query(
    f"WITH p AS ({S.PAGES}), w AS (SELECT DISTINCT {S.words('title')} AS words FROM p), "
    "v AS (SELECT words FROM w WHERE len(words) > 0), "
    f"s AS (SELECT a.words AS a, b.words AS b, {S.jaccard('a.words', 'b.words')} AS similarity FROM v a, v b) "
    "SELECT array_to_string(a, ' ') AS left_words, array_to_string(b, ' ') AS right_words, similarity FROM s "
    "WHERE similarity >= 0.6"
)
def title_similarity(spark, d):
    words = page_words(spark, d)
    return similarity.similar_titles(words, words, 0.6).select(
        F.array_join("left_words", " ").alias("left_words"),
        F.array_join("right_words", " ").alias("right_words"),
        "similarity",
    )


@query(
    f"WITH p AS (SELECT DISTINCT {S.words("title || ' ' || p_type || ' ' || p_brand")} AS words FROM ({S.PARTS})), "
    f"s AS (SELECT a.words AS a, b.words AS b, {S.jaccard('a.words', 'b.words')} AS similarity FROM p a, p b WHERE a.words < b.words) "
    "SELECT array_to_string(a, ' ') AS left_words, array_to_string(b, ' ') AS right_words, similarity FROM s "
    "WHERE similarity >= 0.5"
)
def part_similarity(spark, d):
    """Every pair of different, similar titles once."""
    name = F.concat_ws(" ", "title", "p_type", "p_brand")
    words = V.part_entities(spark, d).select(similarity.title_words(name).alias("words")).distinct()
    pairs = similarity.similar_titles(words, words, 0.5).filter(F.col("left_words") < F.col("right_words"))
    return pairs.select(
        F.array_join("left_words", " ").alias("left_words"), F.array_join("right_words", " ").alias("right_words"), "similarity"
    )


@query(
    f"SELECT doc_id, {S.jaccard(S.words('text'), S.words('lang || source || text'))} AS similarity FROM documents"
)
def text_similarity(spark, d):
    other = F.concat("lang", "source", "text")
    return V.table(spark, d, "documents").select(
        "doc_id", X.similarity(F.col("text"), other).alias("similarity")
    )


def candidate_sql(entity: str, catalog: str) -> str:
    """Brute force: every query against every catalog row, then the first ten per source."""
    return f"""
entity AS ({entity}), cat AS ({catalog}),
q AS (SELECT id AS entity_id, isbn13 AS isbn, title, authors[1] AS author FROM entity
      WHERE isbn13 IS NOT NULL OR coalesce(title, '') <> ''),
qt AS (SELECT title, {S.words('title')} AS words FROM (SELECT DISTINCT title FROM q)),
ct AS (SELECT title, {S.words('title')} AS words FROM (SELECT DISTINCT title FROM cat)),
sim AS (SELECT qt.title AS a, ct.title AS b, {S.jaccard('qt.words', 'ct.words')} AS similarity,
               len(qt.words) > 0 AND len(list_intersect(qt.words, ct.words)) = len(qt.words) AS contained
        FROM qt, ct),
qa AS (SELECT q.*, {S.words("coalesce(author, '')")} AS aw FROM q),
ca AS (SELECT cat.*, {S.words("array_to_string(authors, ' ')")} AS aw FROM cat),
hits AS (
  SELECT entity_id, isbn, c.candidate_id, c.source, c.title, similarity
  FROM q JOIN cat c ON q.isbn = c.isbn13 JOIN sim ON sim.a = q.title AND sim.b = c.title
  UNION ALL
  SELECT entity_id, isbn, c.candidate_id, c.source, c.title, similarity
  FROM qa q JOIN sim ON sim.a = q.title AND (contained OR similarity >= {schemas.CONFIDENCE_THRESHOLD}) JOIN ca c ON c.title = sim.b
  WHERE q.isbn IS NULL AND (len(q.aw) = 0 OR list_has_any(q.aw, c.aw))),
found AS (
  SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY entity_id, source ORDER BY
    CASE WHEN isbn IS NULL THEN similarity END DESC, candidate_id) <= 10),
answering AS (
  SELECT *, CASE source WHEN 'google_books' THEN 1 ELSE 2 END AS place FROM found
  QUALIFY place = min(place) OVER (PARTITION BY entity_id)),
ranked AS (
  SELECT *, row_number() OVER w AS rank, similarity - coalesce(lead(similarity) OVER w, 0) AS margin,
         count(*) OVER (PARTITION BY entity_id) AS n
  FROM answering WINDOW w AS (PARTITION BY entity_id ORDER BY similarity DESC, candidate_id)),
decided AS (
  SELECT q.entity_id, CASE WHEN r.similarity >= 0.6 AND (n = 1 OR margin >= 0.3 OR q.isbn IS NOT NULL)
           THEN 'applied' WHEN n > 0 THEN 'needs_confirmation' ELSE 'no_match' END AS outcome,
         candidate_id, source, similarity, coalesce(n, 0) AS n_candidates
  FROM q LEFT JOIN ranked r ON q.entity_id = r.entity_id AND rank = 1)
"""


PAGE_ENTITY = f"SELECT *, [site] AS authors FROM ({S.PAGES})"
PAGE_CATALOG = (
    "SELECT 'c' || lpad(id::VARCHAR, 9, '0') AS candidate_id, source, title, [site] AS authors, isbn13 "
    f"FROM ({S.PAGES})"
)
PAGE_MATCH = "WITH " + candidate_sql(PAGE_ENTITY, PAGE_CATALOG)
PART_CATALOG = (
    "SELECT 'c' || lpad(id::VARCHAR, 9, '0') AS candidate_id, CASE WHEN p_size > 20 THEN 'google_books' ELSE "
    f"'open_library' END AS source, title || ' ' || p_type AS title, authors, isbn13 FROM ({S.PARTS})"
)
PART_MATCH = "WITH " + candidate_sql(S.PARTS, PART_CATALOG)


def page_candidates(spark, d):
    queries = matching.queries(V.page_entities(spark, d))
    found = matching.find_candidates(queries, V.page_catalog(spark, d))
    return queries, materialize(found.withColumn("error", V.null("string")))


def part_candidates(spark, d):
    entity = V.part_entities(spark, d)
    catalog = entity.select(
        F.format_string("c%09d", "id").alias("candidate_id"),
        F.when(F.col("p_size") > 20, "google_books").otherwise("open_library").alias("source"),
        F.concat_ws(" ", "title", "p_type").alias("title"),
        "authors", "year", "publisher", "language", "isbn10", "isbn13", "description", "series", "series_index",
    )
    queries = matching.queries(entity)
    found = matching.find_candidates(queries, catalog)
    return entity, queries, materialize(found.withColumn("error", V.null("string")))


@query(PAGE_MATCH + "SELECT entity_id, candidate_id, source, title, similarity FROM found")
def candidate_match(spark, d):
    _, found = page_candidates(spark, d)
    return found.select("entity_id", "candidate_id", "source", "title", "similarity")


@query(PART_MATCH + "SELECT entity_id, candidate_id, source, title, similarity FROM found")
def candidate_match_parts(spark, d):
    _, _, found = part_candidates(spark, d)
    return found.select("entity_id", "candidate_id", "source", "title", "similarity")


@query(PAGE_MATCH + "SELECT entity_id, candidate_id, source, rank, margin FROM ranked")
def rank_candidates(spark, d):
    _, found = page_candidates(spark, d)
    best = matching.first_answering_source(found, matching.provider_order("google_books"))
    return matching.rank_candidates(best).select("entity_id", "candidate_id", "source", "rank", "margin")


@query(PAGE_MATCH + "SELECT * FROM decided")
def match_decision(spark, d):
    return matching.decide(*page_candidates(spark, d))


@query(
    PAGE_MATCH + ", renamed AS (SELECT * REPLACE (CASE WHEN candidate_id LIKE '%3' THEN 'my_catalog' ELSE source END AS "
    "source) FROM found), a AS (SELECT *, CASE source WHEN 'open_library' THEN 1 WHEN 'google_books' THEN 2 END AS place "
    "FROM renamed WHERE source IN ('open_library', 'google_books') QUALIFY place = min(place) OVER (PARTITION BY entity_id)) "
    "SELECT entity_id, candidate_id, source, row_number() OVER w AS rank, similarity - coalesce(lead(similarity) OVER w, 0) "
    "AS margin FROM a WINDOW w AS (PARTITION BY entity_id ORDER BY similarity DESC, candidate_id)"
)
def rank_reordered(spark, d):
    """Another order of the sources; candidates of a source outside it are left out."""
    _, found = page_candidates(spark, d)
    renamed = found.withColumn(
        "source", F.when(F.col("candidate_id").endswith("3"), "my_catalog").otherwise(F.col("source"))
    )
    best = matching.first_answering_source(renamed, matching.provider_order("nobody, open_library"))
    return matching.rank_candidates(best).select("entity_id", "candidate_id", "source", "rank", "margin")


@query(
    PART_MATCH + "SELECT CASE WHEN entity_id % 3 = 0 THEN 'failed' ELSE outcome END AS outcome, count(*) AS n "
    "FROM decided GROUP BY ALL"
)
def outcome_failed(spark, d):
    """A third of the lookups end in an error of every source."""
    _, queries, found = part_candidates(spark, d)
    lost = queries.filter("entity_id % 3 = 0").select(
        "entity_id", F.explode(F.array(*map(F.lit, schemas.DEFAULT_PROVIDER_ORDER))).alias("source"), F.lit("timeout").alias("error")
    )
    rows = found.filter("entity_id % 3 <> 0").unionByName(providers.failed_lookups(lost), allowMissingColumns=True)
    return matching.outcome_counts(matching.decide(queries, rows))


@query(PART_MATCH + "SELECT outcome, count(*) AS n FROM decided GROUP BY outcome")
def outcome_counts(spark, d):
    _, queries, found = part_candidates(spark, d)
    return matching.outcome_counts(matching.decide(queries, found))


APPLY = ["publisher", "year", "language", "isbn13", "description", "series", "series_index"]


def apply_sql(policy: str) -> str:
    sets = {}
    for f in ["title", "authors", *APPLY]:
        known = f"c.{f} IS NOT NULL"
        empty = f"e.{f} IS NULL"
        if f == "title":
            sets[f] = f"{known} AND ({policy == 'overwrite'} OR e.title = '') AND e.title <> c.title"
        elif f == "authors":
            sets[f] = f"len(c.authors) > 0 AND ({policy == 'overwrite'} OR len(e.authors) = 0) AND e.authors <> c.authors"
        else:
            sets[f] = f"{known} AND ({policy == 'overwrite'} OR {empty})"
    free = {f: f"NOT (coalesce(e.p_size > 25, false) AND '{f}' IN ('title', 'year'))" for f in sets}
    test = {f: f"coalesce({s} AND {free[f]}, false)" for f, s in sets.items()}
    value = {f: f"CASE WHEN {t} THEN c.{f} ELSE e.{f} END" for f, t in test.items()}
    value["authors"] = f"array_to_string({value['authors']}, '|')"
    return (
        PART_MATCH.replace("decided AS (", "decided AS MATERIALIZED (")
        + ", chosen AS (SELECT d.entity_id, p.title || ' ' || p.p_type AS title, p.* EXCLUDE (title) FROM decided d "
        "JOIN entity p ON d.candidate_id = 'c' || lpad(p.id::VARCHAR, 9, '0') WHERE outcome = 'applied') SELECT e.id, "
        + ", ".join(f"{v} AS {f}" for f, v in value.items())
        + ", array_to_string(list_filter(["
        + ", ".join(f"CASE WHEN {t} THEN '{f}' END" for f, t in test.items())
        + "], lambda x: x IS NOT NULL), '|') AS changed FROM entity e LEFT JOIN chosen c ON e.id = c.entity_id"
    )


APPLY_PARTS = apply_sql("fill_empty").rpartition(" SELECT e.id, ")
DECIDED_PARTS = apply_sql("overwrite").replace("FROM decided d JOIN", "FROM ranked d JOIN").replace(
    "WHERE outcome = 'applied')", "WHERE d.rank = 2)"
)


@query(
    APPLY_PARTS[0] + ", done AS (SELECT e.id, " + APPLY_PARTS[2] + ") SELECT done.id AS book_id, "
    "unnest(string_split(changed, '|')) AS field, d.source FROM done JOIN decided d ON d.entity_id = done.id WHERE changed <> ''"
)
def apply_provenance(spark, d):
    return matching.applied_provenance(applied_rows(spark, d, "fill_empty")).select("book_id", "field", "source")


@query(DECIDED_PARTS)
def apply_decisions(spark, d):
    """A person takes the second candidate wherever there is one."""
    entity, queries, found = part_candidates(spark, d)
    ranked = matching.rank_candidates(matching.first_answering_source(found, schemas.DEFAULT_PROVIDER_ORDER))
    chosen = ranked.filter("rank = 2").select("entity_id", "candidate_id")
    rejected = queries.select("entity_id", V.null("string").alias("candidate_id"))
    rows = matching.apply_decisions(entity, chosen.union(rejected), found, part_manual(entity), "overwrite")
    return rows.select("id", "title", joined("authors"), *APPLY, joined("changed"))


def part_manual(entity):
    return entity.filter(F.col("p_size") > 25).select("id", F.array(F.lit("title"), F.lit("year")).alias("manual_fields"))


def applied_rows(spark, d, policy):
    entity, queries, found = part_candidates(spark, d)
    decisions = matching.decide(queries, found).filter(F.col("outcome") == "applied")
    chosen = found.drop("error").join(decisions.select("entity_id", "candidate_id"), ["entity_id", "candidate_id"])
    return matching.apply_candidates(entity, chosen, part_manual(entity), policy)


def applied(spark, d, policy):
    return applied_rows(spark, d, policy).select("id", "title", joined("authors"), *APPLY, joined("changed"))


@query(apply_sql("fill_empty"))
def apply_match(spark, d):
    return applied(spark, d, "fill_empty")


@query(apply_sql("overwrite"))
def apply_match_overwrite(spark, d):
    return applied(spark, d, "overwrite")


@query(
    PAGE_MATCH + "SELECT entity_id, rank, candidate_id, r.title, e.title AS local_title, "
    "array_to_string(e.authors, '|') AS local_authors, round(r.similarity * 100)::INTEGER AS similarity_percent "
    "FROM ranked r JOIN entity e ON e.id = entity_id WHERE entity_id IN (SELECT entity_id FROM decided WHERE "
    "outcome = 'needs_confirmation')"
)
def review_queue(spark, d):
    queries, found = page_candidates(spark, d)
    queue = matching.review_queue(V.page_entities(spark, d), matching.decide(queries, found), found)
    return queue.select(
        "entity_id", "rank", "candidate_id", "title", "local_title", joined("local_authors"), "similarity_percent"
    )


# ---- names ---------------------------------------------------------------------------------

NAME_PARTS = "p_brand || ' - ' || p_name || CASE WHEN p_size % 4 <> 0 THEN ' - ' || (p_size + 1970) ELSE '' END"


@query(
    f"WITH e AS ({S.PARTS}) SELECT id, CASE WHEN series IS NOT NULL THEN series || ' #' || CASE WHEN series_index = "
    "floor(series_index) THEN series_index::BIGINT::VARCHAR ELSE series_index::VARCHAR END || ' ' ELSE '' END || "
    f"{S.last_first('p_brand')} || ': ' || title || CASE WHEN year IS NOT NULL AND language IS NOT NULL THEN ' (' || "
    "year || ', ' || language || ')' WHEN year IS NOT NULL THEN ' (' || year || ', )' ELSE '' END || '.epub' AS name, "
    "CASE WHEN year IS NOT NULL AND language IS NULL THEN 'language' ELSE '' END AS missing FROM e"
)
def render_names(spark, d):
    template = "{series?{series} #{series_index} }{author_sort}: {title}{year? ({year}, {language})}.{ext}"
    entity = V.part_entities(spark, d).withColumn("authors", F.array("p_brand"))
    columns = ["title", "authors", "year", "series", "series_index", "isbn13", "isbn10", "language", "publisher"]
    values = naming.token_values(*[F.col(c) for c in columns], ext=F.lit("EPUB"))
    text, missing = naming.render(template, values)
    return entity.select("id", text.alias("name"), F.array_join(missing, "|").alias("missing"))


RAW_NAME = "p_brand || ': ' || p_type || '/ () - - - [ ]' || p_name || '   - .epub'"


@query(f"SELECT p_partkey, {S.sanitize(RAW_NAME, chr(39) + 'epub' + chr(39))} AS name FROM part")
def sanitize_names(spark, d):
    raw = F.concat(
        "p_brand", F.lit(": "), "p_type", F.lit("/ () - - - [ ]"), "p_name", F.lit("   - .epub")
    )
    parts = V.table(spark, d, "part")
    return naming.with_legal_name(parts, raw, F.lit("epub"), "name").select("p_partkey", "name")


FULL_NAME = S.sanitize("text || '.epub'", "'epub'")


@query(
    f"WITH n AS (SELECT doc_id, {FULL_NAME} AS name FROM documents), "
    "s AS (SELECT *, left(name, length(name) - 5) AS stem FROM n), "
    "k AS (SELECT *, list_max(list_filter(range(0, 251), lambda i: strlen(left(stem, i::INTEGER)) <= 250)) AS fit FROM s), "
    f"c AS (SELECT doc_id, CASE WHEN strlen(name) > 255 THEN {S.trim_space('left(stem, fit::INTEGER)')} || '.epub' "
    "ELSE name END AS name FROM k) SELECT doc_id, name, strlen(name)::INTEGER AS bytes FROM c"
)
def cap_names(spark, d):
    """Whole documents as names: cut to 255 bytes on a grapheme boundary."""
    documents = V.table(spark, d, "documents")
    named = naming.with_legal_name(documents, F.concat("text", F.lit(".epub")), F.lit("epub"), "name")
    return named.select("doc_id", "name", F.octet_length("name").alias("bytes"))


def part_files(spark, d):
    entity = V.part_entities(spark, d).withColumn("authors", F.array("p_brand"))
    members = entity.select(
        "id",
        F.col("id").alias("book_id"),
        F.concat(F.lit("/lib/"), "p_type", F.lit("/"), F.col("id").cast("string"), F.lit(".epub")).alias("path"),
        (F.col("p_size") % 9 == 0).alias("missing"),
    )
    # Names that are there already: "<brand> - <title> - <year>.epub" and its second copy.
    groups = entity.filter(F.col("year").isNotNull()).select("p_type", "p_brand", "title", "year").distinct()
    base = F.concat(F.lit("/lib/"), "p_type", F.lit("/"), F.concat_ws(" - ", "p_brand", "title", "year"))
    first = groups.filter("p_brand LIKE '%1%'").select(F.concat(base, F.lit(".epub")).alias("path"))
    second = groups.filter("p_type > 'P'").select(F.concat(base, F.lit(" (2).epub")).alias("path"))
    listing = members.filter(~F.col("missing")).select("path").union(first).union(second)
    return entity, members, listing


PLAN = f"""
WITH e AS ({S.PARTS}),
f AS (SELECT id AS file_id, title, '/lib/' || p_type || '/' || id || '.epub' AS current_path, p_type, p_brand, year,
             p_size % 9 = 0 AS missing, p_brand || ' - ' || title || ' - ' || year AS stem FROM e),
present AS (SELECT DISTINCT p_type, stem, p_brand LIKE '%1%' AS one, p_type > 'P' AS two FROM f
            WHERE stem IS NOT NULL),
moves AS (SELECT *, row_number() OVER (PARTITION BY p_type, lower(stem) ORDER BY current_path) AS r FROM f
          WHERE NOT missing AND stem IS NOT NULL),
slots AS (SELECT m.*, CASE WHEN two AND r + one::INTEGER >= 2 THEN r + one::INTEGER + 1 ELSE r + one::INTEGER END AS slot
          FROM moves m JOIN present USING (p_type, stem)),
plan AS (
  SELECT file_id, title, current_path, CASE WHEN slot = 1 THEN stem || '.epub'
           ELSE stem || ' (' || slot || ').epub' END AS proposed_name,
         CASE WHEN slot = 1 THEN 'ready' ELSE 'collision' END AS status, NULL AS reason, true AS included FROM slots
  UNION ALL
  SELECT file_id, title, current_path, file_id || '.epub', 'excluded', CASE WHEN missing THEN 'File is missing on disk'
         ELSE 'Missing value for {{year}}' END, false FROM f WHERE missing OR stem IS NULL)
"""


def part_plan(spark, d):
    return renames.plan_renames(*part_files(spark, d), "{author} - {title} - {year}.{ext}")


@query(PLAN + "SELECT * FROM plan")
def plan_renames(spark, d):
    return part_plan(spark, d).drop("book_id")


@query(PLAN + "SELECT status, reason, count(*) AS n FROM plan GROUP BY ALL")
def plan_summary(spark, d):
    return renames.plan_summary(part_plan(spark, d))


@query(
    PLAN + "SELECT file_id, '/lib/' || split_part(current_path, '/', 3) || '/' || proposed_name AS path, "
    "(SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY current_path) AS journal_id FROM plan WHERE included"
)
def apply_plan(spark, d):
    """Members after a plan was applied, with the number of their journal row behind the known ones."""
    _, members, _ = part_files(spark, d)
    rows = materialize(renames.actionable(part_plan(spark, d)))
    known = V.event_journal(spark, d)
    moved, journal = renames.apply_plan(members, known, rows, "batch", F.current_timestamp())
    numbers = journal.filter("batch_id = 'batch'").select(F.col("file_id").alias("id"), F.col("id").alias("journal_id"))
    return moved.join(numbers, "id").select(F.col("id").alias("file_id"), "path", "journal_id")


@query(
    f"WITH j AS ({S.JOURNAL}) SELECT batch_id, strftime(max(executed_at), {STAMP}) AS executed_at, "
    "arg_max(id, (executed_at, id)) AS last_id, count(*) AS file_count FROM j WHERE NOT reverted GROUP BY batch_id"
)
def open_batches(spark, d):
    rows = renames.open_batches(V.event_journal(spark, d))
    return rows.select("batch_id", stamp("executed_at", "executed_at"), "last_id", "file_count")


UNDO = (
    f"j AS ({S.JOURNAL}), b AS (SELECT batch_id FROM j WHERE NOT reverted ORDER BY executed_at DESC, id DESC LIMIT 1)"
)


@query(
    f"WITH {UNDO} SELECT file_id, arg_min(old_path, id) AS old_path, arg_max(new_path, id) AS new_path FROM j "
    "WHERE NOT reverted AND batch_id IN (SELECT batch_id FROM b) GROUP BY file_id"
)
def undo_batch(spark, d):
    return renames.undo_targets(V.event_journal(spark, d))


@query(
    f"WITH {UNDO} SELECT id, batch_id, reverted OR batch_id IN (SELECT batch_id FROM b) AS reverted FROM j"
)
def undo_journal(spark, d):
    journal = V.event_journal(spark, d)
    members = journal.select(F.col("file_id").alias("id"), F.col("new_path").alias("path"))
    _, flagged = renames.undo_last_batch(members, journal)
    return flagged.select("id", "batch_id", "reverted")


@query(
    f"WITH {UNDO}, r AS (SELECT file_id AS id, arg_min(old_path, id) AS old_path FROM j WHERE NOT reverted AND batch_id IN "
    "(SELECT batch_id FROM b) GROUP BY file_id) SELECT id, coalesce(old_path, '/now/' || id) AS path FROM (SELECT DISTINCT "
    "file_id AS id FROM j) LEFT JOIN r USING (id)"
)
def undo_members(spark, d):
    """Members of the last open batch go back to where they were before it."""
    journal = V.event_journal(spark, d)
    members = journal.select(F.col("file_id").alias("id")).distinct()
    members = members.withColumn("path", F.concat(F.lit("/now/"), F.col("id").cast("string")))
    restored, _ = renames.undo_last_batch(members, journal)
    return restored


# ---- views ---------------------------------------------------------------------------------


def order_catalog(spark, d):
    return V.order_entities(spark, d), V.line_members(spark, d)


FACT_COLUMNS = "n_files, formats, total_size, any_missing, all_missing"


@query(f"{S.CATALOG}, {S.FACTS} SELECT id, title, {FACT_COLUMNS} FROM facts")
def catalog_view(spark, d):
    return views.catalog_view(*order_catalog(spark, d)).select(
        "id", "title", "n_files", F.array_join("formats", ";").alias("formats"), "total_size", "any_missing", "all_missing"
    )


@query(
    f"{S.CATALOG} SELECT id, title, 0 AS part, coalesce(files, '') AS files FROM entity LEFT JOIN (SELECT book_id, "
    "string_agg(path, '|' ORDER BY path) AS files FROM member GROUP BY book_id) ON id = book_id"
)
def load_catalog(spark, d):
    paths = F.transform("files", lambda f: f["path"])
    return views.load_catalog(*order_catalog(spark, d)).select(
        "id", "title", "part", F.array_join(paths, "|").alias("files")
    )


def search_sql(needle: str) -> str:
    return (
        f"{S.CATALOG}, m AS (SELECT DISTINCT book_id FROM member WHERE contains({S.key("string_split(path, '/')[-1]")}, "
        f"'{needle}')) SELECT id, title FROM entity WHERE contains({S.key('title')}, '{needle}') OR "
        f"len(list_filter(authors, lambda a: contains({S.key('a')}, '{needle}'))) > 0 OR "
        f"contains({S.key("coalesce(series, '')")}, '{needle}') OR id IN (SELECT book_id FROM m)"
    )


@query(search_sql("7 1"))
def search(spark, d):
    return views.search(*order_catalog(spark, d), "7-1").select("id", "title")


@query(search_sql("17 1"))
def search_by_index(spark, d):
    entities, members = order_catalog(spark, d)
    folder = f"{work_folder(spark)}/search-{uuid.uuid4().hex}"
    search_index.write_index(entities, members, folder)
    index = search_index.read_index(spark, folder)
    return search_index.search(entities, members, index, "17-1").select("id", "title")


@query(f"{S.CATALOG} SELECT id FROM entity WHERE id IN (SELECT book_id FROM member WHERE format = 'pdf')")
def with_format(spark, d):
    return views.with_format(*order_catalog(spark, d), "pdf").select("id")


@query(f"{S.CATALOG} SELECT id FROM entity WHERE metadata_status = 'partial'")
def with_status(spark, d):
    return views.with_status(V.order_entities(spark, d), "partial").select("id")


@query(f"{S.CATALOG} SELECT id FROM entity WHERE metadata_status <> 'complete'")
def needs_resolution(spark, d):
    return matching.needs_resolution(V.order_entities(spark, d)).select("id")


@query(f"{S.CATALOG} SELECT id FROM entity WHERE id IN (SELECT book_id FROM member WHERE missing)")
def missing_filter(spark, d):
    return views.with_missing_member(*order_catalog(spark, d)).select("id")


@query(
    f"{S.CATALOG} SELECT id FROM entity WHERE id IN (SELECT book_id FROM member GROUP BY book_id HAVING bool_and(missing))"
)
def all_missing_filter(spark, d):
    return views.all_members_missing(*order_catalog(spark, d)).select("id")


@query(f"{S.CATALOG} SELECT id FROM entity WHERE group_method = 'filename'")
def auto_grouped(spark, d):
    return views.auto_grouped(V.order_entities(spark, d)).select("id")


@query(
    f"{S.CATALOG} SELECT id FROM entity WHERE id IN (SELECT book_id FROM member GROUP BY book_id, format HAVING count(*) > 1)"
)
def duplicate_formats(spark, d):
    return views.duplicate_formats(*order_catalog(spark, d)).select("id")


@query(
    f"{S.CATALOG}, {S.FACTS} SELECT id, array_to_string(list_filter([CASE WHEN metadata_status = 'unresolved' THEN "
    "'unresolved' END, CASE WHEN group_method = 'filename' THEN 'auto_grouped' END, CASE WHEN any_missing THEN "
    "'missing' END, CASE WHEN parse_error_note IS NOT NULL THEN 'parse_note' END], lambda c: c IS NOT NULL), '|') AS chips "
    "FROM facts"
)
def review_chips(spark, d):
    return views.chips(views.catalog_view(*order_catalog(spark, d))).select("id", joined("chips"))


def sorted_query(by: str, ascending: bool):
    def run(spark, d):
        view = views.catalog_view(*order_catalog(spark, d))
        rows = views.sort_view(view, by, ascending).select("id", "title_sort", "author_sort", "total_size")
        return number_in_order(rows, "position")

    return run


for _by, _ascending, _order in [
    ("title", True, "title_sort NULLS FIRST, id"),
    ("author", False, "author_sort DESC NULLS LAST, title_sort DESC NULLS LAST, id DESC"),
    ("year", True, "coalesce(year, 0), title_sort NULLS FIRST, id"),
    ("date_added", False, "created_at DESC NULLS LAST, id DESC"),
    ("size", True, "total_size, id"),
]:
    QUERIES[f"sorted_by_{_by}"] = sorted_query(_by, _ascending)
    ORACLE[f"sorted_by_{_by}"] = (
        f"{S.CATALOG}, {S.FACTS} SELECT id, title_sort, author_sort, total_size, row_number() OVER (ORDER BY {_order}) "
        "AS position FROM facts"
    )


@query(
    f"{S.CATALOG}, {S.FACTS} SELECT count(*) AS entities, sum(n_files)::BIGINT AS files, sum(total_size)::BIGINT AS bytes "
    "FROM facts WHERE id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"
)
def selection_summary(spark, d):
    chosen = V.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return views.selection_summary(views.selection(views.catalog_view(*order_catalog(spark, d)), chosen))


PREVIEW_NAME = "(coalesce(authors[1], '') || ' - ' || title || '.' || string_split(path, '.')[-1])"


@query(
    f"{S.CATALOG}, first AS (SELECT e.*, m.path FROM entity e JOIN (SELECT book_id, min(path) AS path FROM member "
    "GROUP BY book_id) m ON id = book_id ORDER BY title_sort, id LIMIT 3) SELECT id, string_split(path, '/')[-1] AS "
    f"current_name, {S.sanitize(PREVIEW_NAME, "string_split(path, '.')[-1]")} AS proposed, "
    "CASE WHEN len(authors) = 0 THEN 'author' ELSE '' END AS tokens FROM first"
)
def template_preview(spark, d):
    rows = views.template_preview(*order_catalog(spark, d), "{author} - {title}.{ext}")
    return rows.select("id", "current_name", "proposed", joined("tokens"))


# ---- whole refresh and snapshots -----------------------------------------------------------


def document_metadata(spark, d):
    files = V.document_files(spark, d)
    listing = files.select(
        "path", X.extension(F.col("path")).alias("format"), "size_bytes", F.timestamp_seconds(F.lit(0)).alias("modified_at")
    )
    authors = F.when(F.col("author_key").isNotNull(), F.array("author_key")).otherwise(F.array().cast("array<string>"))
    metadata = files.select(
        "path",
        "title",
        authors.alias("authors"),
        V.null("string").alias("series"),
        V.null("double").alias("series_index"),
        V.null("string").alias("publisher"),
        V.null("int").alias("year"),
        V.null("string").alias("language"),
        V.null("string").alias("isbn10"),
        "isbn",
        V.null("string").alias("description"),
        V.null("string").alias("parse_error_note"),
    ).withColumnRenamed("isbn", "isbn13")
    return listing, metadata


def empty_catalog(spark):
    return Catalog(*[spark.createDataFrame([], s) for s in (schemas.ENTITY, schemas.MEMBER, schemas.PROVENANCE)])


REFRESHED = RESOLVED + """,
first AS (
  SELECT component, any_value(method) AS group_method, arg_min(title, f.path) AS title,
         coalesce(arg_min(f.author_key, f.path) FILTER (f.author_key IS NOT NULL), '') AS authors,
         arg_min(f.isbn, f.path) AS isbn13
  FROM resolved JOIN f ON f.path = resolved.path GROUP BY component),
numbered AS (SELECT *, row_number() OVER (ORDER BY component) AS id FROM first)
"""


@query(
    REFRESHED + "SELECT id, title, authors, isbn13, CASE WHEN authors = '' THEN 'unresolved' ELSE 'complete' END AS "
    "metadata_status, group_method FROM numbered"
)
def refresh_entities(spark, d):
    """First refresh of an empty catalog from the document files."""
    result = refresh_catalog(*document_metadata(spark, d), empty_catalog(spark))
    return result.catalog.entity.select("id", "title", joined("authors"), "isbn13", "metadata_status", "group_method")


@query(
    REFRESHED + "SELECT id AS book_id, 'title' AS field, CASE WHEN title IS NULL THEN 'filename' ELSE 'embedded' END AS "
    "source FROM numbered UNION ALL SELECT id, 'authors', 'embedded' FROM numbered WHERE authors <> '' "
    "UNION ALL SELECT id, 'isbn13', 'embedded' FROM numbered WHERE isbn13 IS NOT NULL"
)
def refresh_provenance(spark, d):
    """Where the fields of new entities come from."""
    result = refresh_catalog(*document_metadata(spark, d), empty_catalog(spark))
    return result.catalog.provenance.select("book_id", "field", "source")


@query(
    REFRESHED + "SELECT r.path, n.id AS book_id, row_number() OVER (ORDER BY r.path) AS id, f.lang = 'de' AS missing "
    "FROM resolved r JOIN numbered n ON n.component = r.component JOIN (SELECT f.path, d.lang FROM f JOIN documents d "
    "USING (doc_id)) f ON f.path = r.path"
)
def refresh_again(spark, d):
    """Second refresh, after all German files have gone: ids stay, the members are marked missing."""
    listing, metadata = document_metadata(spark, d)
    first = refresh_catalog(listing, metadata, empty_catalog(spark)).catalog
    saved = Catalog(*[materialize(t) for t in (first.entity, first.member, first.provenance)])
    result = refresh_catalog(listing.filter("path NOT LIKE '/lib/de/%'"), metadata, saved)
    return result.catalog.member.select("path", "book_id", "id", "missing")


@query(
    REFRESHED + "SELECT r.path, n.id AS book_id, row_number() OVER (ORDER BY r.path) AS id, f.lang = 'de' AS missing, "
    "n.group_method FROM resolved r JOIN numbered n ON n.component = r.component JOIN (SELECT f.path, d.lang FROM f JOIN "
    "documents d USING (doc_id)) f ON f.path = r.path"
)
def refresh_touched(spark, d):
    """All German files have gone and the French ones were saved again: only their entities are resolved."""
    listing, metadata = document_metadata(spark, d)
    first = refresh_catalog(listing, metadata, empty_catalog(spark)).catalog
    saved = Catalog(*[materialize(t) for t in (first.entity, first.member, first.provenance)])
    again = F.when(F.col("path").startswith("/lib/fr/"), F.timestamp_seconds(F.lit(99))).otherwise(F.col("modified_at"))
    later = listing.filter("path NOT LIKE '/lib/de/%'").withColumn("modified_at", again)
    result = refresh_catalog(later, metadata, saved, only_touched=True).catalog
    methods = result.entity.select(F.col("id").alias("book_id"), "group_method")
    return result.member.select("path", "book_id", "id", "missing").join(methods, "book_id")


@query(RESOLVED + "SELECT f.path, f.isbn AS embedded_isbn FROM f")
def refresh_partial(spark, d):
    """Extraction fails for the German files in the first run; the second run reads them after all."""
    listing, metadata = document_metadata(spark, d)
    first = refresh_catalog(listing, metadata.filter("path NOT LIKE '/lib/de/%'"), empty_catalog(spark)).catalog
    saved = Catalog(*[materialize(t) for t in (first.entity, first.member, first.provenance)])
    return refresh_catalog(listing, metadata, saved).catalog.member.select("path", "embedded_isbn")


@query(
    RESOLVED + "SELECT f.path, 'pin' AS manual_group_id, min(f.path) OVER () AS first_path FROM f JOIN documents USING "
    "(doc_id) WHERE documents.lang = 'fr'"
)
def refresh_overrides(spark, d):
    """A person has put all French files together before the first run sees them."""
    listing, metadata = document_metadata(spark, d)
    pins = listing.filter("path LIKE '/lib/fr/%'").select("path", F.lit("pin").alias("manual_group_id"))
    member = materialize(refresh_catalog(listing, metadata, empty_catalog(spark), pins).catalog.member)
    first = member.groupBy("book_id").agg(F.min("path").alias("first_path"))
    return member.filter("manual_group_id IS NOT NULL").join(first, "book_id").select("path", "manual_group_id", "first_path")


@query(
    f"WITH m AS ({S.MEMBER}) SELECT book_id, '/new' || substr(path, 5) AS path, format, size_bytes, missing FROM m"
)
def snapshot_restore(spark, d):
    """A snapshot written under one root and restored into an empty catalog under another."""
    entities, members = order_catalog(spark, d)
    tables = {
        "entity": entities,
        "member": members,
        "provenance": provenance.latest(V.event_provenance(spark, d), ["event_id"]),
        "rename_journal": V.event_journal(spark, d),
    }
    folder = f"{work_folder(spark)}/store-{uuid.uuid4().hex}"
    store.write_snapshot(tables, folder, 1, "/lib")
    empty = {name: table.limit(0) for name, table in tables.items()}
    restored, _ = store.restore_if_empty(spark, empty, folder, "/new")
    return restored["member"].select("book_id", "path", "format", "size_bytes", "missing")


@query(
    PLAN + ", again AS (SELECT *, status = 'ready' AND p_brand LIKE '%2%' AS stale FROM plan JOIN (SELECT file_id, "
    "p_brand, p_type, stem FROM f) USING (file_id) WHERE included), used AS (SELECT p_type, stem, max(CASE WHEN status = "
    "'ready' THEN 1 ELSE regexp_extract(proposed_name, '\\(([0-9]+)\\)\\.epub$', 1)::INTEGER END) AS top FROM again "
    "GROUP BY ALL), p AS (SELECT DISTINCT p_type, stem, two FROM present) "
    "SELECT file_id, CASE WHEN NOT stale THEN proposed_name ELSE stem || ' (' || CASE WHEN top > 1 THEN top + 1 "
    "WHEN two THEN 3 ELSE 2 END || ').epub' END AS proposed_name, CASE WHEN stale THEN 'collision' ELSE status END AS status "
    "FROM again JOIN used USING (p_type, stem) JOIN p USING (p_type, stem)"
)
def recheck_plan(spark, d):
    """A plan applied late: meanwhile every plain name of some brands has been taken."""
    _, _, listing = part_files(spark, d)
    rows = materialize(renames.actionable(part_plan(spark, d)))
    ready = rows.filter("status = 'ready' AND proposed_name LIKE 'Brand#%2% - %' AND split(proposed_name, ' - ')[0] LIKE '%2%'")
    appeared = ready.select(renames.target_path().alias("path"))
    return renames.recheck_plan(rows, listing.union(appeared)).select("file_id", "proposed_name", "status")


# ---- export --------------------------------------------------------------------------------


EXPORT_SQL = (
    f"{S.CATALOG}, m AS (SELECT book_id, string_agg(format, ';' ORDER BY format) AS formats, string_agg(path, '; ' "
    "ORDER BY path) AS files, sum(size_bytes)::BIGINT AS total FROM member GROUP BY book_id) "
    "SELECT id, 0 AS part, title, array_to_string(authors, '; ') AS authors, coalesce(series, '') AS series, "
    "coalesce(CASE WHEN series_index = floor(series_index) THEN series_index::BIGINT::VARCHAR ELSE "
    "series_index::VARCHAR END, '') AS series_index, coalesce(publisher, '') AS publisher, coalesce(year::VARCHAR, '') "
    "AS year, '' AS language, '' AS isbn10, '' AS isbn13, coalesce(formats, '') AS formats, coalesce(files, '') AS files, "
    "coalesce(total, 0)::VARCHAR AS total_size_bytes, metadata_status, group_method FROM entity LEFT JOIN m ON id = book_id"
)


@query(EXPORT_SQL)
def export_rows_csv(spark, d):
    return export.csv_rows(*order_catalog(spark, d))


@query(EXPORT_SQL + " WHERE id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def export_selection(spark, d):
    chosen = V.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return export.csv_rows(*order_catalog(spark, d), scope=chosen)


@query(
    f"{S.CATALOG}, p AS ({S.PROVENANCE}), last AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY book_id, field "
    "ORDER BY fetched_at DESC, event_id DESC) = 1), l AS (SELECT book_id, string_agg(field || '=' || source || '@' || "
    "strftime(fetched_at, '%Y-%m-%dT%H:%M:%SZ'), '|' ORDER BY field) AS provenance FROM last GROUP BY book_id), "
    "m AS (SELECT book_id, string_agg(path || '=' || format || '=' || size_bytes || '=' || missing, '|' ORDER BY path) AS files "
    "FROM member GROUP BY book_id) SELECT id, 0 AS part, title, array_to_string(authors, '|') AS authors, metadata_status, "
    "coalesce(files, '') AS files, coalesce(provenance, '') AS provenance FROM entity LEFT JOIN m ON m.book_id = id "
    "LEFT JOIN l ON l.book_id = id"
)
def export_rows_json(spark, d):
    """The JSON text of every row, read again."""
    entities, members = order_catalog(spark, d)
    records = provenance.latest(V.event_provenance(spark, d), ["event_id"])
    rows = export.json_rows(entities, members, records)
    fields = F.struct(*[c for c in rows.columns if c != "id"])
    parsed = rows.select("id", F.from_json(F.to_json(fields), rows.drop("id").schema).alias("j"))
    text = lambda *parts: F.concat(*[p.cast("string") if i % 2 == 0 else F.lit(p) for i, p in enumerate(parts)])
    files = F.transform("j.files", lambda f: text(f["path"], "=", f["format"], "=", f["size_bytes"], "=", f["missing"]))
    sources = F.transform(
        F.array_sort(F.map_entries("j.provenance")),
        lambda e: text(e["key"], "=", e["value"]["source"], "@", e["value"]["fetched_at"]),
    )
    return parsed.select(
        "id",
        "j.part",
        "j.title",
        F.array_join("j.authors", "|").alias("authors"),
        "j.metadata_status",
        F.array_join(files, "|").alias("files"),
        F.coalesce(F.array_join(sources, "|"), F.lit("")).alias("provenance"),
    )


@query(f"{S.CATALOG} SELECT 1 AS schema_version, count(*) AS book_count FROM entity")
def export_manifest(spark, d):
    return export.manifest(V.order_entities(spark, d)).drop("exported_at")


# ---- feeds and tags ------------------------------------------------------------------------


def volume_responses(spark, d):
    """One volumes response per site, built from all of its pages; sites with a page in German send junk."""
    info = F.struct(
        F.when(F.length("title") > 20, F.col("title")).alias("title"),
        "authors",
        F.col("language").alias("publisher"),
        F.concat(F.lit("June "), F.col("id") + 1000).alias("publishedDate"),
        F.array(
            F.struct(F.lit("ISBN_13").alias("type"), F.coalesce("isbn13", F.lit("none")).alias("identifier")),
            F.struct(F.lit("OTHER").alias("type"), F.format_string("%010d", "id").alias("identifier")),
        ).alias("industryIdentifiers"),
        "language",
        F.struct(F.when(F.col("isbn13").isNotNull(), F.col("url")).alias("large"), F.concat(F.lit("http://t/"), F.col("id").cast("string")).alias("thumbnail")).alias("imageLinks"),
    )
    item = F.struct(F.col("id").cast("string").alias("id"), info.alias("volumeInfo"))
    body = F.to_json(F.struct(F.array(item).alias("items")))
    junk = F.col("language") == "de"
    return V.page_entities(spark, d).select(
        F.col("id").alias("entity_id"),
        F.col("title").alias("query_title"),
        F.when(junk, F.substring(body, F.lit(1), F.length(body) - 3)).otherwise(body).alias("body"),
    )


@query(
    f"WITH p AS ({S.PAGES}) SELECT id AS entity_id, 'gb-' || id AS candidate_id, title, site AS authors, CASE WHEN "
    "id + 1000 BETWEEN 1000 AND 2999 THEN (id + 1000)::INTEGER END AS year, language AS publisher, "
    "lpad(id::VARCHAR, 10, '0') AS isbn10, isbn13, CASE WHEN isbn13 IS NOT NULL THEN replace(url, 'http://', 'https://') "
    "ELSE 'https://t/' || id END AS cover_url, "
    f"CASE WHEN len({S.words('title')}) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS similarity FROM p WHERE length(title) > 20 AND language <> 'de'"
)
def volumes_feed(spark, d):
    rows = providers.volumes_candidates(volume_responses(spark, d))
    return rows.select(
        "entity_id", "candidate_id", "title", joined("authors"), "year", "publisher", "isbn10", "isbn13", "cover_url", "similarity"
    )


def work_responses(spark, d):
    doc = F.struct(
        F.concat(F.lit("/works/"), F.col("id").cast("string")).alias("key"),
        F.when(F.length("title") > 20, F.col("title")).alias("title"),
        F.col("authors").alias("author_name"),
        (F.col("id") + 1000).cast("int").alias("first_publish_year"),
        F.array("language", "title").alias("publisher"),
        # The last identifier is the 21st and must not count.
        F.concat(
            F.array_repeat(F.lit("junk"), 19),
            F.array(F.coalesce("isbn13", F.lit("none")), F.lit("0000000019")),
        ).alias("isbn"),
        F.array("language").alias("language"),
        F.when(F.col("isbn13").isNotNull(), F.col("id")).alias("cover_i"),
    )
    return V.page_entities(spark, d).select(
        F.col("id").alias("entity_id"),
        F.lit(None).cast("string").alias("query_title"),
        F.to_json(F.struct(F.array(doc).alias("docs"))).alias("body"),
    )


@query(
    f"WITH p AS ({S.PAGES}) SELECT id AS entity_id, 'ol-/works/' || id AS candidate_id, title, site AS authors, "
    "(id + 1000)::INTEGER AS year, language AS publisher, language, NULL::VARCHAR AS isbn10, isbn13, CASE WHEN isbn13 IS NOT "
    "NULL THEN 'https://covers.openlibrary.org/b/id/' || id || '-L.jpg' END AS cover_url, 1.0::DOUBLE AS similarity "
    "FROM p WHERE length(title) > 20"
)
def works_feed(spark, d):
    rows = providers.works_candidates(work_responses(spark, d))
    return rows.select(
        "entity_id", "candidate_id", "title", joined("authors"), "year", "publisher", "language", "isbn10", "isbn13", "cover_url", "similarity"
    )


LINKS = "regexp_extract_all(html, '<a href=\"/([^\"]*)\"', 1)"


@query(
    f"WITH p AS ({S.PAGES}), l AS (SELECT *, {LINKS} AS links FROM p), "
    f"t AS (SELECT *, list_filter(list_transform(links, lambda x: {S.trim_space('x')}), lambda x: x <> '') AS names FROM l) "
    f"SELECT url AS path, CASE WHEN len(names) > 0 THEN names[-1] ELSE nullif({S.trim_space('title')}, '') END AS title, "
    "array_to_string(names, '|') AS authors, nullif(language, '') AS language, names[1] AS publisher, "
    "CASE WHEN id + 1000 BETWEEN 1000 AND 2999 THEN (id + 1000)::INTEGER END AS year, "
    "isbn13 FROM t"
)
def tag_fold(spark, d):
    """Pages as tagged records: links are creators, the last link is the updated title."""
    pages = V.page_entities(spark, d)
    links = F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1))
    tag = lambda name, value: F.array(F.struct(F.lit(name).alias("tag"), value.cast("string").alias("value")))
    many = lambda name: F.transform(links, lambda v: F.struct(F.lit(name).alias("tag"), v.alias("value")))
    tags = F.concat(
        tag("title", F.col("title")),
        many("creator"),
        many("101"),
        many("503"),
        tag("language", F.col("language")),
        tag("106", F.lit("someday")),
        tag("date", F.concat(F.lit("in "), F.col("id") + 1000)),
        tag("identifier", F.concat(F.lit("urn:uuid:"), F.md5("url"))),
        tag("isbn", F.coalesce("isbn13", F.lit("?"))),
    )
    # A page is one file of the catalog even when its address occurs twice.
    rows = pages.select(
        F.concat("url", F.lit("!"), F.col("id").cast("string")).alias("path"), F.posexplode(tags).alias("ord", "t")
    ).select("path", "ord", "t.tag", "t.value")
    folded = tagged.fold_tags(rows)
    return folded.select(
        F.regexp_replace("path", r"![0-9]+$", "").alias("path"), "title", joined("authors"), "language", "publisher", "year", "isbn13"
    )


@query(
    f"WITH p AS ({S.PAGES}) SELECT id, nullif({S.trim_space('language')}, '') AS publisher, "
    "'site ' || site AS title, site || '|' || language AS authors, '2001' || '' AS year_text, 2001 AS year, "
    "isbn13, language || ' series' AS series, id / 2 AS series_index FROM p"
)
def package_metadata(spark, d):
    """Package documents written from the pages and read back."""
    from folioframe.sources.packages import package_metadata as read

    dc = lambda name, value: F.concat(F.lit(f"<dc:{name}>"), value, F.lit(f"</dc:{name}>"))
    meta = lambda name, value: F.concat(F.lit(f'<meta name="{name}" content="'), value.cast("string"), F.lit('"/>'))
    pages = V.page_entities(spark, d)
    site = F.col("authors")[0]
    opf = F.concat(
        F.lit('<package xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf"><metadata>'),
        dc("title", F.concat(F.lit("site "), site)),
        dc("title", F.lit("second")),
        dc("creator", site),
        dc("creator", F.concat(F.lit("  "), "language", F.lit(" "))),
        dc("publisher", F.col("language")),
        dc("date", F.lit("someday")),
        dc("date", F.lit("2001-05-06")),
        dc("identifier", F.concat(F.lit("urn:uuid:"), F.md5("url"))),
        F.lit('<dc:identifier opf:scheme="ISBN">'),
        F.coalesce("isbn13", F.lit("none")),
        F.lit("</dc:identifier>"),
        meta("calibre:series", F.lit("first")),
        meta("calibre:series", F.concat("language", F.lit(" series"))),
        meta("calibre:series_index", F.col("id") / 2),
        F.lit("</metadata></package>"),
    )
    documents = pages.select(
        F.col("id").cast("string").alias("path"), opf.alias("opf"), V.null("string").alias("parse_error_note")
    )
    return read(documents).select(
        F.col("path").cast("long").alias("id"),
        "publisher",
        "title",
        joined("authors"),
        F.lit("2001").alias("year_text"),
        "year",
        "isbn13",
        "series",
        "series_index",
    )


# ---- change events -------------------------------------------------------------------------


@query(
    "WITH e AS (SELECT user_id AS root, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= "
    "INTERVAL 1 HOUR THEN 0 ELSE 1 END AS starts FROM events), b AS (SELECT *, sum(starts) OVER (PARTITION BY root "
    "ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM e) "
    f"SELECT root, strftime(min(ts), {STAMP}) AS started_at, strftime(max(ts), {STAMP}) AS last_at, count(*) AS n_events "
    "FROM b GROUP BY root, burst"
)
def change_bursts(spark, d):
    events = V.table(spark, d, "events").select(F.col("user_id").alias("root"), "ts")
    rows = watch.change_bursts(events, 3600)
    return rows.select("root", stamp("started_at", "started_at"), stamp("last_at", "last_at"), "n_events")
