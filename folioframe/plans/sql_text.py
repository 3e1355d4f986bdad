"""DuckDB expressions that state the row rules independently, for the value checks."""

from __future__ import annotations

# Fixed values, stated here once more so that a wrong list in the engine is noticed.
NOISE_WORDS = [
    "v1", "v2", "v3", "v4", "v5", "final", "draft", "ocr", "scan", "scanned", "retail", "ebook",
    "e-book", "edition", "ed", "revised", "copy", "new", "full", "complete", "unabridged", "www",
    "com", "org",
]

SPACE = r"[\s\p{Z}]"


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def replace(x: str, pattern: str, by: str = " ") -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def trim_space(x: str) -> str:
    return replace(x, f"^{SPACE}+|{SPACE}+$", "")


def key(x: str) -> str:
    return f"trim({replace(f'strip_accents(lower({x}))', '[^\\p{L}\\p{M}\\p{N}]+')})"


def unbracketed(x: str) -> str:
    return replace(x, r"[\(\[\{][^\)\]\}]*[\)\]\}]")


def stem_key(x: str) -> str:
    words = f"string_split({key(unbracketed(x))}, ' ')"
    return f"array_to_string(list_filter({words}, lambda w: w NOT IN ({quoted(NOISE_WORDS)})), ' ')"


def clean_stem(x: str) -> str:
    text = replace(unbracketed(x), "[._]+")
    text = replace(text, f"{SPACE}+[-–—]{SPACE}+", " - ")
    text = replace(text, SPACE + "{2,}")
    keep = f"w <> '' AND {key('w')} NOT IN ({quoted(NOISE_WORDS)})"
    return trim_space(
        f"array_to_string(list_filter(string_split({text}, ' '), lambda w: {keep}), ' ')"
    )


def words(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({key(x)}, ' '), lambda w: w <> '')))"


def jaccard(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return (
        f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN {shared}::DOUBLE / "
        f"(len({a}) + len({b}) - {shared}) ELSE 0.0 END"
    )


def title_sort(x: str) -> str:
    return f"regexp_replace(lower({trim_space(x)}), '^(the |a |an )', '')"


def last_first(x: str) -> str:
    parts = f"list_filter(string_split({x}, ' '), lambda w: w <> '')"
    return (
        f"CASE WHEN len({parts}) > 1 THEN {parts}[-1] || ', ' || "
        f"array_to_string({parts}[1:len({parts})-1], ' ') ELSE {x} END"
    )


def isbn_normalize(x: str) -> str:
    bare = f"upper({replace(replace(x, '(?i)urn:isbn:', ''), '[^0-9Xx]', '')})"
    return f"CASE WHEN length({bare}) IN (10, 13) THEN {bare} END"


def isbn_plausible(x: str) -> str:
    d = lambda i: f"(ascii(substr({x}, {i + 1}, 1)) - 48)"
    s13 = " + ".join(f"{d(i)} * {1 if i % 2 == 0 else 3}" for i in range(13))
    last = f"CASE WHEN substr({x}, 10, 1) = 'X' THEN 10 ELSE {d(9)} END"
    s10 = " + ".join(f"{d(i)} * {10 - i}" for i in range(9)) + f" + ({last})"
    return (
        f"CASE WHEN {x} IS NULL THEN NULL "
        f"WHEN len(list_distinct(string_split({x}, ''))) = 1 THEN false "
        f"WHEN regexp_full_match({x}, '[0-9]{{13}}') THEN ({s13}) % 10 = 0 "
        f"WHEN regexp_full_match({x}, '[0-9]{{9}}[0-9X]') THEN ({s10}) % 11 = 0 ELSE false END"
    )


def parse_year(x: str) -> str:
    found = f"regexp_extract({x}, '(?:^|[^0-9])([12][0-9]{{3}})(?:[^0-9]|$)', 1)"
    return f"CASE WHEN {found} <> '' THEN {found}::INTEGER END"


def status(title: str, authors: str, extra: str) -> str:
    named = f"(coalesce({trim_space(title)} <> '', false) AND len({authors}) > 0)"
    return (
        f"CASE WHEN {named} AND {extra} THEN 'complete' WHEN {named} THEN 'partial' "
        "ELSE 'unresolved' END"
    )


def sanitize(x: str, ext: str) -> str:
    name = f"translate({x}, '/:', '--')"
    for pattern, by in [
        (r"[\p{Cc}\p{Cf}]", ""),
        (SPACE + "{2,}", " "),
        (rf"\({SPACE}*\)", ""),
        (rf"\[{SPACE}*\]", ""),
        ("-( -)+", "-"),
        (SPACE + r"+\.", "."),
        (SPACE + "{2,}", " "),
        ("^[ _-]+|[ _-]+$", ""),
        (r"^\.+", ""),
    ]:
        name = replace(name, pattern, by)
    return f"CASE WHEN {name} = '' THEN 'Untitled.' || lower({ext}) ELSE {name} END"


DOCUMENT_FILES = """
SELECT doc_id, '/lib/' || lang || '/doc' || (doc_id // 3) || '_v' || (doc_id % 3 + 1) || '.' ||
       (['epub', 'pdf', 'mobi'])[doc_id % 3 + 1] AS path,
       'doc' || (doc_id // 3) || '_v' || (doc_id % 3 + 1) AS stem,
       (['epub', 'pdf', 'mobi'])[doc_id % 3 + 1] AS format, text AS title,
       CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'b'
            ELSE 'a' || ((doc_id // 6) % 7) END AS author_key,
       '978' || lpad((doc_id // 4)::VARCHAR, 9, '0') || ((doc_id // 4) % 10) AS isbn,
       n_chars AS size_bytes
FROM documents
"""

LISTINGS = """
docs AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
listing AS (
  SELECT CASE WHEN toxic = 1 THEN '/lib/moved/doc' || doc_id || '.epub'
              ELSE '/lib/' || lang || '/doc' || doc_id || '.epub' END AS path,
         n_chars + CASE WHEN quality = 0 THEN 1 ELSE 0 END AS size_bytes,
         (1700000000 + doc_id) * 1000000 + 500000 AS us FROM docs),
known AS (
  SELECT '/lib/' || lang || '/doc' || doc_id || '.epub' AS path, n_chars AS size_bytes,
         (1700000000 + doc_id) * 1000000 AS us, coalesce(quality = 0, false) AS missing FROM docs),
diff AS (
  SELECT coalesce(n.path, k.path) AS path, n.size_bytes AS size_bytes,
         k.size_bytes AS known_size_bytes, k.missing AS known_missing,
         CASE WHEN n.path IS NULL THEN 'missing' WHEN k.path IS NULL THEN 'added'
              WHEN n.size_bytes = k.size_bytes AND abs(n.us - k.us) < 1000000 THEN 'unchanged'
              ELSE 'updated' END AS change
  FROM listing n FULL JOIN known k ON n.path = k.path)
"""

ENTITY = f"""
SELECT o_orderkey AS id, 'The ' || o_orderpriority || ' ' || o_orderkey AS title,
       {title_sort("'The ' || o_orderpriority || ' ' || o_orderkey")} AS title_sort,
       CASE WHEN o_orderkey % 5 = 0 OR c_name IS NULL THEN [] ELSE [c_name] END AS authors,
       CASE WHEN o_orderkey % 5 = 0 OR c_name IS NULL THEN '' ELSE lower(c_name) END AS author_sort,
       CASE WHEN o_orderstatus = 'P' THEN c_mktsegment END AS series,
       CASE WHEN o_orderstatus = 'P' THEN (o_orderkey % 7) / 2 END AS series_index,
       c_mktsegment AS publisher,
       CASE WHEN o_orderkey % 3 <> 0 THEN year(o_orderdate)::INTEGER END AS year,
       CASE WHEN o_orderkey % 2 = 0 THEN 'covers/' || o_custkey END AS cover_path,
       CASE WHEN o_orderkey % 5 = 0 OR c_name IS NULL THEN 'unresolved'
            WHEN o_orderkey % 3 <> 0 THEN 'complete' ELSE 'partial' END AS metadata_status,
       CASE o_orderstatus WHEN 'F' THEN 'filename' WHEN 'O' THEN 'single' ELSE 'isbn' END AS group_method,
       CASE WHEN o_totalprice > 450000 THEN 'truncated' END AS parse_error_note,
       o_orderdate AS created_at
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
"""

MEMBER = """
SELECT l_orderkey AS book_id, round(l_extendedprice * 100)::BIGINT AS size_bytes,
       CASE l_returnflag WHEN 'A' THEN 'epub' WHEN 'N' THEN 'pdf' ELSE 'mobi' END AS format,
       '/lib/' || l_orderkey || '/' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' ||
       round(l_extendedprice * 100)::BIGINT || '.' ||
       CASE l_returnflag WHEN 'A' THEN 'epub' WHEN 'N' THEN 'pdf' ELSE 'mobi' END AS path,
       l_shipdate AS modified_at, l_linestatus = 'F' AS missing
FROM lineitem
"""

CATALOG = f"WITH entity AS ({ENTITY}), member AS ({MEMBER})"

FACTS = """
facts AS (SELECT e.*, coalesce(n_files, 0) AS n_files, coalesce(formats, '') AS formats,
                 coalesce(total_size, 0)::BIGINT AS total_size,
                 coalesce(any_missing, false) AS any_missing, coalesce(all_missing, false) AS all_missing
          FROM entity e LEFT JOIN (
            SELECT book_id, count(*) AS n_files, string_agg(DISTINCT format, ';' ORDER BY format) AS formats,
                   sum(size_bytes)::BIGINT AS total_size, bool_or(missing) AS any_missing,
                   bool_and(missing) AS all_missing
            FROM member GROUP BY book_id) m ON e.id = m.book_id)
"""

PROVENANCE = """
SELECT user_id AS book_id, event_type AS field, ts AS fetched_at, event_id,
       (['embedded', 'google_books', 'open_library', 'manual', 'filename'])
         [(props->>'$.k')::INTEGER % 5 + 1] AS source
FROM events
"""

JOURNAL = """
SELECT event_id AS id, strftime(ts, '%Y-%m-%d') || '/' || user_id AS batch_id,
       (props->>'$.k')::BIGINT AS file_id,
       '/lib/' || (props->>'$.k') || '/' || event_id AS old_path,
       '/lib/' || (props->>'$.k') || '/' || (event_id + 1) AS new_path, ts AS executed_at,
       event_type = 'error' AS reverted
FROM events
"""

PAGES = """
SELECT page_id AS id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
       regexp_extract(url, '://([^/?#]+)', 1) AS site,
       regexp_extract(html, 'lang="([a-z]+)"', 1) AS language,
       CASE WHEN page_id % 3 = 0 THEN '978' || lpad((page_id // 6)::VARCHAR, 10, '0') END AS isbn13,
       CASE WHEN url LIKE 'https%' THEN 'google_books' ELSE 'open_library' END AS source, url, html
FROM pages
"""

PARTS = """
SELECT p_partkey AS id, p_name AS title, CASE WHEN p_size % 5 = 0 THEN [] ELSE [p_brand] END AS authors,
       CASE WHEN p_size > 25 THEN p_type END AS series, CASE WHEN p_size > 25 THEN p_size / 2 END AS series_index,
       CASE WHEN p_size % 2 = 0 THEN p_brand END AS publisher,
       CASE WHEN p_size % 4 <> 0 THEN p_size + 1970 END AS year,
       CASE WHEN p_size % 3 = 0 THEN lower(p_type) END AS language,
       CASE WHEN p_size % 7 = 0 THEN '978' || lpad(p_partkey::VARCHAR, 10, '0') END AS isbn13,
       CASE WHEN p_size % 6 = 0 THEN p_brand || ' ' || p_name || ' ' || p_type END AS description,
       CASE WHEN p_size % 8 = 0 THEN 'covers/' || p_partkey END AS cover_path,
       p_type, p_brand, p_size, p_retailprice
FROM part
"""

TURNS = """
SELECT conv_id AS entity_id, turn, CASE WHEN role = 'user' THEN text END AS title,
       CASE WHEN role = 'assistant' THEN [role, text] ELSE [] END AS authors,
       CASE WHEN role = 'system' THEN turn / 2 END AS series_index,
       CASE WHEN role = 'assistant' THEN text END AS publisher,
       CASE WHEN role <> 'system' THEN (turn + 2000)::INTEGER END AS year,
       CASE WHEN role = 'system' THEN text END AS language,
       CASE WHEN role <> 'user' THEN text END AS description,
       CASE WHEN role = 'assistant' THEN 'note ' || turn END AS parse_error_note
FROM conversations
"""
