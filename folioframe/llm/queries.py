"""One registered query for each operator, over its whole table, and the SQL that checks it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import circulant_minhash, compression_toxicity, curriculum, exact_dedup, line_spread, pairwise_quality, ppm_language, substring_dedup, table_clustering, template_decontamination, token_alignment, token_counts, warc
from folioframe.llm.fitting import fold
from folioframe.session import work_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), window=50)
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50),
windows AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM starts),
firsts AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, p + unnest(range(0, 50)) AS i FROM windows JOIN firsts USING (h) WHERE least < doc_id),
lists AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(coalesce(g, [])) AS n_removed,
       sha256(array_to_string(CASE WHEN g IS NULL THEN w
              ELSE [x FOR x, i IN w IF NOT list_contains(g, i)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id)
"""

def op2_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{work_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(_table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS x FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS keep FROM h)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string([
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((
           ('0x' || x[1 + 5 * (i // 4):5 + 5 * (i // 4)])::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT]
         FOR i IN range(0, 32)], '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM g
"""


def op3_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.remove_boilerplate(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", "text"
    )


OP3_SQL = """
WITH l AS (SELECT source, trim(unnest(string_split(text, chr(10)))) AS line FROM documents WHERE source IS NOT NULL),
wide AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT list(line) AS gone FROM wide),
k AS (SELECT doc_id, text, lines,
      list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), trim(x))) AS kept FROM d, w)
SELECT doc_id, coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(kept), 0) AS n_removed,
       array_to_string(kept, chr(10)) AS text
FROM k
"""


def op4_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = ppm_language.train(docs, fold("doc_id", 4) != 2)
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return ppm_language.identified(docs, model).select("doc_id", held_out, "lang_pred", "score")


def op5_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = pairwise_quality.train(docs, labels, fold("doc_id", 4) != 2)
    return pairwise_quality.scored(docs, model).select(
        "doc_id",
        F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_decontamination.contaminated(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                           'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum.mix(_table(spark, sf_dir, "documents"))
    return mixed.withColumns(
        {"target": F.round("target", 3), "first_position": F.round("first_position", 6)}
    ).drop("source", "second_position")


OP8_SQL = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size, md5(coalesce(doc_id::VARCHAR, '')) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, (place % 3) AS pattern, [3.0, 1.0, 2.0][(place % 3) + 1]::DOUBLE AS weight FROM s),
r AS (SELECT *, 2.0 * source_size / weight AS ratio,
             1.5 * sum(source_size) OVER () AS total FROM w),
c AS (SELECT *, coalesce(sum(2.0 * source_size) OVER b, 0) AS full_before,
             sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS free_weight
      FROM r WINDOW b AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((total - full_before) / free_weight, (ratio, place)) AS level FROM c
      WHERE (total - full_before) / free_weight <= ratio),
t AS (SELECT source, source_size, pattern, least(weight * level, 2.0 * source_size) AS target FROM w, l),
p AS (SELECT doc_id, size, source_size, target, pattern,
             (sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, greatest(least(floor(target)::BIGINT - before, size), 0) AS once,
             greatest(least(floor(target)::BIGINT - source_size - before, size), 0) AS again,
             before / target AS share FROM p)
SELECT doc_id, size, source_size, round(target, 3) AS target, (once + again)::BIGINT AS taken,
       CASE WHEN once > 0 THEN round(least(greatest(
         CASE pattern
           WHEN 0 THEN (sqrt(greatest(2.25 - 2 * share, 0)) - 1.5) / -1
           WHEN 1 THEN (sqrt(0.25 + 2 * share) - 0.5) / 1
           ELSE CASE WHEN share < 0.5 THEN sqrt(0.5625 + 2 * share) - 0.75
                     ELSE 0.5 + (sqrt(greatest(1.5625 - 2 * (share - 0.5), 0)) - 1.25) / -1 END
         END, 0), 1), 6) END AS first_position
FROM k
"""


def op9_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = compression_toxicity.train(docs, labels, fold("doc_id", 3) != 1)
    return compression_toxicity.scored(docs, model).select(
        "doc_id",
        F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op10_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant_minhash.near_duplicates(_table(spark, sf_dir, "documents"))


_LOWER_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x20\x09-\x0D]+')"
)

OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
          THEN [array_to_string(w[p:p + 4], ' ') FOR p IN range(1, len(w) - 3)]
          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
      GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE 100 * k >= 75 * (na.n + nb.n - k)),
r AS (SELECT doc_id AS a, doc_id AS z FROM documents
      UNION SELECT r.a, e.b FROM r JOIN e ON r.z = e.a),
m AS (SELECT a, min(z) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.a = d.doc_id
"""


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.link_statistics(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_table_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table_clustering.cluster(_table(spark, sf_dir, "embeddings"))
    # One row for each of 16 centroids.
    return found.vectors.join(F.broadcast(found.clusters), "cluster").select(
        "vec_id",
        "cluster",
        "distance",
        "cluster_inertia",
        "inertia",
        F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"),
    )


def _clustering_sql(rounds: int) -> str:
    """The rounds written out: centroids c0, assignments a0, centroids c1, ..."""
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"""d{r} AS (SELECT n, cluster, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance
              FROM v, c{r}),
a{r} AS (SELECT n, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM d{r} GROUP BY n),"""
        )
        if r < rounds:
            steps.append(
                f"""s{r} AS (SELECT cluster, i, sum(x[i])::BIGINT AS s, count(*) AS k
              FROM a{r} JOIN v USING (n), (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
m{r} AS (SELECT cluster, list((s - ((s % k + k) % k)) // k ORDER BY i) AS c FROM s{r} GROUP BY cluster),
c{r + 1} AS (SELECT cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster)),"""
            )
    return "\n".join(steps)


OP13_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x
           FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) - 1 AS cluster, x AS c FROM v
       QUALIFY cluster < 16),
{_clustering_sql(3)}
t AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a3 GROUP BY cluster)
SELECT vec_id, cluster::INT AS cluster, distance, cluster_inertia, (SELECT sum(distance)::BIGINT FROM a3) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN v USING (n) JOIN t USING (cluster) JOIN c3 USING (cluster)
"""


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_warc_roundtrip": op2_warc_roundtrip,
    "op3_line_spread": op3_line_spread,
    "op4_ppm_language": op4_ppm_language,
    "op5_pairwise_quality": op5_pairwise_quality,
    "op6_template_decontamination": op6_template_decontamination,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_curriculum_mix": op8_curriculum_mix,
    "op9_compression_toxicity": op9_compression_toxicity,
    "op10_circulant_minhash": op10_circulant_minhash,
    "op11_token_alignment": op11_token_alignment,
    "op12_token_counts": op12_token_counts,
    "op13_table_clustering": op13_table_clustering,
}

ORACLE = {
    "op1_substring_dedup": OP1_SQL,
    "op2_warc_roundtrip": OP2_SQL,
    "op3_line_spread": OP3_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op8_curriculum_mix": OP8_SQL,
    "op10_circulant_minhash": OP10_SQL,
    "op13_table_clustering": OP13_SQL,
}
