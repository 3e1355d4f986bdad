"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept and returns documents; the last
one adds its schedule. Every row is judged by itself, also where rows share an id or have none (see ``_keyed``). Names of
extra columns are free.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import circulant_minhash, compression_toxicity, curriculum, line_spread, template_decontamination
from folioframe.llm.fitting import fold, free_name
from folioframe.operators.ranking import number_rows
from folioframe.session import configure, work_folder


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key for each row, and the key's name.

    Where ids are known and differ they are the keys. Otherwise rows are numbered by id, those without one last, so that
    the smallest key of a group is a row with its smallest id.
    """
    key = free_name(docs.columns, "_row")
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col("doc_id").isNull())
    if odd.isEmpty():
        return docs.withColumn(key, F.col("doc_id")), key
    last, text = (free_name([*docs.columns, key], n) for n in ("_last", "_text"))
    ordered = docs.withColumns({last: F.col("doc_id").isNull(), text: F.xxhash64("text")})
    return number_rows(ordered, [last, "doc_id", text], key).drop(last, text), key


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose score is 0.7 or more."""
    configure(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = compression_toxicity.train(docs, labels, fold("doc_id", 3) != 1)
    return compression_toxicity.kept(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove boilerplate lines from the texts; every document stays."""
    configure(spark)
    own = {c: free_name([*docs.columns, "n_lines", "n_removed"], c) for c in docs.columns if c in ("n_lines", "n_removed")}
    cleaned = line_spread.remove_boilerplate(docs.withColumnsRenamed(own))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn(
            "n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        )
    return cleaned.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group, that with the smallest id."""
    configure(spark)
    keyed, key = _keyed(docs)
    found = circulant_minhash.near_duplicates(keyed, id_column=key)
    dropped = found.filter(~F.col("kept")).select(F.col("doc_id").alias(key))
    return keyed.join(dropped, key, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which a benchmark item is found."""
    configure(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed, key = _keyed(docs)
    found = template_decontamination.contaminated(keyed, benchmark, id_column=key).select(F.col("doc_id").alias(key))
    return keyed.join(found.distinct(), key, "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each reading of a document, with ``position``, ``reading`` (1 or 2) and ``taken`` words.

    They replace columns of these names.
    """
    configure(spark)
    keyed, key = _keyed(docs)
    mixed = curriculum.mix(keyed, id_column=key).filter(F.col("taken") > 0)
    first = F.least("taken", "size")
    entry = free_name(docs.columns, "_reading")
    readings = mixed.select(
        F.col("doc_id").alias(key),
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("reading"), F.col("first_position").alias("position"), first.alias("taken")),
                F.struct(
                    F.lit(2).alias("reading"),
                    F.col("second_position").alias("position"),
                    (F.col("taken") - first).alias("taken"),
                ),
            )
        ).alias(entry),
    ).filter(F.col(f"{entry}.taken") > 0)
    schedule = ["position", "reading", "taken"]
    order = ["position", "doc_id", "reading"]
    return (
        keyed.join(readings, key)
        .select(*[c for c in docs.columns if c not in schedule], *[F.col(f"{entry}.{c}").alias(c) for c in schedule])
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

# The classifier and the near-duplicate stage have no SQL; a test compares run() with the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet and read as the next stage's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{work_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
