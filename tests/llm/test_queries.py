"""Registered queries of the subpackage against their SQL, and the pipeline."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioframe.llm import circulant_minhash, compression_toxicity, curriculum, queries, template_decontamination
from folioframe.llm.fitting import fold

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "embeddings"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_values(spark, db, name):
    frame = queries.QUERIES[name](spark, FOLDER)
    result = db.execute(queries.ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(names)
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in result.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in sorted(names)) for r in frame.collect()), key=repr) == want


def test_pipeline_does_what_its_stages_decide(spark):
    """run() against the operators' decisions, applied one after another in plain Python."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    frame = lambda: spark.createDataFrame(list(rows.values()), docs.schema)
    model = compression_toxicity.train(docs, labels, fold("doc_id", 3) != 1)
    for r in compression_toxicity.scored(docs, model).filter(F.col("score") >= 0.7).collect():
        del rows[r["doc_id"]]
    sites = {}
    for r in rows.values():
        for line in r["text"].split("\n"):
            sites.setdefault(line.strip(" "), set()).add(r["source"])
    for i, r in list(rows.items()):
        kept = [x for x in r["text"].split("\n") if not x.strip(" ") or len(sites[x.strip(" ")]) < 10]
        text = "\n".join(kept)
        rows[i] = r if text == r["text"] else type(r)(**{**r.asDict(), "text": text, "n_chars": len(text)})
    for r in circulant_minhash.near_duplicates(frame()).filter(~F.col("kept")).collect():
        del rows[r["doc_id"]]
    for r in template_decontamination.contaminated(frame(), benchmark).select("doc_id").distinct().collect():
        del rows[r["doc_id"]]
    want = []
    for r in curriculum.mix(frame()).collect():
        first = min(r["taken"], r["size"])
        for reading, taken, position in ((1, first, r["first_position"]), (2, r["taken"] - first, r["second_position"])):
            if taken:
                want.append((*rows[r["doc_id"]], position, reading, taken))
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == [*docs.columns, "position", "reading", "taken"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


CLASHES = "size _gone _key _kept position reading taken _id _reading _r _row _last _text n_lines n_removed node key bucket".split()


def test_stages_take_odd_rows(spark):
    """Nulls, empty texts, repeated rows and ids, and extra columns named like what the stages use inside."""
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "a b c", None, "s", 5)]
    fields = ", ".join(f"{c} int" for c in CLASHES)
    odd = spark.createDataFrame(
        [(*r, *range(len(CLASHES))) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {fields}"
    )
    for empty in (False, True):
        docs = odd.filter("n_chars > 9") if empty else odd
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), schema := stage(spark, docs, FOLDER).schema)
            assert schema.names == odd.columns, name
        # One of the rows without words stays in every group of itself: nothing links them.
        assert sorted(map(tuple, docs.collect()), key=repr) == sorted([] if empty else map(tuple, odd.collect()), key=repr)
        mixed = corpus_pipeline.mixing(spark, docs, FOLDER)
        assert mixed.columns == [*[c for c in odd.columns if c not in ("position", "reading", "taken")], "position", "reading", "taken"]
        assert mixed.agg(F.sum("taken")).first()[0] == (None if empty else 4)


def test_rows_that_share_an_id_are_judged_one_by_one(spark):
    words = " ".join(f"w{i}" for i in range(40))
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first()["text"]
    rows = [(7, words, "s"), (7, "one two three", "s"), (7, words + " x", "s"), (None, words, "s"), (None, item, "s"), (9, item, "s")]
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, FOLDER).collect()
    assert len(kept) == 3 and {r["doc_id"] for r in kept} == {7, 9} and "one two three" in {r["text"] for r in kept}
    clean = corpus_pipeline.decontamination(spark, docs, FOLDER).collect()
    assert sorted(r["text"] for r in clean) == sorted(t for _, t, _ in rows if t != item)
    mixed = corpus_pipeline.mixing(spark, docs, FOLDER).groupBy("text", "doc_id").agg(F.sum("taken").alias("taken")).collect()
    total = sum(len(t.split()) for _, t, _ in rows)
    assert sum(r["taken"] for r in mixed) == int(1.5 * total)
