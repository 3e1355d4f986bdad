"""Classifiers: held-out accuracy, folds, and odd rows."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioframe.llm import arrays, compression_toxicity, pairwise_quality, ppm_language, queries
from folioframe.llm.fitting import best_cut

FOLDER = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n "), (4, "1234 !!"), (None, "the words of"), (5, "w " * 60_000), (5, "w"), (5, "w")]


def odd(spark):
    return spark.createDataFrame([(i, t, 1.0, "z", "x") for i, t in ODD], "doc_id long, text string, score double, lang string, letters string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


def agreement(spark, labels, name, label):
    rows = queries.QUERIES[name](spark, FOLDER).join(labels, "doc_id").filter("held_out").select(label, "predicted")
    return Counter(map(tuple, rows.collect()))


def test_quality_on_the_held_out_fold(spark, labels):
    counts = agreement(spark, labels, "op5_pairwise_quality", "quality")
    assert (counts[1, 1] + counts[0, 0]) / sum(counts.values()) > 0.95


def test_toxicity_on_the_held_out_fold(spark, labels):
    counts = agreement(spark, labels, "op9_compression_toxicity", "toxic")
    # Half of the toxic labels of this table have no toxic text.
    assert counts[0, 1] <= 0.02 * (counts[0, 0] + counts[0, 1])
    assert counts[1, 1] >= 0.3 * (counts[1, 0] + counts[1, 1])


def test_language_on_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", F.col("lang").alias("truth"))
    rows = queries.QUERIES["op4_ppm_language"](spark, FOLDER).join(docs, "doc_id")
    rows = rows.filter("held_out").select("truth", "lang_pred", "score").collect()
    assert sum(r["truth"] == r["lang_pred"] for r in rows) > 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("name", ["op4_ppm_language", "op5_pairwise_quality", "op9_compression_toxicity"])
def test_every_row_once(spark, name):
    rows = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert rows.count() == rows.select("doc_id").distinct().count() == 200


def test_odd_rows(spark, labels):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    models = (
        compression_toxicity.train(docs, labels, F.lit(True)),
        pairwise_quality.train(docs, labels, F.lit(True)),
    )
    for module, model in zip((compression_toxicity, pairwise_quality), models):
        rows = module.scored(odd(spark), model).collect()
        assert sorted((r["doc_id"] or 0 for r in rows)) == sorted(i or 0 for i, _ in ODD)
        assert all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] == 5}) == 2
        assert module.scored(odd(spark).filter("doc_id > 9"), model).count() == 0
        assert {r["score"] for r in module.scored(odd(spark), None).collect()} == {0.0}
    kept = compression_toxicity.kept(odd(spark), models[0])
    assert kept.columns == odd(spark).columns and kept.count() == len(ODD)
    found = ppm_language.identified(odd(spark), ppm_language.train(docs, F.lit(True))).collect()
    assert {r["doc_id"] for r in found if r["lang_pred"] == "und"} == {1, 2, 3, 4}
    assert {r["lang_pred"] for r in ppm_language.identified(odd(spark), None).collect()} == {"und"}


def test_no_rows_of_a_label(spark, labels):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert compression_toxicity.train(docs, labels.filter("toxic = 0"), F.lit(True)) is None
    assert pairwise_quality.train(docs, labels.filter("quality = 1"), F.lit(True)) is None
    assert ppm_language.train(docs.filter("doc_id < 0"), F.lit(True)) is None


def test_code_lengths_against_a_plain_model():
    """The tables give what escaping step by step from the longest known context gives."""
    rng = random.Random(2)
    rows = [(lang, " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(300)).encode())
            for lang, letters in (("a", "abcde"), ("b", "cdefg"))]
    model = ppm_language.fit(rows)
    counts = {lang: defaultdict(Counter) for lang, _ in rows}
    for lang, text in rows:
        for p in range(len(text)):
            for order in range(min(p, ppm_language.ORDER) + 1):
                counts[lang][text[p - order : p]][text[p]] += 1
    base = int(model.alphabet.max()) + 1
    kept = {c for own in counts.values() for c, n in own.items() if sum(n.values()) >= ppm_language.SUPPORT}
    kept = {c for c in kept if all(c[i:] in kept or i == len(c) for i in range(len(c) + 1))}

    def bits(lang, context, symbol):
        n = counts[lang].get(context, Counter())
        kinds, total = len(n), sum(n.values())
        if symbol in n:
            return math.log2((total + kinds) / n[symbol])
        escape = math.log2((total + kinds) / kinds) if total else 0.0
        return escape + (bits(lang, context[1:], symbol) if context else math.log2(base))

    text = b"abc cde zzz gfe"
    want = []
    for lang in model.languages:
        total = 0.0
        for p in range(len(text)):
            context = next(text[p - o : p] for o in range(min(p, ppm_language.ORDER), -1, -1) if text[p - o : p] in kept or not o)
            symbol = text[p] if model.alphabet[text[p]] else -1
            total += bits(lang, context, symbol)
        want.append(total)
    piece = next(arrays.pieces(pa.array([text.decode()])))
    assert np.allclose(ppm_language.code_lengths(model, piece)[0], want, rtol=1e-4)


def test_best_cut_parts_the_labels():
    assert 1 < best_cut(np.array([0.0, 1.0, 2.0, 3.0]), np.array([0, 0, 1, 1])) < 2


def test_typical_sequences_against_plain_counts(spark):
    """Sequences chosen by lift, from one aggregate over rows, against counting them row by row."""
    rng = random.Random(4)
    words = ["scummy", "ab", "cde", "worthless", "plain", "Text", "zu", "über"]
    rows = []
    for i in range(300):
        label = int(i % 3 == 0)
        pool = words if label else words[4:] + (words[:1] if i % 50 == 1 else [])
        rows.append((i, rng.choice(["", " ", "\n"]).join([""]) + " ".join(rng.choice(pool) for _ in range(rng.randint(0, 30))), label))
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3)
    toxic, ordinary = sum(r[2] for r in rows), sum(1 - r[2] for r in rows)
    holds = {0: Counter(), 1: Counter()}
    for _, text, label in rows:
        raw = (" " + " ".join(text.lower().split()) + " ").encode() if text.split() else b""
        holds[label].update({raw[i : i + 5] for i in range(len(raw) - 4) if b" " not in raw[i + 1 : i + 4]})
    least = max(2, min(20, toxic**0.5 / 2 * (ordinary + 1) / (toxic + 1)))
    lift = lambda g, n: (n / (toxic + 1)) / ((holds[0][g] + 1) / (ordinary + 1))
    want = {int.from_bytes(g, "big") for g, n in holds[1].items() if n >= 3 and lift(g, n) >= least}
    assert set(compression_toxicity._typical(sample, toxic, ordinary).tolist()) == want and want


def test_gains_are_differences_of_compressed_lengths(spark):
    docs = spark.createDataFrame([(1, "you are Worthless scum and  a\nmoron today my friend", 1)], "doc_id long, text string, label int")
    ordinary, toxic = b" today my friend and", b" worthless scum moron"
    lengths = []
    for content in (ordinary, ordinary + toxic):
        press = compression_toxicity._press(content)
        parts = [b" you are worthless scum and ", b" a moron today my friend "]
        lengths.append([len(press.compress(compression_toxicity.MARK + p)) for p in parts])
    gain = np.subtract(*lengths)
    x = docs.mapInArrow(compression_toxicity._feature_rows(ordinary, ordinary + toxic), "doc_id long, label int, x array<double>").first()["x"]
    assert x[9] == max(gain) and x[10] == sum(gain) > 0 and x[13] == sum(gain) / 2
    assert x[:6] == [np.log1p(sum(gain >= k)) for k in range(1, 7)]


def test_language_sample_is_the_smallest_hashes_of_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(ppm_language, "FIT_ROWS", 20)
    monkeypatch.setattr(ppm_language, "FIT_BYTES", 5000)
    taken = []
    monkeypatch.setattr(ppm_language, "fit", taken.extend)
    rows = [(i, "ab"[i % 2], f"text {i} " + "x" * (6000 if i % 10 == 0 else i)) for i in range(500)]
    rows += [(77, "b", "again")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    ppm_language.train(docs, F.lit(True))
    want = []
    hashed = docs.withColumn("draw", F.expr("pmod(xxhash64(doc_id), 2147483648)")).collect()
    for lang in "ab":
        own = sorted((r["draw"], r["doc_id"], r["text"].encode()) for r in hashed if r["lang"] == lang and len(r["text"]) <= 5000)
        limit = int(2**31 * min(1.0, 22 / len(own)))
        want += [(lang, text) for draw, _, text in own[:20] if draw <= limit]
    assert taken == want and {lang for lang, _ in taken} == {"a", "b"}


def test_every_labelled_row_takes_part_in_the_quality_model(spark, monkeypatch):
    """More rows than the fit once took of a label: weights and cut against a plain fit of all rows and all pairs."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["one", "Two", "3", "!!", "a,b", "FOUR"][: 3 + 3 * (i % 4 == 0)]) for _ in range(8)), int(i % 4 != 0)) for i in range(14_000)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    seen = []
    cut, pairs = pairwise_quality._cut, pairwise_quality._pairs
    monkeypatch.setattr(pairwise_quality, "_cut", lambda table, model, below: seen.append((table.count(), below)) or cut(table, model, below))

    def counted(*args):
        found = pairs(*args)
        seen.append(found.count())
        return found

    monkeypatch.setattr(pairwise_quality, "_pairs", counted)
    model = pairwise_quality.train(docs, labels, F.lit(True))
    # 10,500 good rows, 3,500 bad ones: four partners for each of the good rows, twelve for each of the bad ones.
    assert seen == [42_000, (14_000, 3500)]
    x = np.concatenate([pairwise_quality.features(p) for p in arrays.pieces(pa.array([t for _, t, _ in rows]))])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0) + 1e-6)
    worth = np.sort(pairwise_quality._worth(model, x))
    assert math.isclose(model.cut, worth[3499], rel_tol=1e-9, abs_tol=1e-9)
    right = {r["doc_id"]: r["score"] >= 0.7 for r in pairwise_quality.scored(docs, model).collect()}
    assert sum(right[i] == bool(y) for i, _, y in rows) > 0.95 * len(rows)
