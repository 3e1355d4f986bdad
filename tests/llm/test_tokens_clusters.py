"""Token alignment, token counts and table clustering against plain versions."""

from __future__ import annotations

import math
import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioframe.llm import queries, table_clustering, token_alignment, token_counts, tokenizing

FOLDER = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PIECES = [
    "a", " ", "  ", "\n", " \n", "\t", "hello", " world", "'s", "1", "23", "<|endoftext|>", "é", "́", "日本。語", "\x1c", "\x85",
    " ", "　", "😀", "!", "<s>", "\x00", "-", "it's", "x ", ". ", "internationalization", " Donaudampfschiff",
]


def odd_texts(seed, n):
    rng = random.Random(seed)
    pool = [PIECES, [*PIECES, "▁"]]
    return ["".join(rng.choice(pool[rng.random() < 0.05]) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def token_spans(entries):
    spans, at = [], 0
    for entry in entries:
        spans.append((at, at + len(entry)))
        at += len(entry)
    return spans


def aligned_by_hand(text, tokenizer, model, value):
    """(A ids, B ids, groups, links as index pairs) of one text, by comparing all spans."""
    raw = f" {text}".encode()
    a = tokenizer.encode(f" {text}", add_special_tokens=False).ids
    b = model.encode(text)
    bytes_a = [bytes(value[c] for c in tokenizer.id_to_token(i)) for i in a]
    names = [model.id_to_piece(i) for i in b]
    bytes_b = [bytes.fromhex(n[3:5]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(b, names)]
    if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return [], [], [], []
    spans_a, spans_b = token_spans(bytes_a), token_spans(bytes_b)
    common = {e for _, e in spans_a} & {e for _, e in spans_b}
    cuts = [[0, *(n + 1 for n, (_, e) in enumerate(spans) if e in common)] for spans in (spans_a, spans_b)]
    groups = [(a[i:j], b[k:m]) for i, j, k, m in zip(cuts[0], cuts[0][1:], cuts[1], cuts[1][1:])]
    first, links = 0, []
    for i, (s, e) in enumerate(spans_a):
        while spans_b[first][1] <= s:
            first += 1
        j = first
        while j < len(b) and spans_b[j][0] < e:
            links.append((i, j))
            j += 1
    return a, b, groups, links


@pytest.fixture(scope="module")
def by_hand():
    tokenizer, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tokenizer.encode_special_tokens = True
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    value = {chr(b): b for b in plain}
    value |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
    return lambda text: aligned_by_hand(text or "", tokenizer, model, value)


def statistics_by_hand(rows, by_hand):
    found = [(i, *by_hand(text)) for i, text in rows]
    counts = Counter((a[x], b[y]) for _, a, b, _, links in found for x, y in links)
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for i, a, b, groups, links in found:
        pairs = [(a[x], b[y]) for x, y in links]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        best = sum(counts[p] == top[p[1]] for p in pairs)
        out.append((i, len(a), len(b), len(groups), len(pairs), best, sum(counts[p] for p in pairs), sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


def test_alignment_statistics(spark, by_hand):
    """Odd texts, nulls, repeated and missing ids, clashing extra columns."""
    rows = [(i % 90 if i % 7 else None, t) for i, t in enumerate([*odd_texts(3, 1200), None, "", "a b " * 300, "aé" * 2000])]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, block int, pairs string").repartition(3)
    got = sorted(map(tuple, token_alignment.link_statistics(docs, A, B).collect()), key=repr)
    assert got == statistics_by_hand(rows, by_hand)
    assert token_alignment.link_statistics(docs.filter("block > 1"), A, B).collect() == []


def test_alignment_query(spark, by_hand):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = queries.op11_token_alignment(spark, FOLDER)
    want = statistics_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], by_hand)
    assert sorted(map(tuple, got.collect()), key=repr) == want and sum(r[4] for r in want) > 1000


def test_alignments_are_the_groups_and_links(spark, by_hand):
    texts = [*odd_texts(4, 300), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in token_alignment.alignments(docs, A, B).collect():
        a, b, groups, links = by_hand(texts[r["doc_id"]])
        assert (r["a_ids"], r["b_ids"]) == (a, b)
        assert (r["a_sizes"], r["b_sizes"]) == ([len(g) for g, _ in groups], [len(h) for _, h in groups])
        assert r["a_links"] == [sum(x == i for x, _ in links) for i in range(len(a))]


@pytest.mark.parametrize("size", [7, 40])
def test_alignment_of_long_texts_in_slabs(monkeypatch, by_hand, size):
    monkeypatch.setattr(token_alignment, "RUN", size)
    monkeypatch.setattr(token_alignment, "KNOWN", 50)
    monkeypatch.setattr(tokenizing.runs, "__defaults__", (size,))
    aligner, block, texts = token_alignment.Aligner(A, B), token_alignment._Block(0), odd_texts(5, 400)
    for at in range(0, len(texts), 50):
        block.add(pa.array(range(at, at + 50)), texts[at : at + 50], aligner)
    got = block.batch().to_pydict()
    want = {r[0]: r for r in statistics_by_hand(list(enumerate(texts)), by_hand)}
    for i, *rest in zip(*(got[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"))):
        assert (*rest,) == (*want[i][1:5], want[i][7])
    assert sum(map(sum, got["link_times"])) == sum(r[4] for r in want.values()) == sum(got["times"][0])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"])
@pytest.mark.parametrize("size", [6, 1 << 18])
def test_counts_against_whole_texts(monkeypatch, name, size):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        whole = lambda text: len(model.encode(text))
    else:
        tokenizer = Tokenizer.from_file(path)
        whole = lambda text: len(tokenizer.encode(text, add_special_tokens=False))
    monkeypatch.setattr(tokenizing, "SLAB", size)
    monkeypatch.setattr(token_counts, "KNOWN", 40)
    monkeypatch.setattr(tokenizing.runs, "__defaults__", (size,))
    monkeypatch.setattr(tokenizing.slabs, "__defaults__", (size,))
    texts = odd_texts(6, 1500)
    assert token_counts.Counter(path).counts(texts) == [whole(t) for t in texts]


def test_count_query(spark):
    tokenizer = Tokenizer.from_file(A)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    want = {(r["doc_id"], len(r["text"].encode()), n := len(tokenizer.encode(r["text"], add_special_tokens=False)), n > 1024) for r in docs}
    assert set(map(tuple, queries.op12_token_counts(spark, FOLDER).collect())) == want


def test_counts_of_odd_rows(spark):
    rows = [(None, None, 1), (1, "", 1), (1, "a <|endoftext|> b", 1), (1, "a <|endoftext|> b", 1), (2, "word " * 40_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, token_counts.token_counts(docs, A).collect()), key=repr)
    assert got == [(1, 0, 0, False), (1, 17, 4, False), (1, 17, 4, False), (2, 200_000, 40_001, True), (None, 0, 0, False)]
    assert token_counts.token_counts(docs.filter("doc_id > 9"), A).collect() == []


def clustered_by_hand(rows, k, rounds, dims):
    kept = [
        (i, [math.floor(64 * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    draw = lambda r: (r[0] is None, sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=draw)[:k]]
    nearest = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        for n, vs in members.items():
            centroids[n] = [sum(x) // len(vs) for x in zip(*vs)]
    labels = [(i, *nearest(v)[::-1]) for i, v in kept]
    return sorted(labels, key=repr), centroids


def test_clustering_by_hand(spark):
    """Ties, repeated vectors and ids, vectors to leave out, wide values, clashing extra columns."""
    rng = np.random.default_rng(2)
    grid = [[float(x) for x in rng.integers(-2, 3, 4) / 64] for _ in range(300)]
    wide = [[float(x) for x in rng.normal(size=4) * 10.0 ** rng.integers(-2, 5)] for _ in range(200)]
    odd = [None, [], [1.0, 2.0], [1.0, None, 1.0, 1.0], [1.0, math.nan, 1.0, 1.0], [1.0, 1.0, -math.inf, 1.0]]
    rows = [(i % 400 if i % 11 else None, v) for i, v in enumerate([*grid, *wide, *odd])]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int").repartition(3)
    for k in (5, 16):
        found = table_clustering.cluster(vectors, k=k, dims=4)
        labels, centroids = clustered_by_hand(rows, k, 3, 4)
        assert sorted(map(tuple, found.vectors.collect()), key=repr) == labels
        clusters = sorted(found.clusters.collect(), key=lambda r: r["cluster"])
        assert [r["centroid"] for r in clusters] == centroids
        assert [r["cluster_inertia"] for r in clusters] == [sum(d for _, n, d in labels if n == c) for c in range(k)]
        assert {r["inertia"] for r in clusters} == {sum(d for _, _, d in labels)}
    few = table_clustering.cluster(vectors.filter(F.col("vec_id") == 1), dims=4)
    assert few.clusters.count() == vectors.filter("vec_id = 1").count() < 16
    none = table_clustering.cluster(vectors.filter("cluster > 1"), dims=4)
    assert none.vectors.collect() == [] and none.clusters.collect() == []
    with pytest.raises(Exception, match="no distance that fits"):
        table_clustering.cluster(spark.createDataFrame([(1, [1e30] * 4)], "vec_id long, embedding array<double>"), dims=4)
