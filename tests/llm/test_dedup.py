"""Substring, line, exact and near deduplication against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from folioframe.llm import circulant_minhash, exact_dedup, line_spread, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, bucket int, key string, node long"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame(
        [(i, t, s, 7, "clash", 5) for i, t, s in rows], DOCS
    ).repartition(3)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["é", "Ñandú", "x y"]
    passages = [[rng.choice(words) for _ in range(n)] for n in (24, 49, 50, 51, 90, 200)]
    out = []
    for i in range(120):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(0, 99))]
        out.append(((i * 7) % 120, rng.choice([" ", "\t", "\n"]).join(text), f"s{i % 4}"))
    long = " ".join(rng.choice(words) for _ in range(30_000))
    out += [(200, long, "s0"), (201, "pre " + long[:90_000], None), (202, None, "s1"), (203, "", "s1"), (204, " \n\t", "s1")]
    out += [out[5], out[5], (None, out[3][1], "s2"), (205, out[3][1], "s2"), (206, "x " * 120, "s1"), (207, "x " * 70, "s1")]
    return out


def test_repeats_against_brute_force(spark, rows):
    first = {}
    for i, text, _ in rows:
        words = WORD.findall(text or "")
        for p in range(len(words) - 49):
            if i is not None:
                window = tuple(words[p : p + 50])
                first[window] = min(first.get(window, i), i)
    want = []
    for i, text, _ in rows:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for p in range(len(words) - 49):
            if i is not None and first[tuple(words[p : p + 50])] < i:
                gone[p : p + 50] = [True] * 50
        want.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    got = substring_dedup.remove_repeats(frame(spark, rows)).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_text")) for r in got), key=repr) == sorted(
        want, key=repr
    )
    for r in got:
        assert sum(s["words"] for s in r["spans"]) == r["n_removed"]
        assert all(b["first"] > a["first"] + a["words"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_a_passage_in_all_documents(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"own{i} {passage} tail{i}", "s") for i in range(300)]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == {i: 60 if i else 0 for i in range(300)}


def test_empty_tables(spark):
    empty = frame(spark, [(1, "a", "s")]).filter("doc_id > 1")
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert circulant_minhash.near_duplicates(empty).count() == 0
    assert line_spread.remove_boilerplate(empty).count() == 0


def test_exact_groups(spark, rows):
    extra = [(300 + i, "HOT text", "s") for i in range(150)] + [(500, "hot TEXT", "s"), (501, "É", "s"), (502, "é", "s")]
    both = rows + extra
    groups = {}
    for i, text, _ in both:
        groups.setdefault(hashlib.sha256(lower(text).encode()).hexdigest(), []).append(i)
    want = []
    for digest, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, digest) for i in ids]
    got = [tuple(r) for r in exact_dedup.exact_duplicates(frame(spark, both)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_heavy_digests_are_found(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "COUNTERS", 8)
    monkeypatch.setattr(exact_dedup, "SHARE", 0.3)
    rows = [("hot" if i % 3 == 0 else f"d{i}", i) for i in range(900)]
    table = spark.createDataFrame(rows, "text_sha256 string, doc_id long").repartition(5)
    assert [tuple(r) for r in exact_dedup.heavy_digests(table).collect()] == [("hot", 897, 300)]


def brute_components(rows):
    sets = []
    for i, text, _ in rows:
        words = WORD.findall(lower(text))
        shingles = {tuple(words[p : p + 5]) for p in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}
        sets.append((i, shingles))
    parent = {i: i for i, _ in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            common = len(a & b)
            if common and i is not None and j is not None and 100 * common >= 75 * (len(a) + len(b) - common):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted(((i, len(s), find(i), find(i) == i) for i, s in sets), key=repr)


def near_rows():
    rng = random.Random(11)
    rows, words = [], [f"v{i}" for i in range(3000)]
    common = [rng.choice(words) for _ in range(70)]
    for family in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([6, 40, 160]))]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 22))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy).title() if rng.random() < 0.3 else " ".join(copy))
    rows += [" ".join(common + [rng.choice(words) for _ in range(90)]) for _ in range(40)]
    rows += ["a", "A", "a b c d", "a b c D", "b", None, "", "  "]
    rows = [(i * 13 % len(rows), text, "s") for i, text in enumerate(rows)]
    return rows + [(None, rows[0][1], "s"), rows[3], rows[3]]


@pytest.mark.parametrize("block", [256, 8])
def test_near_duplicates_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(circulant_minhash, "BLOCK", block)
    rows = near_rows()
    got = circulant_minhash.near_duplicates(frame(spark, rows)).collect()
    # A row without id links with nothing and stays.
    want = [r if r[0] is not None else (None, r[1], None, True) for r in brute_components(rows)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("chain", [True, False])
def test_members_of_a_bucket_meet_in_a_pair_of_blocks(spark, monkeypatch, chain):
    """Chains of small buckets are taken one by one, buckets that overlap much as one team."""
    monkeypatch.setattr(circulant_minhash, "BLOCK", 2)
    buckets = [[i, i + 1] for i in range(40)] if chain else [[i for i in range(9) if i != k] for k in range(9)]
    table = spark.createDataFrame([(k, n, n) for k, b in enumerate(buckets) for n in b], "key long, node long, comp long")
    rows = circulant_minhash._blocks(table).collect()
    assert {r["team"]["single"] for r in rows} == {chain}
    held = {}
    for r in rows:
        held.setdefault((r["team"], r["low"], r["high"]), set()).add(r["node"])
    assert all(any({a, b} <= own for own in held.values()) for bucket in buckets for a in bucket for b in bucket)
    assert max(map(len, held.values())) <= 9


def test_lines_by_distinct_sites(spark):
    rows = [(i, f"head {i}\n  Shared line \nfew\n\nown", f"s{i}") for i in range(12)]
    rows = [(i, t if i < 9 else t.replace("few", f"few{i}"), s) for i, t, s in rows]
    rows += [(50, "Shared line", None), (51, None, "s1"), (52, "", "s1"), (None, "x\nShared line", "s1"), (53, "own\nhead 1", "s1")]
    rows += [(54, "Shared line\nfirst", "s2"), (54, "second\n Shared line", "s2"), (55, "rare\nrare\nrare", "s3")]
    got = line_spread.remove_boilerplate(frame(spark, rows)).collect()
    sites = {}
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if site and line.strip(" "):
                sites.setdefault(line.strip(" "), set()).add(site)
    want = []
    for i, text, _ in rows:
        lines = None if text is None else text.split("\n")
        kept = None if text is None else [x for x in lines if len(sites.get(x.strip(" "), ())) < 10]
        want.append((i, None if text is None else "\n".join(kept), len(lines or []), len(lines or []) - len(kept or [])))
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got), key=repr) == sorted(want, key=repr)
    assert got[0].asDict()["key"] == "clash"


def test_line_dedup_stays_in_the_jvm(spark):
    plan = line_spread.remove_boilerplate(frame(spark, [(1, "a", "s")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_buckets_follow_the_bytes_of_the_input(spark, monkeypatch):
    """More buckets than shuffle partitions, and the same result."""
    rng = random.Random(8)
    shared = " ".join(f"s{rng.randrange(900)}" for _ in range(80))
    rows = [(i, " ".join(f"w{rng.randrange(9000)}" for _ in range(60)) + (" " + shared if i % 3 == 0 else "")) for i in range(60)]
    docs = spark.createDataFrame([*rows, (60, None), (61, "")], "doc_id long, text string")
    want = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs).collect()}
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 2000)
    assert substring_dedup._buckets(docs, "text") > 10
    assert {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs).collect()} == want
    assert {i for i, r in want.items() if r["n_removed"]} == set(range(3, 60, 3))
    assert {r["n_removed"] for r in want.values()} == {0, 80}
    assert substring_dedup._buckets(docs.limit(0), "text") == int(spark.conf.get("spark.sql.shuffle.partitions"))
