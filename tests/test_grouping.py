"""Grouping against literal cases and a plain union-find."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from folioframe import schemas
from folioframe.operators.components import connected_components
from folioframe.operators.grouping import identity, resolve_groups

ISBN = "9780441172719"


def files(*rows):
    """(path, isbn, title_key, author_key, token) -> identity rows."""
    out = []
    for path, isbn, title, author, token in rows:
        name = path.rsplit("/", 1)[-1]
        stem, _, ext = name.rpartition(".")
        out.append((path, ext, stem, isbn, title, author, token))
    return out


def resolve(spark, rows):
    frame = spark.createDataFrame(rows, schemas.IDENTITY)
    columns = [F.col(c) for c in frame.columns]
    got = resolve_groups(frame.select(*identity(*columns))).collect()
    return {r["path"]: (r["component"], r["method"]) for r in got}


def groups(result):
    by = {}
    for path, (component, method) in result.items():
        by.setdefault((component, method), []).append(path)
    return sorted((sorted(paths), method) for (_, method), paths in by.items())


def test_literal_cases(spark):
    """All independent cases in one run: folders keep their stems and keys apart."""
    rows = files(
        ("/isbn/first-file.epub", ISBN, None, None, None),
        ("/isbn/totally different name.pdf", ISBN, None, None, None),
        ("/meta/one.epub", None, "meta dune", "frank herbert", None),
        ("/meta/two.pdf", None, "meta dune", "frank herbert", None),
        ("/weak/weakdune.epub", None, "weak dune", "frank herbert", None),
        ("/weak/weakdune.pdf", None, "weak dune", "frank herbert", None),
        ("/weak/weakdune_v2.mobi", None, None, None, None),
        ("/x/rework.epub", None, "rework", "jason fried", None),
        ("/y/rework.epub", None, "rework", "somebody else", None),
        ("/u/known.epub", None, "known", "a", None),
        ("/u/known.mobi", None, None, None, None),
        ("/m/pinned.epub", None, None, None, "token-a"),
        ("/m/pinned.mobi", None, None, None, None),
        ("/m/solo.epub", "9780306406157", None, None, "solo"),
        ("/m/solo_v2.mobi", "9780306406157", None, None, None),
        ("/t/a.epub", None, None, None, "both"),
        ("/t/zz.pdf", None, None, None, "both"),
        ("/junk/p.epub", "1111111111", None, None, None),
        ("/junk/q.epub", "1111111111", None, None, None),
        ("/e/final.epub", None, None, None, None),
        ("/e/draft.epub", None, None, None, None),
        # Two known authors in a stem: the files without an author join each other only.
        ("/c/clash.epub", None, "c", "a", None),
        ("/c/clash.pdf", None, "d", "b", None),
        ("/c/clash.mobi", None, None, None, None),
        ("/c/clash_v2.mobi", None, None, None, None),
    )
    assert groups(resolve(spark, rows)) == sorted(
        [
            (["/isbn/first-file.epub", "/isbn/totally different name.pdf"], "isbn"),
            (["/meta/one.epub", "/meta/two.pdf"], "metadata"),
            (["/weak/weakdune.epub", "/weak/weakdune.pdf", "/weak/weakdune_v2.mobi"], "filename"),
            (["/x/rework.epub"], "single"),
            (["/y/rework.epub"], "single"),
            (["/u/known.epub", "/u/known.mobi"], "filename"),
            (["/m/pinned.epub"], "manual"),
            (["/m/pinned.mobi"], "single"),
            (["/m/solo.epub"], "manual"),
            (["/m/solo_v2.mobi"], "single"),
            (["/t/a.epub", "/t/zz.pdf"], "manual"),
            (["/junk/p.epub"], "single"),
            (["/junk/q.epub"], "single"),
            (["/e/final.epub"], "single"),
            (["/e/draft.epub"], "single"),
            (["/c/clash.epub"], "single"),
            (["/c/clash.pdf"], "single"),
            (["/c/clash.mobi", "/c/clash_v2.mobi"], "filename"),
        ]
    )


def union_find(rows):
    """The staged rules file by file."""
    parent = list(range(len(rows)))
    used = [set() for _ in rows]

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def join(members, how):
        for other in members[1:]:
            a, b = root(members[0]), root(other)
            if a != b:
                parent[b] = a
                used[a] |= used[b] | {how}

    def buckets(keys):
        by = {}
        for i, k in keys:
            if k is not None:
                by.setdefault(k, []).append(i)
        return by

    auto = [i for i, r in enumerate(rows) if r[6] is None]
    for b in buckets((i, r[6]) for i, r in enumerate(rows)).values():
        join(b, "manual")
    for b in buckets((i, rows[i][3]) for i in auto).values():
        join(b, "isbn")
    meta = lambda r: (r[4], r[5]) if r[4] and r[5] else None
    for b in buckets((i, meta(rows[i])) for i in auto).values():
        join(b, "metadata")
    stem = lambda r: re.sub(r"_v\d$", "", r[2])
    for b in buckets((i, stem(rows[i])) for i in auto).values():
        if len({rows[i][5] for i in b} - {None}) > 1:
            for sub in buckets((i, rows[i][5] or "") for i in b).values():
                join(sub, "filename")
        else:
            join(b, "filename")
    out = {}
    for i, r in enumerate(rows):
        members = [j for j in range(len(rows)) if root(j) == root(i)]
        evidence = used[root(i)]
        method = (
            "manual" if r[6] else "single" if len(members) == 1
            else next(m for m in ("filename", "metadata", "isbn") if m in evidence)
        )
        out[r[0]] = (min(rows[j][0] for j in members), method)
    return out


def random_rows(seed, n):
    rng = random.Random(seed)
    isbns = [f"97800000000{i:02d}" for i in range(100)]
    check = lambda s: sum(int(c) * (1 if i % 2 == 0 else 3) for i, c in enumerate(s)) % 10 == 0
    isbns = [s for s in isbns if check(s)]
    rows = []
    for i in range(n):
        rows.append(
            (
                f"/{rng.randrange(9)}/w{rng.randrange(60)}_v{rng.randrange(1, 5)}.{i}",
                rng.choice(isbns) if rng.random() < 0.3 else None,
                f"t{rng.randrange(40)}" if rng.random() < 0.5 else None,
                rng.choice("abc") if rng.random() < 0.5 else None,
                f"tok{rng.randrange(4)}" if rng.random() < 0.05 else None,
            )
        )
    return files(*rows)


def test_against_union_find(spark):
    rows = random_rows(7, 300)
    want = union_find(rows)
    assert resolve(spark, rows) == want
    shuffled = random.Random(1).sample(rows, len(rows))
    frame = spark.createDataFrame(shuffled, schemas.IDENTITY).repartition(7)
    again = resolve_groups(frame.select(*identity(*[F.col(c) for c in frame.columns])))
    assert {r["path"]: (r["component"], r["method"]) for r in again.collect()} == want


def test_components_of_chains_hubs_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)]  # a chain
    edges += [(100, i) for i in range(101, 160)]  # a hub that is the smallest node
    edges += [(400, i) for i in range(300, 360)]  # a hub that is the largest node
    edges += [(500 + i, 500 + (i + 1) % 9) for i in range(9)] + [(500, 500)]  # a ring, a loop
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    found = {r["node"]: r["component"] for r in got.collect()}
    want = {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)}
    want |= {i: 300 for i in [*range(301, 360), 400]} | {i: 500 for i in range(501, 509)}
    assert found == want


def test_hub_join_is_split(spark):
    """With low limits AQE splits the rows of a hub key instead of giving them to one task."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    from folioframe.operators.components import _large_star

    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        spread = spark.range(1000, 40000, 1, 8).select(
            F.col("id").alias("hi"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") - 500).alias("lo")
        )
        frame = _large_star(spread)
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert "isFinalPlan=true" in plan and "skew=true" in plan
