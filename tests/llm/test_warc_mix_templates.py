"""Archives, mixing and template decontamination."""

from __future__ import annotations

import gzip
import hashlib
import base64
import math
import tempfile
import time
import uuid

import pytest

from folioframe.llm import curriculum, template_decontamination, warc
from folioframe.session import work_folder

PAGES = [
    (1, "http://a/1", "<p>short</p>"),
    (2, "http://a/2", "é" * 40_000 + "\r\n\r\nWARC/1.1\r\n"),
    (3, "http://a/3", None),
    (4, None, ""),
    (5, "http://a b\n/5", "<p>short</p>"),
    (6, "http://a/6", "<p>short</p>"),
    (7, "http://a/7", "0\r\n\r\n" * 9000),
    (8, "http://a/8", "é" * 40_000 + "\r\n\r\nWARC/1.1\r\n"),
    (6, "http://a/6", "<p>short</p>"),
    (None, "http://a/n", "no id"),
    (None, "http://a/n", "<p>short</p>"),
]


def folder(spark):
    return f"{work_folder(spark)}/warc-{uuid.uuid4().hex}"


@pytest.mark.parametrize("min_bytes", [0, 13])
def test_archive_round_trip(spark, min_bytes):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, digest string, place int")
    at = folder(spark)
    warc.write_archives(pages.repartition(3), at, min_bytes=min_bytes, segment_bytes=1000, file_records=2)
    rows = warc.read_archives(spark, at).collect()
    assert all(r["problem"] is None for r in rows)
    want = []
    for page, _, html in PAGES:
        payload = (html or "").encode()
        keep = max((p for p, _, h in PAGES if (h or "") == (html or "") and p is not None), default=None)
        revisit = len(payload) >= min_bytes and keep is not None and keep != page
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want.append((page, len(payload), digest, "revisit" if revisit else "response", keep if revisit else None))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    bodies = {(r["page_id"], bytes(r["payload"]).decode()) for r in rows if r["record_type"] == "response"}
    assert bodies <= {(p, h or "") for p, _, h in PAGES}


def test_empty_archive(spark):
    at = folder(spark)
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), at)
    assert warc.read_archives(spark, at).count() == 0


def broken(spark, change):
    """Segments of one page, changed and written as an archive."""
    at = folder(spark)
    warc.write_archives(spark.createDataFrame([(1, "u", "abc " * 900)], "page_id long, url string, html string"), at, segment_bytes=1000)
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(at).first()["content"]
    records = [warc._record([*((k, v) for k, v in h.items() if k != "content-length")], b)
               for h, b in change(list(warc.parse_records(gzip.decompress(content))))]
    other = folder(spark)
    spark.createDataFrame([(b"".join(records)[:-1].decode(),)], "value string").write.text(other, compression="gzip")
    return warc.read_archives(spark, other).collect()


def test_segments_out_of_order_are_reassembled(spark):
    (row,) = broken(spark, lambda r: r[::-1])
    assert row["problem"] is None and bytes(row["payload"]).decode() == "abc " * 900


def test_missing_segment_and_wrong_length(spark):
    (row,) = broken(spark, lambda r: [r[0], *r[2:]])
    assert row["problem"] == "segments are missing" and row["payload"] is None
    (row,) = broken(spark, lambda r: r[:-1])
    assert row["problem"] == "total length differs"
    (row,) = broken(spark, lambda r: [*r[:-1], (r[-1][0] | {"warc-segment-total-length": "5"}, r[-1][1])])
    assert row["problem"] == "total length differs"


def member_per_record(spark, change=lambda data: data):
    """The archive of some pages, written again with each record compressed on its own."""
    at = folder(spark)
    pages = [(i, f"http://a/{i}", f"page {i} " * 50) for i in range(20)]
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), at)
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(at).first()["content"]
    members = [gzip.compress(warc._record([*((k, v) for k, v in h.items() if k != "content-length")], b))
               for h, b in warc.parse_records(gzip.decompress(content))]
    other = tempfile.mkdtemp()
    with open(f"{other}/records.warc.gz", "wb") as file:
        file.write(change(b"".join(members)))
    return warc.read_archives(spark, other)


def test_every_gzip_member_is_read(spark):
    rows = member_per_record(spark).collect()
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in rows} == {i: f"page {i} " * 50 for i in range(20)}
    assert all(r["problem"] is None for r in rows)


def test_truncated_gzip_member_raises(spark):
    with pytest.raises(Exception, match="EOFError"):
        member_per_record(spark, lambda data: data[:-20]).collect()


FOREIGN = [
    ([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:1>"), ("Content-Type", "application/warc-fields")], b"software: x\r\n"),
    ([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:uuid:2>"), ("WARC-Target-URI", "http://a/"),
      ("Content-Type", "application/http; msgtype=request")], b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
    ([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:3>"), ("WARC-Target-URI", "http://a/"),
      ("Content-Type", "application/http; msgtype=response")], b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello"),
    ([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:4>"), ("Content-Type", "application/http")],
     b"HTTP/1.1 200 OK\r\nServer:x\r\nTransfer-Encoding:chunked\r\n\r\n5\r\nworld\r\n0\r\n\r\n"),
    ([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:5>"), ("Content-Type", "text/dns")], b"a. 1 IN A 1.2.3.4"),
    ([("WARC-Type", "metadata"), ("WARC-Record-ID", "<urn:uuid:6>"), ("WARC-Payload-Digest", "md5:00")], b"a: b\r\n\r\nc"),
    ([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:7>"), ("Content-Type", "application/http")],
     b"HTTP/1.1 200 OK\r\nContent-Length: 50\r\n\r\nhello"),
    ([("WARC-Type", "revisit"), ("WARC-Record-ID", "<urn:uuid:8>"), ("WARC-Refers-To", "<urn:uuid:3>"),
      ("WARC-Payload-Digest", "sha1:VL2MMHO4YXUKFWV63YHTWSBM3GXKSQ2N"), ("Content-Type", "application/http")], b"HTTP/1.1 200 OK\r\n\r\n"),
    ([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:9>"), ("Content-Type", "application/http")], b"HTTP/1.1 200 OK"),
]


def test_foreign_archive(spark):
    """Other record types, both framings, headers without a space after the colon; one gzip member per record."""
    at = tempfile.mkdtemp()
    with open(f"{at}/crawl.warc.gz", "wb") as file:
        for headers, block in FOREIGN:
            file.write(gzip.compress(warc._record(headers, block).replace(b"WARC-Type: ", b"WARC-Type:")))
    rows = {r["record_id"][-2]: r for r in warc.read_archives(spark, at).collect()}
    payloads = {k: r["payload"] and bytes(r["payload"]) for k, r in rows.items()}
    assert payloads == {
        "1": b"software: x\r\n", "2": b"", "3": b"hello", "4": b"world", "5": b"a. 1 IN A 1.2.3.4", "6": b"a: b\r\n\r\nc",
        "7": b"hello", "8": None, "9": None,
    }
    problems = {k: r["problem"] for k, r in rows.items() if r["problem"]}
    assert problems == {"7": "body is cut short", "9": "no end of the HTTP headers"}
    assert rows["8"]["refers_to_id"] == "<urn:uuid:3>" and rows["8"]["payload_bytes"] == 5
    assert {r["page_id"] for r in rows.values()} == {None}


def test_revisits_name_a_record_of_the_archive(spark):
    pages = spark.createDataFrame(
        [(1, "u", "same"), (2, "u", "same"), (3, "u", "two"), (5, "u", "two"), (5, "v", "two"), (None, "w", "same")],
        "page_id long, url string, html string",
    )
    at = folder(spark)
    warc.write_archives(pages, at)
    rows = warc.read_archives(spark, at).collect()
    names = [r["record_id"] for r in rows]
    assert len(set(names)) == len(names)
    named = {r["page_id"]: r["refers_to_id"] for r in rows if r["record_type"] == "revisit"}
    target = next(r["record_id"] for r in rows if r["page_id"] == 2)
    # Page 5 has its payload twice, so page 3 is tied to it by digest.
    assert named == {1: target, None: target, 3: None}
    assert {r["page_id"]: r["refers_to"] for r in rows if r["record_type"] == "revisit"} == {1: 2, None: 2, 3: 5}


def test_chunked_framing():
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def mixed(spark, rows):
    table = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, part int, target double")
    return curriculum.mix(table.repartition(4))


ROWS = [(i, "w " * ((i * 37) % 50), f"s{i % 5}") for i in range(400)] + [
    (500, "w " * 9000, "big"), (501, None, "none"), (502, "", None), (503, "a b c", None), (None, "a b", "s1"), (7, "x " * 9, "s2"),
]


def test_targets_and_words_taken(spark):
    rows = mixed(spark, ROWS).collect()
    size = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
    names = sorted((s for s in size if s is not None), key=str.encode) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    # Pour level by level until nothing is above its cap.
    left, free, target = 1.5 * sum(size.values()), list(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > 2 * size[s]]
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
            free.remove(s)
    for s in names:
        own = [r for r in rows if r["source"] == s]
        assert all(math.isclose(r["target"], target[s]) and r["source_size"] == size[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= 1
    assert sorted(map(tuple, mixed(spark, ROWS[::-1]).collect()), key=repr) == sorted(map(tuple, rows), key=repr)


def test_positions_follow_the_schedules(spark):
    rows = mixed(spark, [(i, "w " * 10, f"s{i % 3}") for i in range(3000)]).collect()
    for s, knots in zip(("s0", "s1", "s2"), curriculum.SCHEDULES):
        own = [(p, min(r["taken"], r["size"]) if k == 0 else r["taken"] - r["size"])
               for r in rows if r["source"] == s
               for k, p in enumerate((r["first_position"], r["second_position"])) if p is not None]
        total = sum(n for _, n in own)

        def area(end):
            done = 0.0
            for (a, x), (b, y) in zip(knots, knots[1:]):
                b2 = min(b, end)
                if b2 > a:
                    y2 = x + (y - x) * (b2 - a) / (b - a)
                    done += (b2 - a) * (x + y2) / 2
            return done

        for moment in (0.2, 0.5, 0.8):
            assert abs(sum(n for p, n in own if p < moment) / total - area(moment) / area(1.0)) < 0.01
    assert [r["first_position"] is None for r in rows].count(True) == sum(r["taken"] == 0 for r in rows)


def test_mixing_nothing(spark):
    assert mixed(spark, ROWS).filter("doc_id < -5").count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert curriculum.mix(empty).count() == 0
    (row,) = mixed(spark, [(1, "", "s")]).collect()
    assert row["taken"] == 0 and row["target"] == 0


ITEMS = [
    (1, "If Anna buys 5 apples and 3.5 kg of pears then Anna pays how much for 5 apples?"),
    (2, "too short"),
    (3, None),
    (4, "the plain text without any slots in it at all, really"),
    (5, "Él dice que ñandúes corren más rápido que otros pájaros"),
]


def found(spark, rows, items=ITEMS):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, item_id int, window string")
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, slots string")
    got = template_decontamination.contaminated(docs.repartition(3), bench).collect()
    return {(r["doc_id"], r["item_id"]): (r["containment"], r["slots_changed"]) for r in got}


def test_templates(spark):
    rows = [
        (1, "x y. If Bob buys 17 apples, and 2 lb of pears then Bob pays how much for 17 apples? z"),
        (2, "If Bob buys 17 apples and 2 kg of pears then Carl pays how much for 19 apples?"),
        (3, "Before. THE plain text; without any slots in it at all really, after."),
        (4, None), (5, "the plain text without any other stuff"), (6, ""), (7, ITEMS[0][1]),
        (None, ITEMS[3][1]), (8, "ÉL DICE QUE ÑANDÚES CORREN MÁS RÁPIDO QUE OTROS PÁJAROS"),
        (9, "word " * 50_000 + ITEMS[3][1]), (10, "1 2 3 4 5 6 7 8 9 10"), (11, ITEMS[3][1]), (11, ITEMS[3][1]),
    ]
    got = found(spark, rows)
    assert set(got) == {(1, 1), (7, 1), (3, 4), (8, 5), (9, 4), (11, 4)}
    assert got[1, 1] == (1.0, 4) and got[7, 1] == (1.0, 0)


TOM = "Tom has 5 apples. Mary gives him 3. How many apples has Tom?"
PEARS = "Then Anna gives 5 pears to Bob and Carl gives 3.5 kg of pears to Dora, so Anna has 2 Dollars left"


def test_names_at_openings(spark):
    rows = [
        (1, "Ann has 7 apples. Paul gives him 4. How many apples has Ann?"),
        (2, "x y. Ann has 7 apples. Paul gives him 4. How many apples has Ann? z"),
        (3, TOM),
        (4, "Ann has 7 pears. Paul sells her 4. How many pears owns Ann?"),
        (5, "Ann has 7 apples. Paul gives him 4. How many apples has Carl?"),
    ]
    got = found(spark, rows, [(1, TOM)])
    assert got == {(1, 1): (1.0, 4), (2, 1): (1.0, 4), (3, 1): (1.0, 0), (5, 1): (8 / 9, 4)}


@pytest.mark.parametrize("item", [TOM, TOM.lower(), PEARS, PEARS.upper()])
@pytest.mark.parametrize("change", [str.lower, str.upper, str.title])
def test_copies_in_other_case(spark, item, change):
    assert found(spark, [(1, f"before, {change(item)} after")], [(1, item)]) == {(1, 1): (1.0, 0)}


def test_several_variants_in_one_document(spark):
    """Copies with other names and numbers do not mix, nor do those in texts that share an id."""
    tail = " Now give the sum in words and explain every single step on the way"
    item = ITEMS[0][1]

    def variant(k, put_in=""):
        text = f"If Bob{'abcdefghijkl'[k]} buys {k + 17} apples and {k + 2} oz of pears{put_in} then Bob{'abcdefghijkl'[k]} pays"
        return f"{text} how much for {k + 17} apples?"

    rows = [(k, f"{variant(k)} {'word ' * (3 * k)}{variant((k + 1) % 12)} {variant((k + 5) % 12)}") for k in range(12)]
    rows += [(100 + k // 2, variant(k)) for k in range(12)]
    got = found(spark, rows, [(1, item)])
    assert got == {(d, 1): (1.0, 4) for d in [*range(12), *range(100, 106)]}
    rows = [(k, " ".join(variant((k + i) % 12, " also") + tail for i in (0, 1, 5))) for k in range(12)]
    got = found(spark, rows, [(1, item + tail)])
    assert set(got) == {(k, 1) for k in range(12)} and min(got.values())[0] > 0.8


def test_no_benchmark_or_documents(spark):
    assert found(spark, [(1, ITEMS[3][1])], [(1, None)]) == {}
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert template_decontamination.contaminated(docs, bench).count() == 0


def test_benchmark_passages_of_the_table(spark):
    """Every document that holds a whole item, by words, is found, and no document without most of its words."""
    import re

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()
    plain = lambda t: " ".join(re.sub(r"[^\w]+|_", " ", t.lower()).split())
    texts = [(r["doc_id"], f" {plain(r['text'])} ") for r in docs]
    want = {(d, i["item_id"]) for i in items for d, t in texts if f" {plain(i['text'])} " in t}
    rows = template_decontamination.contaminated(spark.createDataFrame(docs), spark.createDataFrame(items)).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert want and want <= got
    words = {d: set(t.split()) for d, t in texts}
    asked = {i["item_id"]: set(plain(i["text"]).split()) for i in items}
    assert all(len(asked[i] & words[d]) >= 0.9 * len(asked[i]) for d, i in got)


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.length()) if files.apply(i).getName().startswith("shuffle_")}


def test_archives_leave_no_shuffled_payloads(spark, tmp_path):
    table = spark.createDataFrame([(i, f"http://x.example/{i}", f"page {i % 7} " * 50) for i in range(40)], "page_id long, url string, html string")
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, conf = _shuffle_files(spark), spark.conf.get(name, None)
    warc.write_archives(table, str(tmp_path / "archives"))
    deadline = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < deadline:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert spark.conf.get(name, None) == conf
    assert warc.read_archives(spark, str(tmp_path / "archives")).filter("record_type = 'response'").count() == 7


def test_parsed_records_take_little_disk(spark, tmp_path):
    table = spark.createDataFrame([(i, f"http://x.example/{i}", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string")
    warc.write_archives(table, str(tmp_path / "archives"))
    files = warc.read_archives(spark, str(tmp_path / "archives")).inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)
