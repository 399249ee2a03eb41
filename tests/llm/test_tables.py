"""Sharding, URL lists and archives against brute force, and the cases that tables may hold."""

import zlib
from datetime import date, timedelta

import numpy as np
import pytest
import zstandard

from curvelark.llm import sharding, url_lists, warc
from tests.llm.util import docs_frame


def test_shards(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), "é" * int(n)) for i, n in zip(rng.permutation(3000), rng.integers(0, 60, 3000), strict=True)] + [(5000, None), (7, "same"), (7, "same"), (None, "x"), (6000, "long " * 2000)]
    got = sharding.byte_balanced_shards(docs_frame(spark, rows, extra=True), 8).toPandas()
    assert len(got) == len(rows) and got.grown_shard.isna().all() and set(got.law) == {"bytes"}
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted(zip(got.doc_id.fillna(-1).astype(int), got["size"], got.text_crc32, strict=True)) == want
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 2 * 10_001 and list(sizes.index) == list(range(8))
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    g = got.sort_values(["shard", "slot"])
    assert g.doc_id.fillna(-1).is_monotonic_increasing
    assert sharding.byte_balanced_shards(docs_frame(spark, []), 8).count() == 0
    with pytest.raises(ValueError):
        sharding.byte_balanced_shards(docs_frame(spark, []), 0)


def test_url_lists(spark):
    rng = np.random.default_rng(2)
    hosts = ["a.x.com", "b.x.com", "x.com", "y.org", "w.v.y.org", "10.0.0.1", "[2001:db8::1.2]"]
    day = lambda n: date(2024, 1, 1) + timedelta(days=int(n))
    entries = [(hosts[int(rng.integers(0, 7))], ["add", "remove"][int(rng.integers(0, 2))], day(rng.integers(0, 60))) for _ in range(60)]
    caps = [(i, f"https://u@{hosts[int(rng.integers(0, 7))].upper()}:8/p?q", day(rng.integers(0, 70))) for i in range(300)] + [(900, None, day(3)), (901, "https://x.com/", None), (902, "no url", day(3)), (903, "", day(9)), (1, caps_url := "http://x.com", day(30)), (1, caps_url, day(30))]
    e = spark.createDataFrame([*entries, (None, "add", day(1)), ("x.com", None, day(1)), entries[0]], "pattern string, action string, listed_on date")
    c = spark.createDataFrame(caps, "page_id long, url string, fetched_on date").selectExpr("*", "1 AS _salt", "2 AS n")
    got = sorted((r.page_id, r.host, r.blocked, r.n_active, r.pattern) for r in url_lists.judge_captures(c.drop("n"), e, 4).collect())

    def state(pattern, when):
        known = sorted((d, a) for p, a, d in entries if p == pattern and d <= when)
        return bool(known) and known[-1][1] == "add"

    want = []
    for i, url, when in caps:
        host = "" if not url or "://" not in url else url.split("://")[1].split("/")[0].split("@")[-1].lower()
        host = host.split("]")[0] + "]" if host[:1] == "[" else host.split(":")[0]
        labels = host.split(".")
        asked = [] if not host else [host] if len(labels) < 2 or host[0].isdigit() or host[0] == "[" else [".".join(labels[k:]) for k in range(len(labels) - 1)]
        hit = [p for p in asked if when is not None and state(p, when)]
        want.append((i, host, bool(hit), len(hit), max(hit, key=lambda p: (len(p), p)) if hit else None))
    assert got == sorted(want)
    clash = c.selectExpr("*", "'mine' AS host", "true AS blocked", "7L AS n_active", "'p' AS pattern", "5 AS valid_to", "6 AS _at", "8 AS _span", "9 AS action")
    said = url_lists.judge_captures(clash, e, 4)  # columns that are added replace those of the same name, others stay
    assert len(set(said.columns)) == len(said.columns) and said.where("valid_to = 5 AND _at = 6 AND _span = 8 AND action = 9 AND n = 2").count() == len(caps)
    assert sorted((r.page_id, r.host, r.blocked, r.n_active, r.pattern) for r in said.collect()) == got
    twice = spark.createDataFrame([("x.com", "add", day(1)), ("x.com", "add", day(5)), ("x.com", "remove", day(9))], "pattern string, action string, listed_on date")
    asked = spark.createDataFrame([(n, "http://x.com", day(n)) for n in (0, 1, 4, 5, 8, 9)], "page_id long, url string, fetched_on date")
    assert [r.listed_on for r in url_lists.judge_captures(asked, twice).orderBy("page_id").collect()] == [None, day(1), day(1), day(5), day(5), None]
    assert url_lists.judge_captures(c.where("false"), e).count() == 0 and url_lists.judge_captures(c, e.where("false")).where("blocked").count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "2 AS _salt")


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    big = "<p>é text</p>" * 120
    rows = [(i, f"http://h/{i}\r\nx%", f"<html>{'page ' * (i % 300)}{i}") for i in range(200)] + [(500, None, big), (501, "u", big), (499, "u", big), (501, "u", big), (600, "u", "tiny"), (601, "u", "tiny"), (700, "u", None), (701, "u", ""), (None, "u", big)]
    folder = f"file://{tmp_path}/w"
    assert warc.write_archives(pages(spark, rows), folder) == len(rows)
    got = warc.read_archives(spark, folder).collect()
    assert len(got) == len(rows) and len(list((tmp_path / "w").glob("*.warc.zst"))) > 3 and not list((tmp_path / "w").glob(".part*"))
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert [x.record_type for x in by[501]] == ["response", "response"] and by[500][0].refers_to == by[499][0].refers_to == 501
    assert by[500][0].payload is None and by[500][0].payload_bytes == len(big.encode()) and by[500][0].payload_digest == by[501][0].payload_digest
    assert by[600][0].record_type == by[601][0].record_type == "response" and by[700][0].payload_bytes == 0
    for i, url, html in rows[:200]:
        assert bytes(by[i][0].payload).decode() == html and by[i][0].url == url
    assert warc.write_archives(pages(spark, []), f"file://{tmp_path}/none") == 0


def test_pages_without_an_id_are_revisits(spark):
    same, alone, nameless = "s" * 2000, "a" * 2000, "n" * 2000
    pages = spark.createDataFrame([(1, "u", same), (5, "u", same), (None, "u", same), (None, "u", alone), (None, "u", nameless), (None, "u", nameless), (7, "u", "small"), (8, "u", "small")], "page_id long, url string, html string")
    got = sorted(((r.page_id or 0, r.payload_bytes, r.refers_to or 0) for r in warc.revisit_plan(pages).collect()))
    assert got == [(0, 2000, 0)] * 3 + [(0, 2000, 5), (1, 2000, 5), (5, 2000, 0), (7, 5, 0), (8, 5, 0)]


def test_archives_are_validated():
    press = zstandard.ZstdCompressor()
    rec = warc.record("response", 1, "u", b"abc", "a9993e364706816aba3e25717850c26c9cd0d89d", 3, None)
    assert next(warc.records(press.compress(rec)))["block"] == b"abc"
    skipped = b"\x50\x2a\x4d\x18\x03\x00\x00\x00xyz"
    assert len(list(warc.records(press.compress(rec) + skipped + press.compress(rec)))) == 2
    bad = [(rec.replace(b"WARC/1.1", b"HTTP/1.1"), "version"), (rec.replace(b"Content-Length: 3", b"Content-Length: 4"), "Content-Length"), (rec.replace(b"abc", b"abd"), "digest"), (rec.replace(b"WARC-Date: ", b"X-Date: "), "missing"), (rec.replace(b"Content-Length: 3", b"Content-Length: x"), "no number"), (rec.replace(b"WARC-Type: ", b"WARC-Type "), "missing|colon")]
    for data, said in bad:
        with pytest.raises(warc.WarcError, match=said):
            list(warc.records(press.compress(data)))
    whole = press.compress(rec)
    for data in (whole[:-3], whole + b"junkjunkjunk", b"\x5d\x2a\x4d\x18\xff\x00\x00\x00", warc.dictionary_frame(b"no dictionary") + whole):
        with pytest.raises((warc.WarcError, zstandard.ZstdError)):
            list(warc.records(data))
    samples = [f"<html><body>page number {i} of the same site".encode() * 3 for i in range(400)]
    d = warc.train_dictionary(samples)
    assert d and len(list(warc.frames(warc.dictionary_frame(d) + zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d)).compress(rec)))) == 1
