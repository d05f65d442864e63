import base64
import gzip
import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from rategrid.llm import warc

ROWS = [(1, "u", "a"), (2, "u", "a"), (3, "u\r\nx: y", None), (4, None, ""), (-5, "v", "é" * 200000),
        (6, "v", "é" * 200000), (None, "w", "a"), (None, "w", "zz"), (7, "x", "WARC/1.0\r\n\r\n"), (8, "x", "\n"),
        (8, "x", "\n"), (9, "y", "x" * 65536), (10, "y", "x" * 65537)]


def pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn(
        "main", F.lit(1)).withColumn("key", F.lit("k")).withColumn("payload", F.lit("p"))


def brute(rows):
    largest = {}
    for p, _, h in rows:
        if p is not None:
            largest[h or ""] = max(largest.get(h or "", p), p)
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        main = largest.get(h or "", p)
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "response" if main == p else "revisit", None if main == p else main))
    return sorted(out, key=str)


def test_round_trip(spark):
    got = warc.roundtrip(spark, pages(spark)).drop("n_chunks").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(ROWS)


def test_chunks_rebuild_payloads_with_running_digests(spark, tmp_path):
    a = warc.write_archives(pages(spark), str(tmp_path / "w"))
    rows = warc.read_chunks(a, chunk_bytes=1000).collect()
    parts = defaultdict(dict)
    for r in rows:
        if r["record_type"] == "response":
            assert len(r["chunk"]) <= 1000
            parts[r["page_id"]][r["chunk_no"]] = r
    want = {p: (h or "").encode() for p, _, h in ROWS if p is not None}
    for p, chunks in parts.items():
        if p is None:
            continue
        data = b""
        for i in range(len(chunks)):
            assert chunks[i]["offset"] == len(data)
            data += bytes(chunks[i]["chunk"])
            assert chunks[i]["digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
            assert chunks[i]["payload_bytes"] == len(data)
        assert data == want[p] and chunks[len(chunks) - 1]["is_last"]


def test_archives_are_plain_warc(spark, tmp_path):
    a = warc.write_archives(pages(spark, ROWS[:4]).coalesce(1), str(tmp_path / "w")).collect()
    raw = gzip.open(a[0]["path"]).read()
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    assert raw.count(b"WARC/1.1\r\n") == 5 and b"u%0D%0Ax:%20y" in raw
    assert raw.endswith(b"\r\n\r\n") and b"WARC-Profile" in raw


def test_small_payloads_are_not_revisited(spark, tmp_path):
    a = warc.write_archives(pages(spark), str(tmp_path / "w"), min_revisit_bytes=1000)
    kinds = {r["page_id"]: r["record_type"] for r in warc.read_chunks(a).collect()}
    assert kinds[1] == "response" and kinds[-5] == "revisit" and kinds[6] == "response"


def test_archive_rotation(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1)
    a = warc.write_archives(pages(spark), str(tmp_path / "w"))
    assert a.count() >= 1 and a.agg(F.sum("records")).first()[0] == len(ROWS)


def test_record_ids_hold_page_ids():
    for p in (0, 1, -1, 2**63 - 1, -2**63, None):
        assert warc.page_of(warc.record_id(p)) == p


def test_empty_table(spark):
    assert warc.roundtrip(spark, pages(spark, [])).count() == 0
