import base64
import gzip
import hashlib
from collections import Counter
from pathlib import Path

from corpusloom.llm import warc
from corpusloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_op10(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    first = {}
    for k in sorted(pages):
        first.setdefault(pages[k], k)
    rows = QUERIES["op10_warc"](spark, SF).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        payload = pages[r.page_id]
        revisit = first[payload] != r.page_id
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", first[payload] if revisit else None)


def test_odd_pages_round_trip(spark, tmp_path):
    hostile = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    rows = [(1, "http://a/\r\nX: y", None, 1), (2, None, "", 2), (3, "http://b", hostile, 3), (4, "http://c", hostile, 4), (5, "http://d", "é" * 300000, None), (6, "u", "a\n", 0), (7, "u", "a\r\n", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _id long")
    warc.write_warc(pages, f"{tmp_path}/w")
    got = {int(r.metadata.fields["page-id"]): r for r in warc.assemble(warc.read_warc(spark, f"{tmp_path}/w")).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7]
    kinds = {k: r.response.type for k, r in got.items()}
    assert kinds == {1: "response", 2: "revisit", 3: "response", 4: "revisit", 5: "response", 6: "response", 7: "response"}
    for k, _, html, _ in rows:
        if kinds[k] == "response":
            assert bytes(got[k].response.payload).decode() == (html or "")
        assert (got[k].request.target_uri is None) == (k == 2)
    warc.write_warc(pages.limit(0), f"{tmp_path}/none")
    assert warc.assemble(warc.read_warc(spark, f"{tmp_path}/none")).count() == 0


def test_assembly_without_partners(spark):
    rows = [("response", "r1", [], None, "u", "D", 1, {}, b"x"), ("request", "q1", ["r1", "r9"], None, "u", None, None, {}, b""), ("request", "q0", ["r1"], None, "u", None, None, {}, b""), ("metadata", "m1", ["r8"], None, "u", None, None, {"a": "b"}, None), ("revisit", "r2", [], "r1", None, "D", None, {}, None)]
    got = {r.capture_id: r for r in warc.assemble(spark.createDataFrame(rows, warc.RECORD_SCHEMA)).collect()}
    assert sorted(got) == ["r1", "r2"] and got["r1"].request.record_id == "q0" and got["r1"].metadata is None and got["r2"].request is None


def test_repeated_rows_and_null_ids(spark, tmp_path):
    """A row each, whatever repeats; the first of equal payloads has the smallest id, null ids coming last."""
    rows = [(1, "u", "x"), (1, "u", "x"), (2, "u", "x"), (None, "u", "x"), (None, None, "x"), (3, "u", "y"), (3, "u", "z"), (None, "u", "only"), (None, "u", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.requested_uri) for r in QUERIES["op10_warc"](spark, str(tmp_path)).collect())
    assert got == Counter({(1, 1, "response", None, "u"): 1, (1, 1, "revisit", 1, "u"): 1, (2, 1, "revisit", 1, "u"): 1, (None, 1, "revisit", 1, "u"): 1, (None, 1, "revisit", 1, None): 1, (3, 1, "response", None, "u"): 2, (None, 4, "response", None, "u"): 1, (None, 0, "response", None, "u"): 1})


def test_files_are_gzip_members(spark, tmp_path):
    """Every file is one gzip member per record, of bounded size, with what the format requires of each record."""
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"{i} " + "q" * 17_000_000 * (i == 5)) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(pages, f"{tmp_path}/w", file_bytes=2000)
    files = [p.read_bytes() for p in Path(f"{tmp_path}/w").glob("part-*")]
    assert len(files) > 5
    found = [r for f in files for m in warc.members(memoryview(f)) for r in warc.parse_records(m)]
    assert len(found) == 120 and all(len(list(warc.parse_records(m))) <= 1 for f in files for m in warc.members(memoryview(f)))
    assert all(h.keys() >= {"warc-record-id", "warc-date", "warc-type", "content-length"} for _, h, _ in found)
    assert len({h["warc-record-id"][0] for _, h, _ in found}) == 120
    assert all([x[1] for x in warc.parse_records(gzip.decompress(f))] for f in files)


def test_response_names_its_request(spark):
    rows = [("response", "r1", ["q1", "nobody"], None, "u", "D", 1, {}, b"x"), ("request", "q1", [], None, "u", None, None, {}, b"")]
    (got,) = warc.assemble(spark.createDataFrame(rows, warc.RECORD_SCHEMA)).collect()
    assert got.request.record_id == "q1" and got.metadata is None
