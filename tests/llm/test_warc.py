import base64
import hashlib
import io

import pytest

from graphloom.llm import warc


def test_records_come_back():
    raw = warc.record(7, "http://a/é", "päge".encode()) + warc.record(9, None, "päge".encode(), refers_to=7) + warc.record(None, "u\r\nv", b"")
    got = list(warc.read_records(io.BytesIO(raw), with_payload=True))
    assert [(r["page_id"], r["url"], r["payload_bytes"], r["record_type"], r["refers_to"], r["payload"]) for r in got] == [
        (7, "http://a/é", 5, "response", None, "päge".encode()),
        (9, None, 5, "revisit", 7, None),
        (None, "u%0D%0Av", 0, "response", None, b""),
    ]
    assert got[1]["payload_digest"] == base64.b32encode(hashlib.sha1("päge".encode()).digest()).decode()


def test_long_payloads_pass_in_steps():
    payload = bytes(range(256)) * 20_000
    (got,) = warc.read_records(io.BytesIO(warc.record(1, "u", payload)), with_payload=True)
    assert got["payload"] == payload


def test_damage_is_found():
    import zlib

    raw = warc.record(1, "u", b"abcdef" * 9)
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(raw[:-20])))
    plain = zlib.decompress(raw, 31).replace(b"abcdef", b"abcdeg", 1)
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(warc.WarcError, match="digest"):
        list(warc.read_records(io.BytesIO(pack.compress(plain) + pack.flush())))


def test_frames(spark):
    rows = [(5, "u5", "same", 1), (3, "u3", "same", 1), (3, "u3", "same", 1), (9, "u9", None, 1), (8, "u8", "", 1), (None, "n", "same", 1), (None, None, "alone", 1), (4, "u4", "x" * 300_000, 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.warc_round_trip(pages).collect()), key=str)
    assert got == sorted(
        [(5, 4, "revisit", 3), (3, 4, "response", None), (3, 4, "response", None), (9, 0, "revisit", 8), (8, 0, "response", None), (None, 4, "revisit", 3), (None, 5, "response", None), (4, 300_000, "response", None)],
        key=str,
    )
    longer = warc.warc_round_trip(pages, min_bytes=5)
    assert longer.where("record_type = 'revisit'").count() == 0
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_equals_sql(spark, sf_dir):
    import duckdb

    from graphloom.llm.queries import op8_warc

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    columns = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    want = set(con.execute(f"select {columns} from ({warc.ORACLE})").fetchall())
    got = {tuple(r) for r in op8_warc(spark, sf_dir).selectExpr(*columns.split(", ")).collect()}
    assert got == want
