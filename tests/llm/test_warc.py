import hashlib

import pytest

from rostrum.llm import warc

SCHEMA = "page_id long, url string, html string"


def expected(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        low = first.get(b)
        again = low is not None and (i is None or low < i)
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", low if again else None, True))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact").collect()), key=repr)


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999:x>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
ROWS = [(0, "http://a/0", "x" * 200), (1, "http://a/1", "x" * 200), (2, "http://a/2", "short"), (3, "http://a/3", "short"), (4, "http://a/4", None), (5, None, ""),
        (6, "http://a/\r\nWARC/1.1\r\n6", FAKE + "tail"), (7, "http://a/7", FAKE * 3), (8, "http://a/8", "WARC/1.1\r\n" * 50), (9, "http://a/9", "é" * 49 + "WARC/1.WARC/1.1\r\n\r\n\r\n"),
        (None, "http://a/n", "x" * 200), (10, "http://a/10", "\r\n\r\n" * 30 + "WARC/1.1\r\n"), (11, "http://a/11", FAKE.replace("5\r", "9\r") + "é\n" * 4000 + FAKE),
        (12, "http://a/12", "é" * 50), (-3, "http://a/-3", "é" * 50), (2, "http://a/2", "short"), (13, "http://a/13", "Content-Length: 3\r\n\r\n" + FAKE)]


@pytest.mark.parametrize("size", ["134217728", "300", "4000"])
def test_round_trip_over_any_blocks(spark, size):
    """Splits of all sizes, down to a few hundred bytes, give the same records."""
    pages = spark.createDataFrame(ROWS, SCHEMA).coalesce(2)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        assert result(warc.round_trip(pages)) == expected(ROWS)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_read_back_whole_payloads(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    got = {r["page_id"]: bytes(r["payload"]) for r in warc.round_trip(pages).where("record_type = 'response'").collect()}
    assert got[7] == (FAKE * 3).encode() and got[11] == ROWS[12][2].encode() and got[4] == b""


def test_empty_table_and_other_columns(spark):
    assert result(warc.round_trip(spark.createDataFrame([], SCHEMA))) == []
    pages = spark.createDataFrame([(1, "u", "a" * 100, "n", 1), (2, "u", "a" * 100, "m", 2)], SCHEMA + ", digest string, first int")
    assert [r[:1] + r[3:5] for r in result(warc.round_trip(pages))] == [(1, "response", None), (2, "revisit", 1)]


def test_groups_of_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCKS_AT_ONCE", 2)
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    assert result(warc.round_trip(pages)) == expected(ROWS)


def test_archive_of_others_with_a_broken_chain(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: resource\r\ncontent-length: 4\r\n\r\n\xff\xfe\r\n\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record * 3 + b"WARC/1.0\r\nno length\r\n\r\n" + record)
    (tmp_path / "b.warc").write_bytes(b"junk" + record)
    (tmp_path / "c.warc").write_bytes(record + record[:-9])
    got = warc.read_archives(spark, str(tmp_path), "WARC/1.0\r\n").collect()
    assert sorted((r["file"][-6:], r["offset"], bytes(r["block"])) for r in got) == [
        ("a.warc", i * len(record), b"\xff\xfe\r\n") for i in range(3)] + [("c.warc", 0, b"\xff\xfe\r\n")]
