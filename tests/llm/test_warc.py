import gzip
import hashlib

import duckdb
import pandas as pd
import pytest

from plumbline.llm import queries, warc
from tests.test_oracles import plain

BIG, SMALL = "é<p>big</p>" * 200, "small"
ROWS = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, None, SMALL), (4, "http://a/4", SMALL), (5, "http://a/5\r\nX: y", None), (6, "", ""), (7, "http://b/7", "other" + BIG), (2, "http://a/2", BIG), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 100), (9, "v", "x" * 1_500_000)]
SCHEMA = "page_id long, url string, html string, KEY string, payload int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def table(found):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.listing(found).collect()), key=str)


def test_equal_payloads_are_stored_once_and_revisited(spark):
    found = warc.archive(pages(spark, ROWS))
    assert found.payloads.count() == len({r[2] or "" for r in ROWS})
    want = []
    for i, (page, _, html) in enumerate(ROWS):
        data = (html or "").encode()
        same = [(r[0], k) for k, r in enumerate(ROWS) if r[2] == html]
        revisit = len(data) >= 1000 and (page, i) != max(same)
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same)[0] if revisit else None))
    assert table(found) == sorted(want, key=str)
    headers = [bytes(r.header).decode() for r in found.headers.collect()]
    assert all(h.startswith("WARC/1.1\r\n") and h.endswith("\r\n\r\n") and h.count("\r\n\r\n") == 1 for h in headers)
    assert not any(line.startswith("X:") for h in headers for line in h.split("\r\n"))


def test_records_are_whole_and_files_round_trip(spark, tmp_path):
    """Records from the archive, through files (plain and gzip members) and another archive, byte for byte."""
    found = warc.archive(pages(spark, ROWS))
    first = sorted(bytes(r.record) for r in warc.records(found).collect())
    for r in first:
        header, block = r.split(b"\r\n\r\n", 1)
        size = next(int(x.split(b":")[1]) for x in header.split(b"\r\n") if x.startswith(b"Content-Length"))
        assert len(block) == size + 4
    warc.write_files(found, f"{tmp_path}/plain", per_file=3)
    again = warc.archive_records(warc.read_files(spark, f"{tmp_path}/plain"), f"{tmp_path}/again")
    assert sorted(bytes(r.record) for r in warc.records(again).collect()) == first
    (tmp_path / "zip").mkdir()
    odd = b"WARC/1.0\r\nwarc-type: warcinfo\r\nX-Own:  kept \r\nCONTENT-LENGTH: 5\r\n\r\na\x00\xff\r\n\r\n\r\n"
    (tmp_path / "zip" / "x.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in [*first, odd, odd]))
    again = warc.archive_records(warc.read_files(spark, f"{tmp_path}/zip"))
    assert sorted(bytes(r.record) for r in warc.records(again).collect()) == sorted([*first, odd, odd])


def test_damage_is_noticed(spark, tmp_path):
    path = f"{tmp_path}/a"
    found = warc.archive(pages(spark, ROWS), path)
    bad = warc.Archive(found.headers, found.payloads.selectExpr("key", "cast(concat(cast(payload as string), '!') as binary) as payload", "parts"))
    with pytest.raises(Exception, match="damaged payload"):
        warc.records(bad).collect()
    (tmp_path / "cut.warc").write_bytes(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort")
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_files(spark, f"{tmp_path}/cut.warc").collect()


def test_hot_payload_is_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(warc, "PART", 10)
    found = warc.archive(pages(spark, [(i, f"u{i}", BIG if i % 3 else f"{i}") for i in range(300)]))
    assert found.headers.groupBy("key", "part").count().agg({"count": "max"}).first()[0] < 30
    rows = table(found)
    assert sum(r[3] == "revisit" for r in rows) == 199 and {r[4] for r in rows} == {None, 299} and warc.records(found).count() == 300


def test_empty_table_and_null_ids(spark):
    assert table(warc.archive(pages(spark, []))) == []
    assert [r[3:] for r in table(warc.archive(pages(spark, [(None, "a", BIG), (None, "b", BIG), (1, "c", BIG)])))] == [("response", None), ("revisit", 1), ("revisit", 1)]


def test_planted_copies_equal_sql(spark, sf, tmp_path):
    p = pd.read_parquet(f"{sf}/pages.parquet")
    p = pd.concat([p, p.assign(page_id=p.page_id + 1000).head(30), p.assign(page_id=p.page_id + 2000).head(10), pd.DataFrame([(5000, None, None), (5001, "u", "")], columns=["page_id", "url", "html"])])
    p.to_parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet')")
    df, want = queries.op11_warc_archive(spark, str(tmp_path)), duck.sql(queries.oracle_sql()["op11_warc_archive"])
    at = [want.columns.index(c) for c in df.columns]
    rows = sorted(tuple(plain(v) for v in r) for r in df.collect())
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert sum(r[3] == "revisit" for r in rows) >= 30
