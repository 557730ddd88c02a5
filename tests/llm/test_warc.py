"""Archives: exact round trips, revisits against a plain version, archives of archives, odd tables."""

import gzip
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from breachlens.llm import warc
from breachlens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string"


def expected(rows):
    """(page_id, bytes, digest, type, refers_to) by a plain loop."""
    payload = [(p, (h or "").encode()) for p, _, h, *_ in rows]
    groups = {}
    for i, (p, b) in enumerate(payload):
        groups.setdefault(b, []).append(i)
    out = []
    for b, own in groups.items():
        first = max(own, key=lambda i: (payload[i][0] is not None, payload[i][0] or 0))
        for i in own:
            again = len(b) >= 1000 and i != first
            out.append((payload[i][0], len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response",
                        payload[first][0] if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def odd_rows():
    rng = random.Random(4)
    long = "é" * 400 + "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n" + "x" * 300
    texts = [None, "", "short", "\r\n\r\n", "a" * 999, "a" * 1000, "é" * 500, long, long + "\r\n", "b\x00c" * 400]
    rows = [(i, f"http://h.test/{i}", rng.choice(texts)) for i in range(120)]
    rows += [(None, None, long), (None, "http://n.test/\r\nWARC-Type: x", long), (5, "http://again.test/", long)] + [rows[7]] * 3
    return rows + [(1000 + i, "http://hot.test/", "hot " * 400) for i in range(200)] + [(9, "u\x7f\x01", "z" * 100_000)]


def write(spark, rows, path, schema=SCHEMA, **options):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return warc.write_archives(warc.from_pages(df), str(path), archive_bytes=20_000, **options)


def test_round_trip(spark, tmp_path):
    rows = odd_rows()
    write(spark, rows, tmp_path / "w")
    read = warc.read_archives(spark, str(tmp_path / "w"), "long")
    assert got(warc.resolved(read)) == expected(rows)
    kept = read.where("record_type = 'response'").select("page_id", "payload").collect()
    assert {(p, bytes(b)) for p, b in kept} <= {(p, (h or "").encode()) for p, _, h in rows}
    # a payload of 1000 bytes or more is there once
    long = [bytes(b) for _, b in kept if len(b) >= 1000]
    assert len(long) == len(set(long))


def test_files_are_warc(spark, tmp_path):
    write(spark, odd_rows(), tmp_path / "w", date="2024-05-06T07:08:09Z")
    files = sorted((tmp_path / "w").glob("part-*"))
    assert len(files) > 3
    ids, refers = set(), set()
    for f in files:
        assert gzip.decompress(f.read_bytes()).count(b"WARC-Record-ID: ") == sum(1 for _ in warc.records_in(f.read_bytes()))
        for fields, block in warc.records_in(f.read_bytes()):
            assert fields["warc-date"] == b"2024-05-06T07:08:09Z" and int(fields["content-length"]) == len(block)
            assert fields["warc-record-id"] not in ids
            ids.add(fields["warc-record-id"])
            refers |= {fields["warc-refers-to"]} if "warc-refers-to" in fields else set()
            http, _, payload = block.partition(b"\r\n\r\n")
            assert http.startswith(b"HTTP/1.1 200 OK\r\n")
            if fields["warc-type"] == b"response":
                assert warc._read_record(fields, block)[5] == hashlib.sha1(payload).hexdigest()
            else:
                assert payload == b"" and fields["warc-profile"].endswith(b"identical-payload-digest")
    assert refers and refers <= ids


def test_archives_of_two_crawls_become_one(spark, tmp_path):
    rows = odd_rows()
    write(spark, rows[:150], tmp_path / "a")
    write(spark, rows[150:], tmp_path / "b")
    both = warc.read_archives(spark, str(tmp_path / "a"), "long").union(warc.read_archives(spark, str(tmp_path / "b"), "long"))
    whole = warc.resolved(both, payloads=True)
    warc.write_archives(whole, str(tmp_path / "c"))
    again = warc.resolved(warc.read_archives(spark, str(tmp_path / "c"), "long"))
    want = expected(rows)
    assert [(r[0], r[1], r[2]) for r in got(again)] == [(r[0], r[1], r[2]) for r in want]
    # payloads of revisits are in one archive only: the response is the largest page id among the records that bring one
    assert again.where("record_type = 'response' AND payload_bytes >= 1000").select("payload_digest").distinct().count() == \
        again.where("record_type = 'response' AND payload_bytes >= 1000").count()


def test_record_of_more_than_16_mb(spark, tmp_path):
    rows = [(1, "u", "abc\0" * (5 << 20)), (2, "v", "short"), (3, "w", "abc\0" * (5 << 20))]
    write(spark, rows, tmp_path / "w")
    assert got(warc.resolved(warc.read_archives(spark, str(tmp_path / "w"), "long"))) == expected(rows)


def test_odd_tables(spark, tmp_path):
    write(spark, [], tmp_path / "none")
    assert got(warc.resolved(warc.read_archives(spark, str(tmp_path / "none"), "long"))) == []
    rows = [(1, "u", "x" * 2000, "r", 1), (2, None, "x" * 2000, None, 2)]
    write(spark, rows, tmp_path / "w", SCHEMA + ", payload string, r int")
    assert got(warc.resolved(warc.read_archives(spark, str(tmp_path / "w"), "long"))) == expected(rows)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0").write_bytes(gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))
    with pytest.raises(Exception, match="another length"):
        warc.read_archives(spark, str(tmp_path / "bad")).collect()


def test_op12(spark):
    con = duckdb.connect()
    rows = con.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall()
    assert got(QUERIES["op12_warc"](spark, SF)) == expected(rows)
    con.sql(f"CREATE VIEW pages AS FROM '{SF}/pages.parquet'")
    assert sorted(con.sql(ORACLES["op12_warc"]).fetchall(), key=str) == expected(rows)
    # the given pages are all different: the same with every third one's text repeated
    df = spark.createDataFrame(rows, SCHEMA)
    more = df.union(df.where("page_id % 3 = 0").select((F.col("page_id") + 10_000).alias("page_id"), "url", "html"))
    made = [tuple(r) for r in more.collect()]
    from breachlens.session import shared_dir
    path = warc.write_archives(warc.from_pages(more), shared_dir(spark, "warc-test"))
    assert got(warc.resolved(warc.read_archives(spark, path, "long"))) == expected(made)
