import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import warc
from tallyforge.llm.common import materialize, scratch_dir

ROWS = [
    (1, "http://b.example.com/x?q=1#f", "<p>one</p>"),
    (2, "https://b.example.com:443/x?q=1", "<p>one</p>"),
    (3, "http://a.example.com", "<p>é</p>"),
    (4, "http://user@a.example.com/z\nq", None),
    (5, None, ""),
    (6, "not a url", "<p>one</p>"),
    (7, "http://a.example.com/long", "x" * 3_000_000),
    (None, "http://a.example.com/n", "<p>one</p>"),
]


def expected(rows):
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = None if i is None or last[h or ""] == i else last[h or ""]
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "'k' as key", "1 as file", "'o' as offset")


def test_round_trip(spark, pages):
    with_id = pages.where("page_id is not null")
    assert got(warc.round_trip(with_id)) == expected([r for r in ROWS if r[0] is not None])
    payloads = {r.page_id: r.payload for r in warc.round_trip(with_id).collect() if r.record_type == "response"}
    assert bytes(payloads[3]) == "<p>é</p>".encode() and len(payloads[7]) == 3_000_000
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_all_rows_by_url(spark, pages):
    root = scratch_dir(spark)
    captures = warc.write_archives(pages, root, most=2000)
    assert captures.select("file").distinct().count() > 1
    heads = warc.build_index(captures, root, lines=2, per_file=3)
    assert len(heads) > 1
    urls = captures.selectExpr("key", "cast(null as bigint) as page_id")
    places = materialize(warc.locate(urls, root, heads), "places")
    assert got(warc.fetch(places, root)) == expected(ROWS)
    one = spark.createDataFrame([("http://B.example.com/x?q=1",)], "url string").select(warc.url_key(F.col("url")).alias("key")).selectExpr("key", "cast(null as bigint) as page_id")
    assert sorted(r.page_id for r in warc.fetch(warc.locate(one, root, heads), root).collect()) == [1, 2]
    missing = one.selectExpr("'com,nowhere)/' as key", "cast(9 as bigint) as page_id")
    assert warc.locate(missing, root, heads).count() == 0


def test_many_copies_over_many_blocks(spark):
    rows = [(i, f"http://h{i % 3}.example.org/{i % 5}", f"body {i % 4}") for i in range(700)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert got(warc.round_trip(df)) == expected(rows)


def test_keys_with_characters_that_lines_encode(spark):
    names = ["a b", "a!b", 'a"b', "a#b", "a$b", "a%b", "a\tb", "a\nb", "a%0Ab", "a%20b", "a", "a b!", "é b", "\x00"]
    rows = [(i, f"{head}{name}", f"body {i}") for i, (head, name) in enumerate((h, n) for h in ("http://x/", "") for n in names)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert got(warc.round_trip(df)) == expected(rows)
    root = scratch_dir(spark)
    captures = warc.write_archives(df, root)
    heads = warc.build_index(captures, root, lines=2, per_file=5)
    for q in (captures, captures.selectExpr("key", "cast(null as bigint) as page_id")):
        assert got(warc.fetch(warc.locate(q, root, heads), root)) == expected(rows)


def test_repeated_rows_over_many_blocks(spark):
    rows = [(7, "http://x/a", "one")] * 9 + [(8, "http://x/a", "two"), (-(1 << 63), "http://x/a", "low"), ((1 << 63) - 1, "http://x/a", "high")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    root = scratch_dir(spark)
    captures = warc.write_archives(df, root)
    heads = warc.build_index(captures, root, lines=2)
    assert got(warc.fetch(warc.locate(captures, root, heads), root)) == expected(rows)


def test_one_id_with_several_payloads(spark):
    rows = [(1, "http://x/a", "A"), (1, "http://x/b", "B"), (2, "http://x/c", "A"), (3, "http://x/d", "B"), (4, "http://x/e", "Z"), (1, "http://x/a", "A"), (2, "http://x/c", "only here"), (2, None, None), (3, None, "")]
    back = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert got(back) == expected(rows)
    payloads = {(r.page_id, bytes(r.payload)) for r in back.collect() if r.record_type == "response"}
    assert payloads == {(2, b"A"), (3, b"B"), (4, b"Z"), (2, b"only here"), (3, b"")}


def test_records_are_checked():
    raw, _, _ = warc.record(3, "http://x/", b"payload", None, "2000-01-01T00:00:00Z")
    assert warc.parse(raw)[:2] == (3, 7) and gzip.decompress(gzip.compress(raw)) == raw
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(raw.replace(b"payload\r\n", b"paylord\r\n"))
