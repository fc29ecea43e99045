import base64
import hashlib

import pytest
from cases import ordered
from pyspark.sql import functions as F

from stepgrove.llm import line_dedup, warc

EVIL = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nfoo"
PAGES = [
    (1, "http://a/b c", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", EVIL), (4, "u", None), (5, "u", ""), (6, "u", EVIL), (None, "u", "WARC/1.1\r\n"),
    (7, "u", "WARC/1.1\r\n" * 3), (8, "u", "end\r\n\r\n"), (9, "q\r\nWARC-Type: fake", "x" * 3000 + "WARC/1.1\r\n" + "y" * 200_000), (9, "q", "again"), (9, "q", "again"),
    *[(i, "u", f"page {i}") for i in range(20, 80)],
]
COLUMNS = {"payload": lambda p: p, "sha": warc.base32_sha1}


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


@pytest.mark.parametrize("split", ["700", "64m"])
def test_archives_come_back(spark, tmp_path, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("payload", F.lit(1)).withColumn("id", F.lit(2))
        warc.write_archives(df.coalesce(2), str(tmp_path / "w"))
        got = warc.read_archives(spark, str(tmp_path / "w"), COLUMNS).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert ordered((r.page_id, r.payload, r.sha, r.stated) for r in got) == ordered((i, h or "", digest(h or ""), digest(h or "")) for i, _, h in PAGES)
    first = {}
    for i, _, h in PAGES:
        first[h or ""] = max(first.get(h or "", -1), -1 if i is None else i)
    for r in got:
        assert r.refers_to == (first[r.payload] if r.record_type == "revisit" else None)
    assert sum(r.record_type == "response" for r in got) == len(first)


def test_small_payloads_are_never_revisits(spark, tmp_path):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]
    warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string"), str(tmp_path / "w"), least=3)
    got = {r.page_id: r.record_type for r in warc.read_archives(spark, str(tmp_path / "w"), COLUMNS).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_broken_chain_keeps_what_comes_before(spark, tmp_path):
    rows = [(i, "u", f"page {i} " * 20) for i in range(10)]
    warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1), str(tmp_path / "w"))
    (name,) = (tmp_path / "w").glob("part-*")
    data = name.read_bytes()
    cut = [i for i in range(len(data)) if data.startswith(b"WARC/1.1", i)]
    folder = tmp_path / "broken"
    folder.mkdir()
    (folder / "x.warc").write_bytes(data[: cut[6]] + b"junk" + data[cut[6] :])
    got = warc.read_archives(spark, str(folder), COLUMNS).collect()
    assert len(got) == 6


def test_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    warc.write_archives(none, str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w"), COLUMNS).count() == 0


def test_site_lines(spark):
    rows = [(i, f"http://Big.example/{i}", f"menu\nbody {i}\nfooter\nmenu" if i % 2 else f"menu\n\n only {i} \nmenu\nfooter") for i in range(10)]
    rows += [(20 + i, f"https://u@small.example:80/{i}", "menu\nx") for i in range(4)] + [(30, None, "menu"), (31, "http://big.example", None), (32, "http://big.example", "")]
    rows += [(None, "http://big.example/n", "menu\nnull id"), (5, "http://big.example/5", "menu\nbody 5\nfooter\nmenu")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for c in ("id", "host", "lines", "marks", "n"):
        df = df.withColumn(c, F.lit("x"))
    got = line_dedup.drop_lines(df, "page_id", line_dedup.host(F.col("url")), F.col("html")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and by[1].host == "big.example" and by[1].host_pages == 14 and by[21].host == "small.example"
    assert (by[1].text, by[1].n_lines, by[1].n_dropped) == ("body 1", 4, 3) and by[2].text == "only 2"
    assert by[21].text == "" and by[21].n_dropped == 2 and by[30].text == "menu" and by[30].host_pages is None
    assert by[31].n_lines == 0 and by[None].text == "null id"
    floor = line_dedup.drop_lines(df, "page_id", line_dedup.host(F.col("url")), F.col("html"), least=5).collect()
    assert {r.page_id: r for r in floor}[21].text == "menu\nx"
    two = [(1, "http://a.example/1", "menu\none"), (2, "http://a.example/2", "menu\ntwo"), (3, "http://b.example/1", "menu\nmenu")]
    df = spark.createDataFrame(two, "page_id bigint, url string, html string")
    got = line_dedup.drop_lines(df, "page_id", line_dedup.host(F.col("url")), F.col("html")).collect()
    assert {r.page_id: r.text for r in got} == {1: "one", 2: "two", 3: "menu\nmenu"}
    assert line_dedup.drop_lines(df.filter("false"), "page_id", line_dedup.host(F.col("url")), F.col("html")).count() == 0


def test_page_text(spark):
    html = "<html><head><title>T</title><script>var a='<p>';</script><style>p{}</style></head><body><!-- no --><p>one <b>two</b></p><ul><li>x</li></ul></body>"
    df = spark.createDataFrame([(html,), (None,)], "html string").select(line_dedup.lines_of(line_dedup.page_text(F.col("html"))))
    assert [r[0] for r in df.collect()] == [["T", "one two", "x"], []]
