"""WARC archives: write pages as records, find the records again by their boundary chain.

Writing: of equal payloads one record is the response, the others revisit it. Records are plain text rows, so Spark's
own writer commits them, wherever the folder is.

Reading: a record's magic can also stand inside a payload. Tasks cut the bytes at every magic and emit candidates
(offset, offset of the successor by its Content-Length). From the start of each file pointer jumping keeps only the
candidates that a chain of records reaches: each round doubles the distance that is known, so a file of n records
takes log2(n) joins of narrow rows, and no task has to walk a file.
"""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from stepgrove.session import checkpoint_folder, drop_table, materialize, store

from .catalog import located, query, table

MAGIC = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
#: Payloads below this many bytes are never revisits; records of one archive file at most.
LEAST_BYTES = 0
FILE_RECORDS = 50_000
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data):
    """The SHA-1 of bytes in upper-case base 32: four digits from each five hex digits."""
    digest, out = F.sha1(data.cast("binary")), []
    for group in range(8):
        value = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(_BASE32), F.shiftright(value, s) % 32 + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def plan_records(pages, id="page_id", url="url", html="html", least=LEAST_BYTES):
    """``pages`` as (id, url, payload, place, refers_place): the place of the response that a revisit refers to, else null.

    The response of equal payloads is the one with the largest id (null ids are smallest), of repeated ids the last
    in place order. Null payloads are empty.
    """
    plain = pages.select(F.col(id).cast("bigint").alias("id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("payload"))
    rows = located(plain, "place")
    keyed = rows.filter(F.octet_length("payload") >= least).select("id", "place", F.sha2(F.col("payload").cast("binary"), 256).alias("same"))
    # Stored, so that their sizes are known: the payloads themselves only move if the repeats are many.
    first = keyed.groupBy("same").agg(F.max(F.struct("id", "place")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = materialize(first.filter("n > 1").select("same", "first"))
    again = keyed.join(first, "same").filter("place <> first.place")
    again = materialize(again.select("place", F.col("first.place").alias("refers_place")))
    return rows.join(again, "place", "left")


def _uuid(place):
    h = F.md5(place.cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def record(row_id="id", url="url", payload="payload"):
    """A WARC record without its magic's separator rules: magic, header lines, blank line, block."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    revisit = F.col("refers_place").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(payload).cast("string"), F.lit(GAP),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col(payload)))
    safe_url = F.regexp_replace(url, r"[\x00-\x20]", "%20")
    return F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _uuid(F.col("place"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", safe_url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col(payload)))),
        line("WARC-Refers-To", _uuid(F.col("refers_place"))),
        line("WARC-Profile", F.when(revisit, F.lit(REVISIT))),
        line("Page-ID", F.col(row_id).cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_archives(pages, path, id="page_id", url="url", html="html", least=LEAST_BYTES):
    """Write the pages as uncompressed WARC 1.1 files below ``path``; files hold FILE_RECORDS records at most."""
    planned = plan_records(pages, id, url, html, least)
    planned.select(record().alias("value")).write.option("lineSep", GAP).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _header(name):
    return F.nullif(F.regexp_extract("header", rf"(?:^|\r\n){name}: *([^\r\n]*)", 1), F.lit(""))


def segments(spark, path):
    """What lies between the magics of the files below ``path``: value, file, file_size, block and order of reading."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"),
    )


def candidates(parts, columns):
    """Narrow rows of ``segments``: offset, octets, successor, header fields, and ``columns`` of the payload.

    ``columns`` maps names to functions of the payload; they are computed here for records that fill their segment.
    """
    end = F.locate(GAP, "value")
    header = F.substring_index("value", GAP, 1)
    body = F.expr("substr(value, locate('\r\n\r\n', value) + 4)")
    staged = parts.withColumns({"header": header, "ended": end > 0, "octets": F.octet_length("value").cast("bigint")}).withColumns({
        "length": F.when(F.col("ended"), _header("Content-Length").cast("bigint")), "lead": (F.octet_length("header") + len(GAP)).cast("bigint"),
    })
    # The block is an HTTP head, a blank line and the payload; the record ends with a gap.
    payload = F.expr("substr(body, locate('\r\n\r\n', body) + 4, length(body) - locate('\r\n\r\n', body) - 7)")
    staged = staged.withColumn("whole", F.col("lead") + F.col("length") + len(GAP) == F.col("octets")).withColumn("body", F.when(F.col("whole"), body))
    staged = staged.withColumn("payload", F.when(F.col("whole"), payload))
    narrow = materialize(staged.select(
        "file", "file_size", "block", "n", "octets", "length", "lead", "whole",
        _header("WARC-Type").alias("type"), _header("WARC-Record-ID").alias("record_id"),
        _header("WARC-Refers-To").alias("refers"), _header("Page-ID").cast("bigint").alias("page"),
        F.substring_index(_header("WARC-Payload-Digest"), ":", -1).alias("stated"),
        *[F.when(F.col("whole"), f(F.col("payload"))).alias(name) for name, f in columns.items()],
    ))
    span = F.col("octets") + len(MAGIC)
    blocks = narrow.groupBy("file", "block").agg(F.sum(span).alias("span"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("file", "block", F.coalesce(F.sum("span").over(earlier), F.lit(0)).alias("base"))
    before = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    within = narrow.withColumn("at", F.coalesce(F.sum(span).over(before), F.lit(0)))
    offset = F.col("base") + F.col("at") - len(MAGIC)
    found = within.join(bases, ["file", "block"]).withColumn("offset", offset).filter("offset >= 0")
    follows = F.col("offset") + len(MAGIC) + F.col("lead") + F.col("length") + len(GAP)
    return materialize(found.withColumn("successor", follows).drop("base", "at"))


def reachable(edges):
    """The rows (file, offset) of ``edges`` (file, offset, successor) on the chain that starts at offset 0 of each file.

    Pointer jumping: a row knows one row that lies 1, 2, 4, ... records further on; rows known to be reached pass that
    on. A successor that is no candidate ends the chain, so a broken archive keeps its records up to the break.
    """
    spark = edges.sparkSession
    start = edges.filter("successor IS NOT NULL").select("file", "offset", F.col("successor").alias("hop"), (F.col("offset") == 0).alias("reached"))
    path, _ = store(start)
    while True:
        rows = spark.read.parquet(path)
        to = rows.select("file", F.col("offset").alias("hop"), F.col("hop").alias("further"))
        jumped = rows.join(to, ["file", "hop"])
        both = F.array(
            F.struct(F.col("offset").alias("offset"), F.col("further").alias("hop"), F.col("reached").alias("reached")),
            F.struct(F.col("hop").alias("offset"), F.lit(None).cast("bigint").alias("hop"), F.col("reached").alias("reached")),
        )
        passed = jumped.select("file", F.explode(both).alias("x")).select("file", "x.*")
        state = rows.select("file", "offset", F.lit(None).cast("bigint").alias("hop"), "reached")
        after, _ = store(
            state.unionByName(passed).groupBy("file", "offset").agg(F.max("hop").alias("hop"), F.max("reached").alias("reached"))
        )
        drop_table(spark, path)
        path = after
        if spark.read.parquet(path).filter("reached AND hop IS NOT NULL").isEmpty():
            return spark.read.parquet(path).filter("reached").select("file", "offset")


def read_archives(spark, path, columns):
    """One row per record of the WARC files below ``path``: page_id, record_type, refers_to, stated digest and ``columns``.

    ``columns`` maps names to functions of the payload, such as the payload itself; for a revisit they are those of
    the record it refers to. Records of any payload come back: what looks like a record inside one is no record. An
    empty folder gives an empty table.
    """
    found = candidates(segments(spark, path), columns)
    chain = reachable(found.select("file", "offset", "successor"))
    records = materialize(found.join(chain, ["file", "offset"]))
    torn = records.filter(~F.col("whole"))
    if not torn.isEmpty():
        records = records.filter("whole").unionByName(_mended(spark, path, found, chain, torn, columns))
    originals = records.filter("type = 'response'").select(
        F.col("record_id").alias("refers"), F.col("page").alias("refers_to"), *[F.col(c).alias(f"_{c}") for c in columns]
    )
    revisit = F.col("type") == "revisit"
    joined = records.join(originals, "refers", "left")
    return joined.select(
        F.col("page").alias("page_id"), F.col("type").alias("record_type"), F.when(revisit, F.col("refers_to")).alias("refers_to"), "stated",
        *[F.when(revisit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns],
    )


def _mended(spark, path, found, chain, torn, columns):
    """The torn records, whose payload holds magics, with their columns from the segments put together again."""
    inside = (
        found.select("file", "block", "n", "offset")
        .join(chain.withColumn("of", F.col("offset")), ["file", "offset"], "left")
        .withColumn("of", F.last("of", ignorenulls=True).over(Window.partitionBy("file").orderBy("offset")))
        .join(torn.select("file", F.col("offset").alias("of")), ["file", "of"])
    )
    texts = segments(spark, path).select("file", "block", "n", "value").join(inside, ["file", "block", "n"])
    whole = texts.groupBy("file", "of").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda x: x["value"]), MAGIC)
    block = F.expr("substr(whole, locate('\r\n\r\n', whole) + 4)")
    payload = F.expr("substr(body, locate('\r\n\r\n', body) + 4, length(body) - locate('\r\n\r\n', body) - 7)")
    mended = whole.select("file", F.col("of").alias("offset"), joined.alias("whole")).withColumn("body", block).withColumn("payload", payload)
    mended = mended.select("file", "offset", *[f(F.col("payload")).alias(name) for name, f in columns.items()])
    return torn.drop(*columns).join(mended, ["file", "offset"]).select(torn.columns)


SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, b, octet_length(b) AS n, sha1(b) AS s, max(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(s, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) % 32 + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM h
"""


@query("op10_warc", SQL)
def op10_warc(spark, folder):
    path = f"{checkpoint_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, folder, "pages"), path)
    columns = {"payload_bytes": lambda p: F.octet_length(p).cast("bigint"), "payload_digest": base32_sha1}
    return read_archives(spark, path, columns).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
