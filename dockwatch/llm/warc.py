"""Web pages to WARC archives and back, one nested row per capture.

Writing: each page becomes a request, a response (or revisit) and a metadata
record. The three share the capture's identifier through WARC-Concurrent-To.
Records are strings with their own header block; Spark's text writer with the
record separator of the format (two line ends) as line separator lays them out
as archive files in any store that Spark writes to.

Reading: archives come back as whole files of bounded size (a bounded number of
records each), every task cuts its files by Content-Length, and the records are
assembled by a join of request and metadata to the response they are concurrent
to. Digests of payloads are taken where the bytes are, so that only narrow rows
are shuffled unless the payload itself is asked for.

Pages with equal payloads of at least ``MIN_REVISIT`` bytes are stored once:
the smallest page_id holds the response, the others are revisits that name the
digest and address of it.

Defined cases: null html is an empty payload; null urls give records without a
target; line ends in a url are dropped from the header; rows that repeat a
page_id and payload which is the smallest of its group are all responses; rows
without page_id are revisits of a group that has one, else responses; an empty
table gives empty archives and no rows. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dockwatch.llm.common import table
from dockwatch.session import shared_dir

MIN_REVISIT = 100
#: Records in one archive file, three for each page.
FILE_RECORDS = 1_500
END = "\r\n"
DATE = "2024-01-01T00:00:00Z"
#: The address of the identical-payload profile.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = """type string, record_id string, concurrent_to string, target_uri string,
    date string, payload binary, payload_bytes long, payload_digest string,
    refers_to_uri string, refers_to_digest string, fields map<string,string>"""


def _block(kind: str, rid: Column, content_type: str, uri: Column, body: Column,
           **more: Column) -> Column:
    """One record: header lines, an empty line, the body. Null header values are left out."""
    head = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"),
            F.concat(F.lit("WARC-Record-ID: "), rid), F.lit(f"WARC-Date: {DATE}"),
            F.concat(F.lit("WARC-Target-URI: "), uri),
            *[F.concat(F.lit(f"{k.replace('_', '-')}: "), v) for k, v in more.items()],
            F.lit(f"Content-Type: {content_type}"),
            F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))]
    return F.concat(F.concat_ws(END, *head), F.lit(END + END), body)


def records(pages: DataFrame) -> DataFrame:
    """All records of ``pages`` as strings, in the column ``value``."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"),
                     F.regexp_replace("url", r"[\r\n]", "").alias("url"),
                     F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("n", F.octet_length("html").cast("long")).withColumn("digest", F.sha2("html", 256))
    shared = (p.filter(F.col("n") >= MIN_REVISIT).groupBy("digest")
              .agg(F.count("*").alias("_pages"), F.min("page_id").alias("first_id"),
                   F.min_by("url", "page_id").alias("first_url"))
              .filter((F.col("_pages") > 1) & F.col("first_id").isNotNull()))
    p = p.join(shared.drop("_pages"), "digest", "left")
    p = p.withColumn("revisit", F.coalesce(
        F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False)))
    for kind in ("response", "request", "metadata"):
        p = p.withColumn(kind, F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))
    sha = F.concat(F.lit("sha256:"), F.col("digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"
                          "Content-Length: "), F.col("n").cast("string"), F.lit(END + END))
    path = F.coalesce(F.regexp_extract("url", r"^[a-z]+://[^/?#]*(.*)$", 1), F.lit(""))
    host = F.coalesce(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1), F.lit(""))
    uri = F.col("url")
    response = F.when(F.col("revisit"), _block(
        "revisit", F.col("response"), "application/http;msgtype=response", uri, http,
        WARC_Payload_Digest=sha, WARC_Profile=F.lit(PROFILE),
        WARC_Refers_To_Target_URI=F.col("first_url"), WARC_Refers_To_Date=F.lit(DATE))).otherwise(_block(
            "response", F.col("response"), "application/http;msgtype=response", uri,
            F.concat(http, F.col("html")), WARC_Payload_Digest=sha))
    request = _block(
        "request", F.col("request"), "application/http;msgtype=request", uri,
        F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path),
                 F.lit(f" HTTP/1.1{END}Host: "), host, F.lit(END + END)),
        WARC_Concurrent_To=F.col("response"))
    fields = F.concat_ws(END, F.concat(F.lit("page_id: "), F.col("page_id").cast("string")),
                         F.when(F.col("revisit"), F.concat(F.lit("refers_to: "),
                                                           F.col("first_id").cast("string"))))
    meta = _block("metadata", F.col("metadata"), "application/warc-fields", uri, fields,
                  WARC_Concurrent_To=F.col("response"))
    return p.select(F.explode(F.array(request, response, meta)).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Archives of ``pages`` under ``path``."""
    (records(pages).write.option("lineSep", END + END).option("compression", "gzip")
     .option("maxRecordsPerFile", FILE_RECORDS).text(path))


_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)", re.I)


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split(END)
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse(data: bytes) -> Iterator[tuple]:
    """The records of one archive file, cut by their Content-Length."""
    at = 0
    while at < len(data):
        split = data.index(b"\r\n\r\n", at)
        head = data[at:split]
        size = int(_LENGTH.search(head)[1])
        body = data[split + 4:split + 4 + size]
        at = split + 4 + size + 4
        h = _headers(head)
        kind, payload, n, fields = h["warc-type"], None, None, None
        digest = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
        if kind in ("response", "revisit"):
            http, _, rest = body.partition(b"\r\n\r\n")
            n = int(_LENGTH.search(http)[1])
            if kind == "response":
                payload, n = rest, len(rest)
                if hashlib.sha256(rest).hexdigest() != digest:
                    raise ValueError(f"payload of {h['warc-record-id']} differs from its digest")
        elif kind == "metadata":
            fields = {k.strip(): v.strip() for k, _, v in (
                x.partition(":") for x in body.decode("utf-8").split(END) if x)}
        yield (kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-target-uri"),
               h.get("warc-date"), payload, n, digest, h.get("warc-refers-to-target-uri"),
               digest if kind == "revisit" else None, fields)


_NAMES = [x.split()[0] for x in RECORD_SCHEMA.replace("\n", " ").split(", ")]


def _parse_files(batches: Iterator[pd.DataFrame], payloads: bool) -> Iterator[pd.DataFrame]:
    at = _NAMES.index("payload")
    for pdf in batches:
        for packed in pdf["content"]:
            data = gzip.decompress(packed)
            rows = [r if payloads else (*r[:at], None, *r[at + 1:]) for r in parse(data)]
            if rows:
                out = pd.DataFrame(rows, columns=_NAMES)
                out["payload_bytes"] = out["payload_bytes"].astype("Int64")
                yield out


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the archives under ``path``; without ``payloads`` the bytes stay null."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .load(path).select("content"))
    return files.mapInPandas(lambda b: _parse_files(b, payloads), RECORD_SCHEMA)


def captures(records_: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit with its request and metadata."""
    main = records_.filter(F.col("type").isin("response", "revisit")).select(
        "record_id", F.struct("type", "target_uri", "date", "payload", "payload_bytes",
                              "payload_digest", "refers_to_uri").alias("response"))
    rest = records_.filter(F.col("type").isin("request", "metadata")).groupBy("concurrent_to").agg(
        F.first(F.when(F.col("type") == "request", F.struct("record_id", "target_uri")),
                ignorenulls=True).alias("request"),
        F.first(F.when(F.col("type") == "metadata", F.struct("record_id", "fields")),
                ignorenulls=True).alias("metadata"))
    return main.join(rest, main["record_id"] == rest["concurrent_to"], "left").drop("concurrent_to")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives, read back and assembled."""
    path = f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    c = captures(read_archives(spark, path, payloads=False))
    return c.select(
        F.col("metadata.fields")["page_id"].cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("metadata.fields")["refers_to"].cast("long").alias("refers_to"))


ORACLE = f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
         q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS n, sha256(h) AS d FROM p),
         f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM q)
    SELECT page_id, n AS payload_bytes, d AS payload_digest,
           CASE WHEN n >= {MIN_REVISIT} AND page_id <> first_id THEN 'revisit' ELSE 'response' END
               AS record_type,
           CASE WHEN n >= {MIN_REVISIT} AND page_id <> first_id THEN first_id END AS refers_to
    FROM f"""
