"""WARC archives with revisit resolution.

Headers alone are shuffled by payload digest; the record with the smallest page id of each group of equal payloads
stays a response and the others become revisits that name it. Responses are then written with their payload and
revisits without, both under fresh headers, and read back.

The files are plain WARC/1.1 record streams: Spark's text writer puts a blank line pair after each row, which is what
ends a WARC record. Each file is one gzip stream, so that a reader gets its rows in order and can follow
Content-Length across payloads that hold blank lines themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmere.llm.common import shared_dir, split_by_keys, stage

MIN_BYTES = 100
WARC_DATE = "2025-01-01T00:00:00Z"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_id string, record_type string, page_id string, url string, payload_digest string, declared long, refers string, payload binary"


def _urn(key: Column, copy: Column) -> Column:
    """A record's name, made from what identifies the record alone."""
    h = F.sha2(F.concat_ws("/", key, copy.cast("string")), 256)
    parts = [F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def with_headers(pages: DataFrame) -> DataFrame:
    """page_id, url, html (never null), digest, n_bytes and a key of every record."""
    return (
        pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
        .withColumn("digest", F.sha2("html", 256))
        .withColumn("n_bytes", F.octet_length("html").cast("long"))
        .withColumn("key", F.sha2(F.to_json(F.struct(F.col("page_id").alias("p"), F.col("url").alias("u"), F.col("digest").alias("d"))), 256))
    )


def _record(kind: Column, urn: Column, refers: Column, date: str, payload: Column) -> Column:
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(END)
    )
    block = F.concat(http, payload)
    uri = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7f]", "%20")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", urn),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Refers-To", refers),
        line("WARC-Profile", F.when(kind == "revisit", F.lit(PROFILE))),
        line("X-Page-Id", F.col("page_id").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: str = WARC_DATE) -> None:
    """Writes pages (page_id, url, html) as WARC files below path: ``responses`` and ``revisits``.

    Of records with equal payloads of at least min_bytes, the one with the smallest page_id is the response (a null
    page_id comes last; of equal ones the smallest url); shorter payloads are all responses. A null html is an empty
    payload. Of repeated rows one is the response and the others revisit it.
    """
    rows = with_headers(pages).drop("html").groupBy("key").agg(
        F.first("page_id").alias("page_id"), F.first("url").alias("url"), F.first("digest").alias("digest"), F.first("n_bytes").alias("n_bytes"),
        F.count(F.lit(1)).alias("copies"),
    )
    rows = stage(rows, "headers")
    long = rows.where(F.col("n_bytes") >= min_bytes)
    first = F.min(F.struct(F.col("page_id").isNull().alias("x"), F.col("page_id"), F.col("url"), F.col("key"))).alias("first")
    groups = long.groupBy("digest").agg(first, F.sum("copies").alias("n")).where("n > 1")
    groups = groups.select("digest", F.col("first.key").alias("first_key"))
    revisits = (
        long.join(groups, "digest")
        .withColumn("from", F.when(F.col("key") == F.col("first_key"), F.lit(2)).otherwise(F.lit(1)).cast("long"))
        .where(F.col("from") <= F.col("copies"))
        .select("*", F.explode(F.sequence("from", "copies")).alias("copy"))
    )
    revisits = stage(revisits.select("key", "first_key", "page_id", "url", "digest", "n_bytes", "copy"), "revisits")
    text = _record(F.lit("revisit"), _urn(F.col("key"), F.col("copy")), _urn(F.col("first_key"), F.lit(1)), date, F.lit(""))
    out = {"lineSep": END, "compression": "gzip"}
    revisits.select(text.alias("value")).write.options(**out).text(f"{path}/revisits")

    # Payloads that are written as they are read stay where they are; only those of copies and repeated rows are shuffled.
    again = F.when(F.col("n_bytes") >= min_bytes, F.lit(1).cast("long")).otherwise(F.col("copies"))
    gone = revisits.where("key != first_key").select("key", "page_id", F.lit(0).cast("long").alias("times")).distinct()
    met = gone.unionByName(rows.where("copies > 1").select("key", "page_id", again.alias("times")).join(gone.select("key"), "key", "left_anti"))
    met = stage(met, "repeated")
    apart, near = split_by_keys(pages.select("page_id", "url", "html"), F.xxhash64("page_id"), met.select(F.xxhash64("page_id").alias("h")))
    met, near = met.drop("page_id"), with_headers(near)
    bodies = with_headers(apart).unionByName(near.join(met, "key", "left_anti")).withColumn("copy", F.lit(1).cast("long"))
    if not met.where("times > 0").isEmpty():
        once = near.join(met.where("times > 0"), "key").dropDuplicates(["key"])
        bodies = bodies.unionByName(once.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times"))
    text = _record(F.lit("response"), _urn(F.col("key"), F.col("copy")), F.lit(None).cast("string"), date, F.col("html"))
    bodies.select(text.alias("value")).write.options(**out).text(f"{path}/responses")


def _parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a byte stream that was cut at each blank line pair; never holds more than a record and a piece.

    A payload that ends in line breaks makes the cut come early; the next piece then starts with the rest of the pair.
    """
    end = END.encode()
    pending, need, held = [], 0, 0
    fields: dict[str, str] | None = None
    for chunk in chunks:
        if fields is not None:
            pending.append(chunk)
            held += len(chunk) + len(end)
            if held - len(end) < need:
                continue
            stream = end.join([*pending, b""])
            yield fields, stream[:need]
            chunk, fields = stream[need + len(end) : -len(end)], None
        if chunk:
            fields = dict(row.partition(": ")[::2] for row in chunk.decode("utf-8").split("\r\n")[1:])
            need, held, pending = int(fields["Content-Length"]), 0, []
    if fields is not None:
        raise ValueError("an archive ends within a record")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives below path: ids, headers and, for responses, the payload."""
    names = [c.split()[0] for c in RECORDS.split(", ")]
    types = {"declared": pa.int64(), "payload": pa.binary()}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for fields, block in _parse(v for b in batches for v in b.column(0).to_pylist()):
            http, _, payload = block.partition(END.encode())
            length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            kind = fields["WARC-Type"]
            rows.append(
                (fields["WARC-Record-ID"], kind, fields.get("X-Page-Id"), fields.get("WARC-Target-URI"), fields["WARC-Payload-Digest"].partition(":")[2], length, fields.get("WARC-Refers-To"), payload if kind == "response" else None)
            )
            size += len(block)
            if len(rows) >= 2000 or size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    parts = [spark.read.option("lineSep", END).text(f"{path}/{kind}").select(F.col("value").cast("binary")) for kind in ("responses", "revisits")]
    return parts[0].mapInArrow(parse, RECORDS).unionByName(parts[1].mapInArrow(parse, RECORDS))


def resolve_revisits(records: DataFrame, id_type: str = "long") -> DataFrame:
    """Joins revisits to the responses that they name: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest of a response come from its payload; a digest that differs from its header's raises an error, as
    does a revisit whose response is not there.
    """
    found = F.sha2("payload", 256)
    responses = records.where("record_type = 'response'").select(
        "record_id",
        F.col("page_id").cast(id_type).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(found == F.col("payload_digest"), found).otherwise(F.raise_error(F.lit("a payload differs from its digest")).cast("string")).alias("payload_digest"),
    )
    responses = stage(responses, "responses")
    named = responses.select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("digest"))
    revisits = records.where("record_type = 'revisit'").select("refers", F.col("page_id").cast(id_type).alias("page_id"), "payload_digest").join(named, "refers", "left")
    revisits = revisits.select(
        "page_id",
        F.col("bytes").alias("payload_bytes"),
        F.when(F.col("digest") == F.col("payload_digest"), F.col("digest")).otherwise(F.raise_error(F.lit("a revisit without its response")).cast("string")).alias("payload_digest"),
        F.lit("revisit").alias("record_type"),
        "refers_to",
    )
    plain = responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast(id_type).alias("refers_to"))
    return plain.unionByName(revisits)


def op1_warc_revisits(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = shared_dir(spark, "warc")
    write_archives(pages, path)
    return resolve_revisits(read_archives(spark, path), dict(pages.dtypes)["page_id"])


OP1_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
