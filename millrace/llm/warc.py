"""WARC archives with revisit resolution.

``resolve`` decides the record types: headers (no payloads) are shuffled by payload digest, the smallest page of a
digest keeps its response record and the others become revisit records that refer to it. ``write_archives`` writes
the records with fresh headers, ``read_archives`` reads them back by their Content-Length, and ``join_revisits``
joins each revisit record to its response, which has the payload's size.

Archives are written by Spark's text writer, with the end of a record as its line separator: so the commit is
atomic, a lost executor's file is written again, and the path may be in any store that Spark reaches. Files are
gzip-compressed as a whole and hold at most ``FILE_RECORDS`` records. A reader holds a file as it is compressed, and of
its content one record at a time. A response's block is an HTTP response, whose body is the payload.

Scale. Payloads move once, by digest; types are found from a partial aggregation of headers, so a
payload that a third of all pages share is one row after it, and joins are plain ones that adaptive execution splits.
Where there are more rows equal in page, url and digest than a broadcast holds, payloads move once more to meet them.

Defined cases. A null payload is empty. Equal page ids with equal payloads: the row of the smallest url is the response,
the others revisit it, with its id. Null page ids, and null urls of one page, come last, so they respond only where
no other does. A null url is left out. Other columns are ignored. Record ids are names of page, url, digest and the
number among equal rows, so reruns write equal records, however the input is split.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import importable_by_workers, shared_folder, written

#: Bytes that are unpacked, or sent, at once.
UNPACKED, SENT = 1 << 20, 8 << 20
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END, VERSION = "\r\n\r\n", "WARC/1.1"
FILE_RECORDS, DATE = 4000, "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed alphabet of base 32 (RFC 4648).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(payload: Column) -> Column:
    """Upper-case base 32 of the SHA-1 of a binary column, 32 characters."""
    # 40 hex digits are eight groups of 20 bits, each four letters of 5 bits.
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda g: F.conv(F.substring(F.sha1(payload), g * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    letter = lambda v, k: F.substring(F.lit(BASE32), F.shiftright(v, k).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.array_join(F.transform(groups, lambda v: F.concat(letter(v, 15), letter(v, 10), letter(v, 5), letter(v, 0))), "")


def resolve(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """`pages` (page_id, url, payload as text) with payload_digest, payload_bytes, copy, record_type, refers_to and its url.

    Only headers are aggregated. One exchange moves the payloads, by digest, to meet the first of their kind; as it
    feeds nothing but a join, a digest that many pages share is split over several tasks. A row is known by page,
    url, digest and ``copy``, its number (from 1) among the rows that are equal in all of these: by nothing that
    depends on how the input is split, as the headers and the records are read in jobs of their own.
    """
    rows = pages.select("page_id", "url", F.coalesce("payload", F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_digest", payload_digest(F.encode("payload", "UTF-8")))
    headers = written(rows.groupBy("payload_digest", "page_id", "url").agg(F.count(F.lit(1)).alias("n")), "headers")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("bare"), "url")).alias("first")
    shared = written(headers.groupBy("payload_digest").agg(first, F.sum("n").alias("total")).filter("total > 1").drop("total"), "shared")
    equal = headers.filter("n > 1").select(F.col("payload_digest").alias("_d"), F.col("page_id").alias("_p"), F.col("url").alias("_u"), "n")
    if equal.isEmpty():
        joined = rows.withColumn("copy", F.lit(1).cast("bigint")).join(shared, "payload_digest", "left")
    else:
        # Equal rows become one row and their number, and rows again after the join.
        same = (F.col("payload_digest") == F.col("_d")) & F.col("page_id").eqNullSafe(F.col("_p")) & F.col("url").eqNullSafe(F.col("_u"))
        alone = rows.join(equal, same, "left_anti").withColumn("n", F.lit(1).cast("bigint"))
        several = rows.join(equal, same, "left_semi").groupBy("page_id", "url", "payload_digest").agg(F.first("payload").alias("payload"), F.count(F.lit(1)).alias("n"))
        joined = alone.unionByName(several).join(shared, "payload_digest", "left")
        joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    joined = joined.withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    is_first = F.col("first.page_id").eqNullSafe(F.col("page_id")) & F.col("first.url").eqNullSafe(F.col("url")) & (F.col("copy") == 1)
    responds = F.col("first").isNull() | (F.col("payload_bytes") < least_bytes) | is_first
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest", "copy",
        F.when(responds, "response").otherwise("revisit").alias("record_type"),
        F.when(~responds, F.col("first.page_id")).alias("refers_to"),
        F.when(~responds, F.col("first.url")).alias("refers_to_url"),
    )


def _record_id(page_id: Column, url: Column, copy: Column, digest: Column) -> Column:
    # Only the url, which is last, may have a slash; a letter before it keeps null apart.
    parts = (F.coalesce(page_id.cast("string"), F.lit("null")), copy.cast("string"), digest, F.coalesce(F.concat(F.lit("u"), url), F.lit("")))
    return F.regexp_replace(F.md5(F.concat_ws("/", *parts)), "(.{8})(.{4})(.{4})(.{4})(.{12})", "<urn:uuid:$1-$2-$3-$4-$5>")


def records(resolved: DataFrame) -> DataFrame:
    """The text of each record without its end."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(HTTP), F.col("payload")))
    clean = F.regexp_replace("url", "[\\r\\n]", "")
    return resolved.select(
        F.concat(
            F.lit(f"{VERSION}\r\n"),
            line("WARC-Type", F.col("record_type")),
            line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"), F.col("copy"), F.col("payload_digest"))),
            line("WARC-Date", F.lit(DATE)),
            line("WARC-Target-URI", clean),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
            line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
            line("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to"), F.col("refers_to_url"), F.lit(1), F.col("payload_digest")))),
            line("X-Page-Id", F.col("page_id").cast("string")),
            line("Content-Type", F.when(~revisit, F.lit("application/http; msgtype=response"))),
            line("Content-Length", F.octet_length(body).cast("string")),
            F.lit("\r\n"), body,
        ).alias("value")
    )


def write_archives(resolved: DataFrame, path: str) -> None:
    """Writes the records of ``resolve`` as gzip-compressed archives of at most FILE_RECORDS below `path`."""
    writer = records(resolved).write.option("compression", "gzip").option("lineSep", END)
    writer.option("maxRecordsPerFile", FILE_RECORDS).text(path)


_HEADER = re.compile(rb"([A-Za-z-]+): ?([^\r\n]*)\r\n")
READ = "page_id bigint, url string, record_type string, payload_digest string, record_id string, refers_to_record string, payload_bytes bigint"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def unpacked(content: bytes) -> Iterator[bytes]:
    """What a gzip file of one or more members holds, in pieces of at most UNPACKED bytes."""
    while content:
        member = zlib.decompressobj(31)
        while not member.eof:
            piece = member.decompress(content, UNPACKED)
            content = member.unconsumed_tail
            if not piece and not content and not member.eof:
                raise ValueError("an archive ends within a record")
            yield piece
        content = member.unused_data


def parse(pieces: Iterable[bytes], payloads: bool) -> Iterator[tuple]:
    """Records of an archive, found by their Content-Length; a response's size and digest are of the body that is read."""
    rest, held = iter(pieces), bytearray()

    def more() -> bool:
        piece = next(rest, None)
        held.extend(piece or b"")
        return piece is not None

    while held or more():
        while (stop := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held:
                    raise ValueError("an archive ends within a header")
                return
        head = {k: v.decode() for k, v in _HEADER.findall(bytes(held[len(VERSION) + 2 : stop + 2]))}
        start = stop + 4
        end = start + int(head[b"Content-Length"])
        while len(held) < end + len(END):
            if not more():
                raise ValueError("an archive ends within a record")
        page, kind, block = head.get(b"X-Page-Id"), head[b"WARC-Type"], bytes(held[start:end])
        del held[: end + len(END)]
        response = kind == "response"
        body = block.partition(b"\r\n\r\n")[2] if response else block
        digest = digest_of(body) if response else head[b"WARC-Payload-Digest"].removeprefix("sha1:")
        row = (None if page is None else int(page), head.get(b"WARC-Target-URI"), kind, digest, head[b"WARC-Record-ID"], head.get(b"WARC-Refers-To"), len(body) if response else None)
        yield (*row, body) if payloads else row


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record in the archives below `path`, with its payload unless only headers are wanted."""
    schema = READ + ", payload binary" * payloads

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = (pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary())

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for row in parse(unpacked(content.as_py()), payloads):
                    rows.append(row)
                    size += len(row[-1]) if payloads else 0
                    if len(rows) == 1000 or size > SENT:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    importable_by_workers(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(parsed, schema)


def join_revisits(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records read back: a revisit record gets the
    size of the response that it refers to."""
    responses = found.filter("record_type = 'response'")
    named = responses.select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), "payload_bytes")
    revisits = found.filter("record_type = 'revisit'").drop("payload_bytes").join(named, "refers_to_record", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("bigint")).select(*columns).unionByName(revisits.select(*columns))


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the pages (page_id, url, html) as deduplicated archives, reads them back and resolves the revisits."""
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark)}/archives-{uuid.uuid4().hex[:8]}"
    write_archives(resolve(pages.select("page_id", "url", F.col("html").alias("payload"))), path)
    return join_revisits(written(read_archives(spark, path, payloads=False), "records"))
