"""WARC archives on Spark: records to gzip files and back, and revisit resolution.

Writing goes through Spark's text writer with CRLF CRLF, which ends every WARC record, as line separator: any file
system Spark knows, committed task by task. Reading splits at the end of a record followed by the next one's version
line and then goes by Content-Length, so that a payload which holds such lines is put together again; a gzip file is
read from its beginning by one task and no more than a record is in memory.

Resolution shuffles headers only to find, for each payload digest that occurs more than once, the record with the smallest
id; that table, usually small, is joined to the records on the digest. The copies of a payload may be a large
part of all records: the aggregation combines before the shuffle, and the join's other side is a written table,
so that Spark broadcasts it, or, beyond the threshold, shuffles records by digest and AQE splits a hot one.

Reading measures and hashes every payload that it reads; what differs from its header, and a record that ends before its
length, is an error, and so is a revisit that disagrees with the record it names.

Edge cases: no records give no files and none back; a null payload is empty, a null id an empty URN, a null URI the empty
text; repeated records are each written; very long payloads are read whole, one at a time. Further columns stay as they are,
also with names that are used here; result columns replace columns of their own names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import free_name, written

CRLF = "\r\n"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id long, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(digits: Column) -> Column:
    """Bare upper-case base32 of 40 hexadecimal digits, ten at a time: eight digits to base 32, in the alphabet of base32."""
    parts = [F.lpad(F.conv(F.substring(digits, i, 10), 16, 32), 8, "0") for i in range(1, 40, 10)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def resolve_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Records (record_id, payload, ...) with record_type, refers_to, payload_bytes and payload_digest.

    Of records with equal payloads of at least min_bytes the one with the smallest record_id is response, the others
    are revisits of it. A null payload counts as empty. Rows that repeat a record_id and its payload are all what that
    record is. A null record_id comes after all others; records without any id are all response.
    """
    payload = F.coalesce("payload", F.lit(b""))
    original, digits = free_name(records, "original"), free_name(records, "digits")
    rows = records.withColumns({"payload": payload, "payload_bytes": F.octet_length(payload).cast("long"), digits: F.sha1(payload)})
    headers = rows.select("record_id", "payload_bytes", digits).where(F.col("payload_bytes") >= min_bytes)
    originals = headers.groupBy(digits).agg(F.min("record_id").alias("original"), F.count("*").alias("n")).where("n > 1 and original is not null")
    originals = written(originals.select(digits, F.col("original").alias(original)), "originals")
    joined = rows.join(originals, digits, "left").withColumn("payload_digest", base32(F.col(digits))).drop(digits)
    revisit = F.col(original).isNotNull() & (F.col("payload_bytes") >= min_bytes) & ~F.col(original).eqNullSafe(F.col("record_id"))
    return joined.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col(original))}).drop(original)


def write_warc(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write resolved records with fresh headers; a revisit has no payload but its original's digest, length and id."""
    revisit = F.col("record_type") == "revisit"
    urn = lambda x: F.concat(F.lit("<urn:record:"), F.coalesce(x.cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    uri = F.regexp_replace(F.coalesce("target_uri", F.lit("")), r"[\r\n]", "")
    head = F.concat(
        F.lit(VERSION + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn(F.col("record_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(F.col("refers_to"))))).otherwise(F.lit("")),
        F.lit("Content-Type: text/html; charset=utf-8" + CRLF),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(CRLF),
    )
    # the writer copies the bytes of a string as they are, so that payloads need not be text
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    records.select(F.concat(head.cast("binary"), body).cast("string").alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the gzip archives at the path, as RECORD; payload is null for revisits. Without payloads they are
    read and checked, but not returned."""
    schema = RECORD if payloads else RECORD.removesuffix(", payload binary")
    names = [x.split()[0] for x in schema.split(", ")]
    between = (CRLF * 2 + VERSION + CRLF).encode()
    lines = spark.read.option("lineSep", between.decode()).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))

    def record(named: dict[str, str], body: bytes) -> tuple:
        number = lambda x: int(x) if (x := named.get(x, "").removeprefix("<urn:record:").removesuffix(">")) else None
        kind, size, digest = named["WARC-Type"], int(named["X-Payload-Length"]), named["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and (size, digest) != (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()):
            raise ValueError(f"record {named['WARC-Record-ID']}: the payload is not what its header says")
        return (number("WARC-Record-ID"), kind, named["WARC-Target-URI"], size, digest, number("WARC-Refers-To"), *([body if kind == "response" else None] if payloads else []))

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, pending = None, b""
        for pdf in batches:
            out = []
            for file, value in zip(pdf["file"], pdf["value"], strict=True):
                if file != at:
                    if pending:
                        raise ValueError(f"{at} ends within a record")
                    at = file
                    value = value.removeprefix((VERSION + CRLF).encode())
                pending = pending + between + value if pending else value
                head, found, body = pending.partition(CRLF.encode() * 2)
                named = dict(x.split(": ", 1) for x in head.decode("utf-8").split(CRLF) if ": " in x) if found else {}
                size = int(named.get("Content-Length", -1))
                if size < 0 or len(body) < size:
                    continue  # this record's payload holds what looks like a record's end
                pending = b""
                out.append(record(named, body[:size]))
            columns = dict(zip(names, zip(*out, strict=True) if out else [()] * len(names), strict=True))
            yield pd.DataFrame(columns | {x: pd.array(columns[x], dtype="Int64") for x in ("record_id", "refers_to")})
        if pending:
            raise ValueError(f"{at} ends within a record")

    return lines.mapInPandas(records, schema)


def checked_revisits(records: DataFrame) -> DataFrame:
    """Records as read, of which a revisit that disagrees with the response it names, or has none, is an error."""
    key = [F.col("payload_digest"), F.col("payload_bytes")]
    answers = records.where("record_type = 'response' and record_id is not null").select(F.col("record_id").alias("refers_to"), *key, F.lit(True).alias("found_")).distinct()
    revisits = records.where("record_type = 'revisit'").join(answers, ["refers_to", "payload_digest", "payload_bytes"], "left")
    fine = F.when(F.col("found_"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("no response with the payload of the revisit of record "), F.coalesce(F.col("refers_to").cast("string"), F.lit("?")))))
    return records.where("record_type = 'response'").union(revisits.withColumn("payload_digest", fine).select(*records.columns))
