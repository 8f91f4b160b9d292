"""WARC archives without repeated payloads: revisit records and their resolution.

Writing: the headers of all pages are shuffled by payload digest; of equal payloads the page with
the smallest id is the response, the others become revisit records that refer to it and carry no
payload.  Payloads stay where they are: a table of bits tells which pages are surely responses, and
only the few that chance puts beside a revisit are compared by id.  Records get fresh headers and leave as gzip-compressed archives, one per task, in the
shared folder.  Reading streams the archives line by line, so an archive never has to fit in
memory, and resolution joins every revisit to the response of its digest.

A null payload is empty.  A null id is written as an empty one and read back as null; it is never
the smallest.  Repeated rows of the smallest id are all responses.  Very long payloads are single
records.  Line breaks in a url are percent-encoded.  An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from encircle.llm.shared import replacing, written

MIN_BYTES = 0
DATE = "2000-01-01T00:00:00Z"
_END = "\r\n"
#: Fixed value: the profile of revisits with equal payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "urn:page:"
#: Bits of the tables that keep payloads out of the shuffle, and so the size bound of their broadcast:
#: 2^(BIT_TABLE - 6) rows.
BIT_TABLE = 24
#: Payload characters after which a reading task hands over a batch.
BATCH_CHARS = 8 << 20


def base32_sha1(value: Column | str) -> Column:
    """SHA-1 of a string's UTF-8 in upper-case base 32: 20 bits of hexadecimals give 4 characters."""
    digest = F.sha1(value)
    parts = [F.lpad(F.lower(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32)), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def archive_records(pages: DataFrame, min_bytes: int = MIN_BYTES, date: str = DATE) -> DataFrame:
    """``page_id, record_type, record``: the text of every record.  Pages: ``page_id, url, html``."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")
    ).withColumns({"bytes": F.octet_length("payload").cast("bigint"), "digest": base32_sha1("payload")})
    headers = written(rows.select("page_id", "url", "bytes", "digest"), "headers")
    repeated = headers.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.count("*").alias("_n")
    ).where("_n > 1").select("digest", "first_id")
    # the same plan at every size: the planner does not see how many digests are repeated
    met = headers.join(written(repeated, "repeated").hint("merge"), "digest")
    revisits = written(met.where("not (page_id <=> first_id)"), "revisits").withColumn("payload", F.lit(""))
    responses = _without_revisits(rows, headers, revisits)
    joined = responses.withColumn("first_id", F.lit(None).cast("bigint")).withColumn("_revisit", F.lit(False)).unionByName(
        revisits.withColumn("_revisit", F.lit(True))
    )
    revisit = F.col("_revisit")
    kind = F.when(revisit, "revisit").otherwise("response")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "),
        F.col("bytes").cast("string"), F.lit(_END * 2),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))

    def ident(page: str) -> Column:
        return F.concat(F.lit(f"<{_RECORD}"), F.coalesce(F.col(page).cast("string"), F.lit("")), F.lit(">"))

    address = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    refers = F.concat(F.lit(f"{_END}WARC-Profile: {PROFILE}{_END}WARC-Refers-To: "), ident("first_id"))
    record = F.concat(
        F.lit(f"WARC/1.0{_END}WARC-Type: "), kind,
        F.lit(f"{_END}WARC-Record-ID: "), ident("page_id"),
        F.lit(f"{_END}WARC-Date: {date}{_END}WARC-Target-URI: "), address,
        F.lit(f"{_END}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, refers).otherwise(""),
        F.lit(f"{_END}Content-Type: application/http; msgtype=response{_END}Content-Length: "),
        F.octet_length("_block").cast("string"), F.lit(_END * 2), F.col("_block"),
    )
    return joined.withColumn("_block", block).select("page_id", kind.alias("record_type"), record.alias("record"))


def _bits(frame: DataFrame, seed: int) -> DataFrame:
    """``_word{seed}, _bits{seed}``: 2^BIT_TABLE bits, 64 in a row; those of the ids and digests are set."""
    words = frame.select(_slot(seed).alias("_slot")).groupBy(F.expr("_slot >> 6").alias(f"_word{seed}"))
    return written(words.agg(F.expr("bit_or(shiftleft(1L, cast(_slot & 63 as int)))").alias(f"_bits{seed}")), "bits")


def _slot(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "page_id", "digest"), F.lit(1 << BIT_TABLE))


def _marked(rows: DataFrame, bits: DataFrame, seed: int) -> DataFrame:
    """The rows with ``_maybe{seed}``: whether their bit is set.  The table has a proven size."""
    own = rows.withColumn("_at", _slot(seed))
    found = own.join(F.broadcast(bits), F.col(f"_word{seed}") == F.expr("_at >> 6"), "left")
    held = F.expr(f"coalesce(_bits{seed} & shiftleft(1L, cast(_at & 63 as int)), 0L) <> 0")
    return found.select(*rows.columns, held.alias(f"_maybe{seed}"))


def _without_revisits(rows: DataFrame, headers: DataFrame, revisits: DataFrame) -> DataFrame:
    """``rows`` that are responses.

    A page whose bit no revisit sets is a response.  Of the others, the headers tell the responses,
    and a second table holds these: pages that it knows are compared by id and digest, the rest are
    revisits, whose payloads go nowhere.
    """
    gone = _bits(revisits, 1)
    other = revisits.select(F.col("page_id").alias("_page_id"), F.col("digest").alias("_digest")).hint("merge")
    same = F.col("page_id").eqNullSafe(F.col("_page_id")) & (F.col("digest") == F.col("_digest"))
    beside = _marked(headers.select("page_id", "digest"), gone, 1).where("_maybe1").drop("_maybe1")
    beside = written(beside.join(other, same, "left_anti").distinct(), "beside")
    single = _marked(rows, gone, 1)
    likely = _marked(single.where("_maybe1").drop("_maybe1"), _bits(beside, 2), 2).where("_maybe2").drop("_maybe2")
    known = beside.toDF("_page_id", "_digest").hint("merge")
    return single.where("not _maybe1").drop("_maybe1").unionByName(likely.join(known, same, "left_semi"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Records end with two line breaks, which the text writer puts between rows."""
    archive_records(pages, min_bytes).select("record").write.option("lineSep", _END * 2).option(
        "compression", "gzip"
    ).text(path)


def _parsed(with_payload: bool):
    """Records from the lines of archives; a compressed archive is never cut between tasks."""

    def run(batches):
        rows, held = [], 0
        headers: dict[str, str] | None = None
        body: list[str] = []
        missing = -1  # bytes of the block still to come; below zero: in the headers or between records

        def finish():
            block = _END.join(body)
            payload = block.partition(_END * 2)[2].encode("utf-8")
            kind = headers["warc-type"]
            digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
            if kind == "response":
                found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if found != digest:
                    raise ValueError(f"payload of {headers['warc-record-id']} has digest {found}, not {digest}")
            ids = [
                int(text) if (text := headers.get(name, "").strip("<>").removeprefix(_RECORD)) else None
                for name in ("warc-record-id", "warc-refers-to")
            ]
            return (
                ids[0], headers.get("warc-target-uri", ""), kind, digest, len(payload), ids[1],
                payload.decode("utf-8") if with_payload else None,
            )

        def batch_of(rows):
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
            columns = list(zip(*rows)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for line in batch.column(0).to_pylist():
                if headers is None:
                    if line.startswith("WARC/"):
                        headers = {}
                elif missing < 0:
                    if line:
                        name, _, value = line.partition(": ")
                        headers[name.lower()] = value
                        continue
                    missing, body = int(headers["content-length"]), []
                    if missing == 0:
                        rows.append(finish())
                        headers, missing = None, -1
                else:
                    missing -= len(line.encode("utf-8")) + (len(_END) if body else 0)
                    body.append(line)
                    held += len(line)
                    if missing <= 0:
                        rows.append(finish())
                        headers, missing, body = None, -1, []
                if held >= BATCH_CHARS:
                    yield batch_of(rows)
                    rows, held = [], 0
        if headers is not None:
            raise ValueError("an archive ends inside a record")
        yield batch_of(rows)

    return run


_SCHEMA = (
    "page_id LONG, url STRING, record_type STRING, payload_digest STRING, payload_bytes LONG, refers_to LONG, payload STRING"
)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of archives; digests of responses are computed again and must agree."""
    lines = spark.read.option("lineSep", _END).text(path)
    return lines.mapInArrow(_parsed(with_payload), _SCHEMA)


def resolved(records: DataFrame) -> DataFrame:
    """Records with the size (and payload) of the response that a revisit refers to."""
    originals = records.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("_digest")).agg(
        F.min("page_id").alias("_first"), F.max("payload_bytes").alias("_bytes"), F.min("payload").alias("_payload")
    )
    responses = records.where("record_type = 'response'")
    revisits = records.where("record_type = 'revisit'")
    found = revisits.join(originals, revisits.payload_digest == originals._digest, "left")
    filled = replacing(found, {"payload_bytes": F.col("_bytes"), "refers_to": F.col("_first"), "payload": F.col("_payload")})
    return responses.unionByName(filled.select(*records.columns))
