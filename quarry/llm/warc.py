"""WARC archives: writing page records, and reading them by boundary-chain verification.

Reading splits the archives at the record magic, wherever it stands, also inside payloads. Each task parses its
candidates and emits the offset at which each one's successor would begin. Per archive, pointer jumping from the file
start keeps the candidates that the chain reaches; magic inside payloads is never reached and so is rejected.

Defined results: a null payload is empty; a null url gives no target header and reads back as null; CR and LF in urls
are percent-encoded; records without an id give null and sort after all ids. Repeated rows (same id, same payload) are
the same record and are written as often as they stand. An empty table gives an empty archive and no rows. A chain that
breaks ends the archive there: what follows is not emitted. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.llm.common import forget, settle, shared_dir

MAGIC = "WARC/1.0\r\n"
_MAGIC = MAGIC.encode()
_EXTRA = len(_MAGIC)
_SCAN = "file string, block long, local long, length long, head long, content long, record_id string, record_type string, uri string, refers_to string, digest string, stated_bytes long, whole boolean, read_digest string"
#: All that the chain of an archive needs of a candidate, and what it finds.
_NUMBERS = ("file", "block", "local", "length", "head", "content")
_CHAIN = "file string, block long, local long, offset long, record_offset long, is_record boolean"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: ten hex digits make eight base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_roles(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, payload_bytes, digest, refers_to``; ``refers_to`` is null for responses.

    Only digests that occur more than once are joined back, and a hot one is split by the skewed join.
    """
    slim = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    slim = slim.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": base32_sha1(F.col("payload").cast("binary"))})
    again = slim.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("digest", "payload_bytes").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    again = settle(again.where("n > 1").drop("n"), "revisits")
    out = slim.join(again, ["digest", "payload_bytes"], "left")
    return out.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))).drop("first_id")


def _name(id_: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), id_.cast("string"), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_archives(roles: DataFrame, path: str, date: str = "2020-01-01T00:00:00Z") -> None:
    """One WARC file a task through Spark's own writer, so on any store and safe against lost or repeated tasks."""
    revisit = F.col("refers_to").isNotNull()
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    record = F.concat(
        F.lit(MAGIC),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", _name(F.col("page_id"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", url),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Payload-Bytes", F.col("payload_bytes").cast("string")),
        _header("WARC-Refers-To", _name(F.col("refers_to"))),
        F.lit("Content-Type: text/html\r\n"),
        _header("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
        F.lit("\r\n\r"),  # the writer's line end completes the record's
    )
    roles.select(record.alias("value")).write.option("lineSep", "\n").text(path)


def _parse(value: bytes) -> dict:
    """The headers of a candidate record (what stands after its magic)."""
    end = value.find(b"\r\n\r\n")
    out: dict = dict.fromkeys(("head", "content", "record_id", "record_type", "uri", "refers_to", "digest", "stated_bytes"))
    if end < 0:
        return out
    fields = {}
    for line in value[:end].split(b"\r\n"):
        key, colon, rest = line.partition(b":")
        if colon:
            fields[key.strip().lower()] = rest.strip().decode("utf-8", "replace")
    length = fields.get(b"content-length", "")
    if not (length.isascii() and length.isdigit()):
        return out
    stated = fields.get(b"warc-payload-bytes", "")
    return out | {
        "head": end + 4, "content": int(length), "record_id": fields.get(b"warc-record-id"), "record_type": fields.get(b"warc-type"),
        "uri": fields.get(b"warc-target-uri"), "refers_to": fields.get(b"warc-refers-to"),
        "digest": fields.get(b"warc-payload-digest", "").removeprefix("sha1:") or None, "stated_bytes": int(stated) if stated.isdigit() else None,
    }


def _sha(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, int, int, bytes]]]:
    """(file, split start, place in the split, bytes) of what stands between magics; a split's rows come in order."""
    at, place = None, 0
    for batch in batches:
        rows = []
        for file, block, value in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if at != (file, block):
                at, place = (file, block), 0
            rows.append((file, block, place, value))
            place += len(value) + _EXTRA
        yield rows


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.strip().split(" ")[0] for x in _SCAN.split(",")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[x.strip().split(" ")[1]]) for n, x in zip(names, _SCAN.split(","), strict=True)])
    for rows in _segments(batches):
        out = []
        for file, block, place, value in rows:
            found = _parse(value)
            whole = found["head"] is not None and len(value) == found["head"] + found["content"] + 4 and value.endswith(b"\r\n\r\n")
            out.append(found | {"file": file, "block": block, "local": place, "length": len(value), "whole": whole, "read_digest": _sha(value[found["head"] : -4]) if whole else None})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _segments(batches):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["file", "block", "local", "raw"])


def reached(offsets: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which of the sorted ``offsets`` the chain from offset 0 reaches; ``following``: where each one's successor begins."""
    n = len(offsets)
    place = np.searchsorted(offsets, following)
    hit = place < n
    hit[hit] &= offsets[place[hit]] == following[hit]
    jump = np.append(np.where(hit, place, n), n)
    seen = np.zeros(n + 1, bool)
    if n and offsets[0] == 0:
        seen[0] = True
    steps = 1
    while steps < n + 1:
        seen[jump[seen]] = True
        jump = jump[jump]
        steps *= 2
    return seen[:n]


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """One archive's candidates, as numbers: true offsets from the splits' lengths, then the chain."""
    pdf = pdf.sort_values(["block", "local"], ignore_index=True)
    used = (pdf["length"] + _EXTRA).groupby(pdf["block"]).sum().sort_index()
    base = used.cumsum() - used
    offsets = (pdf["block"].map(base) + pdf["local"]).to_numpy() - _EXTRA
    pdf["offset"] = offsets
    own = offsets >= 0  # what stands before the first magic has a negative one
    ends = np.where(pdf["head"].notna(), offsets + _EXTRA + pdf["head"].fillna(0) + pdf["content"].fillna(0) + 4, -1).astype(np.int64)
    record = np.zeros(len(pdf), bool)
    if pdf.loc[~own, "length"].sum() == 0:
        record[own] = reached(offsets[own], ends[own])
    pdf["is_record"] = record
    pdf["record_offset"] = pd.Series(np.where(record, offsets, np.nan)).ffill().astype("Int64")
    return pdf[[x.strip().split(" ")[0] for x in _CHAIN.split(",")]]


def _text(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.option("lineSep", MAGIC).text(path)
    return found.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row a record: ``record_id, record_type, uri, refers_to, digest, payload_bytes, file, offset`` (and ``payload``).

    ``digest`` is that of the payload as read, of a revisit the stated one; ``damaged`` says whether a stated digest differs
    from it, so that one bad record does not end a job. Tasks hold a batch of records; an archive's chain holds six numbers
    a candidate. Records whose payload contains the magic are put together again in a second pass, made only if there are any.
    """
    scan = settle(_text(spark, path).mapInArrow(_scan, _SCAN), "archive-scan")
    chain = scan.select(*_NUMBERS).groupBy("file").applyInPandas(_chain, _CHAIN)
    index = settle(scan.join(chain, ["file", "block", "local"]), "archive-index")
    forget(scan)
    parted = index.where("not is_record and record_offset is not null").select("file", "record_offset").distinct()
    heads = index.where("is_record")
    if payload:
        wanted = heads.select("file", "record_offset")
    else:
        wanted = heads.where("not whole").select("file", "record_offset")
    if payload or not parted.isEmpty():
        pieces = index.join(wanted, ["file", "record_offset"]).select("file", "block", "local", "offset", "record_offset")
        raw = _text(spark, path).mapInArrow(_raw, "file string, block long, local long, raw binary").join(pieces, ["file", "block", "local"])
        body = raw.groupBy("file", "record_offset").applyInPandas(_joined, "file string, record_offset long, payload binary, body_digest string")
        heads = heads.join(body, ["file", "record_offset"], "left")
    else:
        heads = heads.withColumns({"payload": F.lit(None).cast("binary"), "body_digest": F.lit(None).cast("string")})
    read = F.coalesce("body_digest", "read_digest")
    revisit = F.col("record_type").eqNullSafe(F.lit("revisit"))
    digest = F.when(revisit, F.coalesce("digest", read)).otherwise(F.coalesce(read, F.col("digest")))
    damaged = ~revisit & F.col("digest").isNotNull() & ~F.col("digest").eqNullSafe(read)
    size = F.when(F.col("record_type") == "revisit", F.coalesce("stated_bytes", "content")).otherwise(F.col("content"))
    columns = ["record_id", "record_type", "uri", "refers_to", digest.alias("digest"), damaged.alias("damaged"), size.alias("payload_bytes"), "file", "offset"]
    return heads.select(*columns, *["payload"] * payload)


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """One record's pieces, with the magic between them."""
    value = _MAGIC.join(pdf.sort_values("offset")["raw"])
    found = _parse(value)
    body = value[found["head"] : found["head"] + found["content"]]
    return pd.DataFrame({"file": pdf["file"].iloc[:1], "record_offset": pdf["record_offset"].iloc[0], "payload": [body], "body_digest": [_sha(body)]})


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and return what reading them gives."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/quarry/warc-{uuid.uuid4().hex}"
    write_archives(with_roles(pages, min_revisit_bytes), path)
    found = read_archives(spark, path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).cast("long")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


__all__ = ["MAGIC", "base32_sha1", "reached", "read_archives", "round_trip", "with_roles", "write_archives"]
