"""Operator 9, WARC: archives of one gzip member a record, written and read through Spark's own file access."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.llm.common import fresh_path, saved, table

SALTS = 16


class WarcError(ValueError):
    """A record that is cut short or whose framing or digest is wrong."""


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(head.encode() + block + b"\r\n\r\n") + press.flush()


def members(data: bytes, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The inflated members of an archive in turn; line ends between members are passed over."""
    view, at = memoryview(data), 0
    while True:
        while at < len(view) and view[at] in (10, 13):
            at += 1
        if at >= len(view):
            return
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(view):
                raise WarcError("an archive ends inside a gzip member")
            piece = view[at : at + chunk]
            try:
                parts.append(inflate.decompress(piece))
            except zlib.error as e:
                raise WarcError(f"bad gzip member: {e}") from e
            at += len(piece) - len(inflate.unused_data)
        yield b"".join(parts)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record; checks version, Content-Length framing and both digests."""
    head, gap, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise WarcError("no WARC record here")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    try:
        size = int(fields["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("a record without Content-Length") from e
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError("Content-Length differs from the record's block")
    block = rest[:size]
    if fields.get("warc-block-digest") != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise WarcError("the block digest differs")
    if fields.get("warc-type") == "response" and fields.get("warc-payload-digest") != fields["warc-block-digest"]:
        raise WarcError("the payload digest differs")
    return fields, block


def with_origin(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """Each row's payload digest, and the smallest id of an equal payload where that isn't its own.

    Digests that occur once never leave the map side's partial sums as join keys with a partner; the row side is salted,
    so that a payload of a third of the pages is dealt over many tasks. A null payload is empty; a null id refers to the
    smallest of its payload; rows tied on the smallest id refer to none; an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), "url", F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload")).withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("bigint")})
    first = rows.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("origin"), F.count("*").alias("n")).where("n > 1")
    first = first.select("digest", "origin", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = rows.join(first, ["digest", "salt"], "left")
    return joined.select("page_id", "url", "payload", "digest", "size", F.when(F.col("origin") != F.coalesce("page_id", F.col("origin") + 1), F.col("origin")).alias("refers_to"))


def write_archives(rows: DataFrame, path: str, archive_bytes: int = 32 << 20) -> None:
    """Write rows of with_origin as archives under path through Spark's text writer (any store).

    An archive is closed once it has archive_bytes, so a file is at most that and one record. An empty table writes none;
    null ids and URLs are left out of their record's header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["value"])

        for batch in batches:
            for r in batch.to_pylist():
                block = b"" if r["refers_to"] is not None else r["payload"]
                fields = [("WARC-Type", "response" if r["refers_to"] is None else "revisit"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "text/html; charset=utf-8")]
                if r["page_id"] is not None:
                    fields.append(("WARC-Record-ID", f"<urn:page:{r['page_id']}>"))
                if r["url"] is not None:
                    fields.append(("WARC-Target-URI", "".join(c for c in r["url"] if c >= " ")))
                if r["refers_to"] is not None:
                    fields += [("WARC-Refers-To", f"<urn:page:{r['refers_to']}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                fields += [("WARC-Payload-Digest", f"sha256:{r['digest']}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("X-Payload-Length", str(r["size"]))]
                parts.append(record(fields, block))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield out()
                    parts, size = [], 0
        if parts:
            yield out()

    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records under path in turn: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for revisits).

    A cut or altered record raises; an empty folder of archives gives no rows. Each file is a row on its way to a worker,
    where its members are inflated one after the other, so files must stay under 2 GB (write_archives rolls them).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        urn = lambda x: int(x.rpartition(":")[2].rstrip(">")) if x else None
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows, size = [], 0
                for member in members(data):
                    f, block = parse(member)
                    revisit = f["warc-type"] == "revisit"
                    rows.append({
                        "page_id": urn(f.get("warc-record-id")), "url": f.get("warc-target-uri"), "record_type": f["warc-type"], "refers_to": urn(f.get("warc-refers-to")),
                        "payload_bytes": int(f["x-payload-length"]) if revisit else len(block), "payload_digest": f["warc-payload-digest"].removeprefix("sha256:"), "payload": None if revisit else block,
                    })
                    size += len(block)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary")


def check_revisits(records: DataFrame) -> None:
    """Raises if a revisit's digest and length aren't those of a response with the id that it refers to.

    Revisits of one payload are one row before they meet responses.
    """
    said = records.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest", "payload_bytes").distinct()
    bad = said.join(records.where("record_type = 'response'").select(*said.columns), said.columns, "left_anti").limit(1).collect()
    if bad:
        raise WarcError(f"a revisit refers to page {bad[0]['page_id']}, which has no response of its digest and length")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages tied on the smallest id with equal payloads are each a response; a null id revisits the smallest of its payload."""
    path = fresh_path(spark, "warc")
    write_archives(with_origin(table(spark, sf_dir, "pages"), "page_id", "html", 100), path)
    records = saved(read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records")
    check_revisits(records)
    return records


OP9_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first_id from p where n >= 100 group by d)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
       case when page_id > first_id then 'revisit' else 'response' end as record_type,
       case when page_id > first_id then first_id end as refers_to
from p left join f using (d)
"""
