"""Legacy archive converter: ARC files become WARC files, and both are read back by their declared lengths.

The converter reads each file's version block, then every header line by that version's fields, takes the declared
number of bytes, and synthesises the WARC record: an identifier derived from the content, the ARC date as WARC-Date,
response, revisit or resource as type, and block and payload digests. A version block becomes a warcinfo record; records
that are no HTTP exchange (dns: and the like) become resources. Equal payloads are found by digest over all records,
without moving payloads: what is shuffled is a line per record, and then whole compressed files. The payload itself
goes into the first of equal records only; the others refer to it by identifier, URI and date.

Pages are written as ARC files of version 1 or 2 through Spark's own writer, so that the commit protocol covers lost
executors and any store works. Archives of others may have HTTP heads with bare line feeds, no page number, and a gzip
member per record. A file is read as one value, so it must be under 2 GB compressed; Spark's writer makes one gzip
member a file.

Defined cases: null html is an empty payload; null or unprintable urls are percent-encoded or become urn:page:<id>;
a null page_id is written as a dash and read as null. Payloads under min_revisit bytes are always responses. Of equal
payloads the least page_id is the response (null is more than any); of repeated rows with that page_id every one is a
response. Payloads may hold any text, header lines of either format included. An empty table makes no records, and
other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.util import cut, fresh_path

# The field lists that open an ARC file, by version.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "20240101000000"


#: Bytes of pages in an archive file, about: files have so many records of the mean size, 5,000 at most.
FILE_BYTES, FILE_RECORDS = 64 << 20, 5000
SALTS = 64


class Record(NamedTuple):
    kind: str
    """http, other, or info for a version block."""
    page: str
    url: str
    date: str
    mime: str
    head: bytes
    payload: bytes


class First(NamedTuple):
    """The response that a record revisits."""

    page: str
    url: str
    date: str


def safe_url(url: str | None, page: str) -> str:
    if not url:
        return f"urn:page:{page}"
    return re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def arc_opening(version: int, name: str) -> str:
    body = f"{version} 0 tidemark\n{' '.join(ARC_FIELDS[version])}\n\n"
    fields = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": DATE, "Content-type": "text/plain", "Archive-length": str(len(body)), "Result-code": "200", "Filename": name}
    return " ".join(fields.get(f, "-") for f in ARC_FIELDS[version]) + "\n" + body


def arc_record(version: int, page: str, url: str, html: str) -> str:
    size = len(html.encode())
    content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {page}\r\nContent-Length: {size}\r\n\r\n{html}"
    fields = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": DATE, "Content-type": "text/html", "Archive-length": str(size + len(content) - len(html)), "Result-code": "200"}
    return " ".join(fields.get(f, "-") for f in ARC_FIELDS[version]) + "\n" + content + "\n"


def write_arc(pages: DataFrame, path: str, records_per_file: int | None = None) -> None:
    """pages(page_id, url, html) as gzip-compressed ARC files, versions 1 and 2 in turn. Each file has its version block."""
    if records_per_file is None:
        mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
        records_per_file = max(1, min(FILE_RECORDS, int(FILE_BYTES / (mean + 500))))

    def run(batches):
        version, held = None, 0
        for batch in batches:
            out = []
            for page, url, html in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html")), strict=True):
                page = "-" if page is None else str(page)
                if held % records_per_file == 0:
                    name = uuid.uuid5(uuid.NAMESPACE_OID, f"{page}:{held}")
                    version = 1 + name.int % 2
                    opening = arc_opening(version, f"{name}.arc")
                else:
                    opening = ""
                held += 1
                out.append(opening + arc_record(version, page, safe_url(url, page), html or ""))
            yield pa.RecordBatch.from_arrays([pa.array([x[:-1] for x in out], pa.string())], ["value"])

    pages.select("page_id", "url", "html").mapInArrow(run, "value string").write.option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


def lines(stream: io.BufferedIOBase) -> Iterator[bytes]:
    while line := stream.readline():
        yield line


HEAD_END, PAGE = re.compile(rb"\r?\n\r?\n"), re.compile(rb"(?im)^X-Page-Id:[ \t]*(\S+)[ \t]*\r?$")


def read_arc(stream: io.BufferedIOBase) -> Iterator[Record]:
    """The records of an ARC file; the version block says which fields a header line has."""
    names: list[str] = []
    for line in lines(stream):
        if not line.strip():
            continue
        parts = line.decode("utf-8", "surrogateescape").rstrip("\r\n").split(" ")
        if parts[0].startswith("filedesc://"):
            body = stream.read(int(parts[-1]))
            said = body.decode("utf-8", "surrogateescape").replace("\r\n", "\n").split("\n")
            names = said[1].split(" ")
            if names != ARC_FIELDS.get(int(said[0].split(" ")[0])):
                raise ValueError(f"unknown ARC version block: {said[:2]}")
            yield Record("info", "-", parts[0].removeprefix("filedesc://"), dict(zip(names, parts, strict=False)).get("Archive-date", DATE), "text/plain", b"", body)
            continue
        if len(parts) != len(names):
            raise ValueError(f"not an ARC header line: {line[:200]!r}")
        at = dict(zip(names, parts, strict=True))
        content = stream.read(int(at["Archive-length"]))
        end = HEAD_END.search(content) if content.startswith(b"HTTP/") else None
        if end is None:
            yield Record("other", "-", at["URL"], at["Archive-date"], at["Content-type"], b"", content)
            continue
        page = PAGE.search(content, 0, end.start() + 1)
        yield Record("http", page[1].decode() if page else "-", at["URL"], at["Archive-date"], at["Content-type"], content[: end.end()], content[end.end() :])


def record_id(page: str, url: str, date: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {page} {date} {digest}')}>"


def warc_date(d: str) -> str:
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(r: Record, digest: str, first: First | None) -> bytes:
    """first: the response that this record revisits; None for any other record."""
    block = r.head + (r.payload if first is None else b"")
    kind = {"info": "warcinfo", "other": "resource", "http": "response" if first is None else "revisit"}[r.kind]
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id(r.page, r.url, r.date, digest), "WARC-Date": warc_date(r.date)}
    head |= {"WARC-Filename": r.url} if r.kind == "info" else {"WARC-Target-URI": r.url}
    head |= {"WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}"}
    if r.kind == "http":
        head |= {"WARC-Payload-Digest": f"sha256:{digest}", "X-Page-Id": r.page, "X-Payload-Length": str(len(r.payload))}
    if first is not None:
        head |= {
            "WARC-Profile": PROFILE,
            "WARC-Refers-To": record_id(*first, digest),
            "WARC-Refers-To-Target-URI": first.url,
            "WARC-Refers-To-Date": warc_date(first.date),
            "X-Refers-To-Page-Id": first.page,
        }
    mime = {"info": "application/warc-fields", "other": r.mime, "http": "application/http; msgtype=response"}[r.kind]
    head |= {"Content-Type": mime, "Content-Length": str(len(block))}
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head.items()), "\r\n"]).encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def read_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a WARC file."""
    for line in lines(stream):
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC version line: {line[:200]!r}")
        head = {}
        for field in lines(stream):
            if not field.strip():
                break
            key, _, value = field.decode().partition(":")
            head[key.lower()] = value.strip()
        yield head, stream.read(int(head["content-length"]))


def files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")


def opened(content: pa.Scalar) -> io.BufferedReader:
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())), 1 << 20)


def arc_index(spark, path: str) -> DataFrame:
    """path, nth, kind, page, url, date, n, digest of every ARC record: a line for each, without its payload."""
    schema = "path string, nth int, kind string, page string, url string, date string, n bigint, digest string"
    kinds = [pa.string(), pa.int32(), *[pa.string()] * 4, pa.int64(), pa.string()]

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                rows = [(name, nth, r.kind, r.page, r.url, r.date, len(r.payload), hashlib.sha256(r.payload).hexdigest()) for nth, r in enumerate(read_arc(opened(content)))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    return files(spark, path).mapInArrow(run, schema)


def revisits(index: DataFrame, min_revisit: int) -> DataFrame:
    """path, nth and the first response of every record that repeats its payload. A payload's records are counted and joined in parts."""
    page = F.col("page").try_cast("long")
    rows = index.where((F.col("kind") == "http") & (F.col("n") >= min_revisit)).withColumn("salt", F.pmod(F.xxhash64("path", "nth"), F.lit(SALTS)))
    first = F.min(F.struct(page.isNull().alias("none"), page.alias("number"), "path", "nth", "page", "url", "date"))
    firsts = (
        rows.groupBy("digest", "salt")
        .agg(first.alias("first"), F.count("*").alias("k"))
        .groupBy("digest")
        .agg(F.min("first").alias("first"), F.sum("k").alias("copies"), F.collect_list("salt").alias("salts"))
        .where("copies > 1")
        .select("digest", F.struct("first.page", "first.url", "first.date").alias("first"), F.explode("salts").alias("salt"))
    )
    return rows.join(firsts, ["digest", "salt"]).where("page <> first.page").select("path", "nth", "first.*")


def convert(spark, arc: str, warc: str, min_revisit: int = 100) -> None:
    """The ARC files in folder arc as WARC files in folder warc."""
    index = cut(arc_index(spark, arc), "arc-index")
    again = revisits(index, min_revisit).groupBy("path").agg(F.collect_list(F.struct("nth", "page", "url", "date")).alias("again"))

    def run(batches):
        for batch in batches:
            for content, again in zip(batch["content"], batch["again"].to_pylist(), strict=True):
                first = {x["nth"]: First(x["page"], x["url"], x["date"]) for x in again or []}
                out, size = [], 0
                for nth, r in enumerate(read_arc(opened(content))):
                    made = warc_record(r, hashlib.sha256(r.payload).hexdigest(), first.get(nth))
                    out.append(made[:-1])
                    size += len(made)
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    records = files(spark, arc).join(again, "path", "left").mapInArrow(run, "value binary")
    # The bytes of a record are not all UTF-8; a cast to string keeps them as they are.
    records.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(warc)


def index(spark, warc: str) -> DataFrame:
    """One row per response and revisit of WARC files, from its header; a response's digest and length are taken from its payload."""

    def run(batches):
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for head, block in read_warc(opened(content)):
                    if head["warc-type"] not in ("response", "revisit"):
                        continue
                    page, refers = head.get("x-page-id", "-"), head.get("x-refers-to-page-id", "-")
                    if head["warc-type"] == "response":
                        end = HEAD_END.search(block)
                        body = block[end.end() :] if end else block
                        n, digest = len(body), hashlib.sha256(body).hexdigest()
                    else:
                        n, digest = int(head.get("x-payload-length", -1)), head["warc-payload-digest"].partition(":")[2]
                    rows.append((None if page == "-" else int(page), n, digest, head["warc-type"], None if refers == "-" else int(refers)))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return files(spark, warc).mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def round_trip(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """pages written as ARC, converted to WARC and read back."""
    spark = pages.sparkSession
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc, min_revisit)
    return index(spark, warc)


ORACLE = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
         d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n, sha256(html) AS digest FROM p),
         f AS (SELECT d.*, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM d)
    SELECT page_id, n AS payload_bytes, digest AS payload_digest,
           CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN first <> page_id THEN first END AS refers_to
    FROM f"""
