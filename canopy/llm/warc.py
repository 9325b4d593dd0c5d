"""WARC archives: writing, normalising monolithic gzip files, reading by index.

``write_archives`` is one Spark job of SQL expressions: each page becomes a
WARC/1.1 record, a full ``response`` (an HTTP message with the html in UTF-8)
or a ``revisit`` that refers to the response with the same payload.  The text
writer puts the records of a task into one gzip stream, ``part-*.gz``: a
monolithic file, in which no record can be reached without inflating all
before it.

``normalise`` inflates each such file once, as a stream, and writes every
record as its own gzip member (``*.warc.gz``) together with a sidecar index
(``*.idx``: the byte offset of each member and the end of the last, uint64).
It holds one record and one block of the stream at a time.  With
``delete_source`` a monolithic file is deleted once its index is complete; a
task that runs again finds the index and leaves it so.

``read_archives`` fetches the members by index and checks each digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.shared import complete_file, cut, filesystem, scratch

CHUNK = 1 << 20                 # bytes inflated or fetched at once
LEVEL = 6                       # gzip level of the members
END = "\r\n\r\n"                # fixed value: what follows every record
BASE32 = ("0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")  # fixed values: digits of base 32, its RFC 4648 letters
REVISIT_PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"  # fixed value


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hexadecimal digits are four base32 digits."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.lower(F.concat(*groups)), *BASE32)


def records(pages: DataFrame, min_payload: int = 0, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """``page_id, record``: the text of each page's WARC record, without its end mark.

    Of pages with equal payloads of ``min_payload`` bytes or more, the largest
    page_id is the response (all rows, if repeated) and the others revisit it.
    Null html is an empty payload, a null url the empty URI, a null page_id an
    id of its own kind that revisits like any other.  Digests are counted with
    partial aggregation, and the join to the payloads is an equi-join on the
    digest that adaptive execution splits where one digest is frequent.
    """
    page = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    page = page.select("page_id", "url", "html", payload_digest(F.col("html")).alias("digest"))
    big = F.octet_length("html") >= min_payload
    copies = (page.where(big).groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
              .where((F.col("n") > 1) & F.col("original").isNotNull()).select("digest", "original"))
    joined = page.join(copies, "digest", "left")
    revisit = F.col("original").isNotNull() & big & ~F.col("page_id").eqNullSafe(F.col("original"))

    def line(name: str, value) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    def urn(page_id) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Target-URI", uri), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("original"))), line("WARC-Profile", F.lit(REVISIT_PROFILE))))
        .otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")))
    return joined.select("page_id", F.concat(head, line("Content-Length", F.octet_length(block).cast("string")),
                                             F.lit("\r\n"), block).alias("record"))


def write_archives(pages: DataFrame, folder: str, **columns) -> None:
    """Write monolithic gzip WARC files, ``part-*.gz``, below ``folder``.  Empty input: no records."""
    (records(pages, **columns).select("record").write.option("lineSep", END).option("compression", "gzip").text(folder))


# -- one file ------------------------------------------------------------------

def inflate(stream):
    """Yield blocks of a gzip stream of one or more members."""
    gz = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            out = gz.decompress(data, CHUNK)
            if out:
                yield out
            data = gz.unconsumed_tail
            if gz.eof:
                data = gz.unused_data
                gz = zlib.decompressobj(31)


def split_records(blocks):
    """Yield (headers, whole record with its end mark) from blocks of a WARC stream."""
    held = bytearray()
    blocks = iter(blocks)

    def fill(size: int) -> bool:
        while len(held) < size:
            block = next(blocks, None)
            if block is None:
                return False
            held.extend(block)
        return True

    while fill(1):
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill(len(held) + 1):
                raise ValueError("a record's headers do not end")
        headers = parse_headers(bytes(held[:end]))
        size = end + 4 + int(headers["content-length"]) + 4
        if not fill(size) or held[size - 4:size] != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield headers, bytes(held[:size])
        del held[:size]


def parse_headers(head: bytes) -> dict[str, str]:
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def normalise_file(files, source: str, target: str, delete_source: bool = False) -> int:
    """Rewrite one gzip WARC file with a member per record and its offset index; the number of records."""
    from pyarrow import fs
    if files.get_file_info(f"{target}.idx").type != fs.FileType.File:
        offsets = [0]
        with complete_file(files, f"{target}.warc.gz") as out, files.open_input_file(source) as stream:
            for _, record in split_records(inflate(stream)):
                gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = gz.compress(record) + gz.flush()
                out.write(member)
                offsets.append(offsets[-1] + len(member))
        with complete_file(files, f"{target}.idx") as out:
            out.write(np.asarray(offsets, "<u8").tobytes())
        count = len(offsets) - 1
    else:
        count = files.get_file_info(f"{target}.idx").size // 8 - 1
    if delete_source and files.get_file_info(source).type == fs.FileType.File:
        files.delete_file(source)
    return count


def read_members(files, target: str, which: list[int] | None = None):
    """Yield (headers, block) of a normalised file's records: all, or those numbered in ``which``."""
    with files.open_input_file(f"{target}.idx") as f:
        offsets = np.frombuffer(f.read(), "<u8").astype(np.int64).tolist()
    with files.open_input_file(f"{target}.warc.gz") as f:
        numbers = range(len(offsets) - 1) if which is None else which
        data, base = b"", 0
        for i in numbers:
            a, b = offsets[i], offsets[i + 1]
            if not base <= a <= b <= base + len(data):
                data, base = f.read_at(max(b - a, CHUNK if which is None else 0), a), a
            record = zlib.decompress(data[a - base:b - base], 31)
            end = record.index(b"\r\n\r\n")
            yield parse_headers(record[:end]), record[end + 4:-4]


# -- Spark jobs ----------------------------------------------------------------

def normalise(spark: SparkSession, source: str, target: str, delete_source: bool = False) -> DataFrame:
    """Normalise every ``*.gz`` file of folder ``source`` into ``target``; ``name, n_records`` per file.  Runs at once."""
    from pyarrow import fs
    files, root = filesystem(source)
    names = sorted(i.base_name for i in files.get_file_info(fs.FileSelector(root)) if i.base_name.endswith(".gz"))
    listed = spark.createDataFrame([(n,) for n in names], "file string").repartition(max(1, len(names)))

    def run(batches):
        files, src = filesystem(source)
        _, dst = filesystem(target)
        files.create_dir(dst, recursive=True)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                name = re.sub(r"(\.\w+)*\.gz$", "", file)
                n = normalise_file(files, f"{src}/{file}", f"{dst}/{name}", delete_source)
                yield pa.RecordBatch.from_pydict({"name": [name], "n_records": [n]})

    return cut(listed.mapInArrow(run, "name string, n_records long"), "archives")


def read_archives(archives: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the normalised files: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to, url`` and, with ``with_payload``, the response's ``payload``.

    A response whose payload does not have its digest raises ValueError.
    """
    kept = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]
    kept += [("payload", pa.binary())] * with_payload
    schema = pa.schema(kept)

    def page(urn: str | None) -> int | None:
        return None if urn is None or urn == "<urn:page:null>" else int(urn[len("<urn:page:"):-1])

    def one(headers: dict, block: bytes) -> tuple:
        kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
        if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"the payload of {headers['warc-record-id']} is damaged")
        row = (page(headers["warc-record-id"]), size, digest, kind, page(headers.get("warc-refers-to")),
               headers["warc-target-uri"])
        return row + ((payload if kind == "response" else None,) if with_payload else ())

    def run(batches):
        files, root = filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                for headers, block in read_members(files, f"{root}/{name}"):
                    rows.append(one(headers, block))
                    held += 500 + len(block) * with_payload
                    if held > 4 * CHUNK:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    return (archives.select("name").repartition(max(1, archives.count()))
            .mapInArrow(run, ddl + ", payload binary" * with_payload))


def archive_pages(pages: DataFrame, min_payload: int = 0, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html", with_payload: bool = False) -> DataFrame:
    """Write the pages, normalise the files and read them back, in new shared folders."""
    spark = pages.sparkSession
    raw, normal = scratch(spark, "warc-raw"), scratch(spark, "warc")
    write_archives(pages, raw, min_payload=min_payload, id_col=id_col, url_col=url_col, html_col=html_col)
    return read_archives(normalise(spark, raw, normal, delete_source=True), normal, with_payload)
