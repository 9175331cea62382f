"""WARC archives: a writer with revisit records and a splittable reader.

Archives are gzip files with one member for each record. The reader cuts every file into byte ranges; a task
looks for the gzip magic inside its range, accepts a place if the member there decodes to a WARC header, and
owns the records that start in its range, however far beyond it they reach. No index and no sequential pass
is needed, so one large archive is read by as many tasks as it has ranges.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import new_path, read, shared_dir

MAGIC = b"\x1f\x8b\x08"
#: Bytes of an archive that one task scans, and that it asks the store for at once.
RANGE_BYTES = 8 << 20
READ_BYTES = 1 << 20
#: Copies of the table of repeated payloads, so that one payload's rows are dealt to so many tasks.
SALTS = 16
FILES = "path string, bytes long, records long"
RECORDS = "path string, offset long, warc_type string, record_id string, target_uri string, payload_digest string, refers_to_id string, payload_bytes long, truncated boolean, payload binary"


def filesystem(uri: str):
    """pyarrow's file system for a URI (file, hdfs, s3, gs), and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key) -> str:
    """The record's URN; the same key gives the same URN in any run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'framewright:{key}')}>"


def _one_line(text) -> str:
    return " ".join(str(text or "").split())


def mark_revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """pages with _digest (hex SHA-1 of the payload's UTF-8 bytes) and _first, the smallest id with the same payload if others share it.

    Digests are counted with partial aggregation; payloads that occur once leave no row. The rest, two narrow
    columns, is copied SALTS times and joined by digest and salt, so a payload that fills a third of the
    table is dealt to SALTS tasks. Payloads under min_bytes are never revisited.
    """
    p = pages.withColumn(payload_col, F.coalesce(F.col(payload_col), F.lit(""))).withColumn("_digest", F.sha1(F.encode(payload_col, "UTF-8")))
    many = (
        p.where(F.octet_length(payload_col) >= min_bytes).groupBy("_digest").agg(F.min(id_col).alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1").select("_digest", "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    )
    return p.withColumn("_salt", F.pmod(F.xxhash64(id_col, "url"), F.lit(SALTS)).cast("int")).join(many, ["_digest", "_salt"], "left").drop("_salt")


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes a record for each row and returns the files: path, bytes, records.

    A row whose payload has another row with a smaller id is written as revisit of that row, without the
    payload; all others are responses. A null payload is empty, a null url is an empty URI, a null id
    is a key of its own and never the smaller one. Rows that repeat id and payload both stay responses. Each task writes a file under
    a name of its own and the returned table names only files of tasks that succeeded, so a task that is run
    again, or twice at once, leaves no record twice. An empty table gives no files. The writer's only state
    is one open file.
    """
    spark = pages.sparkSession
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"))
    p = mark_revisits(p, "page_id", "html", min_bytes).select("page_id", "url", "html", "_first")
    now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        out, name, done, n = None, f"{folder}/part-{uuid.uuid4().hex}.warc.gz", 0, 0
        files, path = filesystem(name)
        for batch in batches:
            for key, url, html, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode()
                revisit = first is not None and key != first
                fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(key)), ("WARC-Date", now), ("WARC-Target-URI", _one_line(url)), ("WARC-Payload-Digest", f"sha1:{digest32(payload)}"), ("X-Record-Key", "" if key is None else str(key)), ("X-Payload-Bytes", str(len(payload)))]
                if revisit:
                    fields += [("WARC-Refers-To", record_id(first)), ("X-Refers-To-Key", str(first)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Truncated", "length")]
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                member = record([*fields, ("Content-Type", "application/http; msgtype=response")], head + (b"" if revisit else payload))
                if out is None:
                    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = files.open_output_stream(path, compression=None)
                out.write(member)
                done, n = done + len(member), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([done]), pa.array([n])], names=["path", "bytes", "records"])

    table = new_path(spark, "warc-files")
    p.mapInArrow(run, FILES).write.parquet(table)  # the archives are written once, here
    return spark.read.schema(FILES).parquet(table)


class _Bytes:
    """A window onto a file that only moves forward."""

    def __init__(self, f, at: int, size: int):
        self.f, self.base, self.data, self.size = f, at, b"", size
        f.seek(at)

    def more(self) -> bool:
        got = self.f.read(READ_BYTES)
        self.data += got
        return bool(got)

    def drop(self, at: int) -> None:
        self.data, self.base = self.data[at - self.base :], at


def _member(window: _Bytes, at: int, header_only: bool):
    """Inflates the member at an offset: its bytes and the offset after it; None if it is no WARC record."""
    unpacker, parts, have, pos = zlib.decompressobj(31), [], 0, at
    while True:
        if pos - window.base >= len(window.data) and not window.more():
            return None
        piece = window.data[pos - window.base : pos - window.base + READ_BYTES]
        try:
            got = unpacker.decompress(piece)
        except zlib.error:
            return None
        parts.append(got)
        if have < 8 and (b"".join(parts)[:8] + b"WARC/1.0"[min(8, have + len(got)) :])[:7] != b"WARC/1.":
            return None
        have += len(got)
        pos += len(piece) - len(unpacker.unused_data)
        if unpacker.eof:
            return (b"".join(parts), pos) if have >= 8 else None


def scan(f, start: int, end: int):
    """(offset, inflated record) of the records that start in [start, end)."""
    window, at = _Bytes(f, start, end), start
    while at < end:
        found = window.data.find(MAGIC, at - window.base)
        if found < 0:
            at = max(at, window.base + len(window.data) - 2)  # the magic may lie across two reads
            window.drop(min(at, window.base + len(window.data)))
            if window.base >= end or not window.more():
                return
            continue
        at = window.base + found
        if at >= end:
            return
        window.drop(at)
        got = _member(window, at, False)
        if got is None:
            at += 1
            continue
        yield at, got[0]
        at = got[1]
        window.drop(at)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of an inflated record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        fields[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "replace").strip()
    try:
        n = int(fields.get("content-length", ""))
    except ValueError:
        n = max(0, len(rest) - 4)
    return fields, rest[:n]


def ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, start, stop: every file in ranges."""
    size = F.lit(range_bytes)
    return files.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("bytes - 1"), size.cast("long"))).alias("start"), "bytes").select("path", "start", F.least(F.col("start") + size, "bytes").alias("stop"))


def read_warc(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of archives (columns path and bytes): see RECORDS, and fields map<string,string>.

    payload is what follows the HTTP header of an http block, else the block; payload_bytes is its length,
    or for a record cut short the length that its header names. Bytes that are no WARC member are skipped. A
    path that can't be opened fails the job. Ranges are spread over the tasks evenly.
    """
    spark = files.sparkSession
    cut = ranges(files, range_bytes).repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "start")
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def run(batches):
        rows: list[tuple] = []
        size = 0

        def table():
            cols = list(zip(*rows, strict=True))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]
            arrays = [pa.array(c, type=k) for c, k in zip(cols, kinds, strict=False)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([list(x.items()) for x in cols[10]], type=pa.map_(pa.string(), pa.string()))], names=[*names, "fields"])

        for batch in batches:
            for path, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files_, local = filesystem(path)
                with files_.open_input_file(local) as f:
                    for at, raw in scan(f, start, stop):
                        fields, block = parse(raw)
                        payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
                        cut_short = "warc-truncated" in fields
                        n = int(fields["x-payload-bytes"]) if cut_short and fields.get("x-payload-bytes", "").isdigit() else len(payload)
                        rows.append((path, at, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-payload-digest", "").rpartition(":")[2] or None, fields.get("warc-refers-to"), n, cut_short, payload, fields))
                        size += len(payload)
                        if size > 8 << 20 or len(rows) >= 5000:
                            yield table()
                            rows, size = [], 0
        if rows:
            yield table()

    return cut.mapInArrow(run, RECORDS + ", fields map<string,string>")


def verified(records: DataFrame) -> DataFrame:
    """records with digest_ok: whether a record's payload has the digest that it names; null where the payload is left out."""
    def run(batches):
        for batch in batches:
            col = batch.schema.get_field_index
            ok = [None if t else digest32(p) == d for p, d, t in zip(batch.column(col("payload")).to_pylist(), batch.column(col("payload_digest")).to_pylist(), batch.column(col("truncated")).to_pylist(), strict=True)]
            yield batch.append_column("digest_ok", pa.array(ok, pa.bool_()))

    return records.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in records.dtypes) + ", digest_ok boolean")


def round_trip(pages: DataFrame, folder: str, **cols) -> DataFrame:
    """Writes the pages to folder, reads the archives back and returns what the records say of each page.

    payload_bytes and payload_digest of responses are taken from the payload that was read, not from the
    header; a digest that differs from the header's stops the job. Of revisits they are those of the header.
    """
    read_back = verified(read_warc(write_warc(pages, folder, **cols)))
    checked = F.when(F.coalesce("digest_ok", F.lit(True)), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("digest differs: "), "path", F.lit(" "), F.col("offset").cast("string"))).cast("string"))
    key = lambda k: F.expr(f"cast(nullif(fields['{k}'], '') as long)")
    return read_back.select(
        key("x-record-key").alias("page_id"), "payload_bytes", checked.alias("payload_digest"), F.col("warc_type").alias("record_type"), key("x-refers-to-key").alias("refers_to"),
        F.col("target_uri").alias("url"), "path", "offset",
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/framewright/warc-{uuid.uuid4().hex}"
    return round_trip(read(spark, sf_dir, "pages"), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base 32 by hand: each five hex digits are 20 bits, four characters.
OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h FROM p),
f AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY h) > 1 THEN min(page_id) OVER (PARTITION BY h) END AS first_id FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
