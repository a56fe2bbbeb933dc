"""WARC archives compressed record by record with a Zstandard dictionary.

write_archives trains a dictionary on a bounded sample of the records, and each task writes one
archive: a skippable frame (magic 0x184D2A5D) that holds the dictionary, then a Zstandard frame for
each record, so that any record can be read on its own. Of records with equal payloads of at least
MIN_REVISIT bytes, the one of the smallest page id is stored as a response; the others are revisit
records that name it. read_archives reads archives back without the index.

Null html: an empty payload. Null page id: such a record is never the one that others name, unless
all of a group are null; then all are responses. Rows that repeat a page id and its payload are
stored each, with the same type. Null url: the target is named by page id. A retried task writes
a file of its own name; only files of tasks that ended well are in the index.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmenta.llm.common import sampled, scratch, table, written

DICTIONARY_MAGIC = 0x184D2A5D
MIN_REVISIT = 100
#: The sample that the dictionary is trained on: so many records, of so many bytes at most.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 32_768, 65_536
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, record_type string, archive string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def to_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record, with its two closing line ends."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def from_record(data: bytes) -> tuple:
    """The fields of RECORD. The digest of a response is worked out from what was read."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    page, refers = page and int(page), refers and int(refers)
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        return page, fields["WARC-Target-URI"], "response", None, len(payload), hashlib.sha256(payload).hexdigest(), payload
    return page, fields["WARC-Target-URI"], "revisit", refers, int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:"), None


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; where the samples are too few or too much alike to train one, their
    own bytes, which Zstandard takes as a dictionary of plain content."""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 4), samples, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def marked(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and refers_to of each record."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload"), F.sha2(html, 256).alias("digest"))
    repeated = base.where(F.length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return base.join(repeated, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, to: str, date: str = DATE, level: int = 3) -> DataFrame:
    """Writes the archives into the folder to, a URI that every executor reaches; returns their index."""
    fit = pages.where(F.coalesce(F.length("html"), F.lit(0)) <= SAMPLE_BYTES).select("page_id", "url", "html")
    drawn = sampled(fit, "page_id", SAMPLE_RECORDS, fit.count())
    plain = to_record(None, None, b"", hashlib.sha256(b"").hexdigest(), None, date)  # where no page is small enough
    dictionary = train([to_record(r.page_id, r.url, (r.html or "").encode(), "", None, date) for r in drawn.collect()] or [plain])
    shared = pages.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place, name = None, 0, ""
        trained = shared.value
        press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained))
        try:
            for batch in batches:
                if out is None:  # an empty partition leaves no file
                    store, folder = fs.FileSystem.from_uri(to)
                    store.create_dir(folder, recursive=True)
                    task = TaskContext.get()
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.zst"
                    # the name ends in .zst: without compression=None the whole file would be pressed once more
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained)
                    place = 8 + len(trained)
                index = []
                for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    frame = press.compress(to_record(page, url, payload, digest, refers, date))
                    out.write(frame)
                    index.append((page, "response" if refers is None else "revisit", name, place, len(frame)))
                    place += len(frame)
                columns = list(zip(*index, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "record_type", "archive", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return written(marked(pages).mapInArrow(run, INDEX), "warc-index")


def records(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one after the other; holds one record and a chunk at a time."""
    start = stream.read(8)
    magic, size = struct.unpack("<II", start) if len(start) == 8 else (0, 0)
    known = None
    if magic == DICTIONARY_MAGIC:
        known, data = zstandard.ZstdCompressionDict(stream.read(size)), b""
    else:
        data = start
    unpack = zstandard.ZstdDecompressor(dict_data=known)
    while True:
        data = data or stream.read(chunk)
        if not data:
            return
        frame, parts = unpack.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            data = stream.read(chunk)
            if not data:
                raise ValueError("the archive ends within a record")
        yield b"".join(parts)


def read_archives(archives: DataFrame, folder: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """The records (RECORD) of the archives named in the column archive, each read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = [x.split()[0] for x in RECORD.split(", ")]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(folder)
                rows, size = [], 0
                with store.open_input_stream(f"{at}/{name}", compression=None) as stream:
                    for data in records(stream):
                        rows.append(from_record(data))
                        size += len(data)
                        if size >= batch_bytes:
                            yield pack(rows)
                            rows, size = [], 0
                if rows:
                    yield pack(rows)

    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt in turn: by its key, Spark would take the distinct's own shuffle and join its partitions to one
    return archives.select("archive").distinct().repartition(n).mapInArrow(run, RECORD)


def op5_warc(spark, sf_dir):
    folder = scratch(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    back = read_archives(index, folder)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id IS DISTINCT FROM f THEN f END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest,
             min(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) AS f FROM pages)
"""

QUERIES = {"op5_warc": (op5_warc, SQL)}
