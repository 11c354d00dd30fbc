"""WARC archives, index first: every record's file, offset, length, URL and digest are written as a table; readers sort
the selected records, coalesce neighbouring byte ranges, and read only those.

Records are gzip members of their own, known by an id made from page and digest. A task writes one archive to the shared folder under a name of its own attempt; only
index rows of attempts that succeeded are kept, so a repeated task leaves no second copy in the index.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import looked_up, new_path, partitions, saved

#: Payloads of at least so many bytes are written once.
MIN_SHARED = 100
GAP, MOST = 64 << 10, 8 << 20
INDEX = "file string, offset long, length long, page_id long, url string, digest string"
_RECORD = "page_id long, record_type string, digest string, payload_bytes long, refers_to long"


def _id(page, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def _record(page, url, refers, payload: bytes, digest: str) -> bytes:
    kind = "response" if refers is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_id(page, digest)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').replace(chr(13), ' ').replace(chr(10), ' ')}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Page: {page}", f"X-Payload-Bytes: {len(payload)}",
    ]
    if refers is not None:
        head += [f"WARC-Refers-To: {_id(refers, digest)}", f"X-Refers-To-Page: {refers}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = payload if refers is None else b""
    return ("\r\n".join([*head, f"Content-Length: {len(body)}"]) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def _write(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(root)
        store.create_dir(top, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        at = 0
        with store.open_output_stream(f"{top}/{name}", compression=None) as out:
            for batch in batches:
                rows = []
                for page, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    member = gzip.compress(_record(page, url, refers, (html or "").encode("utf-8", "surrogatepass"), digest), 4, mtime=0)
                    out.write(member)
                    rows.append((f"{root}/{name}", at, len(member), page, url, digest))
                    at += len(member)
                cols = list(zip(*rows, strict=True)) or [()] * 6
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["file", "offset", "length", "page_id", "url", "digest"])

    return run


def write(pages: DataFrame, root: str) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html), returns the index, itself a table in the shared folder.

    A null html is an empty payload. Of equal payloads of MIN_SHARED bytes or more the one of the smallest page_id is a
    response, others revisit it. Rows of equal page_id and payload are of one kind, and have one record id. A row of null
    page_id is a response, and none revisits it. Other columns are ignored. An empty table gives an empty index.
    """
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    rows = pages.select("page_id", "url", "html", digest.alias("digest"))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    narrow = pages.select("page_id", digest.alias("digest"), size.alias("size")).where(F.col("size") >= MIN_SHARED)
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    found = looked_up(narrow, saved(first, "warc-first"), ["digest"], "n", pages.count())
    revisits = found.where("page_id > first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    full = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")
    return saved(full.mapInArrow(_write(root), INDEX), "warc-index")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by file and offset. Neighbours with gaps of at most GAP are read at once, up to MOST bytes."""
    stores: dict = {}

    def fetch(run):
        file, low, high = run[0][0], run[0][1], run[-1][1] + run[-1][2]
        folder, _, name = file.rpartition("/")
        if folder not in stores:
            stores[folder] = pafs.FileSystem.from_uri(folder)
        store, top = stores[folder]
        with store.open_input_file(f"{top}/{name}") as f:
            data = f.read_at(high - low, low)
        rows = []
        for _, offset, length, digest in run:
            text = gzip.decompress(data[offset - low : offset - low + length])
            head, _, rest = text.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            body = rest[: int(fields["Content-Length"])]
            found = fields["WARC-Payload-Digest"].removeprefix("sha256:")
            revisit = fields["WARC-Type"] == "revisit"
            size, refers = int(fields["X-Payload-Bytes"]), int(fields["X-Refers-To-Page"]) if revisit else None
            if found != digest or not revisit and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
                raise ValueError(f"record at {offset} of {file} doesn't match its digest")
            if revisit and fields["WARC-Refers-To"] != _id(refers, digest):
                raise ValueError(f"record at {offset} of {file} refers to another record than its page's")
            page = None if fields["X-Page"] == "None" else int(fields["X-Page"])
            rows.append((page, fields["WARC-Type"], digest, size, refers))
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "record_type", "digest", "payload_bytes", "refers_to"])

    run: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if run and (row[0] != run[0][0] or row[1] - (run[-1][1] + run[-1][2]) > GAP or row[1] + row[2] - run[0][1] > MOST):
                yield fetch(run)
                run = []
            run.append(row)
    if run:
        yield fetch(run)


def read(selected: DataFrame) -> DataFrame:
    """Records of the selected index rows: page_id, record_type, digest, payload_bytes (of the full payload), refers_to.
    Digests are checked while reading."""
    rows = selected.select("file", "offset", "length", "digest").repartition(partitions(selected.sparkSession), "file", F.floor(F.col("offset") / MOST)).sortWithinPartitions("file", "offset")
    return rows.mapInArrow(_read, _RECORD)


def archived(pages: DataFrame) -> DataFrame:
    """Writes and reads back all pages: page_id, payload_bytes, payload_digest, record_type, refers_to. A revisit's payload
    is that of the response it refers to, whose size and digest its header carries."""
    index = write(pages, new_path(pages.sparkSession, "warc"))
    return read(index).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
