"""WARC archives: an index first, then coalesced byte-range reads.

`write` turns each page into a WARC record, a gzip member of its own, in
archives of the shared folder; every record's archive, offset, length, URL and
digest go to an index table.  Of records with equal payloads of at least
`REVISIT_FROM` bytes the one with the largest page_id is the response, and the
others are revisit records without a payload.  `read` takes rows of the index,
sorts them by archive and offset, joins neighbouring ranges into reads of up to
`READ_BYTES`, and parses the records.

A task writes its archives under names of its own attempt, and the index that
Spark commits names only archives of attempts that succeeded, so a lost
executor or a speculative copy leaves no half-written archive in the index.
Archives are cut at `ARCHIVE_BYTES`, and reads at `READ_BYTES`.  The folder may
be in any store that `pyarrow.fs` opens by URI.

Defined results.  Null html: an empty payload.  Null url: a record without
target URI.  Null page_id: a response or revisit as its payload has it, never
preferred as the response; a group of only null ids is all responses.  Repeated
rows: each has a record; those that share the largest page_id are all
responses.  Other columns are ignored.  Carriage returns and line feeds in a
URL are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import text_bytes
from shelfcast.session import materialize, shared_path

REVISIT_FROM = 1_000
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 4 << 20
GAP_BYTES = 64 << 10
TASK_BYTES = 16 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
INDEX = ("archive string, offset long, length long, url string, digest string, "
         "page_id long, record_type string, refers_to long, payload_bytes long")


def _file_system(uri: str):
    """The file system of a URI or local path, and the path in it."""
    from pyarrow import fs
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit where `refers_to` is given."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = HTTP % len(payload) + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and HTTP payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return headers, rest[:int(headers["content-length"])].partition(b"\r\n\r\n")[2]


def with_roles(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, _refers): the response that a row revisits."""
    rows = pages.select("page_id", "url", "html").withColumns({
        "_raw": F.coalesce(F.col("html"), F.lit("")).cast("binary")}).withColumns({
        "_size": F.octet_length("_raw"), "_sha": F.sha1("_raw")}).drop("_raw")
    # One row per payload that occurs more than once: a hot payload is counted
    # before the shuffle, and the join splits its rows where they are skewed.
    shared = (rows.where(F.col("_size") >= REVISIT_FROM).groupBy("_sha")
              .agg(F.max("page_id").alias("_top"), F.count("*").alias("_n"))
              .where((F.col("_n") > 1) & F.col("_top").isNotNull()))
    return rows.join(shared.select("_sha", "_top"), "_sha", "left").select(
        "page_id", "url", "html",
        F.when((F.col("_size") >= REVISIT_FROM) & ~F.col("page_id").eqNullSafe(F.col("_top")),
               F.col("_top")).alias("_refers"))


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the archives below `folder` (default: a new one in the shared
    folder) and return their index, a table of its own."""
    folder = folder or shared_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _file_system(folder)
        store.create_dir(root, recursive=True)
        attempt, out, name, at, part = uuid4().hex, None, "", 0, 0
        try:
            for b in batches:
                rows = []
                for page_id, url, html, refers in zip(b["page_id"], b["url"], b["html"], b["_refers"]):
                    page_id, refers = (None if pd.isna(x) else int(x) for x in (page_id, refers))
                    payload = text_bytes(html)
                    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
                    raw = pack.compress(record(page_id, url, payload, refers)) + pack.flush()
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"{TaskContext.get().partitionId():05d}-{attempt}-{part:04d}.warc.gz"
                        out, at, part = store.open_output_stream(f"{root}/{name}", compression=None), 0, part + 1
                    out.write(raw)
                    rows.append((name, at, len(raw), url, hashlib.sha1(payload).hexdigest(), page_id,
                                 "response" if refers is None else "revisit", refers, len(payload)))
                    at += len(raw)
                yield _frame(rows, INDEX)
        finally:
            if out is not None:
                out.close()
    index = with_roles(pages).mapInPandas(run, INDEX)
    return materialize(index, "warc-index").withColumn("archive", F.concat(F.lit(folder + "/"), "archive"))


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    longs = {x.split()[0] for x in schema.split(", ") if x.endswith("long")}
    columns = list(zip(*rows)) or [()] * len(names)
    return pd.DataFrame({k: pd.array(v, dtype="Int64") if k in longs else list(v) for k, v in zip(names, columns)})


RECORD = "page_id long, url string, record_type string, digest string, payload_bytes long, refers_to long, payload binary"


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the given index rows, checked against their digests."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for archive, group in b.groupby("archive", sort=True):
                store, path = _file_system(str(archive))
                with store.open_input_file(path) as source:
                    for raw in _ranges(source, list(zip(group["offset"], group["length"]))):
                        rows.append(_record(zlib.decompress(raw, 31), payloads))
            yield _frame(rows, RECORD)
    wanted = index.select("archive", "offset", "length")
    # Ranges in order, so that neighbours in an archive meet in a batch; dealt
    # by the bytes to read, as the rows of the index are small.
    size = wanted.agg(F.sum("length")).first()[0] or 0
    return (wanted.repartitionByRange(max(1, -(-size // TASK_BYTES)), "archive", "offset")
            .sortWithinPartitions("archive", "offset").mapInPandas(run, RECORD))


def _ranges(source, spans: list[tuple[int, int]]) -> Iterator[bytes]:
    """The bytes of the spans, which ascend; near ones come in one read."""
    k = 0
    while k < len(spans):
        first, end, n = spans[k][0], spans[k][0] + spans[k][1], k + 1
        while n < len(spans) and spans[n][0] - end <= GAP_BYTES and spans[n][0] + spans[n][1] - first <= READ_BYTES:
            end, n = spans[n][0] + spans[n][1], n + 1
        got = source.read_at(int(end - first), int(first))
        yield from (got[o - first:o - first + size] for o, size in spans[k:n])
        k = n


def _record(raw: bytes, payloads: bool) -> tuple:
    head, payload = parse(raw)
    number = lambda x: int(x[len("<urn:page:"):-1]) if x and x != "<urn:page:>" else None
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    if head["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
    return (number(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], digest,
            int(head["warc-payload-length"]), number(head.get("warc-refers-to")),
            payload if payloads and head["warc-type"] == "response" else None)
