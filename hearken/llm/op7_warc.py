"""WARC archives with an index: records are written with their places first, and read back by coalesced ranges.

Every page is first written where it is read, as a response, with an index row (file, offset, length, URL, digest).
Roles are decided on the index alone, which is all that is shuffled. Then the members of responses are copied as they
are, by coalesced ranges, into the archives proper, and revisits are made from their index rows. A retried task writes
a new file, and only the rows of the attempt that succeeded are kept, so the index never points into a torn file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.llm.common import _remove, file_system, new_path, small_batches, text_of, written

#: Ranges at most this far apart are read together, up to so many bytes at a time (or one record, if larger).
GAP_BYTES, READ_BYTES = 64 << 10, 4 << 20
#: Bytes of archives that one task reads; fewer, down to the second, where that leaves cores idle.
SPLIT_BYTES, LEAST_BYTES = 128 << 20, 1 << 20
_FIRST = "file string, offset long, length long, url string, sha binary, page_id long, n_bytes long"
_INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _clean(s: str | None) -> str:
    return (s or "").replace("\r", "%0D").replace("\n", "%0A")


def _member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, revisit: bool = False, n_bytes: int | None = None) -> bytes:
    """One gzip member; a revisit has no payload, but says how long it is."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if n_bytes is None else n_bytes}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {_clean(url)}", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    raw = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _parsed(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode("utf-8").split("\r\n")[1:]), payload


class _Archive:
    """An archive that is made when its first record comes."""

    def __init__(self, folder: str, suffix: str = ""):
        self.folder, self.name, self.out, self.place = folder, f"part-{uuid.uuid4().hex}{suffix}.warc.gz", None, 0

    def add(self, member: bytes) -> tuple[str, int, int]:
        if self.out is None:
            fs, at = file_system(self.folder)
            fs.create_dir(at, recursive=True)
            self.out = fs.open_output_stream(f"{at}/{self.name}", compression=None)
        self.out.write(member)
        self.place += len(member)
        return f"{self.folder}/{self.name}", self.place - len(member), len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*rows, strict=True), types, strict=True)], list(names))


class _Reader:
    """Members of archives by place; neighbours come in one read. One archive is open at a time."""

    def __init__(self):
        self.opened, self.handle = None, None

    def members(self, file: str, todo: list[tuple[int, int]]) -> Iterator[bytes]:
        """Those at (offset, length), which are in order."""
        if self.opened != file:
            fs, at = file_system(file)
            self.handle, self.opened = fs.open_input_file(at), file
        k = 0
        while k < len(todo):
            begin, end, j = todo[k][0], sum(todo[k]), k + 1
            while j < len(todo) and todo[j][0] - end <= GAP_BYTES and sum(todo[j]) - begin <= READ_BYTES:
                end, j = max(end, sum(todo[j])), j + 1
            data = self.handle.read_at(end - begin, begin)
            yield from (data[o - begin : o - begin + n] for o, n in todo[k:j])
            k = j


def _placed(index: DataFrame) -> DataFrame:
    """index in order of place, dealt to as many tasks as its bytes ask for."""
    total = index.agg(F.sum("length")).first()[0] or 0
    cores = index.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-total // SPLIT_BYTES), min(cores, total // LEAST_BYTES))
    block = F.floor(F.col("offset") / (total // tasks + 1))
    return index.repartition(tasks, "file", block).sortWithinPartitions("file", "offset")


def _first_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Every row of pages as a response, where it is read; the index of that."""
    small_batches(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = _Archive(folder)
        try:
            for batch in batches:
                rows = []
                for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload = html.encode("utf-8")
                    sha = hashlib.sha1(payload).digest()
                    rows.append((*archive.add(_member(page_id, url, payload, base64.b32encode(sha).decode())), url, sha, page_id, len(payload)))
                if rows:
                    yield _batch(rows, _FIRST)
        finally:
            archive.close()

    return written(own.mapInArrow(run, _FIRST), "warc-first")


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) and returns the index, itself a written table.

    Of equal payloads of at least min_bytes one record of the smallest page_id is a response, and the others, its own
    copies too, revisit it. A null html is an empty payload; a row without page_id is a response that nothing refers to.
    Line breaks in URLs are percent-encoded; other columns are ignored; no pages give no records.
    """
    spark = pages.sparkSession
    folder, scratch = folder or new_path(spark, "warc"), new_path(spark, "warc-scratch")
    first = _first_archives(pages, scratch)
    alike = first.where("page_id is not null").where(F.col("n_bytes") >= min_bytes)
    kept = alike.groupBy("sha").agg(F.min(F.struct("page_id", "file", "offset")).alias("kept"), F.count("*").alias("n")).where("n > 1").select("sha", "kept")
    again = F.col("kept").isNotNull() & F.col("page_id").isNotNull() & ((F.col("file") != F.col("kept.file")) | (F.col("offset") != F.col("kept.offset")))
    roles = first.join(kept, "sha", "left").select("file", "offset", "length", "url", "sha", "page_id", "n_bytes", F.when(again, F.col("kept.page_id")).alias("refers_to"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive, reader = _Archive(folder), _Reader()
        names = [x.split()[0] for x in _INDEX.split(", ")]
        try:
            for batch in batches:
                for file, part in batch.groupby("file", sort=False):
                    revisit = part["refers_to"].notna()
                    live = reader.members(file, list(zip(part["offset"][~revisit].tolist(), part["length"][~revisit].tolist(), strict=True)))
                    rows = []
                    for url, sha, page_id, n, refers_to in zip(part["url"], part["sha"], part["page_id"], part["n_bytes"], part["refers_to"], strict=True):
                        page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                        digest = base64.b32encode(sha).decode()
                        member = next(live) if refers_to is None else _member(page_id, url, b"", digest, refers_to, True, n)
                        rows.append((*archive.add(member), url, digest, page_id, "response" if refers_to is None else "revisit", refers_to))
                    yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
        finally:
            archive.close()

    index = written(_placed(written(roles, "warc-roles")).mapInPandas(run, _INDEX), "warc-index")
    _remove(spark, scratch)
    return index


def read_records(index: DataFrame, keep_payload: bool = False) -> DataFrame:
    """One row per index row, from the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to
    and, if asked for, payload (null for revisits). A response whose payload doesn't have its digest is an error."""
    small_batches(index.sparkSession)
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    number = lambda s: int(x) if (x := s[len("<urn:page:") : -1]) else None

    def record(member: bytes) -> tuple:
        warc, http, payload = _parsed(member)
        digest, revisit = warc["WARC-Payload-Digest"].removeprefix("sha1:"), warc["WARC-Type"] == "revisit"
        if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"{warc['WARC-Record-ID']}: the payload isn't the one that was written")
        return number(warc["WARC-Record-ID"]), warc["WARC-Target-URI"], int(http["Content-Length"]), digest, warc["WARC-Type"], number(warc["WARC-Refers-To"]) if revisit else None, payload if keep_payload and not revisit else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, reader = [x.split()[0] for x in schema.split(", ")], _Reader()
        for batch in batches:
            for file, rows in batch.groupby("file", sort=False):
                todo = list(zip(rows["offset"].tolist(), rows["length"].tolist(), strict=True))
                step = 400 if keep_payload else len(todo)
                members = reader.members(file, todo)
                for k in range(0, len(todo), step):
                    frame = pd.DataFrame([record(m) for m, _ in zip(members, todo[k : k + step])], columns=names)
                    yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    return _placed(index.select("file", "offset", "length")).mapInPandas(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, written and read back."""
    return read_records(write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
