"""Web archives written from and read into chunked record tables.

A payload never has to be one cell: a record table has one row per chunk, with the record's identifier, the chunk's number, the digest of
all bytes so far and a mark on the last. Chunks of a record follow each other. The writer takes such rows and streams them into gzip members, the reader
streams archives in bounded reads and yields such rows again, whatever the length of a record.

Of payloads that are equal and not short, one is stored (``response``) and the others refer to it (``revisit``, without payload). Which
is which comes from one grouping of digests; the pages themselves are shuffled once, to meet their group.

Each task writes one archive with an unpredictable name and returns a row that names it; only archives of committed tasks are listed
and read, so executors may be lost at any time.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.shared import file_system

MIN_REVISIT = 100  # bytes from which equal payloads are stored once
CHUNK = 1 << 20  # bytes of a payload in one row
READ = 1 << 18  # compressed bytes read at once
DATE = "1970-01-01T00:00:00Z"  # pages carry no date
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE = b"\r\n"

RECORDS = "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, chunk_no int, chunk binary, digest_so_far string, last boolean"


def _http(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def _name(page: str | None) -> str:
    return f"<urn:x-page:{'' if page is None else page}>"


def _header(page: str | None, url: str | None, size: int, digest: str, refers_to: str | None) -> bytes:
    """Record header and the head of its block."""
    http = _http(size)
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _name(page),
        "WARC-Date": DATE,
        "WARC-Target-URI": " ".join((url or "").split()) or "about:blank",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(http) + (size if refers_to is None else 0),
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _name(refers_to)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + LINE + http


class _Archive:
    """One archive file, a gzip member per record, opened at the first record."""

    def __init__(self, folder: str) -> None:
        self.file = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        self._sink = self._packer = None
        self.records = 0

    def begin(self, head: bytes) -> None:
        if self._sink is None:
            store, where = file_system(self.file)
            store.create_dir(where.rpartition("/")[0], recursive=True)
            self._sink = store.open_output_stream(where)
        self._packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.records += 1
        self.add(head)

    def add(self, data: bytes) -> None:
        self._sink.write(self._packer.compress(data))

    def end(self) -> None:
        self.add(LINE * 2)
        self._sink.write(self._packer.flush())

    def close(self) -> None:
        if self._sink is not None:
            self._sink.close()


def record_table(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_revisit: int = MIN_REVISIT, chunk: int = CHUNK) -> DataFrame:
    """The pages as chunk rows in the form of ``RECORDS``, each page's rows together and in order; a revisit has one row with an empty chunk.

    Among equal payloads of at least ``min_revisit`` bytes the least id is the response. A null body is an empty payload. Rows with null
    ids are revisits if some page with an id has their payload, else responses; rows that repeat an id and its payload are
    responses each if that id is the least. A null url is written as ``about:blank``.
    """
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    rows = rows.select("*", F.octet_length("body").cast("bigint").alias("size"), F.sha2("body", 256).alias("digest"))
    groups = rows.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.min("id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    # the pages of a frequent payload are on the side that Spark can split
    typed = rows.join(groups.where("n > 1").select("digest", "keeper"), "digest", "left")
    refers = F.when(F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper")), F.col("keeper").cast("string"))
    typed = typed.select(F.col("id").cast("string").alias("page"), "url", "size", "digest", refers.alias("refers_to"), "body")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow_schema()
        for batch in batches:
            out, held = [], 0
            for page, url, size, digest, refers_to, payload in zip(*(batch.column(k) for k in range(6))):
                data = memoryview(payload.as_buffer()) if refers_to.as_py() is None else memoryview(b"")
                state, size = hashlib.sha256(), size.as_py()
                for no, at in enumerate(range(0, max(1, len(data)), chunk)):
                    piece = data[at : at + chunk]
                    state.update(piece)
                    last = at + chunk >= len(data)
                    kind = "response" if refers_to.as_py() is None else "revisit"
                    so_far = state.hexdigest() if kind == "response" else digest.as_py()
                    out.append((page.as_py(), url.as_py(), size, digest.as_py(), kind, refers_to.as_py(), no, bytes(piece), so_far, last))
                    held += len(piece) + 400
                    if held >= 8 * chunk:
                        yield _batch(out, schema)
                        out, held = [], 0
            if out:
                yield _batch(out, schema)

    return typed.mapInArrow(cut, RECORDS)


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (f.strip().split(" ") for f in RECORDS.split(","))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Stream chunk rows into archives below ``folder``; the rows of a record must follow each other. Returns the list of archives (file, records),
    kept as Parquet in ``folder/list``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = _Archive(folder)
        try:
            for batch in batches:
                for r in _rows(batch):
                    page, url, size, digest, _, refers_to, no, piece, _, last = r
                    if no == 0:
                        archive.begin(_header(page, url, size, digest, refers_to))
                    archive.add(piece)
                    if last:
                        archive.end()
        finally:
            archive.close()
        if archive.records:
            yield pa.RecordBatch.from_arrays([pa.array([archive.file]), pa.array([archive.records], pa.int64())], ["file", "records"])

    records.mapInArrow(write, "file string, records bigint").write.parquet(f"{folder}/list")
    return records.sparkSession.read.parquet(f"{folder}/list")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    for k in range(batch.num_rows):
        yield tuple(c[k].as_py() for c in batch.columns)


class Parser:
    """Turns the bytes of an archive, fed in any pieces, into chunk rows; holds one header and one chunk at most."""

    def __init__(self, chunk: int = CHUNK) -> None:
        self._chunk, self._buffer, self._fields = chunk, bytearray(), None
        self._left = self._no = 0
        self._state = hashlib.sha256()

    def feed(self, data: bytes) -> Iterator[tuple]:
        self._buffer += data
        while True:
            if self._fields is None:
                row_or_more = self._open()
                if row_or_more is False:
                    return
            take = min(self._chunk, self._left)
            if len(self._buffer) < take + (4 if take == self._left else 0):
                return
            piece = bytes(self._buffer[:take])
            del self._buffer[:take]
            self._state.update(piece)
            self._left -= take
            last = not self._left
            page, url, size, digest, kind, refers_to = self._fields
            yield page, url, size, digest, kind, refers_to, self._no, piece, self._state.hexdigest() if kind == "response" else digest, last
            self._no += 1
            if last:
                if kind == "response" and self._state.hexdigest() != digest:
                    raise ValueError(f"payload of {page} does not have its digest")
                if bytes(self._buffer[:4]) != LINE * 2:
                    raise ValueError(f"record of {page} does not end where it should")
                del self._buffer[:4]
                self._fields = None

    def _open(self) -> bool:
        """Read the headers of a record and of the response in it, if they are there."""
        top = self._buffer.find(LINE * 2)
        end = self._buffer.find(LINE * 2, top + 4) if top >= 0 else -1
        if end < 0:
            return False
        head = dict(x.split(": ", 1) for x in self._buffer[:top].decode().split("\r\n")[1:])
        http = dict(x.split(": ", 1) for x in self._buffer[top + 4 : end].decode().split("\r\n")[1:])
        page = head["WARC-Record-ID"][12:-1] or None
        refers = head.get("WARC-Refers-To")
        url = head["WARC-Target-URI"]
        self._fields = page, url, int(http["Content-Length"]), head["WARC-Payload-Digest"].partition(":")[2], head["WARC-Type"], refers and refers[12:-1]
        self._left = int(head["Content-Length"]) - (end - top)  # the block's head is what lies between the two, with its own end
        self._no, self._state = 0, hashlib.sha256()
        del self._buffer[: end + 4]
        return True

    def close(self) -> None:
        if self._fields is not None or self._buffer:
            raise ValueError("an archive ends within a record")


def read_archives(archives: DataFrame, chunk: int = CHUNK, with_payload: bool = True) -> DataFrame:
    """Chunk rows of the listed archives (``file``), streamed; without payload only the last row of each record, its chunk left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, held = _arrow_schema(), [], 0
        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, where = file_system(file)
                parser = Parser(chunk)
                with store.open_input_stream(where) as source:
                    for data in _unpacked(source):
                        for row in parser.feed(data):
                            if with_payload:
                                out.append(row)
                                held += len(row[7])
                            elif row[9]:
                                out.append((*row[:7], None, *row[8:]))
                            held += 400
                            if held >= 8 * chunk:
                                yield _batch(out, schema)
                                out, held = [], 0
                parser.close()
        if out:
            yield _batch(out, schema)

    spark = archives.sparkSession
    # a task per archive; there are as many as tasks that wrote
    files = archives.select("file").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file")
    return files.mapInArrow(read, RECORDS)


def _unpacked(source) -> Iterator[bytes]:
    """Bytes of a file of gzip members, in pieces of bounded size."""
    unpacker = zlib.decompressobj(31)
    rest = b""
    while data := rest or source.read(READ):
        if unpacker.eof:
            unpacker = zlib.decompressobj(31)
        yield unpacker.decompress(data, 4 * READ)
        rest = unpacker.unconsumed_tail or unpacker.unused_data
