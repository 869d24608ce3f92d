"""Token sequences in length-delimited binary records with a separate offset index.

A record is: length of the payload (8 bytes), masked CRC-32C of those 8 bytes, payload, masked CRC-32C of the payload, all little-endian.
The payload is the sequence of ids, 2 bytes each where the vocabulary allows it, else 4. The index, a Parquet table, has the file,
offset and length of every record, so readers can visit records in any order without reading the files from the start.

Documents are range-partitioned by id, so files follow id order; each task streams its documents into one file of
its own with an unpredictable name and returns the index rows. Only the index of tasks that Spark commits is kept, so a repeated task
leaves at most a file that nothing refers to.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.llm.shared import file_system

POLYNOMIAL = 0x82F63B78  # fixed value: CRC-32C, reflected
MASK_DELTA = 0xA282EAD8  # fixed value: of the masked checksum
BLOCK = 512  # bytes that one lane of the checksum takes
MEMO_WORDS = 1 << 20  # about 200 MB
FRAME = 16  # bytes of a record besides its payload


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Effect on the checksum of four bytes given by their low and high halves, and of ``BLOCK`` zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1)
    rows = [step]
    for _ in range(3):
        rows.append(step[rows[-1] & 0xFF] ^ (rows[-1] >> 8))
    half = np.arange(1 << 16, dtype=np.uint32)
    low, high = rows[3][half & 0xFF] ^ rows[2][half >> 8], rows[1][half & 0xFF] ^ rows[0][half >> 8]
    far_low, far_high = half.copy(), half << 16
    for _ in range(BLOCK // 4):
        far_low = low[far_low & 0xFFFF] ^ high[far_low >> 16]
        far_high = low[far_high & 0xFFFF] ^ high[far_high >> 16]
    return low, high, far_low, far_high


def crc32c(payloads: list[bytes]) -> np.ndarray:
    """CRC-32C of each payload; all payloads advance together, cut into blocks that are joined afterwards."""
    low, high, far_low, far_high = _tables()
    out = np.zeros(len(payloads), np.uint32)
    blocks = np.array([-(-max(len(p), 1) // BLOCK) for p in payloads], np.int64)
    first = np.concatenate([[0], np.cumsum(blocks)]) if len(blocks) else np.zeros(1, np.int64)
    data = np.zeros((int(first[-1]), BLOCK), np.uint8)
    flat = data.reshape(-1)
    for k, p in enumerate(payloads):  # zeros in front do not count; the initial value is the inversion of the first four bytes
        end = int(first[k + 1]) * BLOCK
        flat[end - len(p) : end] = np.frombuffer(p, np.uint8)
        flat[end - len(p) : min(end, end - len(p) + 4)] ^= 0xFF
    state = np.zeros(len(data), np.uint32)
    for word in np.ascontiguousarray(data.view("<u4").T):
        state ^= word
        state = low[state & 0xFFFF] ^ high[state >> 16]
    order = np.argsort(-blocks, kind="stable")
    ranked = blocks[order]
    for k in range(int(blocks.max(initial=0))):
        live = order[: np.searchsorted(-ranked, -k, side="left")]
        out[live] = far_low[out[live] & 0xFFFF] ^ far_high[out[live] >> 16] ^ state[first[live] + k]
    for k, p in enumerate(payloads):
        if len(p) < 4:  # shorter than the initial value
            crc = 0xFFFFFFFF
            for b in p:
                crc ^= b
                for _ in range(8):
                    crc = crc >> 1 ^ (POLYNOMIAL if crc & 1 else 0)
            out[k] = crc
    return ~out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def frames(payloads: list[bytes]) -> Iterator[bytes]:
    """The payloads as records."""
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    for n, nc, p, pc in zip(lengths, masked(crc32c(lengths)).tolist(), payloads, masked(crc32c(payloads)).tolist()):
        yield b"".join((n, struct.pack("<I", nc), p, struct.pack("<I", pc)))


def payloads_of(records: list[bytes]) -> list[bytes]:
    """Payloads of whole records, lengths and checksums verified."""
    lengths, out = [r[:8] for r in records], [r[12:-4] for r in records]
    stored = np.array([struct.unpack("<I", r[8:12])[0] for r in records], np.uint32), np.array([struct.unpack("<I", r[-4:])[0] for r in records], np.uint32)
    if any(struct.unpack("<Q", n)[0] != len(p) for n, p in zip(lengths, out)):
        raise ValueError("a record's length differs from the index")
    if (masked(crc32c(lengths)) != stored[0]).any() or (masked(crc32c(out)) != stored[1]).any():
        raise ValueError("a record's checksum is wrong")
    return out


class WordEncoder:
    """Ids of texts by a tokenizer that folds case and drops white space: each distinct word goes to the library once.

    Words end at white space. Where full stops and commas follow letters or digits only, they are words of their own, as the tokenizer
    itself parts them, so the memo holds words rather than words with every mark that may follow. The library looks for added tokens in the
    text as it is, so a text that holds one in any letter case is not lower-cased before.
    """

    _run = re.compile(r"(?:[^\w\s]|_)[.,]")  # a mark that belongs to a run of marks
    _kinds = bytes(0 if chr(c) in ".," else 1 if c < 128 and (chr(c).isalnum() or chr(c) in " \t\n\r\v\f") else 2 if c < 128 else 3 for c in range(256))

    def __init__(self, spec: str, width: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread to a task; each further one would hold memory of its own
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(spec)
        self._batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        self._kind = "H" if width == 2 else "I"
        parsed = json.loads(spec)
        model, self._added = parsed["model"], [t["content"].lower() for t in parsed.get("added_tokens") or ()]
        suffix, vocabulary = model.get("end_of_word_suffix"), model["vocab"]
        self._ends = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
        if suffix:
            self._ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self._words = regex.compile(r"\S+")
        self._coded: dict[str, bytes] = {}  # words met lately, and those met before them
        self._before: dict[str, bytes] = {}

    def _parts(self, text: str) -> bool:
        """Whether each full stop and comma follows a letter, a digit or white space, also after normalisation."""
        kinds = text.encode().translate(self._kinds)
        if b"\2\0" in kinds or b"\0\0" in kinds:
            return False
        return b"\3\0" not in kinds or (unicodedata.is_normalized("NFC", text) and not self._run.search(text))

    def _split(self, text: str) -> list[str]:
        if "\u03a3" not in text:  # the one letter that Python lower-cases by its neighbours
            lower = text.lower()
            if not any(t in lower for t in self._added):
                text = lower
                if self._parts(text):
                    text = text.replace(".", " .").replace(",", " ,")
        # str.split also cuts at these four separators, which the tokenizer does not take for white space
        return self._words.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def _together(self, words: list[str]) -> None:
        """Code words of letters as one text and part it where a token ends a word; nothing is kept if that gives another number of words."""
        ids = array(self._kind, self._batch([" ".join(words)], add_special_tokens=False)[0].ids)
        ends = np.flatnonzero(self._ends[np.frombuffer(ids, self._kind)]) + 1
        if len(ends) == len(words):
            packed, ends = ids.tobytes(), [0, *(ends * ids.itemsize).tolist()]
            self._coded.update(zip(words, map(packed.__getitem__, map(slice, ends, ends[1:]))))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        if len(self._coded) > MEMO_WORDS // 2:  # words not met again since are forgotten
            self._coded, self._before = {}, self._coded
        coded = self._coded
        split = [self._split(t) for t in texts]
        new = set(chain.from_iterable(split)).difference(coded)
        fresh = []
        for word in new:
            if word in self._before:
                coded[word] = self._before[word]
            else:
                fresh.append(word)
        plain = [w for w in fresh if w.isalpha()]
        for at in range(0, len(plain), 256):
            self._together(plain[at : at + 256])
        rest = [w for w in fresh if w not in coded]
        for at in range(0, len(rest), 1024):
            some = rest[at : at + 1024]
            for word, made in zip(some, self._batch(some, add_special_tokens=False)):
                coded[word] = array(self._kind, made.ids).tobytes()
        return [b"".join(map(coded.__getitem__, words)) for words in split]


_encoders: dict[tuple[str, int], WordEncoder] = {}


def write_records(
    df: DataFrame, tokenizer: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", chunk: int = 256
) -> DataFrame:
    """Encode every text, add ``end_id``, write the records below ``folder`` in ascending id order; returns the index.

    Index columns: the id, ``shard`` (number of the file in id order), ``file``, ``offset``, ``length`` (of the whole record), ``width``
    (bytes of an id), ``n_tokens``, ``first`` (ids before it in its file). It is also written as Parquet under ``folder/index``.

    A null text is an empty one (the end id alone). Null ids come first; rows that repeat an id follow each other in the order of a
    digest of their texts, each with its own record. An empty table gives an empty index. A task holds ``chunk`` texts at a time.
    """
    spark = df.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_str(spec).get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4
    shipped = spark.sparkContext.broadcast(spec)  # bounded by the vocabulary
    end = end_id.to_bytes(width, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get((tokenizer, width))
        if encoder is None:
            encoder = _encoders[tokenizer, width] = WordEncoder(shipped.value, width)
        shard = TaskContext.get().partitionId()
        file = f"{folder}/part-{shard:06d}-{uuid.uuid4().hex}.u{8 * width}.records"
        sink, offset, first = None, 0, 0
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, chunk):
                    part = batch.slice(at, chunk)
                    if sink is None and part.num_rows:
                        store, where = file_system(file)
                        store.create_dir(where.rpartition("/")[0], recursive=True)
                        sink = store.open_output_stream(where)
                    coded = [ids + end for ids in encoder.encode([t or "" for t in part.column(1).to_pylist()])]
                    for record in frames(coded):
                        sink.write(record)
                    sizes = np.array([len(p) for p in coded], np.int64)
                    tokens = sizes // width
                    cols = [
                        part.column(0),
                        pa.array(np.full(len(sizes), shard, np.int32)),
                        pa.array([file] * len(sizes), pa.string()),
                        pa.array(offset + np.cumsum(sizes + FRAME) - sizes - FRAME),
                        pa.array(sizes + FRAME),
                        pa.array(np.full(len(sizes), width, np.int32)),
                        pa.array(tokens),
                        pa.array(first + np.cumsum(tokens) - tokens),
                    ]
                    offset, first = offset + int((sizes + FRAME).sum()), first + int(tokens.sum())
                    yield pa.RecordBatch.from_arrays(cols, ["id", "shard", "file", "offset", "length", "width", "n_tokens", "first"])
        finally:
            if sink is not None:
                sink.close()

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    # the digest spreads rows that share an id, and orders them
    order = ["id", F.xxhash64("text")]
    schema = f"id {kind}, shard int, file string, offset bigint, length bigint, width int, n_tokens bigint, first bigint"
    index = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, schema)
    index.write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index").withColumnRenamed("id", id_col)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index written by ``write_records`` (the id column is called ``id``)."""
    return spark.read.parquet(f"{folder}/index")


def read_records(index: DataFrame, chunk_bytes: int = 8 << 20, digest: bool = False) -> DataFrame:
    """The records that the rows of ``index`` name, in any order and number: its columns, ``ids`` (4 bytes each, little-endian) verified
    against both checksums, or with ``digest`` their CRC-32 as ``ids_crc32``. Rows are read where they are, without a shuffle; consecutive rows of a
    file share one open file."""
    names = index.columns
    last, kind = ("ids_crc32", "bigint") if digest else ("ids", "binary")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        for batch in batches:
            files, offsets, lengths = (batch.column(names.index(c)).to_pylist() for c in ("file", "offset", "length"))
            widths = batch.column(names.index("width")).to_pylist()
            at = 0
            while at < batch.num_rows:
                records, start, size = [], at, 0
                while at < batch.num_rows and (not records or size < chunk_bytes):
                    if files[at] != opened:
                        store, where = file_system(files[at])
                        opened, source = files[at], store.open_input_file(where)
                    records.append(source.read_at(lengths[at], offsets[at]))
                    size += lengths[at]
                    at += 1
                ids = (np.frombuffer(p, f"<u{w}").astype("<u4").tobytes() for p, w in zip(payloads_of(records), widths[start:at]))
                made = pa.array(map(zlib.crc32, ids), pa.int64()) if digest else pa.array(ids, pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(start, at - start).columns, made], [*names, last])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema)
    return index.mapInArrow(read, f"{fields}, {last} {kind}")


def with_starts(index: DataFrame) -> DataFrame:
    """Adds ``start``: the number of ids of all documents before it. Files are few (one per task), so their totals may be broadcast."""
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return index.join(F.broadcast(bases), "shard").withColumn("start", F.col("first") + F.col("base")).drop("base")

