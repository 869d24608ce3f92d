"""Byte-level BPE encoding and decoding in linear time.

Bytes are read as Latin-1 letters, so the vocabulary fits an Aho-Corasick automaton over text. A pre-token is encoded by taking
the longest vocabulary string at each place and stepping back to shorter ones where two neighbours could not stand next to each
other in a merged text. That test of neighbours is exact: undo the later of the two last merges, again and again, and look
whether a merge across the border would have come first. Its answer depends on the pair alone and is memoised. Places from which no
way leads on are marked once, so a pre-token takes time linear in its length. The result is exactly that of merging by rank.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import vocab

MEMO_PRETOKENS = 1 << 20
MEMO_PAIRS = 1 << 21
LONG_PRETOKEN = 64  # longer ones are encoded but not remembered


class Memo(dict):
    """Pre-token -> ids, filled when a pre-token is first met; long pre-tokens are encoded but not kept."""

    def __init__(self, encode) -> None:
        super().__init__()
        self._encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self._encode(piece)
        if len(piece) <= LONG_PRETOKEN:
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder over a list of token byte strings whose places are ranks and ids."""

    def __init__(self, tokens: list[bytes], pattern: str = vocab.PATTERN) -> None:
        self.tokens = tokens
        self._pretokens = regex.compile(pattern)
        self._size = [len(t) for t in tokens]
        self._automaton = ahocorasick.Automaton()
        ids = {}
        for i, token in enumerate(tokens):
            if token:
                ids[token] = i
                self._automaton.add_word(token.decode("latin-1"), i)
        self._automaton.make_automaton()
        self._shorter = [next((ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ids), -1) for t in tokens]
        self._halves: list[tuple[int, int]] = []  # the last merge that makes a token; a byte has itself twice
        self._joined: dict[tuple[int, int], int] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._memo = Memo(self.encode_piece)
        for i, token in enumerate(tokens):
            pair = self._last_merge(token, ids, i) if len(token) > 1 else None
            self._halves.append(pair or (i, i))
            if pair:
                self._joined[pair] = i

    @staticmethod
    def _last_merge(token: bytes, ids: dict[bytes, int], rank: int) -> tuple[int, int] | None:
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            ranked = [(ids.get(a + b, rank), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))]
            low, k = min(ranked)
            if low >= rank:
                return None  # not reachable by merges
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return ids[parts[0]], ids[parts[1]]

    def _fits(self, left: int, right: int) -> bool:
        """Whether ``left`` followed by ``right`` can stand in a merged text."""
        known = self._pairs.get((left, right))
        if known is not None:
            return known
        a, b, limit, fits = left, right, len(self.tokens), True
        while True:
            across = self._joined.get((a, b), limit)
            if across < limit:
                fits = False
                break
            # undo the later merge; of equal tokens the right one was merged later
            if a > b:
                limit, a = a, self._halves[a][1]
                if a == limit:
                    limit, b = b + 1, self._halves[b][0]
                    if b + 1 == limit:
                        break
            else:
                limit, b = b + 1, self._halves[b][0]
                if b + 1 == limit:
                    limit, a = a, self._halves[a][1]
                    if a == limit:
                        break
        if len(self._pairs) >= MEMO_PAIRS:
            self._pairs.clear()
        self._pairs[left, right] = fits
        return fits

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        data = piece.encode()
        n, size = len(data), self._size
        longest = [-1] * (n + 1)
        for end, token in self._automaton.iter(data.decode("latin-1")):
            start = end + 1 - size[token]
            if longest[start] < 0 or size[token] > size[longest[start]]:
                longest[start] = token
        if longest[0] >= 0 and size[longest[0]] == n and self._halves[longest[0]][0] != longest[0]:
            return (longest[0],)
        open_ends = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + size[token]
            if open_ends[end] and (not out or self._fits(out[-1], token)):
                out.append(token)
                at, token = end, longest[end]
            elif self._shorter[token] >= 0:
                token = self._shorter[token]
            else:  # nothing leads on from here
                open_ends[at] = 0
                token = out.pop()
                at -= size[token]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        if len(self._memo) > MEMO_PRETOKENS:
            self._memo.clear()
        return list(chain.from_iterable(map(self._memo.__getitem__, self._pretokens.findall(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[str, Codec] = {}


def encode_documents(
    df: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Per row: the id, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by a space), ``decoded_sha256`` (of the bytes the
    ids decode to) and, on request, the ids themselves.

    A null text is encoded as an empty one: no ids, digests of nothing. Every row is encoded on its own: repeated rows give
    repeated rows, a null id stays null, an empty table gives an empty result, other columns are not read. A text is held in memory
    once with its ids; memos are bounded.
    """
    shipped = df.sparkSession.sparkContext.broadcast(vocab.read_ranks(ranks))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codecs.get(ranks)
        if codec is None:
            codec = _codecs[ranks] = Codec(shipped.value)
        decimal = [str(i) for i in range(len(codec.tokens))]
        for batch in batches:
            n, packed, decoded, lists = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = codec.encode(text or "")
                n.append(len(ids))
                packed.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(pa.array(ids, pa.int32()))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(packed, pa.string()), pa.array(decoded, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                offsets = pa.array([0, *_running(n)], pa.int32())
                cols.append(pa.ListArray.from_arrays(offsets, pa.concat_arrays(lists) if lists else pa.array([], pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _running(counts: list[int]) -> Iterator[int]:
    total = 0
    for c in counts:
        total += c
        yield total
