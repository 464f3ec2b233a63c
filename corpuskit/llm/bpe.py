"""Byte-level BPE encoding in linear time, exactly as repeated lowest-rank merging would do it.

Bytes are mapped to Latin-1 so that pyahocorasick can hold the vocabulary. One pass of the
automaton gives the longest token that starts at each byte; the encoder takes longest tokens and
backtracks to shorter ones whenever two adjacent tokens could not stand side by side in a merge
result. That compatibility depends on the two tokens alone and is memoised; a position from which
no completion exists is remembered, so the work is linear in the length of the piece.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the tables that a worker keeps: compatible tokens, and pieces in each of two generations.
MEMO = 1 << 18
PIECES = 150_000
LONG_TEXT = 1_000_000
#: Rows that are encoded together.
ROWS = 512


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def parse_ranks(blob: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a line per token, its bytes in base64 and its rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines()) if a}


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.rank = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.split = regex.compile(pattern)
        self.parts: dict[int, tuple[int, int]] = {}  # the merge that makes a token; single bytes have none
        self.memo: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.auto = ahocorasick.Automaton()
        self.size: dict[int, int] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1 or self._made(token, i):
                self.size[i] = len(token)
                self.auto.add_word(token.decode("latin-1"), i)
        self.auto.make_automaton()
        self.shorter: dict[int, int] = {}

    def _made(self, token: bytes, i: int) -> bool:
        """Finds the last merge of a token; False if merging its bytes never gives the token."""
        for k in range(1, len(token)):
            a, b = self.rank.get(token[:k]), self.rank.get(token[k:])
            if a is not None and b is not None and a < i and b < i and a in self.size and b in self.size and self._adjacent(a, b, i):
                self.parts[i] = (a, b)
                return True
        return False

    def _adjacent(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge across the border of a and b comes before ``limit`` and before both are complete.

        Walks back through the merges of either side, the latest first; at each state the two parts
        that touch the border must not merge earlier than the part undone last was made.
        """
        rank, text, parts = self.rank, self.bytes_of, self.parts
        while True:
            both = rank.get(text[a] + text[b])
            if both is not None and both < limit:
                return False
            inner_a, inner_b = parts.get(a), parts.get(b)
            if inner_a is None and inner_b is None:
                return True
            if inner_b is None or (inner_a is not None and a > b):
                limit, a = a, inner_a[1]
            else:  # of equal merges the left one, across the border, would come first
                limit, b = b + 1, inner_b[0]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            known = self.memo[key] = self._adjacent(a, b, 1 << 62)
        return known

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        text = self.bytes_of[token]
        found = next((i for k in range(len(text) - 1, 0, -1) if (i := self.rank.get(text[:k])) in self.size), -1)
        self.shorter[token] = found
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        n, size, compatible, shorter = len(piece), self.size, self.compatible, self.shorter
        longest = [-1] * (n + 1)
        for end, token in self.auto.iter(piece.decode("latin-1")):
            longest[end + 1 - size[token]] = token
        dead, ids, at, token = bytearray(n + 1), [], 0, longest[0]
        while True:
            end = at + size[token]
            if not dead[end] and (not ids or compatible(ids[-1], token)):
                ids.append(token)
                if end == n:
                    return ids
                at, token = end, longest[end]
                continue
            less = shorter.get(token)
            token = self._shorter(token) if less is None else less
            if token < 0:
                dead[at] = 1
                token = ids.pop()
                at -= size[token]

    def _lot(self, pieces: list[str]) -> bytes:
        """Ids of pieces, each known one looked up; a full table becomes the old one, so frequent pieces stay."""
        if len(self.cache) > PIECES:
            self.cache, self.old = {}, self.cache
        cache, old = self.cache, self.old
        found = list(map(cache.get, pieces))
        for i, ids in enumerate(found):
            if ids is None:
                piece = pieces[i]
                ids = cache.get(piece) or old.get(piece) or _pack(self.encode_piece(piece.encode("utf-8", "surrogatepass")))
                if len(piece) <= 64:
                    cache[piece] = ids
                found[i] = ids
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if len(text) < LONG_TEXT:
            return self._lot(self.split.findall(text))
        pieces, out = (m[0] for m in self.split.finditer(text)), []
        while lot := list(itertools.islice(pieces, 100_000)):
            out.append(self._lot(lot))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def _coder(blob: bytes, pattern: str) -> ByteBPE:
    key = (hashlib.sha256(blob).hexdigest(), pattern)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBPE(parse_ranks(blob), pattern)
    return _LOADED[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids])``, one row per input row, in one pass without a shuffle.

    Null is encoded as the empty text (no ids). The vocabulary file, whose size is fixed, is read by
    the driver and sent to the workers; with ``ids`` the token ids come as an array too.
    """
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sha = _coder(shared.value, pattern), hashlib.sha256
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            n, a, b, lists = [], [], [], []
            for x in batch.column(1):
                got = coder.encode(x.as_py() or "")
                n.append(len(got) // 4)
                a.append(sha(got).hexdigest())
                b.append(sha(coder.decode(got)).hexdigest())
                if ids:
                    lists.append(np.frombuffer(got, dtype="<u4").astype(np.int32))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns, names = [*columns, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return rows.mapInArrow(run, kinds)
