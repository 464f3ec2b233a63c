"""Token ids as sorted-string-table shards.

A shard holds documents in ascending key order. File layout::

    data blocks   zstd frames of entries: varint shared, varint unshared, varint value size,
                  the unshared end of the key, value (ids, little-endian, 2 or 4 bytes each)
    index         a line per block: its last key, offset, size, entries (sparse index)
    bloom         bit array over the document keys
    footer        fixed size: places of index and bloom, counts, id width, magic

A key is one byte for null or not, the document id as a big-endian integer with the sign bit
flipped, and a number that tells repeated ids of a shard apart; byte order is id order.
``Shard.get`` finds a document by Bloom filter, binary search of the index and a scan of one block.
"""

from __future__ import annotations

import bisect
import itertools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.plans.durable import shared_dir


BLOCK = 1 << 18
BLOOM_BITS, BLOOM_HASHES = 10, 7
FOOTER = struct.Struct("<QQQQQQB7s")
MAGIC = b"CKSST01"
WORDS = 300_000
END_ID = 1
#: Bytes of text that are encoded together.
PART = 4 << 20
#: Bytes of text a shard holds at most, but for one document.
SHARD_BYTES = 256 << 20


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def doc_key(doc_id: int | None) -> bytes:
    return b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def key_doc(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _places(key: bytes, bits: int) -> Iterator[int]:
    h = xxhash.xxh128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return ((a + i * b) % bits for i in range(BLOOM_HASHES))


class ShardWriter:
    """Writes one shard to a binary stream; documents must come in ascending order."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.last, self.first_of_block = bytearray(), b"", True
        self.index: list[tuple[str, int, int, int]] = []
        self.keys: list[bytes] = []
        self.in_block = self.docs = self.tokens = self.repeat = 0
        self.low = self.high = None  # ids that are not null
        self.zstd = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int | None, value: bytes) -> None:
        stem = doc_key(doc_id)
        self.repeat = self.repeat + 1 if self.last[:9] == stem else 0
        if self.repeat == 0:
            self.keys.append(stem)
        if doc_id is not None:
            self.low, self.high = doc_id if self.low is None else self.low, doc_id
        key = stem + struct.pack(">I", self.repeat)
        if self.last > key:
            raise ValueError("documents must come in ascending order")
        shared = 0 if self.first_of_block else len(os.path.commonprefix([key, self.last]))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.first_of_block = key, False
        self.in_block, self.docs, self.tokens = self.in_block + 1, self.docs + 1, self.tokens + len(value) // self.width
        if len(self.block) >= BLOCK:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        place = (self.at, len(data))
        self.out.write(data)
        self.at += len(data)
        return place

    def _flush(self) -> None:
        if self.in_block:
            at, size = self._put(self.zstd.compress(bytes(self.block)))
            self.index.append((self.last.hex(), at, size, self.in_block))
            self.block, self.in_block, self.first_of_block = bytearray(), 0, True

    def finish(self) -> None:
        self._flush()
        index = self._put(json.dumps(self.index).encode())
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        for key in self.keys:
            for p in _places(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        filter_ = self._put(struct.pack("<Q", bits) + bloom.tobytes())
        self.out.write(FOOTER.pack(*index, *filter_, self.docs, self.tokens, self.width, MAGIC))


class Shard:
    """Reads a shard from a random-access file (``read_at(size, offset)`` as pyarrow's have it)."""

    def __init__(self, file):
        self.file = file
        end = file.size() - FOOTER.size
        i_at, i_size, b_at, b_size, self.docs, self.tokens, self.width, magic = FOOTER.unpack(file.read_at(FOOTER.size, end))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.index = [(bytes.fromhex(k), at, size, n) for k, at, size, n in json.loads(file.read_at(i_size, i_at))]
        bloom = file.read_at(b_size, b_at)
        self.bits, self.bloom = struct.unpack("<Q", bloom[:8])[0], bloom[8:]
        self.zstd = zstandard.ZstdDecompressor()

    def _block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, size, n = self.index[i]
        data, pos, key = self.zstd.decompress(self.file.read_at(size, at)), 0, b""
        for _ in range(n):
            shared, pos = _read_varint(data, pos)
            own, pos = _read_varint(data, pos)
            length, pos = _read_varint(data, pos)
            key = key[:shared] + data[pos : pos + own]
            pos += own
            yield key, np.frombuffer(data, f"<u{self.width}", length // self.width, pos)
            pos += length

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            for key, ids in self._block(i):
                yield key_doc(key), ids

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of all documents of this id, none if it is not in the shard."""
        stem = doc_key(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _places(stem, self.bits)):
            return []
        found = []
        for i in range(bisect.bisect_left([k for k, *_ in self.index], stem), len(self.index)):
            keys = [(key, ids) for key, ids in self._block(i) if key[:9] == stem]
            found += [ids for _, ids in keys]
            if self.index[i][0][:9] > stem:
                break
        return found


def open_shard(uri: str) -> Shard:
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    return Shard(fs.open_input_file(path))


#: The normalizer and the piece pattern for which texts may be cut at white space and words encoded by themselves.
NORMALIZERS = ("NFC", "Replace", "Lowercase")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters that no normalisation joins or changes but to lower case, and marks of which a run behind them is one piece.
WORD = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
LETTERS = "".join(c for c in map(chr, range(256)) if WORD.fullmatch(c))
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A digit is a piece of its own, so between white space it marks where one chunk ends and the next begins.
DIGIT, JOINED = "0", 100
BLANK = re.compile(r"[\t-\r ]")


def _splits(form: dict) -> bool:
    """Whether a tokenizer has the normalizer and the pieces that ``_Coder`` relies on."""
    steps = ((form.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    names = tuple(n["type"] for n in (form.get("normalizer") or {}).get("normalizers", ()))
    plain = all(BLANK.search(t["content"]) is None and not t["lstrip"] and not t["rstrip"] for t in form.get("added_tokens", ()))
    return names == NORMALIZERS and steps.get("pattern") == {"Regex": PATTERN} and plain


def _gather(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Runs of ``flat``, which holds runs of these sizes, at these numbers, one after another."""
    counts = sizes[at]
    shift = (np.cumsum(sizes) - sizes)[at] - (np.cumsum(counts) - counts)
    # A part of a text has far fewer than 2**31 ids.
    index = np.repeat(shift.astype(np.int32), counts)
    index += np.arange(len(index), dtype=np.int32)
    return flat[index]


class _Coder:
    """Encodes texts with the tokenizers library, each distinct chunk between white space once.

    Arrow cuts texts into chunks and numbers the distinct ones; only chunks not met before go to the
    library, and numpy gathers the ids of all by number. A chunk that is a word with marks behind it is
    cut into these two pieces, so that a word is encoded once however it is written. Pieces are kept in
    two generations: a full one becomes the old one, from which pieces that come up again are taken
    over, so frequent ones stay and memory is bounded. A tokenizer of another form encodes whole texts.
    """

    def __init__(self, blob: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(blob)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.type = np.dtype(f"<u{self.width}")
        self.end = END_ID.to_bytes(self.width, "little")
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.splits = _splits(json.loads(blob))
        mark = self._ids([DIGIT])[0]
        self.mark = int(mark[0]) if len(mark) == 1 else None
        # The same model for words that normalisation leaves as they are and that are one piece each.
        self.words = Tokenizer.from_str(blob)
        if self.splits:
            self.words.normalizer = None
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _ids(self, texts: list[str], words: bool = False) -> list[np.ndarray]:
        by = self.words if words else self.tokenizer
        return [np.array(x.ids, self.type) for x in by.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str], words: bool = False) -> None:
        """Encodes new chunks, many in one call: joined by marks, cut at the marks' ids again."""
        plain = [c for c in chunks if DIGIT not in c] if self.mark is not None else []
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        for group, ids in zip(groups, self._ids([f" {DIGIT} ".join(g) for g in groups], words)):
            data, ends = ids.tobytes(), (np.nonzero(ids == self.mark)[0] * self.width).tolist()
            if len(ends) == len(group) - 1:
                starts = [0, *(e + self.width for e in ends)]
                self.known.update(zip(group, (data[a:b] for a, b in zip(starts, [*ends, len(data)]))))
        rest = [c for c in chunks if c not in self.known]
        self.known.update(zip(rest, (x.tobytes() for x in self._ids(rest))))

    def _new(self, chunks: list[str]) -> list[str]:
        """The chunks of which the ids are not known; those of the old generation are taken over."""
        known, old = self.known, self.old
        new = [c for c in chunks if c not in known]
        if old:
            kept = {c: ids for c, ids in zip(new, map(old.get, new)) if ids is not None}
            known.update(kept)
            new = [c for c in new if c not in kept]
        return new

    def _values(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces one after another, and how many each has. Lower-case words are told apart by ``WORD``."""
        if len(self.known) > WORDS:
            self.known, self.old = {}, self.known
        every = pieces.to_pylist()
        new = self._new(every)
        word = [WORD.fullmatch(c) is not None for c in new]
        self._learn(list(itertools.compress(new, word)), True)
        self._learn([c for c, w in zip(new, word) if not w])
        values = list(map(self.known.__getitem__, every))
        return np.frombuffer(b"".join(values), self.type), np.fromiter(map(len, values), np.int64, len(values)) // self.width

    def _encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text begins and ends."""
        lists = pc.ascii_split_whitespace(texts)
        chunks = pc.dictionary_encode(lists.flatten())
        at, places, chunks = chunks.indices.to_numpy(), lists.offsets.to_numpy(), chunks.dictionary
        core = pc.utf8_rtrim(chunks, MARKS)
        plain = pc.match_substring_regex(core, f"^(?:{WORD.pattern})$")
        tail = pc.if_else(plain, pc.utf8_ltrim(chunks, LETTERS), "")
        pieces = pc.dictionary_encode(pa.concat_arrays([pc.if_else(plain, pc.utf8_lower(core), chunks), tail]))
        flat, sizes = self._values(pieces.dictionary)
        # Ids of a chunk are those of its two pieces.
        two = pieces.indices.to_numpy().reshape(2, -1).T.ravel()
        flat, two = _gather(flat, sizes, two), sizes[two].reshape(-1, 2).sum(axis=1)
        ids, ends = _gather(flat, two, at), np.concatenate((np.zeros(1, np.int64), np.cumsum(two[at])))
        return ids, ends[places - places[0]]

    def _long(self, text: str) -> Iterator[str]:
        """A long text in pieces that end at white space."""
        at = 0
        while at < len(text):
            found = BLANK.search(text, at + PART)
            end = found.end() if found else len(text)
            yield text[at:end]
            at = end

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text and the end id, as bytes; null is empty."""
        texts = pc.fill_null(texts, "")
        if not self.splits:
            for x in texts:
                yield self._ids([x.as_py()])[0].tobytes() + self.end
            return
        size = pc.binary_length(texts).to_numpy().astype(np.int64)
        at = 0
        while at < len(size):
            if size[at] > PART:
                yield b"".join(self._encoded(pa.array([x]))[0].tobytes() for x in self._long(texts[at].as_py())) + self.end
                at += 1
                continue
            long = np.nonzero(size[at:] > PART)[0]
            stop = at + int(long[0]) if len(long) else len(size)
            stop = max(at + 1, at + int(np.searchsorted(np.cumsum(size[at:stop]), PART, side="right")))
            ids, ends = self._encoded(texts.slice(at, stop - at))
            for a, b in itertools.pairwise(ends.tolist()):
                yield ids[a:b].tobytes() + self.end
            at = stop


@lru_cache(1)
def _coder(blob: str) -> _Coder:
    return _Coder(blob)


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> list[dict]:
    """Encodes documents and writes one shard per range of ids, in ascending order over the shards.

    Returns the manifest, a dict per shard in order: ``shard, path, docs, tokens, first, last``, the
    latter two its least and greatest id that is not null. The number of shards follows the bytes of
    the texts. Null text is empty (only the end id); null ids come first; repeated ids follow one
    another in the order of their texts' hashes. A task writes a file of its own name, so a task that
    runs again leaves the manifest's files whole. Only the manifest reaches the driver.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    text = F.col(text_col).cast("string")
    if shards is None:
        size = docs.agg(F.sum(F.octet_length(text).cast("long")).alias("n")).first().n or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    folder = folder or f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob = shared.value
        coder = _coder(blob)
        number = TaskContext.get().partitionId()
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base)
        name = f"shard-{number:06d}-{uuid.uuid4().hex}.sst"
        with fs.open_output_stream(f"{base}/{name}") as out:
            writer = ShardWriter(out, coder.width)
            for batch in batches:
                for doc_id, value in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1))):
                    writer.add(doc_id, value)
            writer.finish()
        facts = {"shard": number, "path": f"{folder}/{name}", "docs": writer.docs, "tokens": writer.tokens, "first": writer.low, "last": writer.high}
        yield pa.RecordBatch.from_pylist([facts], pa.schema([(k, pa.string() if k == "path" else pa.int64()) for k in facts]))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("order"))
    rows = rows.repartitionByRange(shards, "doc_id", "order").sortWithinPartitions("doc_id", "order").select("doc_id", "text")
    manifest = rows.mapInArrow(write, "shard long, path string, docs long, tokens long, first long, last long").collect()
    return sorted((r.asDict() for r in manifest), key=lambda r: r["shard"])


def lookup(manifest: list[dict], doc_id: int | None) -> list[np.ndarray]:
    """Ids of all documents of one id: opens the shards whose range holds it, each answers by Bloom filter and index."""
    found = []
    for m in manifest:
        # Null ids come first, so the first shard with a document that has an id is the last that may hold them.
        if m["docs"] and (doc_id is None or (m["first"] is not None and m["first"] <= doc_id <= m["last"])):
            found += open_shard(m["path"]).get(doc_id)
        if doc_id is None and m["first"] is not None:
            break
    return found


def read_shards(docs: DataFrame, manifest: list[dict]) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the shards of a manifest."""
    spark, base, rows = docs.sparkSession, 0, []
    for m in manifest:
        rows.append((m["path"], base))
        base += m["tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for row in batch.to_pylist():
                start, out = row["base"], ([], [], [], [])
                for doc_id, ids in open_shard(row["path"]).scan():
                    for column, x in zip(out, (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                        column.append(x)
                    start += len(ids)
                    if len(out[0]) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)
                        out = ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    files = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_to_shards(docs: DataFrame, tokenizer_path: str, folder: str | None = None, **options) -> DataFrame:
    """Writes the shards and returns what they hold, one row per input row."""
    return read_shards(docs, write_shards(docs, tokenizer_path, folder, **options))
