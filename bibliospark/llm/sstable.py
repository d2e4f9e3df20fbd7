"""Token-id output as sorted-string-table shards.

File: blocks, sparse block index, Bloom filter, footer. A block holds entries in key order; each gives the length
of the prefix it shares with the key before, the rest of its key and the packed ids; blocks are compressed alone.
The index has each block's first key and place, so a lookup asks the Bloom filter, bisects the index and reads one
block (or the few that a repeated key spans).

Defined cases: null text is empty; a null identifier sorts first; repeated identifiers keep all rows, ordered by
text; an empty table writes no rows and one or no shard.
"""

from __future__ import annotations

import bisect
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window, functions as F

from .common import bundles, scratch, small_batches, stored
from .tokens import encoder

MAGIC = b"TKSST001"
FOOTER = struct.Struct("<QQQQQQB8s")
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    """Nine bytes whose byte order is null first, then numeric order."""
    return b"\0" if doc_id is None else b"\1" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _places(keys: list[bytes], bits: int) -> np.ndarray:
    h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(BLOOM_HASHES, dtype=np.uint64)) % np.uint64(bits)


class Writer:
    """Writes one shard; keys must come in ascending order."""

    def __init__(self, out, width: int, block_bytes: int):
        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.block, self.held, self.first, self.last, self.at, self.tokens = [], 0, b"", b"", 0, 0
        self.pack = zstandard.ZstdCompressor(level=1)

    def _flush(self) -> None:
        if self.block:
            data = self.pack.compress(b"".join(self.block))
            self.out.write(data)
            self.index.append((self.first, self.at, len(data)))
            self.at += len(data)
            self.block, self.held = [], 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        entry = _varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(len(value))
        self.block += [entry, value]
        self.held += len(entry) + len(value)
        self.last = key
        self.keys.append(key)
        self.tokens += len(value) // self.width
        if self.held >= self.block_bytes:
            self._flush()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index)
        bits = max(64, BLOOM_BITS * len(self.keys) + 7 & ~7)
        bloom = np.zeros(bits, np.uint8)
        for i in range(0, len(self.keys), 100_000):
            bloom[_places(self.keys[i : i + 100_000], bits).ravel().astype(np.int64)] = 1
        packed = np.packbits(bloom).tobytes()
        self.out.write(index)
        self.out.write(packed)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), len(self.keys), self.tokens, self.width, MAGIC))


class Shard:
    """Reads one shard through any file system that pyarrow opens."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - FOOTER.size)
        self.index_at, index_len, bloom_at, bloom_len, self.n_docs, self.n_tokens, self.width, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        self.file.seek(self.index_at)
        data, at = self.file.read(index_len), 0
        self.firsts: list[bytes] = []
        self.blocks: list[tuple[int, int]] = []
        while at < len(data):
            n, at = _read_varint(data, at)
            self.firsts.append(data[at : at + n])
            start, at = _read_varint(data, at + n)
            length, at = _read_varint(data, at)
            self.blocks.append((start, length))
        self.bloom = self.file.read(bloom_len)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        start, length = self.blocks[block]
        self.file.seek(start)
        data, at, key = zstandard.ZstdDecompressor().decompress(self.file.read(length)), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            n, at = _read_varint(data, at + rest)
            yield key, data[at : at + n]
            at += n

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for block in range(len(self.blocks)):
            yield from self.entries(block)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of all rows with this identifier, none if it is absent."""
        key = key_of(doc_id)
        places = _places([key], len(self.bloom) * 8)[0].astype(np.int64)
        if not all(self.bloom[p >> 3] & (128 >> (p & 7)) for p in places):
            return []
        found = []
        for block in range(max(0, bisect.bisect_left(self.firsts, key) - 1), len(self.blocks)):
            if self.firsts[block] > key:
                break
            found += [np.frombuffer(v, f"<u{self.width}").astype("<u4") for k, v in self.entries(block) if k == key]
        return found


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, block_bytes: int = 1 << 18, shards: int | None = None) -> DataFrame:
    """Encode and write all documents; returns the manifest (shard, path, n_docs, n_tokens, first_id, last_id).

    Range-partitioned on doc_id, so shard order is identifier order. Each task writes under a name of its own and
    reports it in its row: what a lost or repeated task left behind is never read.
    """
    small_batches(docs.sparkSession)
    folder = scratch(docs.sparkSession, "tokens")
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        code = encoder(tokenizer)
        end = np.array([end_id], code.type).tobytes()
        out = writer = path = first = last = None
        for table in bundles(batches, "text", 8 << 20):
            if writer is None:
                path = f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}.sst"
                system, local = fs.FileSystem.from_uri(path)
                system.create_dir(local.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(local)
                writer = Writer(out, code.width, block_bytes)
                first = table["doc_id"][0].as_py()
            for doc_id, ids in zip(table["doc_id"].to_pylist(), code.packed([t or "" for t in table["text"].to_pylist()])):
                writer.add(key_of(doc_id), ids + end)
                last = doc_id
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int64()), "path": [path], "n_docs": pa.array([len(writer.keys)], pa.int64()), "n_tokens": pa.array([writer.tokens], pa.int64()), "first_id": pa.array([first], pa.int64()), "last_id": pa.array([last], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return stored(ordered.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long, first_id long, last_id long"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; ids are little-endian unsigned 32-bit, start counts the ids before it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with Shard(row["path"]) as shard:
                    start, kept = row["before"], {"doc_id": [], "start": [], "n_tokens": [], "ids": []}
                    for block in range(len(shard.blocks)):
                        for key, value in shard.entries(block):
                            ids = np.frombuffer(value, f"<u{shard.width}")
                            for name, v in (("doc_id", id_of(key)), ("start", start), ("n_tokens", len(ids)), ("ids", ids.astype("<u4").tobytes())):
                                kept[name].append(v)
                            start += len(ids)
                        if block % 8 == 7 or block == len(shard.blocks) - 1:
                            yield pa.RecordBatch.from_pydict(kept, pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]))
                            kept = {k: [] for k in kept}

    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = manifest.select("path", before.alias("before"))  # one row a shard
    return placed.repartition(shards).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def lookup(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the wanted identifiers: a null one too; the shard by binary search among the shards' ends, then within it."""

    def find(key: tuple, table: pa.Table) -> pa.Table:
        out: dict[str, list] = {"doc_id": [], "ids": []}
        with Shard(table["path"][0].as_py()) as shard:
            for doc_id in table["doc_id"].to_pylist():
                for ids in shard.get(doc_id):
                    out["doc_id"].append(doc_id)
                    out["ids"].append(ids.tobytes())
        return pa.table(out, pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())]))

    shards = [(key_of(r.first_id), key_of(r.last_id), r.path) for r in manifest.orderBy("shard").collect()]  # one row a shard, in order of keys
    lasts = [last for _, last, _ in shards]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "path": []}
            for doc_id in batch.column("doc_id").to_pylist():
                key = key_of(doc_id)
                at = bisect.bisect_left(lasts, key)
                while at < len(shards) and shards[at][0] <= key:
                    out["doc_id"].append(doc_id)
                    out["path"].append(shards[at][2])
                    at += 1
            yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("path", pa.string())]))

    ids = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return ids.mapInArrow(place, "doc_id long, path string").groupBy("path").applyInArrow(find, "doc_id long, ids binary")
