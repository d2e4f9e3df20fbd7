"""Shared pieces: scratch tables, hashing of words, packed integers, components."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Lower-cases A-Z only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name inside the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names it; where it is unset and all runs in one process (tests), a temporary folder is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let no more rows than these go to a Python worker at once: texts are long, and a worker's memory is small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each lengthened until no column of the table has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bytes_of(column: pa.Array) -> list[bytes]:
    """Values of a text or binary column as bytes, null as empty."""
    return [b"" if v is None else v.encode("utf-8", "surrogatepass") if isinstance(v, str) else v for v in column.to_pylist()]


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(20_011).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWERED = _BYTES[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not glibc
    _trim = None


def _power(base: int, count: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    held = _powers.get(base)
    if held is None or len(held) < count:
        ones = np.full(max(count, 1 << 19), base, np.uint64)
        ones[0] = 1
        with np.errstate(over="ignore"):
            held = _powers[base] = np.multiply.accumulate(ones)
    return held[:count]


def word_hashes(texts: list[bytes], lower: bool = False, most_bytes: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts, number of words of each text).

    Words are the runs of bytes other than the six ASCII blanks; lower: A-Z as a-z. A word's hash is the polynomial of
    its bytes' random numbers, from running sums over the joined texts, then mixed.
    """
    found, counts, begin = [], [], 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) < most_bytes):
            size += len(texts[end]) + 1
            end += 1
        raw = np.frombuffer(b"\n" + b"\n".join(texts[begin:end]) + b"\n", np.uint8)
        blank = _BLANK[raw]
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        starts, ends = edges[0::2], edges[1::2]
        with np.errstate(over="ignore"):
            sums = np.cumsum((_LOWERED if lower else _BYTES)[raw] * _power(_BASE, len(raw)), dtype=np.uint64)
            hashed = (sums[ends - 1] - sums[starts - 1]) * _power(_INVERSE, len(raw))[starts]
            found.append(mixed(hashed + (ends - starts).astype(np.uint64)))
        lengths = np.array([len(t) for t in texts[begin:end]], np.int64)
        places = np.concatenate([[1], 1 + np.cumsum(lengths + 1)])
        counts.append(np.diff(np.searchsorted(starts, places)))
        begin = end
    return (np.concatenate(found), np.concatenate(counts)) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of n consecutive word hashes: a polynomial in an odd base, then mixed."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15 + 2 * seed * 0x1000003D)
    out = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * base + words[i : i + count]
        return mixed(out + np.uint64(seed))


def packed_gaps(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as gaps in the narrowest width that needs few escapes.

    One width byte, then the gaps; a gap of at least the width's top value is a run of that value and the rest.
    """
    if not len(values):
        return b""
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(0))
    mean = max(1, int(gaps[-1] if len(gaps) == 1 else gaps.mean()))
    for width, top in ((1, 255), (2, 65535)):
        if mean * 3 < top:
            escapes = gaps // top
            if escapes.any():
                at = np.cumsum(escapes + 1) - 1
                out = np.full(int(at[-1]) + 1, top, f"<u{width}")
                out[at] = gaps % top
            else:
                out = gaps.astype(f"<u{width}")
            if width == 1:
                return b"\x01" + out.tobytes()
            planes = out.view(np.uint8).reshape(-1, 2)  # the high bytes are few values: they compress well
            return b"\x02" + len(out).to_bytes(8, "little") + planes[:, 0].tobytes() + zstandard.ZstdCompressor(level=1).compress(planes[:, 1].tobytes())
    return b"\x08" + gaps.astype("<u8").tobytes()


def plain_blobs(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Slices of unsigned integers as blobs for ``unpacked_gaps``, not packed: for many slices of a few values."""
    raw = values.astype("<u4").tobytes()
    return [b"\x04" + raw[i:j] for i, j in zip((4 * begins).tolist(), (4 * ends).tolist())]


def joined_blobs(blobs: list[bytes]) -> list[np.ndarray]:
    """The values of blobs; those that are not packed are read at once."""
    plain = b"".join([b[1:] for b in blobs if b[:1] == b"\x04"])
    out = [unpacked_gaps(b) for b in blobs if b[:1] != b"\x04"]
    return [*out, np.frombuffer(plain, "<u4").astype(np.int64)] if plain else out


def unpacked_gaps(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, np.int64)
    width = blob[0]
    if width == 4:
        return np.frombuffer(blob, "<u4", offset=1).astype(np.int64)
    if width == 2:
        count = int.from_bytes(blob[1:9], "little")
        high = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[9 + count :]), np.uint8)
        raw = np.frombuffer(blob, np.uint8, count, 9).astype(np.int64) | high.astype(np.int64) << 8
        return np.cumsum(raw)[raw != 65535]
    raw = np.frombuffer(blob, f"<u{width}", offset=1).astype(np.int64)
    total = np.cumsum(raw)
    return total if width == 8 else total[raw != 255]


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, and two share an executor."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def bundles(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.Table]:
    """Arrow batches regrouped so that each table holds at most about most_bytes of the column.

    A single longer value makes a table of its own; values are never cut.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)).astype(np.int64)
        begin = 0
        for end in range(1, len(lengths) + 1):
            size += int(lengths[end - 1]) + 64
            if size >= most_bytes:
                held.append(batch.slice(begin, end - begin))
                yield pa.Table.from_batches(held)
                held, size, begin = [], 0, end
                give_back()
        if begin < len(lengths):
            held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)
        held.clear()
        give_back()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable; nodes without an edge are absent.

    ``edges`` has the long columns a and b. Alternates large-star and small-star steps, each an aggregate and a
    join on the node, written to the shared folder, until every edge ends in its component's smallest node.
    """
    spark = edges.sparkSession
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = now.select(F.col("v").alias("u"), F.col("m").alias("w")).unionAll(now.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("least"))
        large = both.where("w > u").join(least, "u").select(F.col("w").alias("v"), F.col("least").alias("m")).where("v <> m")
        large, last = stored(large, "edges"), now
        small_least = large.groupBy(F.col("v").alias("u")).agg(F.min("m").alias("least"))
        small = large.join(small_least, F.col("v") == F.col("u")).select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("least").alias("m")), F.struct(F.col("v"), F.col("least").alias("m")))).alias("e")).select("e.*").where("v <> m").distinct()
        now = stored(small, "edges")
        discard(large, last)
        state = now.agg(F.count("*"), F.sum(F.hash("v", "m").cast("long")), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("m").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("v").alias("node"), F.col("m").alias("component")).unionAll(roots)
