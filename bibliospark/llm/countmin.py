"""Count-min sketches that answer one question: may this key have been counted twice or more?

Two rows of counters that stop at two. Tasks send their counters as packed gaps by row and counter range; the
ranges are summed apart from each other, and the bitmap of counters of two or more, of a size set beforehand
(2 * 2^bits bits), is what a broadcast holds. An answer of no is always right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import discard, distinct, packed_gaps, stored, unpacked_gaps

ROWS, RANGE_BITS = 2, 20
#: Keys that a task gathers before it counts them as members.
MEMBERS = 1 << 18
SCHEMA = "cell int, salt int, once binary, twice binary"
_ARROW = pa.schema([("cell", pa.int32()), ("salt", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def bits_for(keys: int, most: int) -> int:
    """Counters (as a power of two) for about so many keys: two to four each, at most 2^most."""
    return min(most, max(16, (2 * keys).bit_length()))


def places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return [keys & mask, (keys >> np.uint64(32)) & mask]


def counted(once: np.ndarray, twice: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows for distinct keys counted once and, of them, those counted twice."""
    low = min(bits, RANGE_BITS)
    out: dict[str, list] = {"cell": [], "salt": [], "once": [], "twice": []}
    edges = np.arange((1 << (bits - low)) + 1, dtype=np.int64) << low
    for row, (one, two) in enumerate(zip(places(once, bits), places(twice, bits))):
        every = np.sort(one.astype(np.uint32))
        again = distinct(np.concatenate([every[1:][every[1:] == every[:-1]], two.astype(np.uint32)]))
        every = distinct(every)
        a, b = np.searchsorted(every, edges), np.searchsorted(again, edges)
        for r in np.flatnonzero(np.diff(a)):
            out["cell"].append(row << 20 | int(r))
            out["salt"].append(int(once[0] % np.uint64(1 << 16)))
            out["once"].append(packed_gaps(every[a[r] : a[r + 1]] - np.uint32(edges[r])))
            out["twice"].append(packed_gaps(again[b[r] : b[r + 1]] - np.uint32(edges[r])))
    return pa.RecordBatch.from_pydict(out, _ARROW)


def _summed(sketches: DataFrame, low: int, salts: int) -> DataFrame:
    """Each task holds one byte a counter of the cells that it is dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for cell, salt, once, twice in zip(*(batch.column(c).to_pylist() for c in ("cell", "salt", "once", "twice"))):
                if (cell, salt) not in sums:
                    sums[cell, salt] = np.zeros(1 << low, np.uint8)
                held = sums[cell, salt]
                for blob in (once, twice):
                    at = unpacked_gaps(blob)
                    held[at] = np.minimum(held[at] + 1, 2)
        for (cell, _), held in sums.items():
            yield pa.RecordBatch.from_pydict({"cell": [cell], "salt": [0], "once": [packed_gaps(np.flatnonzero(held))], "twice": [packed_gaps(np.flatnonzero(held > 1))]}, _ARROW)

    return sketches.withColumn("salt", F.col("salt") % salts).repartition("cell", "salt").mapInArrow(run, SCHEMA)


class Repeated:
    """Broadcast bitmaps of the counters of two or more."""

    def __init__(self, spark: SparkSession, sketches: DataFrame, bits: int, many: bool = False):
        """many: sum in two steps, so that no task reads the sketches of all others."""
        low = min(bits, RANGE_BITS)
        merged = stored(_summed(_summed(sketches, low, 16) if many else sketches, low, 1).select("cell", "twice"), "sketch")
        maps = [np.zeros(1 << bits >> 3, np.uint8) for _ in range(ROWS)]
        for cell, twice in merged.toLocalIterator():  # at most ROWS * 2^(bits - low) rows; stored, as each partition is a job here and most are empty
            held = np.zeros(1 << low, np.uint8)
            held[unpacked_gaps(bytes(twice))] = 1
            begin = (cell & (1 << 20) - 1) << low >> 3
            maps[cell >> 20][begin : begin + (1 << low >> 3)] = np.packbits(held, bitorder="little")
        discard(merged)
        self.bits, self.shared = bits, spark.sparkContext.broadcast([m.tobytes() for m in maps])

    def of(self, keys: np.ndarray) -> np.ndarray:
        """For each key whether it may have been counted twice."""
        out = np.ones(len(keys), bool)
        for raw, at in zip(self.shared.value, places(keys, self.bits)):
            bitmap = np.frombuffer(raw, np.uint8)
            out &= (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def members(wanted: DataFrame) -> Repeated:
    """A bitmap in which every text_key of the table is found; of a size set by their number, 2 * 2^26 bits at most."""
    bits = bits_for(4 * wanted.count(), 26)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:  # a sketch has a row for each range of counters, so it is made of many keys
            held.append(distinct(batch.column("text_key").to_numpy().view(np.uint64)))
            if sum(map(len, held)) >= MEMBERS:
                held = [distinct(np.concatenate(held))]
                if len(held[0]) >= MEMBERS // 2:
                    yield counted(held[0], held[0], bits)
                    held = []
        keys = distinct(np.concatenate(held)) if held else np.empty(0, np.uint64)
        if len(keys):
            yield counted(keys, keys, bits)

    return Repeated(wanted.sparkSession, wanted.select("text_key").mapInArrow(count, SCHEMA), bits, False)
