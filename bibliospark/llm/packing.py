"""Hierarchical multi-length packing.

A document's ids are cut into whole windows of the longest tier; what is left is routed to the shortest tier that
holds it. The longest tier is packed first and its gaps are filled from the shorter tiers, largest fit first and
cut where nothing fits; then the next tier, and so on. Tiers are powers of two, so full windows need no padding.
What is too little for a window is carried to the task's next bundle; the task's last rest is cut at powers of two.
Every bundle's sequences are dealt to step groups in snake order of their length, so steps have like token counts.

Work is local to a task: no shuffle, and nothing grows beyond one bundle. Defined cases: null text is empty and
gives one piece with the end id; repeated identifiers are packed as documents of their own; an empty table gives none.
"""

from __future__ import annotations

import bisect
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bundles, small_batches
from .tokens import encoder

TIERS = (256, 512, 1024)
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long, tier long, step long"


class Packer:
    """Places pieces (document, start, length) into sequences; documents are any values."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        if any(t & (t - 1) for t in tiers):
            raise ValueError("tiers must be powers of two")
        self.tiers = sorted(tiers)
        self.pools: list[list[tuple[int, int, object]]] = [[] for _ in tiers]  # (length, start, document), by length
        self.ready: list[tuple[int, list[tuple[object, int, int]]]] = []

    def add(self, doc, length: int) -> None:
        top, start = self.tiers[-1], 0
        while length - start >= top:
            self.ready.append((top, [(doc, start, top)]))
            start += top
        if length > start:
            self._pool(doc, start, length - start)

    def _pool(self, doc, start: int, length: int) -> None:
        bisect.insort(self.pools[bisect.bisect_left(self.tiers, length)], (length, start, doc), key=lambda p: p[0])

    def _fill(self, pieces: list, gap: int, tier: int) -> int:
        """Fill a window's gap from the tiers up to this one; returns what stays empty."""
        while gap:
            best = None
            for t in range(tier + 1):
                if (at := bisect.bisect_right(self.pools[t], gap, key=lambda p: p[0])) and (best is None or self.pools[t][at - 1][0] > best[1]):
                    best = (t, self.pools[t][at - 1][0], at - 1)
            if best:
                length, start, doc = self.pools[best[0]].pop(best[2])
                pieces.append((doc, start, length))
                gap -= length
                continue
            t = next((t for t in range(tier + 1) if self.pools[t]), None)  # nothing fits: cut the smallest
            if t is None:
                return gap
            length, start, doc = self.pools[t].pop(0)
            pieces.append((doc, start, gap))
            self._pool(doc, start + gap, length - gap)
            gap = 0
        return 0

    def pack(self) -> list[tuple[int, list[tuple[object, int, int]]]]:
        """Full sequences of what was added; the rest stays for later."""
        for tier in range(len(self.tiers) - 1, -1, -1):
            size, left = self.tiers[tier], sum(p[0] for pool in self.pools[: tier + 1] for p in pool)
            while self.pools[tier] and left >= size:
                length, start, doc = self.pools[tier].pop()
                pieces = [(doc, start, length)]
                self._fill(pieces, size - length, tier)
                left -= size
                self.ready.append((size, pieces))
        done, self.ready = self.ready, []
        return done

    def rest(self) -> list[tuple[int, list[tuple[object, int, int]]]]:
        """Sequences for all that stayed, cut at powers of two."""
        pieces = deque((doc, start, length) for pool in reversed(self.pools) for length, start, doc in reversed(pool))
        self.pools = [[] for _ in self.tiers]
        left, out = sum(p[2] for p in pieces), []
        while left:
            size = min(self.tiers[-1], 1 << (left.bit_length() - 1))
            sequence, room = [], size
            while room:
                doc, start, length = pieces.popleft()
                take = min(room, length)
                sequence.append((doc, start, take))
                room -= take
                if take < length:
                    pieces.appendleft((doc, start + take, length - take))
            out.append((size, sequence))
            left -= size
        return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, tiers: tuple[int, ...] = TIERS, step_sequences: int = 64, bundle_bytes: int = 8 << 20, remembered: int | None = None) -> DataFrame:
    """Pieces of all documents with their ids (little-endian unsigned 32-bit); columns as in ``SCHEMA``.

    remembered: texts of which a worker keeps the ids; fewer take less memory and more time.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        code, packer = encoder(tokenizer, remembered), Packer(tiers)
        end = np.array([end_id], code.type).tobytes()
        held: dict[int, tuple] = {}  # document's number in the task -> (doc_id, ids)
        number = sequence = step = 0

        def rows(found: list) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, step
            groups = -(-len(found) // step_sequences)
            by_length = sorted(range(len(found)), key=lambda i: -found[i][0])
            group_of = {i: (k % groups if k // groups % 2 == 0 else groups - 1 - k % groups) for k, i in enumerate(by_length)}
            out: list[tuple] = []
            for i, (size, pieces) in enumerate(found):
                offset = 0
                for doc, start, length in pieces:
                    doc_id, ids = held[doc]
                    cut = np.frombuffer(ids, code.type, length, start * code.width).astype("<u4").tobytes()
                    out.append((doc_id, start, length, cut, len(ids) // code.width, part << 32 | sequence, offset, size, size, part << 32 | step + group_of[i]))
                    offset += length
                sequence += 1
            step += groups
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            for i in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, zip(*out[i : i + 20_000]))], names=names)

        for table in bundles(batches, "text", bundle_bytes):
            for doc_id, ids in zip(table["doc_id"].to_pylist(), code.packed([t or "" for t in table["text"].to_pylist()])):
                held[number] = (doc_id, ids + end)
                packer.add(number, len(ids) // code.width + 1)
                number += 1
            yield from rows(packer.pack())
            stay = {p[2] for pool in packer.pools for p in pool}
            held = {k: v for k, v in held.items() if k in stay}
        if held:
            yield from rows(packer.rest())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
