"""Substring dedup with a count-min prefilter.

Pass 1: each task sketches how many documents hold each window of words (two rows of saturating counters); the
sketches are merged by counter range, and only the bitmap of counters of two or more is kept. The sketch never
underestimates, so a window in two documents is always estimated repeated. Pass 2: only windows estimated repeated
are sent to be grouped exactly, by 80 hash bits made of 64-bit word hashes; of the documents of one bundle that share a window, only the one
with the smallest identifier sends it, since the others are repeats already - so a window that a third of all
documents hold costs one entry a bundle. Last, each document drops the words that its repeated windows cover.

The bitmaps are the only data broadcast: at most 2 * 2^most_bits bits, whatever the input. Beyond about 2^most_bits
windows the prefilter lets more windows through; the result stays exact.

Defined cases: null text has no words; a null identifier neither removes nor is removed from; rows with the same
identifier never remove each other's words; texts shorter than a window stay whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import countmin
from .common import bundles, bytes_of, joined_blobs, mixed, packed_gaps, plain_blobs, small_batches, stored, unpacked_gaps, window_hashes, word_hashes


class Windows:
    """All windows of a bundle of documents, in ascending order of identifier, and their order by hash."""

    def __init__(self, table: pa.Table, n: int, second: bool):
        table = table.filter(table["doc_id"].is_valid()).sort_by([("doc_id", "ascending")])
        self.ids = table["doc_id"].to_numpy()
        self.keys = table["text_key"].to_numpy()
        words, counts = word_hashes(bytes_of(table["text"]))
        doc = np.repeat(np.arange(len(counts)), counts)
        inside = np.flatnonzero(doc[: max(0, len(doc) - n + 1)] == doc[n - 1 :])
        self.doc = doc[inside]
        self.at = inside  # where each window begins in all words of the bundle
        self.starts = (np.cumsum(counts) - counts).astype(np.int64)
        self.pos = inside - self.starts[self.doc]
        self.h1 = window_hashes(words, n)[inside]
        self.h2 = window_hashes(words, n, 1)[inside].astype(np.uint16) if second else None
        self.order = np.argsort(self.h1, kind="stable")
        h = self.h1[self.order]
        self.begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)

    def first_ids(self) -> np.ndarray:
        """For each window the smallest identifier of the bundle that holds it."""
        owner = self.ids[self.doc]
        out = np.empty(len(owner), np.int64)
        if len(owner):
            out[self.order] = np.repeat(owner[self.order][self.begins], np.diff(np.append(self.begins, len(owner))))
        return out


def _sketches(rows: DataFrame, n: int, bits: int, bundle_bytes: int) -> DataFrame:
    """The windows of each bundle, counted once or, if two of its documents hold them, twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in bundles(batches, "text", bundle_bytes):
            w = Windows(table, n, False)
            if len(w.h1):
                last = w.order[np.append(w.begins[1:], len(w.h1)) - 1]
                distinct = w.h1[w.order[w.begins]]
                several = w.ids[w.doc[w.order[w.begins]]] != w.ids[w.doc[last]]
                yield countmin.counted(distinct, distinct[several], bits)

    return rows.mapInArrow(run, countmin.SCHEMA)


def repeated_windows(rows: DataFrame, n: int, most_bits: int, bundle_bytes: int) -> DataFrame:
    """(doc_id, text_key, windows): packed starts of the windows that a smaller identifier holds too; several rows a document."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = countmin.bits_for(size // 6, most_bits)
    repeated = countmin.Repeated(spark, _sketches(rows, n, bits, bundle_bytes), bits, many=size > 512 * bundle_bytes)
    shards = max(211, size >> 23)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in bundles(batches, "text", bundle_bytes):
            w = Windows(table, n, True)
            owner = w.ids[w.doc]
            again = owner > w.first_ids()
            open_ = ~again & repeated.of(w.h1)
            out: dict[str, list] = {c: [] for c in ("shard", "h1", "h2", "doc", "pos", "ids", "keys", "windows")}

            def put(shard, h1=None, h2=None, doc=None, pos=None, ids=None, keys=None, windows=None):
                for c, v in zip(out, (shard, h1, h2, doc, pos, ids, keys, windows)):
                    out[c].append(v)

            if again.any():  # known here: goes with the others, past the grouping, to a shard of the bundle's own
                put(int(mixed(w.ids[:1].view(np.uint64) ^ w.keys[-1:].view(np.uint64))[0] % np.uint64(shards)), *_known(w.doc[again], w.pos[again], w.ids, w.keys)[1:])
            pick = np.flatnonzero(open_)
            shard = ((w.h1[pick] >> np.uint64(16)) % np.uint64(shards)).astype(np.int64)
            pick = pick[np.argsort(shard, kind="stable")]
            shard = np.sort(shard)
            for part in np.split(np.arange(len(pick)), np.flatnonzero(np.diff(shard)) + 1) if len(pick) else []:
                at = pick[part]
                new = np.concatenate([[True], w.doc[at][1:] != w.doc[at][:-1]])  # windows are in order of document
                docs = w.doc[at][new]
                put(int(shard[part[0]]), w.h1[at].tobytes(), w.h2[at].tobytes(), packed_gaps(w.starts[docs]), packed_gaps(w.at[at]), w.ids[docs].tobytes(), w.keys[docs].tobytes())
            yield pa.RecordBatch.from_pydict(out, pa.schema([("shard", pa.int64()), *((c, pa.binary()) for c in list(out)[1:])]))

    schema = "shard long, h1 binary, h2 binary, doc binary, pos binary, ids binary, keys binary, windows binary"

    def group(key: tuple, table: pa.Table) -> pa.Table:
        """The windows of one hash range, exactly grouped; about 2^23 bytes of text a range."""
        known = table.filter(table["windows"].is_valid()).select(["ids", "keys", "windows"])
        table = table.filter(table["h1"].is_valid())
        if not len(table):
            return known
        parts = {c: [np.frombuffer(b, t) for b in table[c].to_pylist()] for c, t in (("h1", "<u8"), ("h2", "<u2"), ("ids", "<i8"), ("keys", "<i8"))}
        starts, places = ([unpacked_gaps(b) for b in table[c].to_pylist()] for c in ("doc", "pos"))
        parts["doc"] = [np.searchsorted(s, p, "right") - 1 for s, p in zip(starts, places)]
        parts["pos"] = [p - s[d] for s, p, d in zip(starts, places, parts["doc"])]
        shift = np.concatenate([[0], np.cumsum([len(i) for i in parts["ids"]])[:-1]]).astype(np.int64)
        doc = np.concatenate([d.astype(np.int64) + s for d, s in zip(parts["doc"], shift)])
        h1, h2, pos, ids, keys = (np.concatenate(parts[c]) for c in ("h1", "h2", "pos", "ids", "keys"))
        order = np.lexsort((h2, h1))
        a, b, owner = h1[order], h2[order], ids[doc[order]]
        begins = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        least = np.repeat(np.minimum.reduceat(owner, begins), np.diff(np.append(begins, len(a))))
        again = order[owner > least]
        _, _, _, _, _, kept_ids, kept_keys, windows = _known(doc[again], pos[again].astype(np.int64), ids, keys)
        return pa.concat_tables([known, pa.table({"ids": [kept_ids], "keys": [kept_keys], "windows": [windows]}, known.schema)])

    return rows.mapInArrow(send, schema).groupBy("shard").applyInArrow(group, "ids binary, keys binary, windows binary")


def _known(doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> tuple:
    """One row for many documents: their identifiers and keys, and (size, starts) of each, as packed gaps where they are many."""
    order = np.lexsort((pos, doc))
    begins = np.flatnonzero(np.concatenate([[True], np.diff(doc[order]) != 0])) if len(order) else order
    docs = doc[order][begins]
    ends = np.append(begins[1:], len(order))
    if len(order) < 32 * len(begins):
        blobs = plain_blobs(pos[order], begins, ends)
    else:
        blobs = [packed_gaps(pos[order[i:j]]) for i, j in zip(begins, ends)]
    lengths = np.array([len(b) for b in blobs], "<u4").tobytes()
    return None, None, None, None, None, ids[docs].tobytes(), keys[docs].tobytes(), lengths + b"".join(blobs)


def _by_document(found: DataFrame) -> DataFrame:
    """(doc_id, text_key, windows), several rows a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, keys, windows in zip(*(batch.column(c).to_pylist() for c in ("ids", "keys", "windows"))):
                n = len(ids) // 8
                if n:
                    ends = np.cumsum(np.frombuffer(windows, "<u4", n).astype(np.int64)) + 4 * n
                    blobs = [windows[i:j] for i, j in zip(np.append(4 * n, ends[:-1]), ends)]
                    yield pa.RecordBatch.from_pydict({"doc_id": np.frombuffer(ids, "<i8"), "text_key": np.frombuffer(keys, "<i8"), "windows": blobs})

    return found.mapInArrow(run, "doc_id long, text_key long, windows binary")


def remove_repeats(docs: DataFrame, n: int = 13, most_bits: int = 28, bundle_bytes: int = 3 << 20) -> DataFrame:
    """(doc_id, n_words, n_removed, text): every document without the words that repeated windows cover."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": batch.column("doc_id"), "n_words": [], "n_removed": [], "text": []}
            found = batch.column("windows").to_pylist() if "windows" in batch.schema.names else [None] * batch.num_rows
            for text, windows in zip(bytes_of(batch.column("text")), found):
                words = kept = text.split()
                if windows:
                    covered = np.zeros(len(words) + 1, np.int64)
                    for at in joined_blobs(windows):
                        covered[at] += 1
                        covered[at + n] -= 1
                    keep = np.cumsum(covered[:-1]) == 0
                    kept = [w for w, k in zip(words, keep.tolist()) if k]
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["text"].append(b" ".join(kept).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())]))

    found = _by_document(repeated_windows(rows, n, most_bits, bundle_bytes)).groupBy("doc_id", "text_key").agg(F.collect_list("windows").alias("windows"))
    found = stored(found, "repeats")  # a row a document
    held = countmin.members(found)

    def marked(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(held.of(batch.column("text_key").to_numpy().view(np.uint64)) == wanted))

        return run

    schema = "doc_id long, n_words long, n_removed long, text string"
    whole = rows.mapInArrow(lambda batches: cut(marked(False)(batches)), schema)
    r = rows.mapInArrow(marked(True), rows.schema).alias("r")
    f = found.alias("f")
    joined = r.join(f, (F.col("r.doc_id") == F.col("f.doc_id")) & (F.col("r.text_key") == F.col("f.text_key")), "left").select("r.doc_id", "r.text", "f.windows")
    return whole.unionAll(joined.mapInArrow(cut, schema))


SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, s AS pos, array_to_string(w[s : s + 12], ' ') AS seq FROM words, unnest(generate_series(1, len(w) - 12)) AS u(s) WHERE len(w) >= 13),
again AS (SELECT doc_id, pos FROM (SELECT *, min(doc_id) OVER (PARTITION BY seq) AS least FROM windows) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, pos + i AS at FROM again, unnest(generate_series(0, 12)) AS u(i)),
flat AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS at FROM words),
kept AS (SELECT f.doc_id, string_agg(f.word, ' ' ORDER BY f.at) AS text, count(*) AS n FROM flat f ANTI JOIN gone g ON f.doc_id = g.doc_id AND f.at = g.at GROUP BY f.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)
"""
