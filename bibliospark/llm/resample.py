"""Importance resampling towards a target distribution, over inverted postings partitioned by bucket.

A feature is a run of one to three words; its bucket is the CRC-32 of its bytes modulo the number of buckets. Tasks turn
bundles of documents into inverted postings - for each range of buckets, the (bucket, document, count) triples of the
bundle, sorted and packed - and sum the buckets' totals of all that they read. Postings are dealt by (range of buckets,
salt), so that a bucket which every document has is spread as well; the totals of both corpora for a range are
co-grouped with each of its shares, its buckets' gains are computed there, and what leaves a share is one sum a document.
A last sum by document gives its weight. Documents are drawn by weight plus Gumbel noise, that is, with chances in
proportion to their importance: scores are sorted by range, and ranks follow from the sizes of the sorted parts.

Defined cases: a null text has no words; a document without features weighs 0; a null identifier's noise is that of an
empty one, and it comes last among equal scores; rows that repeat count as documents of their own; an empty target or
table gives its buckets no counts; texts of any length are read whole, in pieces; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import bytes_of, give_back, packed_gaps, small_batches, stored, unpacked_gaps

BUCKETS, LONGEST = 10_000, 3
#: Documents and bytes of text of a bundle; bytes that are cut into words at once; ranges of buckets; bytes of a share.
ROWS, BYTES, PIECE, RANGES, SHARE = 128, 1 << 21, 1 << 20, 20, 8 << 20

_POLYNOMIAL = 0xEDB88320
#: Lengths up to this have a table each; longer ones go by powers of two.
_LONG = 64
#: Bytes of words after lower-casing A-Z; 0 elsewhere.
_WORD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)


def _zero_byte(x: np.ndarray) -> np.ndarray:
    """The checksum's register after one more byte of zeros: a linear map over bits."""
    return _BYTE[x & np.uint32(255)] ^ (x >> np.uint32(8))


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & np.uint32(1), (c >> np.uint32(1)) ^ np.uint32(_POLYNOMIAL), c >> np.uint32(1))
    return c


_BYTE = _byte_table()


def _moved(tables: np.ndarray, base: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The maps whose four byte tables begin at base, applied to the checksums c."""
    out = tables[base + (c & np.uint32(255))]
    for k in range(1, 4):
        out ^= tables[base + (256 * k) + ((c >> np.uint32(8 * k)) & np.uint32(255))]
    return out


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Byte tables of the maps for 0.._LONG zero bytes, and for 1, 2, 4, ... of them."""
    one = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    short = [one.ravel()]
    for _ in range(_LONG):
        short.append(_zero_byte(short[-1]))
    powers = [short[1]]
    for _ in range(31):
        powers.append(_moved(powers[-1], np.zeros(1024, np.int64), powers[-1]))
    return np.concatenate(short), np.concatenate(powers)


_SHORT, _POWERS = _tables()
_SPACE = np.uint32(zlib.crc32(b" "))


def shifted(c: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums as a part of those of longer texts: moved by the number of bytes that follow."""
    out = _moved(_SHORT, np.minimum(lengths, _LONG) * 1024, c)
    for i in np.flatnonzero(lengths > _LONG):
        x, n, bit = c[i : i + 1], int(lengths[i]), 0
        while n >> bit:
            if n >> bit & 1:
                x = _moved(_POWERS, np.array([1024 * bit]), x)
            bit += 1
        out[i] = x[0]
    return out


def word_checksums(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, all words a byte at a time, the longest first so that those still open stand in front."""
    order = np.argsort(-np.minimum(lengths, _LONG + 1), kind="stable")
    begin, n = starts[order], lengths[order]
    c = np.full(len(order), 0xFFFFFFFF, np.uint32)
    long = int(np.count_nonzero(n > _LONG))
    open_ = len(n)
    for j in range(int(n[long]) if long < len(n) else 0):
        open_ = long + int(np.searchsorted(-n[long:open_], -j, "left"))
        part = c[long:open_]
        c[long:open_] = _BYTE[(part ^ raw[begin[long:open_] + j]) & np.uint32(255)] ^ (part >> np.uint32(8))
    c ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        c[i] = zlib.crc32(raw[begin[i] : begin[i] + n[i]].tobytes())
    out = np.empty_like(c)
    out[order] = c
    return out


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, list[bytes], bool]]:
    """(number of the first text, texts, whether they go on with the last piece's text): PIECE bytes or one long word."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        if held and size + len(text) > PIECE:
            yield first, held, False
            held, size = [], 0
        if len(text) <= PIECE:
            first = first if held else i
            held.append(text)
            size += len(text) + 1
            continue
        at, more = 0, False
        while at < len(text):
            to = min(len(text), at + PIECE)
            while to < len(text) and _WORD[text[to]]:
                to += 1
            yield i, [text[at:to]], more
            at, more = to, True
    if held:
        yield first, held, False


def features(texts: list[bytes], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the text, bucket) of all features, in parts, with the number of the text of each word."""
    tail: tuple[np.ndarray, ...] | None = None
    for first, part, more in _pieces(texts):
        raw = _WORD[np.frombuffer(b"\0" + b"\0".join(part) + b"\0", np.uint8)]
        edges = np.flatnonzero((raw[1:] != 0) != (raw[:-1] != 0)) + 1
        starts, lengths = edges[0::2], edges[1::2] - edges[0::2]
        c = word_checksums(raw, starts, lengths)
        begins = np.cumsum([1, *(len(t) + 1 for t in part[:-1])])
        doc = first + np.searchsorted(begins, starts, "right") - 1
        after = shifted(np.full(len(c), _SPACE), lengths) ^ c  # of the word with a space before it
        own = doc
        if more and tail is not None:
            c, after, lengths, doc = (np.concatenate([a, b]) for a, b in zip(tail, (c, after, lengths, doc)))
        skip = len(doc) - len(own)
        found, at = [c[skip:]], [own]
        run = c
        for n in range(1, LONGEST):
            run = shifted(run[:-1], lengths[n:] + 1) ^ after[n:]  # run[i]: the words i .. i + n
            whole = np.flatnonzero(doc[n:] == doc[:-n])
            whole = whole[whole + n >= skip]
            found.append(run[whole])
            at.append(doc[n:][whole])
        tail = (c[1 - LONGEST :], after[1 - LONGEST :], lengths[1 - LONGEST :], doc[1 - LONGEST :])
        yield np.concatenate(at), (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), own


_SCHEMA = "part int, bundle long, target boolean, ids array<long>, n_words array<long>, n_features array<long>, counts array<long>, postings binary"
_ARROW = pa.schema([("part", pa.int32()), ("bundle", pa.int64()), ("target", pa.bool_()), ("ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("n_features", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("postings", pa.binary())])


def _packed(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Places as gaps and counts in a byte each, or eight where one needs them."""
    width = "<u1" if counts.max(initial=0) < 256 else "<u8"
    blob = packed_gaps(places)
    raw = len(blob).to_bytes(4, "little") + width.encode()[1:] + blob + counts.astype(width).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    end = 6 + int.from_bytes(raw[:4], "little")
    return unpacked_gaps(raw[6:end]), np.frombuffer(raw[end:], "<" + raw[4:6].decode()).astype(np.int64)


def _edges(buckets: int, ranges: int) -> np.ndarray:
    return np.linspace(0, buckets, ranges + 1).astype(np.int64)


def postings(rows: DataFrame, buckets: int = BUCKETS, ranges: int = RANGES) -> DataFrame:
    """Of (doc_id, text, target): a row a bundle with its documents (part -1), rows of postings a bundle and range of
    buckets, and rows of totals a task and range. The target needs totals only."""
    edges = _edges(buckets, ranges)

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bundle = TaskContext.get().partitionId() << 33
        totals: dict[bool, np.ndarray] = {}
        held: list[tuple[int | None, bytes]] = []

        def flush(target: bool) -> Iterator[pa.RecordBatch]:
            nonlocal bundle
            n, out = len(held), {c: [] for c in _ARROW.names}
            counts, words = np.zeros(buckets * n, np.int64), np.zeros(n, np.int64)
            for doc, bucket, own in features([t for _, t in held], buckets):
                counts += np.bincount(bucket * n + doc, minlength=buckets * n)
                words += np.bincount(own, minlength=n)
            table = counts.reshape(buckets, n)
            totals[target] = totals.get(target, 0) + table.sum(1)
            if not target:
                some = np.flatnonzero(counts)
                cuts = np.searchsorted(some, edges * n)
                put = lambda **x: [out[c].append(x.get(c)) for c in out]
                put(part=-1, bundle=bundle, target=False, ids=[i for i, _ in held], n_words=words.tolist(), n_features=table.sum(0).tolist())
                for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if a < b:
                        put(part=part, bundle=bundle, target=False, ids=[n], postings=_packed(some[a:b] - edges[part] * n, counts[some[a:b]]))
                yield pa.RecordBatch.from_pydict(out, _ARROW)
                bundle += 1
            held.clear()
            give_back()

        target, size = False, 0
        for batch in batches:
            for doc, text, target in zip(batch.column("doc_id").to_pylist(), bytes_of(batch.column("text")), batch.column("target").to_pylist()):
                held.append((doc, text))
                size += len(text)
                if len(held) == ROWS or size >= BYTES:
                    yield from flush(target)
                    size = 0
        if held:
            yield from flush(target)
        for target, sums in totals.items():
            pieces = [sums[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_pydict({c: {"part": list(range(ranges)), "target": [target] * ranges, "counts": pieces}.get(c, [None] * ranges) for c in _ARROW.names}, _ARROW)

    return rows.mapInArrow(invert, _SCHEMA)


def gains(s: np.ndarray, t: np.ndarray, all_s: int, all_t: int, buckets: int) -> np.ndarray:
    """floor(1000 ln) of how much likelier a bucket is in the target, each corpus with one count more a bucket."""
    return np.floor(1000 * np.log((t + 1.0) * (all_s + buckets) / ((s + 1.0) * (all_t + buckets))))


def weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, ranges: int = RANGES) -> DataFrame:
    """(bundle, pos, doc_id, n_words, n_features, weight) of every row of docs (doc_id, text); target: (text)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(False).alias("target"))
    rows = rows.unionAll(target.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(True).alias("target")))
    held = stored(postings(rows, buckets, ranges), "postings")

    each = held.where("counts is not null").select("part", "target", F.posexplode("counts").alias("i", "n")).groupBy("part", "target", "i").agg(F.sum("n").alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "n"))), lambda x: x["n"])
    totals = stored(each.groupBy("part", "target").agg(listed.alias("counts"), F.sum("n").alias("size")), "totals")  # 2 * ranges rows
    size = dict(totals.groupBy("target").agg(F.sum("size")).collect())
    all_s, all_t = size.get(False, 0), size.get(True, 0)
    edges = _edges(buckets, ranges)

    shares = held.where("postings is not null")
    salts = max(2, -(-(shares.agg(F.sum(F.octet_length("postings"))).first()[0] or 0) // (ranges * SHARE)))
    shares = shares.select("part", F.pmod(F.xxhash64("bundle"), F.lit(salts)).alias("salt"), "bundle", F.col("ids")[0].alias("n"), "postings")
    beside = totals.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), "target", "counts")

    def contribute(own: pa.Table, both: pa.Table) -> pa.Table:
        sums: dict[str, list] = {"bundle": [], "weights": []}
        if len(own):
            part = own["part"][0].as_py()
            none = np.zeros(edges[part + 1] - edges[part])
            counts = dict(zip(both["target"].to_pylist(), both["counts"].to_pylist()))
            gain = gains(np.array(counts.get(False, none), float), np.array(counts.get(True, none), float), all_s, all_t, buckets)
            for bundle, n, blob in zip(own["bundle"].to_pylist(), own["n"].to_pylist(), own["postings"]):
                places, count = _unpacked(blob.as_py())
                sums["bundle"].append(bundle)
                sums["weights"].append(np.bincount(places % n, gain[places // n] * count, n).astype(np.int64))
        return pa.table(sums, pa.schema([("bundle", pa.int64()), ("weights", pa.list_(pa.int64()))]))

    by = ("part", "salt")
    sums = shares.groupBy(*by).cogroup(beside.groupBy(*by)).applyInArrow(contribute, "bundle long, weights array<long>")
    own = held.where("part = -1").select("bundle", F.posexplode(F.arrays_zip("ids", "n_words", "n_features")).alias("pos", "d"))
    own = own.select("bundle", "pos", "d.ids", "d.n_words", "d.n_features", F.lit(0).cast("long").alias("w"))
    none = F.lit(None).cast("long")
    each = own.unionAll(sums.select("bundle", F.posexplode("weights").alias("pos", "w")).select("bundle", "pos", none, none, none, "w"))
    agg = each.groupBy("bundle", "pos").agg(F.max("ids").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("n_features").alias("n_features"), F.sum("w").alias("weight"))
    return agg


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 g) of a standard Gumbel number g that the identifier's hash gives."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, most: int, *order: Column) -> DataFrame:
    """rows with their rank, 1, 2, ... in this order up to most, else null: sorted by range, no single task."""
    placed = stored(rows.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "sorted")
    sizes = placed.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("n")).collect()  # one row a partition
    before, offsets = 0, []
    for part, n in sorted(map(tuple, sizes)):
        offsets.append((part, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(offsets, "part long, before long")
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    joined = placed.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(offsets), "part")
    return joined.select(*rows.columns, F.when(rank <= most, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) of every row of docs: percent of the documents with least_words
    words or more are drawn without replacement, rank in order of score; the others' rank is null."""
    scored = weights(docs, target, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = stored(scored.withColumn("may", F.col("n_words") >= least_words), "scored")
    most = percent * scored.where("may").count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("bundle"), F.col("pos")]
    drawn = ranked(scored.where("may"), most, *order).unionAll(scored.where("not may").withColumn("rank", F.lit(None).cast("long")))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs whose identifier is drawn."""
    ids = resample(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("drawn_id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["drawn_id"]), "left_semi")


SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, false AS target, text FROM documents UNION ALL SELECT -row_number() OVER (), NULL, true, text FROM benchmark),
words AS (SELECT r, doc_id, target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT r, target, array_to_string(w[i : i + n - 1], ' ') AS f FROM words, unnest([1, 2, 3]) AS a(n), unnest(generate_series(1, len(w) - n + 1)) AS b(i)),
features AS (SELECT r, target, f, count(*) AS n FROM runs GROUP BY ALL),
named AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM features)),
buckets AS (SELECT f, xor(list_reduce(range(0, len(x) // 2), lambda c, i: list_reduce(range(0, 8), lambda a, j: xor(a // 2, 3988292384 * (a % 2)), xor(c, CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), 4294967295), 4294967295) % 10000 AS b FROM named),
placed AS (SELECT r, target, b, sum(n) AS n FROM features JOIN buckets USING (f) GROUP BY ALL),
counts AS (SELECT b, coalesce(sum(n) FILTER (NOT target), 0) AS s, coalesce(sum(n) FILTER (target), 0) AS t FROM placed GROUP BY b),
totals AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM counts),
gains AS (SELECT b, CAST(floor(1000 * ln(CAST((t + 1) * (all_s + 10000) AS DOUBLE) / CAST((s + 1) * (all_t + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM counts, totals),
weights AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM placed JOIN gains USING (b) WHERE NOT target GROUP BY r),
scored AS (SELECT w.r, w.doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(w.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM words w LEFT JOIN weights x ON w.r = x.r WHERE NOT w.target),
drawn AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20
  QUALIFY rank <= 5 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, rank FROM scored LEFT JOIN drawn USING (r)
"""
