"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

1. A sketch of shingle counts (a fixed number of bins) orders every document's shingles rare first. Any order is
   right; this one keeps common shingles out of the prefixes.
2. A document's prefix holds a shingle of every document that it may link to. Documents with the same set form one
   class from here on. Prefix shingles that no other prefix holds are dropped by a count-min bitmap.
3. Leaders: in every bucket of classes that share a prefix shingle, each class is compared with one of them, then, in
   buckets whose classes are still of different components, with a few more in each
   round while rounds link enough (small buckets have few pairs and wait for step 4). A round is linear in the bucket,
   and rounds join groups of near copies without making their pairs.
4. What is left, classes of different components that share a prefix shingle, is compared pair by pair. A pair is made
   at the first of a run of shared prefix shingles only: where both have the same one before, it was made there.
A pair that passes the length and positional filters, and the suffix filter on parity bits (of which two sets cannot
differ in more places than in elements), is verified once, on whole texts; components follow from the links. Leaders
with many followers are dealt to several tasks, each with the leader's text. Shingles are told apart by 64-bit hashes.

Defined cases: null and empty texts have no set and link with nothing; a text with fewer words than n has one
shingle, all its words; repeated identifiers are documents of their own; a null identifier takes part but never
names a component (it is null where all of it are); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from . import countmin
from .common import bundles, bytes_of, components, discard, distinct, fresh, packed_gaps, small_batches, stored, unpacked_gaps, window_hashes, word_hashes

#: Bins of the shingle counts; leaders of a bucket in a round after the first; one pair in so many must link for another round.
COUNT_BITS, LEADERS, WORTH = 20, 16, 60
FOLLOWERS = 500


def shingle_hashes(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Hashes of the n-word shingles of each text, A-Z lower-cased; of all its words where they are fewer."""
    words, counts = word_hashes(texts, lower=True)
    every = window_hashes(words, n)
    out, begin = [], 0
    for count in counts.tolist():
        if count >= n:
            out.append(every[begin : begin + count - n + 1])
        elif count:
            out.append(window_hashes(words[begin : begin + count], count, n - count))
        else:
            out.append(np.empty(0, np.uint64))
        begin += count
    return out


def _bin_counts(rows: DataFrame, n: int, many: bool) -> np.ndarray:
    """Counts of shingles by hash bin, over all documents; 2^COUNT_BITS numbers whatever the input."""
    width = 1 << 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << COUNT_BITS, np.int64)
        for table in bundles(batches, "text", 2 << 20):
            h = np.concatenate(shingle_hashes(bytes_of(table["text"]), n))
            sums += np.bincount((h >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=1 << COUNT_BITS)
        yield from rows_of(sums, int(xxhash.xxh3_64_intdigest(sums.tobytes()) % 16))

    def rows_of(sums: np.ndarray, salt: int) -> Iterator[pa.RecordBatch]:
        for part in range(0, len(sums), width):
            at = np.flatnonzero(sums[part : part + width])
            if len(at):
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "salt": pa.array([salt], pa.int32()), "bins": [packed_gaps(at)], "counts": [sums[part : part + width][at].astype("<u4" if sums.max() < 1 << 32 else "<u8").tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for part, bins, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "bins", "counts"))):
                at = unpacked_gaps(bins)
                sums[at + part] += np.frombuffer(counts, "<u4" if len(counts) == 4 * len(at) else "<u8").astype(np.int64)
        yield from rows_of(sums, 0)

    schema = "part int, salt int, bins binary, counts binary"
    sketch = rows.select("text").mapInArrow(count, schema)
    if many:
        sketch = sketch.repartition("part", "salt").mapInArrow(add, schema)
    out = np.zeros(1 << COUNT_BITS, np.int64)
    total = stored(sketch.repartition("part").mapInArrow(add, schema), "counts")  # most partitions are empty, and each is a job below
    for part, _, bins, counts in total.toLocalIterator():
        at = unpacked_gaps(bytes(bins))
        out[at + part] += np.frombuffer(bytes(counts), "<u4" if len(counts) == 4 * len(at) else "<u8").astype(np.int64)
    discard(total)
    return out


def _need(a: Column, b: Column, num: int, den: int) -> Column:
    """Least overlap of two sets of these sizes whose Jaccard similarity is num / den at least."""
    return F.ceil((a + b) * num / F.lit(num + den) - F.lit(1e-9))


def _parity(s: np.ndarray) -> np.ndarray:
    """Parity bits of a set of hashes, two to four an element, as 64-bit words; halves fold into a set of half the bits."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length() if len(s) else 64)
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _apart(a: Column, b: Column) -> Column:
    """Places in which two parities differ, at most the number of elements that only one set holds."""
    fold = lambda x, n: F.when(F.size(x) > n, F.zip_with(F.slice(x, 1, n), F.slice(x, n + 1, n), lambda u, v: u.bitwiseXOR(v))).otherwise(x)
    least = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(fold(a, least), fold(b, least), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, x: s + x)


class Join:
    """One run over a table of documents; ``num / den`` is the least similarity."""

    def __init__(self, docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, most_bits: int = 27):
        self.spark, self.n, self.num, self.den = docs.sparkSession, n, num, den
        small_batches(self.spark)
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        self.rows = rows.withColumn("text_key", F.xxhash64("text"))
        total = self.rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.many = total > 512 * (24 << 20)
        self.sets = self._sets()
        self.index = self._index(countmin.bits_for(total * (den - num) // den // 6, most_bits))

    def _sets(self) -> DataFrame:
        """(row, doc_id, text_key, n_shingles, k1, k2, prefix, parity): k1 and k2 are 128 bits of the set's hash."""
        n, num, den = self.n, self.num, self.den
        shared = self.spark.sparkContext.broadcast(np.minimum(_bin_counts(self.rows, n, self.many), (1 << 32) - 1).astype(np.uint32))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part, number, counts = TaskContext.get().partitionId(), 0, shared.value
            for batch in bundles(batches, "text", 2 << 20):
                out: dict[str, list] = {c: [] for c in ("n_shingles", "k1", "k2", "prefix", "parity")}
                for s in map(distinct, shingle_hashes(bytes_of(batch["text"]), n)):
                    key = xxhash.xxh3_128_intdigest(s.tobytes())
                    order = np.lexsort((s, counts[(s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]))
                    keep = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
                    for c, v in (("n_shingles", len(s)), ("k1", (key >> 64) - (1 << 63)), ("k2", (key & (1 << 64) - 1) - (1 << 63)), ("prefix", s[order[:keep]].tobytes()), ("parity", _parity(s))):
                        out[c].append(v)
                first = part << 33 | number
                number += batch.num_rows
                batch = batch.combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(first, first + batch.num_rows), pa.int64()), batch["doc_id"].combine_chunks(), batch["text_key"].combine_chunks(), pa.array(out["n_shingles"], pa.int64()), pa.array(out["k1"], pa.int64()), pa.array(out["k2"], pa.int64()), pa.array(out["prefix"], pa.binary()), pa.array(out["parity"], pa.list_(pa.int64()))],
                    names=["row", "doc_id", "text_key", "n_shingles", "k1", "k2", "prefix", "parity"])

        return stored(self.rows.mapInArrow(run, "row long, doc_id long, text_key long, n_shingles long, k1 long, k2 long, prefix binary, parity array<long>"), "sets")

    def _index(self, bits: int) -> DataFrame:
        """(token, c, size, pos, prev): prefix shingles that several prefixes may hold, each with the one before it.

        c is a class, the row of one of its documents.
        """

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in bundles(batches, "prefix", 4 << 20):
                tokens = np.sort(np.frombuffer(b"".join(table["prefix"].to_pylist()), np.uint64))
                if len(tokens):
                    yield countmin.counted(distinct(tokens), distinct(tokens[1:][tokens[1:] == tokens[:-1]]), bits)

        repeated = countmin.Repeated(self.spark, self.sets.select("prefix").mapInArrow(count, countmin.SCHEMA), bits, self.many)

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tokens, positions, before = [], [], []
                for blob in batch.column("prefix").to_pylist():
                    t = np.frombuffer(blob, np.uint64)
                    at = np.flatnonzero(repeated.of(t))
                    tokens.append(t[at].astype(np.int64))
                    positions.append(at.astype(np.int32))
                    before.append(np.concatenate([tokens[-1][:1], tokens[-1][:-1]]))  # the first has itself
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("n_shingles"), pa.array(tokens, pa.list_(pa.int64())), pa.array(positions, pa.list_(pa.int32())), pa.array(before, pa.list_(pa.int64()))],
                    names=["c", "size", "tokens", "positions", "before"])

        own = self.sets.where("n_shingles > 0")
        self.classes = stored(own.groupBy("k1", "k2").agg(F.min("row").alias("c")), "classes")
        picked = own.select("row", "n_shingles", "prefix").mapInArrow(pick, "c long, size long, tokens array<long>, positions array<int>, before array<long>").where(F.size("tokens") > 0)
        picked = picked.join(self.classes.select("c"), "c", "left_semi")
        spread = picked.select("c", "size", F.explode(F.arrays_zip("tokens", "positions", "before")).alias("t"))
        return stored(spread.select(F.col("t.tokens").alias("token"), "c", "size", F.col("t.positions").alias("pos"), F.col("t.before").alias("prev")), "index")

    def _may_link(self, a: str, b: str) -> Column:
        """Length and positional filter on a shared prefix shingle."""
        na, nb, pa_, pb = (F.col(f"{x}.{y}") for y in ("size", "pos") for x in (a, b))
        left = F.least(na - pa_, nb - pb)
        return (na * self.den >= nb * self.num) & (nb * self.den >= na * self.num) & (left >= _need(na, nb, self.num, self.den))

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that link: suffix filter, then whole texts, read for the pairs that are left."""
        sets = self.sets.select(F.col("row"), F.col("n_shingles").alias("size"), "parity")
        near = pairs.join(sets.select(F.col("row").alias("a"), F.col("size").alias("size_a"), F.col("parity").alias("parity_a")), "a")
        near = near.join(sets.select(F.col("row").alias("b"), F.col("size").alias("size_b"), F.col("parity").alias("parity_b")), "b")
        most = F.col("size_a") + F.col("size_b") - 2 * _need(F.col("size_a"), F.col("size_b"), self.num, self.den)
        near = stored(near.where(_apart(F.col("parity_a"), F.col("parity_b")) <= most).select("a", "b"), "pairs")
        texts = self._texts(near.select(F.explode(F.array("a", "b")).alias("row")).distinct())
        salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("followers") / FOLLOWERS))
        salted = near.join(near.groupBy("a").agg(F.count("*").alias("followers")), "a").select("a", "b", salt.alias("salt"))
        text = texts.select(F.col("row"), F.col("text"))
        leaders = salted.select("a", "salt").distinct().join(text.withColumnRenamed("row", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
        followers = salted.join(text.withColumnRenamed("row", "b"), "b").select("a", "salt", "b", "text")
        n, num, den = self.n, self.num, self.den

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            leader = held = None
            for batch in bundles(batches, "text", 2 << 20):
                out: dict[str, list] = {"a": [], "b": []}
                for a, b, s in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), map(distinct, shingle_hashes(bytes_of(batch["text"]), n))):
                    if b is None:
                        leader, held = a, s
                        continue
                    assert a == leader
                    joined = np.sort(np.concatenate([s, held]))
                    both = int((joined[1:] == joined[:-1]).sum())
                    if den * both >= num * (len(s) + len(held) - both):
                        out["a"].append(a)
                        out["b"].append(b)
                yield pa.RecordBatch.from_pydict(out, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

        dealt = leaders.unionAll(followers).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        return stored(dealt.select("a", "b", "text").mapInArrow(verify, "a long, b long"), "links")

    def _texts(self, rows: DataFrame) -> DataFrame:
        """(row, text) of these rows. A bitmap of their text keys keeps other texts out of the shuffle."""
        wanted = stored(self.sets.select("row", "doc_id", "text_key").join(rows, "row", "left_semi"), "wanted")
        asked = countmin.members(wanted)

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(asked.of(batch.column("text_key").to_numpy().view(np.uint64))))

        r = self.rows.mapInArrow(pick, "doc_id long, text string, text_key long").dropDuplicates(["doc_id", "text_key"]).alias("r")
        w = wanted.alias("w")
        return stored(r.join(w, F.col("r.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("r.text_key") == F.col("w.text_key"))).select("w.row", "r.text"), "texts")

    def _candidates(self, found: DataFrame, tested: DataFrame | None = None) -> DataFrame:
        pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return stored(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "candidates")

    def _followers(self, index: DataFrame, leaders: DataFrame) -> DataFrame:
        """Pairs (a, b) of a bucket's leader and each other class that may link to it; leaders: (token, l)."""
        i = index.alias("i")
        met = i.join(leaders.select("token", "l.*").alias("l"), "token").where((F.col("i.c") != F.col("l.c")) & self._may_link("i", "l"))
        met = met.where(F.col("i.component") != F.col("l.component")) if "component" in index.columns else met
        return met.select(F.col("l.c").alias("a"), F.col("i.c").alias("b"))

    def _left(self, index: DataFrame, part: DataFrame) -> DataFrame:
        """The index with components, without rows that have no class of another component near enough in size in their
        bucket. In order of size such a class is the one before or after the run of classes of the row's own component."""
        index, columns = index.join(part, "c", "left").withColumn("component", F.coalesce("component", "c")), [*index.columns, "component"]
        for near, order in (("below", ["size", "c"]), ("above", [F.desc("size"), F.desc("c")])):
            w = Window.partitionBy("token").orderBy(*order)
            edge = F.when(F.lag("component").over(w) != F.col("component"), F.lag("size").over(w))
            index = index.withColumn("edge", edge).withColumn(near, F.last("edge", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        close = (F.col("below") * self.den >= F.col("size") * self.num) | (F.col("size") * self.den >= F.col("above") * self.num)
        return stored(index.where(close).select(*columns), "apart")

    def _classed(self) -> DataFrame:
        """(k1, k2, component) of every class: links to leaders in rounds, then links between what those leave apart."""
        first = self.index.groupBy("token").agg(F.min(F.struct("c", "size", "pos")).alias("l"), F.count("*").alias("n")).where("n > 1")
        first = stored(first, "leaders")
        tested = self._candidates(self._followers(self.index, first))
        links = self._verified(tested)
        part = components(links)
        several = self.index.join(first.where("n > 2").select("token", "n"), "token")  # a bucket of two is tested
        columns = several.columns
        left = self._left(several, part.withColumnRenamed("node", "c"))
        if not left.isEmpty():
            turn, grown = 0, True
            while grown:
                turn += 1
                order = Window.partitionBy("token").orderBy(F.xxhash64("c", F.lit(turn)), "c")
                led = left.where(F.col("n") > 4 * LEADERS).withColumn("place", F.row_number().over(order)).where(F.col("place") <= LEADERS)
                led = stored(led.select("token", F.struct("c", "component", "size", "pos").alias("l")), "leaders")
                found = self._candidates(self._followers(left, led), tested)
                if found.isEmpty():
                    break
                tested = tested.unionAll(found)
                more = self._verified(found)
                linked = more.count()
                grown = linked >= LEADERS and linked * WORTH > found.count()  # else the pairs that are left cost less than further rounds
                if linked:
                    links = links.unionAll(more)
                if grown:
                    part = components(links)
                    left, last = self._left(left.select(*columns), part.withColumnRenamed("node", "c")), left
                    discard(last)
            x, y = left.alias("x"), left.alias("y")
            on = (F.col("x.token") == F.col("y.token")) & (F.col("x.c") < F.col("y.c")) & (F.col("x.component") != F.col("y.component"))
            fresh = (F.col("x.prev") != F.col("y.prev")) | (F.col("x.prev") == F.col("x.token")) | (F.col("y.prev") == F.col("y.token"))
            rest = self._candidates(x.join(y, on & fresh & self._may_link("x", "y")).select(F.col("x.c").alias("a"), F.col("y.c").alias("b")), tested)
            part = components(links.unionAll(self._verified(rest)))
        return self.classes.join(part.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))

    def components(self) -> DataFrame:
        """(doc_id, text_key, n_shingles, component_id, kept, row) of every row."""
        classes = self._classed().select("k1", "k2", "component")
        placed = stored(self.sets.select("row", "doc_id", "text_key", "n_shingles", "k1", "k2").join(classes, ["k1", "k2"], "left").select("row", "doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).alias("component")), "placed")
        least = placed.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
        least = stored(least, "least")  # apart from the join, so that a large component's rows can be split
        out = placed.join(least, "component", "left")
        kept = F.col("component").isNull() | (F.col("first.row") == F.col("row"))
        return out.select("doc_id", "text_key", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), kept.alias("kept"), "row")


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of all documents; one document of each component is kept, the smallest identifier."""
    return Join(docs, n, num, den).components().select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents with all their columns, one of each component. Rows alike in identifier and text count as copies."""
    found = Join(docs, n, num, den).components()
    gone = found.where("not kept").groupBy("doc_id", "text_key").agg(F.count("*").alias("gone"))
    kept = found.where("kept").select("doc_id", "text_key").distinct().withColumn("stays", F.lit(True))
    some = gone.join(kept.alias("k"), gone.doc_id.eqNullSafe(F.col("k.doc_id")) & (gone.text_key == F.col("k.text_key")), "left").select(gone.doc_id, gone.text_key, "gone", "stays")
    some = stored(some, "gone")
    bitmap = countmin.members(some)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bitmap.of(batch.column(key_).to_numpy().view(np.uint64)))], names=[*batch.schema.names, maybe_])

    key_, maybe_, gone_, stays_ = fresh(docs, "_key", "_maybe", "_gone", "_stays")
    keyed = docs.withColumn(key_, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    marked = keyed.mapInArrow(mark, T.StructType([*keyed.schema.fields, T.StructField(maybe_, T.BooleanType())]))
    # only rows whose text may be a copy's are joined; the others' texts are not shuffled
    d, g = marked.where(F.col(maybe_)).alias("d"), some.alias("g")
    on = F.col("d.doc_id").cast("long").eqNullSafe(F.col("g.doc_id")) & (F.col(f"d.{key_}") == F.col("g.text_key"))
    joined = d.join(g, on, "left").select("d.*", F.col("g.gone").isNotNull().alias(gone_), F.coalesce(F.col("g.stays"), F.lit(False)).alias(stays_))
    once = joined.where(F.col(gone_) & F.col(stays_)).dropDuplicates(["doc_id", key_])
    out = marked.where(~F.col(maybe_)).select(*docs.columns).unionByName(joined.where(~F.col(gone_)).select(*docs.columns))
    return out.unionByName(once.select(*docs.columns))


SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i : i + 2], ' ') for i in generate_series(1, len(w) - 2)]) END AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  WHERE 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
ends AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM sets UNION SELECT r.node, e.b FROM reach r JOIN ends e ON r.seen = e.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.seen) AS component_id FROM sets s JOIN reach r ON s.doc_id = r.node GROUP BY s.doc_id, len(s.s)
"""
