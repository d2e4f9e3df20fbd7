"""Hard negatives by dual-tree search: for each anchor the best rows of its label, then the closest rows of other labels
whose score lies in a band below each of them.

Equal vectors of one label are one entry that keeps only the smallest identifiers, which is all that a result can hold.
Entries are cut into cells around pivots, large cells into blocks of bounded size. An anchor is sent to a cell only if
the interval of inner products that the cell's ball allows meets the scores it still wants: for its own label it is first
sent to its home block alone, whose scores bound what other cells must reach. A task builds ball trees over the anchors
and over the entries that it is dealt and walks both at once: a pair of nodes whose interval of inner products misses
what every anchor below wants is dropped for the whole group of anchors, and pairs of leaves are scored exactly, by one
product of matrices. Entries are copied once for every SENT anchors that are really sent to their cell, and not at all
where none is. Vectors without clusters are all about as far from each other: then nothing can be pruned above the
leaves and work grows with anchors times rows.

Defined cases: rows with a null identifier, label, vector or component take no part; vectors of unlike length have no
inner product; rows that repeat identifier, label and vector count once, those that repeat the identifier alone are rows
of their own; rows with the anchor's identifier are left out; equal scores go to the smaller identifier; an anchor without another row of its label has no negatives; scores are exact
below 2^53; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

#: Numbers in the vectors of a block; anchors of a task, as a multiple of the block; vectors of a cell; the most pivots.
NUMBERS, SENT, CELL, PIVOTS = 1 << 19, 4, 1024, 4096
#: Vectors of a leaf; hits of a task that are kept before they are ranked.
LEAF, HITS = 128, 1 << 20


class BallTree:
    """Nested balls over the rows of x: places begin..end of ``rows`` are a node's, its children split them in two."""

    def __init__(self, x: np.ndarray):
        self.rows = np.arange(len(x))
        self.begin, self.end, self.left, self.right, centers, radii = [], [], [], [], [], []
        stack = [(0, len(x), -1, self.left)]
        while stack:
            begin, end, parent, side = stack.pop()
            own = x[self.rows[begin:end]]
            center = own.mean(0)
            apart = ((own - center) ** 2).sum(1)
            node = len(self.begin)
            self.begin.append(begin)
            self.end.append(end)
            self.left.append(-1)
            self.right.append(-1)
            if parent >= 0:
                side[parent] = node
            centers.append(center)
            radii.append(np.sqrt(apart.max()) * (1 + 1e-9))
            if end - begin > LEAF and apart.max() > 0:
                a = own[apart.argmax()]
                b = own[((own - a) ** 2).sum(1).argmax()]
                order = np.argpartition(own @ (b - a), (end - begin) // 2)
                self.rows[begin:end] = self.rows[begin:end][order]
                middle = begin + (end - begin) // 2
                stack += [(middle, end, node, self.right), (begin, middle, node, self.left)]
        self.centers, self.radii = np.array(centers), np.array(radii)
        self.x = x[self.rows]


class Search:
    """The k best entries of each query, within its window of scores, over pairs of trees."""

    def __init__(self, k: int, lows: np.ndarray, highs: np.ndarray, own: np.ndarray, ids: list[list[int]]):
        self.k, self.highs, self.own = k, highs, own
        self.sizes = np.array([len(i) for i in ids], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.ids = np.array([i for some in ids for i in some], np.int64)
        mine = self.ids[np.isin(self.ids, own)]  # entries that may hold nothing but the query's own identifier
        self.spare = int(np.unique(mine, return_counts=True)[1].max()) if len(mine) else 0
        self.need = lows.copy()
        self.top = np.full((len(lows), k + self.spare), -np.inf)
        self.hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held, self.pairs = 0, 0
        self.best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

    def _rank(self) -> None:
        """Keep of all hits the k best identifiers of each query: by score, then by identifier."""
        q, e, s = (np.concatenate(x) for x in zip(*self.hits)) if self.hits else self.best
        if self.hits:
            some = s >= self.need[q]
            q, e, s = q[some], e[some], s[some]
            n = self.sizes[e]
            ids = self.ids[np.repeat(self.begins[e] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            q, s = np.repeat(q, n), np.repeat(s, n)
            q, ids, s = (np.concatenate(x) for x in zip(self.best, (q, ids, s)))
            other = ids != self.own[q]
            q, ids, s = q[other], ids[other], s[other]
            order = np.lexsort((ids, -s, q))
            q, ids, s = q[order], ids[order], s[order]
            first = np.searchsorted(q, q, "left")
            kept = np.arange(len(q)) - first < self.k
            self.best = q[kept], ids[kept], s[kept]
            self.hits, self.held = [], 0

    def _leaves(self, q: np.ndarray, xq: np.ndarray, e: np.ndarray, xe: np.ndarray, allowed: np.ndarray | None) -> None:
        scores = xq @ xe.T
        ok = (scores >= self.need[q, None]) & (scores <= self.highs[q, None])
        if allowed is not None:
            ok &= allowed
        i, j = np.nonzero(ok)
        if not len(i):
            return
        self.hits.append((q[i], e[j], scores[i, j]))
        self.held += len(i)
        some = np.flatnonzero(ok.any(1))
        both = np.concatenate([self.top[q[some]], np.where(ok[some], scores[some], -np.inf)], 1)
        wanted = self.top.shape[1]
        self.top[q[some]] = best = np.partition(both, both.shape[1] - wanted, 1)[:, -wanted:]
        self.need[q[some]] = np.maximum(self.need[q[some]], best.min(1))
        if self.held > HITS:
            self._rank()

    def walk(self, queries: np.ndarray, xq: np.ndarray, entries: np.ndarray, xe: np.ndarray, apart: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """queries, entries: numbers of the rows of xq, xe; apart: labels, if only pairs of unlike ones count."""
        s, t = BallTree(xq), BallTree(xe)
        queries, entries = queries[s.rows], entries[t.rows]
        inner = s.centers @ t.centers.T
        spread = np.outer(np.sqrt((s.centers**2).sum(1)), t.radii) + np.outer(s.radii, np.sqrt((t.centers**2).sum(1)) + t.radii)
        spread += 1e-6 + 1e-9 * (np.abs(inner) + spread)
        upper, lower = inner + spread, inner - spread
        highs = [self.highs[queries[b:e]].max() for b, e in zip(s.begin, s.end)]
        stack = [(0, 0)]
        while stack:
            a, b = stack.pop()
            q = queries[s.begin[a] : s.end[a]]
            if upper[a, b] < self.need[q].min() or lower[a, b] > highs[a]:
                continue
            if s.left[a] < 0 and t.left[b] < 0:
                self.pairs += 1
                e = entries[t.begin[b] : t.end[b]]
                allowed = apart[0][q][:, None] != apart[1][e][None, :] if apart else None
                for at in range(0, len(e), 4 * LEAF):  # a leaf of equal vectors may be larger
                    for begin in range(0, len(q), 4 * LEAF):
                        part = slice(begin, begin + 4 * LEAF), slice(at, at + 4 * LEAF)
                        x, y = s.x[s.begin[a] : s.end[a]][part[0]], t.x[t.begin[b] : t.end[b]][part[1]]
                        self._leaves(q[part[0]], x, e[part[1]], y, None if allowed is None else allowed[part])
                continue
            if t.left[b] < 0 or s.left[a] >= 0 and s.radii[a] > t.radii[b]:
                below = [(s.left[a], b), (s.right[a], b)]
            else:
                below = [(a, t.left[b]), (a, t.right[b])]
            stack += sorted(below, key=lambda p: upper[p])  # the most promising is taken first

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._rank()
        return self.best


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(flat).astype(np.float64).reshape(-1, dim) if dim else np.zeros((len(column), 0))


def _nearest(pivots: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest pivot and how far it is."""
    cell = ((pivots**2).sum(1)[None, :] - 2 * (x @ pivots.T)).argmin(1)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(1)) * (1 + 1e-9)


class _Cells:
    """Entries (c, label, v, ids) in cells, as a stored table, and what the driver knows of each cell."""

    def __init__(self, entries: DataFrame, block: int | None, cell: int | None):
        spark = entries.sparkSession
        dims = entries.groupBy("dim").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("c").alias("h"), "v")).alias("first"))
        known = {r.dim: (r.n, r.v) for r in dims.select("dim", "n", "first.v").collect()}  # one row a length of vectors
        total, most = sum(n for n, _ in known.values()), max(known, default=1)
        self.block = block or max(LEAF, NUMBERS // max(1, most))
        share = (1 << 30) // max(cell or CELL, total // PIVOTS, 1)
        pivots = {d: [v] for d, (_, v) in known.items()}
        for r in entries.where(F.pmod(F.xxhash64("c"), F.lit(1 << 30)) < share).select("dim", "v").toLocalIterator():  # about PIVOTS at most
            pivots[r.dim].append(r.v)
        self.pivots = spark.sparkContext.broadcast({d: np.unique(np.array(p, np.float64).reshape(len(p), d), axis=0) for d, p in pivots.items()})
        shared = self.pivots

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                cell, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    cell[at], far[at] = _nearest(shared.value[d], _matrix(batch.column("v").take(pa.array(at)), d))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

        kind = dict(entries.dtypes)
        self.schema = ", ".join(f"{c} {kind[c]}" for c in entries.columns) + ", cell int, far double"
        self.placed = stored(entries.mapInArrow(place, self.schema), "placed")
        stats = self.placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect()  # one row a pivot
        held = {d: (np.zeros(len(p)), np.zeros(len(p), np.int64)) for d, p in self.pivots.value.items()}
        for r in stats:
            held[r.dim][0][r.cell], held[r.dim][1][r.cell] = r.r, -(-r.n // self.block)
        self.stats = spark.sparkContext.broadcast(held)  # radius and number of blocks of each cell


def _search(cells: _Cells, asked: DataFrame, k: int, same: bool, home: bool | None) -> DataFrame:
    """(q, vec_id, score): the k best of each query in every block that it is sent to.

    asked: (q, own, label, v, dim, lo, hi). home: to one block of the home cell only, to all others only, or to all.
    """
    spark = asked.sparkSession
    pivots, stats, sent = cells.pivots, cells.stats, SENT * cells.block
    schema = ", ".join(f"{c} {kind}" for c, kind in asked.dtypes) + ", cell int, block int"

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, lo, hi, q = (batch.column(c).to_numpy() for c in ("dim", "lo", "hi", "q"))
            for d in np.unique(dims):
                if d not in pivots.value:
                    continue
                p, (radii, blocks) = pivots.value[d], stats.value[d]
                for at in np.array_split(np.flatnonzero(dims == d), -(-len(dims) // 64)):
                    x = _matrix(batch.column("v").take(pa.array(at)), d)
                    own = _nearest(p, x)[0]
                    pick = (q[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64) % np.maximum(blocks[own], 1)
                    if home:
                        i, cell, block = np.arange(len(at)), own, pick
                        i, cell, block = (z[blocks[own] > 0] for z in (i, cell, block))
                    else:
                        inner, spread = x @ p.T, np.outer(np.sqrt((x**2).sum(1)), radii)
                        spread += 1e-6 + 1e-9 * (np.abs(inner) + spread)
                        i, cell = np.nonzero((inner + spread >= lo[at, None]) & (inner - spread <= hi[at, None]) & (blocks > 0))
                        n = blocks[cell]
                        i, cell = np.repeat(i, n), np.repeat(cell, n)
                        block = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                        if home is not None:
                            new = (cell != own[i]) | (block != pick[i])
                            i, cell, block = i[new], cell[new], block[new]
                    taken = batch.take(pa.array(at[i]))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell, pa.int32()), pa.array(block, pa.int32())], names=[*batch.schema.names, "cell", "block"])

    routed = asked.mapInArrow(route, schema)
    counted = routed.groupBy("dim", "cell", "block").agg(F.count("*").alias("n"))
    turns = stored(counted.select("dim", "cell", "block", F.ceil(F.col("n") / sent).alias("turns")), "turns")  # one row a block
    blocks = [(d, i, int(n)) for d, (_, all_) in stats.value.items() for i, n in enumerate(all_) if n]
    blocks = spark.createDataFrame(blocks, "dim int, cell int, blocks long")
    own = cells.placed.join(F.broadcast(blocks), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    own = own.join(turns, ["dim", "cell", "block"]).select("dim", "cell", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), "label", "v", "ids")
    asks = routed.join(turns, ["dim", "cell", "block"]).withColumn("turn", F.pmod(F.xxhash64("q"), F.col("turns"))).drop("turns")

    def search(entries: pa.Table, queries: pa.Table) -> pa.Table:
        out = [np.empty(0, np.int64)] * 3
        if len(entries) and len(queries):
            d = entries["dim"][0].as_py()
            xe, xq = _matrix(entries["v"], d), _matrix(queries["v"], d)
            codes: dict = {}
            le, lq = (np.array([codes.setdefault(x, len(codes)) for x in t["label"].to_pylist()]) for t in (entries, queries))
            found = Search(k, queries["lo"].to_numpy().copy(), queries["hi"].to_numpy(), queries["own"].to_numpy(), entries["ids"].to_pylist())
            if same:
                for label in np.intersect1d(le, lq):
                    e, q = np.flatnonzero(le == label), np.flatnonzero(lq == label)
                    found.walk(q, xq[q], e, xe[e])
            else:
                found.walk(np.arange(len(xq)), xq, np.arange(len(xe)), xe, (lq, le))
            at, ids, scores = found.result()
            out = [queries["q"].to_numpy()[at], ids, scores.astype(np.int64)]
        return pa.table(dict(zip(("q", "vec_id", "score"), out)))

    by = ("dim", "cell", "block", "turn")
    return own.groupBy(*by).cogroup(asks.groupBy(*by)).applyInArrow(search, "q long, vec_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int | None = None, cell: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, v array<long>).

    For each anchor and each of its first ``positives`` other rows of its label, the first ``negatives`` rows of other
    labels with low % to high % of the positive's score. block, cell: entries of a task and of a cell.
    """
    keep = max(positives, negatives) + 1
    held = rows.where("vec_id is not null and label is not null and v is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "label", "v", F.size("v").alias("dim"), is_anchor.alias("asks"))
    held = stored(held, "vectors")
    least = F.dense_rank().over(Window.partitionBy("label", "v", F.pmod("vec_id", F.lit(64))).orderBy("vec_id"))
    few = held.select("label", "v", "dim", "vec_id", least.alias("n")).where(F.col("n") <= keep)
    entries = few.groupBy("label", "v", "dim").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, keep).alias("ids"))
    cells = _Cells(stored(entries.withColumn("c", F.monotonically_increasing_id()), "entries"), block, cell)

    infinite = F.lit(float("inf"))
    anchors = held.where("asks").select(F.col("vec_id").alias("own"), "label", "v", "dim").distinct()
    anchors = stored(anchors.withColumn("q", F.monotonically_increasing_id()).withColumns({"lo": -infinite, "hi": infinite}), "anchors")
    near = stored(_search(cells, anchors, positives, True, True), "near")
    reached = near.groupBy("q").agg(F.when(F.count("*") >= positives, F.min("score").cast("double")).otherwise(-infinite).alias("lo"))
    others = stored(anchors.drop("lo").join(reached, "q", "left").fillna(float("-inf"), "lo").select(*anchors.columns), "anchors")
    best = _first(near.unionAll(_search(cells, others, positives, True, False)), positives)
    best = stored(best.select("q", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    bands = best.where("positive_score >= 0").select("q", "positive_score").distinct()
    bands = bands.withColumns({"lo": F.expr(f"(positive_score * {low} + 99) div 100").cast("double"), "hi": F.expr(f"positive_score * {high} div 100").cast("double")}).where("lo <= hi")
    wanted = anchors.drop("lo", "hi").join(bands, "q").withColumn("band", F.monotonically_increasing_id())
    wanted = stored(wanted.select(F.col("q").alias("anchor"), "positive_score", F.col("band").alias("q"), "own", "label", "v", "dim", "lo", "hi"), "bands")
    found = _first(_search(cells, wanted.select(*anchors.columns), negatives, False, None), negatives)
    found = found.join(wanted.select("q", F.col("anchor"), F.col("own").alias("anchor_id"), "positive_score"), "q")
    pairs = best.withColumnRenamed("q", "anchor").join(found, ["anchor", "positive_score"])
    return pairs.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
bands AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS r
  FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM bands WHERE r <= 3
"""
