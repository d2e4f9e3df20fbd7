"""Embedding near-dedup by dual traversal of cover trees.

Vectors of one label and equal components form one class. Large labels are cut into cells around pivots, a vector
being sent to another cell only when the cell's covering radius lets it have a partner there; cells are cut into
blocks of bounded size (cells beyond it, where pivots are few, into several). A task builds cover trees (nested levels, halving radii, actual covering radii) of its block
and of the vectors sent to it, walks both at once, prunes pairs of nodes whose balls are farther apart than the
threshold allows, and verifies what is left by cosine in double precision. All pairs of children of two nodes are tested
by one product of matrices. Vectors without clusters are all about as far from each other, so that nothing can be pruned
above the single vectors: then pairs within a label are all tested, in that cheap form. A task returns sums and a spanning forest of
its links, never the pairs of a group of copies.

Defined cases: rows without a label, identifier or usable vector (null, zero, null or non-finite components) link
with nothing; vectors of unlike length do not link; a null identifier's component is null and it is kept; repeated
identifiers are vectors of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import components, stored

#: Radii of the levels, on the unit sphere; below the last, vectors are compared directly.
RADII = tuple(2.0 / (1 << i) for i in range(6))
#: Numbers in the vectors of a block; vectors sent to a block in one task, as a multiple of the block; the most pivots in all.
NUMBERS, SENT, PIVOTS = 1 << 19, 3, 4096
_CHUNK, _DENSE = 100_000, 256


class CoverTree:
    """Levels of nodes: centers (row of x), covering radii and where the nodes' children on the next level begin.

    The last level's children are the vectors, ``rows`` of x in order. ``points`` holds the centers of each level, and
    the vectors, one after the other, so that all pairs of children of two nodes are one product of matrices.
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        self.radii: list[np.ndarray] = []
        self.begins: list[np.ndarray] = []
        self.points: list[np.ndarray] = []
        members, centers = [np.arange(len(x))], [0]
        for level in range(len(RADII)):
            self.points.append(x[centers])
            self.radii.append(np.array([self._far(c, m).max() if len(m) > 1 else 0.0 for c, m in zip(centers, members)]))
            if level == len(RADII) - 1:
                break
            below_centers, below_members, begins = [], [], [0]
            for c, m in zip(centers, members):
                for center, own in self._net(c, m, RADII[level + 1]) if len(m) > 1 else [(c, m)]:
                    below_centers.append(center)
                    below_members.append(own)
                begins.append(len(below_centers))
            self.begins.append(np.array(begins))
            centers, members = below_centers, below_members
        self.begins.append(np.concatenate([[0], np.cumsum([len(m) for m in members])]))
        self.rows = np.concatenate(members)
        self.points.append(x[self.rows])

    def _far(self, center: int, members: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.x[members] - self.x[center]) ** 2).sum(1))

    def _net(self, center: int, members: np.ndarray, r: float) -> list[tuple[int, np.ndarray]]:
        """Centers more than r apart, the node's own first, with the members within r of each."""
        found, rest, candidates = [], members, np.array([center])
        while len(rest):
            picked: list[int] = []
            apart = 2.0 - 2.0 * (self.x[candidates] @ self.x[candidates].T)
            open_ = np.ones(len(candidates), bool)
            for i in range(len(candidates)):
                if open_[i]:
                    picked.append(int(candidates[i]))
                    open_ &= apart[i] > r * r
            d = 2.0 - 2.0 * (self.x[picked] @ self.x[rest].T)
            near = d.argmin(0)
            within = d[near, np.arange(len(rest))] <= r * r + 1e-12
            within |= np.isin(rest, picked)
            for i, p in enumerate(picked):
                found.append((p, rest[within & (near == i)]))
            rest = rest[~within]
            candidates = rest[:128]
        return [(c, m) for c, m in found if len(m)]


def _children(begins: np.ndarray, a: np.ndarray, b_begins: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of children of the node pairs, in chunks."""
    na, nb = begins[a + 1] - begins[a], b_begins[b + 1] - b_begins[b]
    total = na * nb
    ends = np.cumsum(total)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CHUNK, "right")))
        count = total[at:to]
        pair = np.repeat(np.arange(at, to), count)
        offset = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
        for i in range(0, len(pair), _CHUNK):
            p, o = pair[i : i + _CHUNK], offset[i : i + _CHUNK]
            yield begins[a[p]] + o // nb[p], b_begins[b[p]] + o % nb[p]
        at = to


def dual(s: CoverTree, t: CoverTree, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (of s, of t) whose cosine may reach the threshold; for s is t each pair once."""
    reach = np.sqrt(2.0 - 2.0 * cosine) + 1e-7
    none = np.zeros(1)

    def near(level: int, i, j, product: np.ndarray) -> np.ndarray:
        """Of children with these places and inner products, those whose balls are near enough."""
        r = reach + (s.radii[level + 1][i] + t.radii[level + 1][j] if level + 1 < len(RADII) else none)
        return 2.0 - 2.0 * product <= r * r

    stack = [(0, np.array([0]), np.array([0]))]
    while stack:
        level, a, b = stack.pop()
        p, q = s.points[level + 1], t.points[level + 1]
        dense = (s.begins[level][a + 1] - s.begins[level][a]) * (t.begins[level][b + 1] - t.begins[level][b]) >= _DENSE
        found = []
        for u, v in zip(a[dense].tolist(), b[dense].tolist()):  # nodes with many children: one product of matrices
            end, last = s.begins[level][u + 1], t.begins[level][v + 1]
            step = max(1, _CHUNK * 10 // int(last - t.begins[level][v]))
            for begin in range(s.begins[level][u], end, step):
                i, j = np.arange(begin, min(end, begin + step)), np.arange(t.begins[level][v], last)
                x, y = np.nonzero(near(level, i[:, None], j[None, :], p[i[0] : i[-1] + 1] @ q[j[0] : j[-1] + 1].T))
                found.append((i[x], j[y]))
        for i, j in _children(s.begins[level], a[~dense], t.begins[level], b[~dense]):
            some = near(level, i, j, np.einsum("ij,ij->i", p[i], q[j]))
            found.append((i[some], j[some]))
        for i, j in found:
            if s is t:  # by place: a node paired with itself yields both orders; of two nodes the first comes first
                once = i <= j if level + 1 < len(RADII) else i < j
                i, j = i[once], j[once]
            if level + 1 < len(RADII):
                stack += [(level + 1, i[k : k + _CHUNK], j[k : k + _CHUNK]) for k in range(0, len(i), _CHUNK)]
            else:
                yield s.rows[i], t.rows[j]


class _Sums:
    """Weights of linked rows and a spanning forest, from links in chunks."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.links, self.root = weights, np.zeros(len(weights), np.int64), np.arange(len(weights))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.links, i, self.weights[j])
        np.add.at(self.links, j, self.weights[i])
        while len(i):
            a, b = self.root[i], self.root[j]
            i, j, a, b = i[a != b], j[a != b], a[a != b], b[a != b]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, block: int | None = None, sent: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label).

    block: vectors of a block, by default as many as hold NUMBERS numbers; sent: vectors compared with them in a task.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(finite, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.withColumn("usable", usable)
    classes = rows.where("usable").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("w"))
    classes = stored(classes.withColumn("c", F.monotonically_increasing_id()).withColumn("key", F.concat_ws(" ", F.col("label").cast("string"), F.size("v"))), "classes")

    total, dim = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    block = block or max(64, NUMBERS // (dim or 1))
    sent = sent or SENT * block
    sizes = classes.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("c").alias("h"), "v")).alias("first"))
    large = {r.key: (r.n, r.v) for r in sizes.where(F.col("n") > block).select("key", "n", "first.v").collect()}  # at most total / block
    pivots = {k: [v] for k, (_, v) in large.items()}
    if large:
        counts = spark.createDataFrame([(k, n) for k, (n, _) in large.items()], "key string, n long")
        sample = classes.join(F.broadcast(counts), "key").where(F.pmod(F.xxhash64("c"), F.lit(1 << 30)) < F.lit((1 << 30) // max(block, total // PIVOTS)))
        for r in sample.select("key", "v").toLocalIterator():  # about total / block, PIVOTS at most
            pivots[r.key].append(r.v)
    unit = lambda x: x / np.sqrt((x**2).sum(-1, keepdims=True))
    pivots = {k: unit(np.unique(np.array(p), axis=0)) for k, p in pivots.items()}
    shared = spark.sparkContext.broadcast(pivots)
    schema = "key string, c long, w long, v array<double>, cell int, far double"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for i, (key, v) in enumerate(zip(batch.column("key").to_pylist(), batch.column("v").to_pylist())):
                if key in shared.value:
                    d = np.sqrt(((shared.value[key] - unit(np.array(v))) ** 2).sum(1))
                    cell[i] = d.argmin()
                    far[i] = d[cell[i]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "c", "w", "v")), pa.array(cell), pa.array(far)], names=["key", "c", "w", "v", "cell", "far"])

    placed = stored(classes.select("key", "c", "w", "v").mapInArrow(place, schema), "placed")
    cells = {}
    if large:
        stats = placed.join(F.broadcast(counts.select("key")), "key", "left_semi").groupBy("key", "cell").agg(F.count("*").alias("n"), F.max("far").alias("r"))
        cells = {(r.key, r.cell): (r.n, r.r) for r in stats.collect()}  # one row a pivot
    plan = spark.sparkContext.broadcast((cells, {k: -(-n // sent) for k, (n, _) in large.items()}))
    reach = float(np.sqrt(2.0 - 2.0 * cosine)) + 1e-9

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, turns = plan.value
        for batch in batches:
            out: list[tuple] = []
            for i, (key, c, v, home) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("key", "c", "v", "cell")))):
                if key not in turns:
                    out.append((i, home, 0, 0, True))
                    continue
                spread = c * 0x9E3779B97F4A7C15 >> 20
                blocks, turn = -(-cells[key, home][0] // block), spread % turns[key]
                own = spread // turns[key] % blocks
                out += [(i, home, own, t, True) for t in range(turns[key])]
                out += [(i, home, b, turn, False) for b in range(own + 1, blocks)]
                d = np.sqrt(((shared.value[key] - unit(np.array(v))) ** 2).sum(1))
                for other in range(home + 1, len(d)):
                    if (key, other) in cells and d[other] <= reach + cells[key, other][1]:
                        out += [(i, other, b, turn, False) for b in range(-(-cells[key, other][0] // block))]
            taken = batch.select(["key", "c", "w", "v"]).take(pa.array([o[0] for o in out], pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array([o[n] for o in out], pa.int32()) for n in (1, 2, 3)), pa.array([o[4] for o in out], pa.bool_())], names=["key", "c", "w", "v", "cell", "block", "turn", "home"])

    dealt = placed.select("key", "c", "w", "v", "cell").mapInArrow(deal, "key string, c long, w long, v array<double>, cell int, block int, turn int, home boolean")

    def link(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("home", "descending"), ("c", "ascending")])
        raw = np.asarray(table["v"].combine_chunks().flatten()).reshape(len(table), -1)
        length = np.sqrt((raw**2).sum(1))
        x, homes = raw / length[:, None], int(pa.compute.sum(table["home"].cast(pa.int64())).as_py())
        sums = _Sums(table["w"].to_numpy())
        own = CoverTree(x[:homes]) if homes else None

        def add(found: Iterator[tuple[np.ndarray, np.ndarray]], shift: int) -> None:
            for i, j in found:
                for k in range(0, len(i), _CHUNK):
                    a, b = i[k : k + _CHUNK], j[k : k + _CHUNK] + shift
                    near = (raw[a] * raw[b]).sum(1) / (length[a] * length[b]) >= cosine
                    sums.add(a[near], b[near])

        if own and key[3].as_py() == 0:
            add(dual(own, own, cosine), 0)
        if own and homes < len(x):
            add(dual(own, CoverTree(x[homes:]), cosine), homes)
        some = np.flatnonzero(sums.links)
        c = table["c"].to_numpy()
        return pa.table({"c": c[some], "links": sums.links[some], "root": c[sums.root[some]]})

    found = stored(dealt.groupBy("key", "cell", "block", "turn").applyInArrow(link, "c long, links long, root long"), "links")
    counted = found.groupBy("c").agg(F.sum("links").alias("links"))
    part = components(found.select(F.col("c").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "c")
    whole = classes.join(counted, "c", "left").join(part, "c", "left").withColumn("component", F.coalesce("component", "c"))
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    whole = whole.join(least, "component").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    r, k = rows.alias("r"), whole.alias("k")
    out = r.join(k, F.col("usable") & (F.col("r.label") == F.col("k.label")) & (F.col("r.v") == F.col("k.v")), "left")
    component = F.coalesce("k.component_id", "r.vec_id")
    return out.select("r.vec_id", F.coalesce("k.n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("r.vec_id"), F.lit(True)).alias("kept"))


SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a),
roots AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, r.component_id, r.component_id = e.vec_id AS kept
FROM embeddings e JOIN roots r ON e.vec_id = r.node LEFT JOIN counts c ON e.vec_id = c.a
"""
