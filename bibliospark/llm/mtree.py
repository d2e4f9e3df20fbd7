"""Exact top-k inner products by best-first search of M-trees.

Largest inner product is nearest point once each candidate gets one more coordinate, sqrt(M^2 - |x|^2), and each
query a zero there. Candidates are dealt to blocks of bounded size by hash, queries to blocks as well; a task builds
the M-tree of its candidate block - pages of entries with a covering radius and the distance to the parent - and
searches it best-first for each of its queries. An entry whose stored parent distance already proves it too far, by
the triangle inequality, is never computed. A last ranking merges the blocks' results. Equal vectors are one entry
that keeps only the k + 1 smallest identifiers, which is all that a result can hold.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, nor do rows without an
identifier; a query's candidates have its number of components; equal scores go to the smaller identifier; rows
with the query's identifier are its own; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

#: Entries of a page; numbers in the vectors of a block.
PAGE, NUMBERS = 256, 1 << 19


class MTree:
    """Over integer vectors (rows of x); distances are in the lifted space."""

    def __init__(self, x: np.ndarray, page: int = PAGE):
        self.x, self.page = x.astype(np.float64), page
        norms = (self.x**2).sum(1)
        self.most = float(norms.max()) if len(x) else 0.0
        self.lift = np.sqrt(np.maximum(self.most - norms, 0.0))
        self.computed = 0
        self.root = self._build(np.arange(len(x)), None) if len(x) else None

    def _far(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Distances of the rows i and j; lifted, all rows have the same length."""
        inner = self.x[i] @ self.x[j].T + np.outer(self.lift[i], self.lift[j])
        return np.sqrt(np.maximum(2.0 * self.most - 2.0 * inner, 0.0))

    def _build(self, members: np.ndarray, parent: int | None) -> tuple:
        """A page: (is leaf, objects, their vectors, radii, distances to the parent's object, child pages)."""
        apart = lambda own: self._far(np.array([parent]), own)[0] if parent is not None else None
        if len(members) <= self.page:
            return True, members, self.x[members], np.zeros(len(members)), apart(members), None
        wanted = min(self.page, max(2, -(-2 * len(members) // self.page)))  # children about half full
        pivots = members[np.linspace(0, len(members) - 1, wanted).astype(int)]
        far = self._far(pivots, members)
        near = far.argmin(0)
        groups = [np.flatnonzero(near == g) for g in range(len(pivots))]
        if max(len(g) for g in groups) == len(members):  # pivots alike: deal evenly
            groups = np.array_split(np.arange(len(members)), wanted)
        held = [(p, g) for p, g in enumerate(groups) if len(g)]
        objects = pivots[[p for p, _ in held]]
        radii = np.array([far[p, g].max() for p, g in held])
        return False, objects, self.x[objects], radii, apart(objects), [self._build(members[g], pivots[p]) for p, g in held]

    def search(self, q: np.ndarray, k: int, ids: list[list[int]], own: int) -> list[tuple[int, int]]:
        """The k best (score, identifier); ids: identifiers of each row of x; own: the identifier left out."""
        q = q.astype(np.float64)
        constant = float((q**2).sum()) + self.most
        slack = 1e-6 * (1.0 + np.sqrt(constant))
        best: list[tuple[int, int]] = []  # heap of (score, -identifier), the worst on top
        heap: list[tuple[float, int, tuple, float | None]] = [(0.0, 0, self.root, None)] if self.root else []
        pushed = 0
        while heap:
            bound, _, (leaf, objects, vectors, radii, to_parent, children), parent_far = heapq.heappop(heap)
            limit = np.sqrt(max(0.0, constant - 2.0 * best[0][0])) + slack if len(best) == k else np.inf
            if bound > limit:
                break
            open_ = np.arange(len(objects))
            if parent_far is not None:
                open_ = np.flatnonzero(np.abs(parent_far - to_parent) - radii <= limit)
            self.computed += len(open_)
            score = (vectors if len(open_) == len(objects) else vectors[open_]) @ q
            if leaf:
                some = np.flatnonzero(score >= best[0][0]) if len(best) == k else np.arange(len(score))
                for i in some[np.argsort(-score[some], kind="stable")]:
                    s = int(score[i])
                    if len(best) == k and s < best[0][0]:
                        break
                    for vec in ids[objects[open_[i]]]:
                        if vec != own:
                            heapq.heappush(best, (s, -vec))
                            if len(best) > k:
                                heapq.heappop(best)
                continue
            far = np.sqrt(np.maximum(constant - 2.0 * score, 0.0))
            for i in np.flatnonzero(far - radii[open_] <= limit):
                pushed += 1
                at = open_[i]
                heapq.heappush(heap, (max(0.0, far[i] - radii[at]), pushed, children[at], far[i]))
        return [(s, -v) for s, v in sorted(best, reverse=True)]


def integers(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as double; null unless all components are finite."""
    usable = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")), F.lit(False)))
    return F.when(usable, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, block: int | None = None, query_block: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row that ``is_query`` picks; vectors: (vec_id, v array<long>).

    block, query_block: candidates and queries of a task, by default as many as hold NUMBERS and twice NUMBERS numbers.
    """
    rows = stored(vectors.where("vec_id is not null and v is not null").select("vec_id", "v", is_query.alias("asks")), "integers")
    salted = Window.partitionBy("v", F.pmod("vec_id", F.lit(64))).orderBy("vec_id")
    few = rows.select("vec_id", "v").distinct().withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k + 1)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    entries = stored(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "entries")
    queries = rows.where("asks").select("vec_id", "v").distinct()
    total, most = entries.agg(F.count("*"), F.max(F.size("v"))).first()
    block = block or max(PAGE, NUMBERS // (most or 1))
    query_block = query_block or 2 * block
    blocks = -(-total // block) or 1
    query_blocks = -(-queries.count() // query_block) or 1
    dim = F.size("v").alias("dim")
    held = entries.select(dim, F.pmod(F.xxhash64("v"), F.lit(blocks)).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("qb"), F.lit(None).cast("long").alias("query_id"), "ids", "v")
    asked = queries.select(dim, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"), F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).alias("qb"), F.col("vec_id").alias("query_id"), F.lit(None).cast("array<long>").alias("ids"), "v")

    def search(key: tuple, table: pa.Table) -> pa.Table:
        asks = table["query_id"].is_valid()
        own, wanted = table.filter(pa.compute.invert(asks)), table.filter(asks)
        matrix = lambda t: np.asarray(t["v"].combine_chunks().flatten()).reshape(len(t), -1)
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(own) and len(wanted):
            tree, ids = MTree(matrix(own)), own["ids"].to_pylist()
            for query, q in zip(wanted["query_id"].to_pylist(), matrix(wanted)):
                for score, vec in tree.search(q, k, ids, query):
                    out["query_id"].append(query)
                    out["vec_id"].append(vec)
                    out["score"].append(score)
        return pa.table(out, pa.schema([(c, pa.int64()) for c in out]))

    found = held.unionAll(asked).groupBy("dim", "b", "qb").applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scores)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""
