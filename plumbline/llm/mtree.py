"""Exact top-k search by inner product, with M-trees.

Inner products become distances by one more coordinate, sqrt(M^2 - |x|^2) for the
vectors of a tree and 0 for queries, where M is the tree's largest norm: then
|q' - x'|^2 = |q|^2 + M^2 - 2 <q, x>, and the nearest are those of the highest
product. Each shard of the vectors is an M-tree of paged nodes. An entry of an inner
page has its routing vector, its covering radius and its distance to the page's own
routing vector; an entry of a leaf page its vector and that distance. Search takes
pages best first by the least distance that they allow, and computes a distance only
where the stored ones do not already exclude the entry by the triangle inequality.

Vectors are dealt to shards of near ones (routes.Shards), the tree of each is built once
and written down. A query first searches the shards of the route nearest to it; its k-th
product then shows to which other routes it has to go at all. Products are exact: they
are integers below 2^53, or, where a shard's values are larger, the tree's bounds are
widened by the error of doubles and what they leave is multiplied as Python integers (a
product beyond 64 bits is returned as the largest or smallest of them).

Defined results: vectors that are null, or have null or non-finite components, take
no part; vectors are compared with those of their own length only; a query is not
its own candidate, nor are rows that repeat its id; repeated candidates are ranked
one by one; repeated queries of the same vector are answered once. Ties go to the
smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import written
from plumbline.llm.routes import Shards, matrix, quantised

K = 10
SCALE = 1024
#: Entries of a page.
PAGE = 64
_EXACT = 2.0**52
_LONG = 2**63 - 1


class MTree:
    """Over the rows of whole, integer vectors. ids: of the rows."""

    def __init__(self, whole: np.ndarray, ids: np.ndarray):
        self.x, self.ids, self.whole = whole.astype(np.float64), ids, whole
        x = self.x
        self.square = np.einsum("ij,ij->i", x, x)
        self.top = float(self.square.max()) if len(x) else 0.0
        self.lift = np.sqrt(np.maximum(0.0, self.top - self.square))
        # Distances carry rounding errors of this size at most; bounds are widened by it.
        self.slack = 1e-6 * (1 + np.sqrt(self.top))
        self.rng = np.random.default_rng(7)
        # A page: (is leaf, rows, distances to the page's routing vector, radii, children)
        self.pages: list[tuple] = []
        self.computed = 0
        self.root = self._grow(np.arange(len(x)), None)

    def _between(self, rows: np.ndarray, pivot: int) -> np.ndarray:
        d2 = 2 * self.top - 2 * (self.x[rows] @ self.x[pivot] + self.lift[rows] * self.lift[pivot])
        return np.sqrt(np.maximum(0.0, d2))

    def _page(self, *page) -> int:
        self.pages.append(page)
        return len(self.pages) - 1

    def _grow(self, rows: np.ndarray, pivot: int | None) -> int:
        """Bulk loading: rows go to the nearest of some sampled routing vectors."""
        to_parent = self._between(rows, pivot) if pivot is not None else np.zeros(len(rows))
        if len(rows) <= PAGE:
            return self._page(True, rows, to_parent, None, None)
        heads = self.rng.choice(rows, min(PAGE, max(2, len(rows) // PAGE + 1)), replace=False)
        each = np.stack([self._between(rows, int(p)) for p in heads])
        near = each.argmin(axis=0)
        groups = [(int(p), rows[near == i], each[i][near == i]) for i, p in enumerate(heads) if (near == i).any()]
        if len(groups) == 1:  # equal vectors: pages of a full size under one routing vector
            p, own, d = groups[0]
            cut = [(p, own[i : i + max(PAGE, len(own) // PAGE + 1)], d[i : i + max(PAGE, len(own) // PAGE + 1)]) for i in range(0, len(own), max(PAGE, len(own) // PAGE + 1))]
            groups = cut if len(own) > PAGE else groups
        heads = np.array([g[0] for g in groups])
        radii = np.array([g[2].max() for g in groups])
        dist = self._between(heads, pivot) if pivot is not None else np.zeros(len(heads))
        return self._page(False, heads, dist, radii, [self._grow(g[1], g[0]) for g in groups])

    def _products(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        self.computed += len(rows)
        return self.x[rows] @ q

    def packed(self) -> bytes:
        """The pages and what belongs to them, as plain arrays and lists."""
        return pickle.dumps({k: v for k, v in vars(self).items() if k not in ("rng", "x")}, protocol=5)

    @classmethod
    def unpacked(cls, blob: bytes) -> MTree:
        tree = cls.__new__(cls)
        vars(tree).update(pickle.loads(blob))
        tree.x = tree.whole.astype(np.float64)
        return tree

    def error(self, q: np.ndarray) -> float:
        """How far a product in doubles may be off: nothing while all are integers below 2^53."""
        reach = np.sqrt(self.top) * np.sqrt(float(q @ q))
        return 0.0 if reach * max(1, len(q)) < _EXACT else 2.0**-50 * max(1, len(q)) * reach

    def search(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k rows of the highest product whose id is not own: (product, id), best first."""
        if not len(self.x):
            return []
        q = query.astype(np.float64)
        q2, off = float(q @ q), self.error(q)
        exact = [int(v) for v in query.tolist()] if off else None
        slack = self.slack + np.sqrt(2 * off)
        best: list[tuple[int, int]] = []  # a heap, the worst first
        bound = np.inf
        todo: list[tuple[float, int, float]] = [(0.0, self.root, -1.0)]
        while todo:
            least, at, d_own = heapq.heappop(todo)
            if least > bound:
                break
            leaf, rows, dist, radii, children = self.pages[at]
            keep = np.arange(len(rows))
            if d_own >= 0:
                gap = np.abs(d_own - dist)
                keep = np.flatnonzero((gap if leaf else gap - radii) <= bound + slack)
                if not len(keep):
                    continue
            s = self._products(rows[keep], q)
            if leaf:
                take = np.flatnonzero(s >= float(best[0][0]) - off) if len(best) >= k else np.arange(len(s))
                for i in take.tolist():
                    row = rows[keep[i]]
                    score = sum(a * b for a, b in zip(self.whole[row].tolist(), exact)) if off else int(s[i])
                    item = (score, -int(self.ids[row]))
                    if -item[1] == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                if len(best) >= k:
                    bound = np.sqrt(max(0.0, q2 + self.top - 2 * float(best[0][0]) + 2 * off)) + slack
                continue
            d = np.sqrt(np.maximum(0.0, q2 + self.top - 2 * s))
            low = np.maximum(0.0, d - radii[keep] - slack)
            for i in np.flatnonzero(low <= bound).tolist():
                heapq.heappush(todo, (float(low[i]), children[keep[i]], float(d[i])))
        return [(s, -i) for s, i in sorted(best, key=lambda x: (-x[0], -x[1]))]


def top_k(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score. queries: rows of the same columns."""

    def made(df: DataFrame) -> DataFrame:
        df = df.select(F.col(vec_id).cast("long").alias("id"), quantised(F.col(vector), SCALE).alias("v"))
        return df.where(F.col("id").isNotNull() & F.col("v").isNotNull()).withColumn("dim", F.size("v"))

    def grow(t: pa.Table) -> bytes:
        return MTree(matrix(t.column("v"), t.column("dim")[0].as_py()), t.column("id").to_numpy()).packed()

    def solve(blob: bytes | None, right: pa.Table) -> pa.Table:
        rows = []
        if blob is not None:
            tree = MTree.unpacked(blob)
            q = matrix(right.column("v"), right.column("dim")[0].as_py())
            for i, own in enumerate(right.column("id").to_pylist()):
                rows += [(own, d, max(-_LONG, min(_LONG, s))) for s, d in tree.search(q[i], own, k)]
        return pa.table({n: pa.array([r[j] for r in rows], pa.int64()) for j, n in enumerate(("query_id", "vec_id", "score"))})

    shards = Shards(made(vectors), grow)
    found = "query_id long, vec_id long, score long"
    at_home = shards.homes(made(queries).distinct())
    at_home = written(at_home, "home") if shards.n_routes > 1 else at_home
    first = shards.searched(at_home, solve, found, "first")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if shards.n_routes > 1:  # else the first search has met every vector
        kth = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least")).distinct()
        away = at_home.join(kth, "id", "left").withColumn("most", F.lit(None).cast("double"))
        first = first.unionByName(shards.searched(shards.reached(away), solve, found, "second"))
    ranked = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
