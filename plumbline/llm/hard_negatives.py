"""Hard negatives by inner product, with ball trees.

Rows have a label. The positives of an anchor are the rows of its label with the highest
products; a hard negative of a positive is a row of another label whose product lies in a
window below the positive's, LOW to HIGH percent of it, the highest first.

Each shard of rows (routes.Shards) is a ball tree, split at the median of its widest
component, with the centre, the radius and the least id of every node. For a node, every
product with q lies within |q| * radius of <q, centre>. So branch and bound leaves out a
node that lies outside of the window on either side, or strictly beneath the k-th product
found so far, or at it with larger ids only. A block of queries goes down together, each
to its nearer child first; a leaf is one product of matrices.

First the shards of the route nearest to an anchor give a k-th product, then those that
may hold more are searched. Windows are known beforehand, so negatives are sought in the
shards of all routes whose products can lie in some window of the anchor's.

Products are exact: integers below 2^53 in doubles, otherwise Python integers, with bounds
widened by the error of doubles (a product beyond 64 bits counts as the largest or
smallest of them, once it is found).

Defined results: rows with a null id, label or vector, or a null or non-finite component,
take no part; vectors are compared with those of their own length only; rows that repeat an
anchor's id are not its positives or negatives; repeated rows are found one by one, and
repeated anchors of one label and vector are answered once; ties go to the smaller id. A
positive without a hard negative gives no row. An empty table gives an empty result;
columns beside id, label and vector play no part.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import written
from plumbline.llm.routes import Shards, matrix, quantised

SCALE = 256
#: Positives of an anchor, negatives of a positive, and the window in percent of the positive's product.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Rows of a leaf, and queries that go down a tree together.
LEAF, TOGETHER = 256, 1024
_EXACT = 2.0**52
_LONG = 2**63 - 1


class BallTree:
    """Over the rows of whole, integer vectors, with their ids and labels."""

    def __init__(self, whole: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        self.whole, self.ids, self.labels = whole, ids, labels
        self.order = np.arange(len(whole))
        # A node: (from, to, centre, radius, least id, children)
        self.nodes: list[tuple] = []
        self.computed = 0
        x = whole.astype(np.float64)
        self.longest = float(np.sqrt((x * x).sum(axis=1).max())) if len(x) else 0.0
        if len(x):
            self._grow(x, 0, len(x))
        self.whole, self.ids, self.labels = whole[self.order], ids[self.order], labels[self.order]

    def _grow(self, x: np.ndarray, start: int, end: int) -> int:
        rows = self.order[start:end]
        centre = x[rows].mean(axis=0)
        radius = float(np.sqrt(((x[rows] - centre) ** 2).sum(axis=1).max()))
        me = len(self.nodes)
        self.nodes.append(())
        children = ()
        if end - start > LEAF:
            spread = x[rows].max(axis=0) - x[rows].min(axis=0) if x.shape[1] else np.zeros(1)
            # Equal vectors are divided by their ids.
            by = x[rows, int(spread.argmax())] if spread.max() > 0 else self.ids[rows]
            self.order[start:end] = rows[np.argsort(by, kind="stable")]
            cut = (start + end) // 2
            children = (self._grow(x, start, cut), self._grow(x, cut, end))
        self.nodes[me] = (start, end, centre, radius, int(self.ids[rows].min()), children)
        return me

    def packed(self) -> bytes:
        return pickle.dumps({k: v for k, v in vars(self).items() if k != "order"}, protocol=5)

    @classmethod
    def unpacked(cls, blob: bytes) -> BallTree:
        tree = cls.__new__(cls)
        vars(tree).update(pickle.loads(blob))
        return tree

    def search(self, queries: np.ndarray, own: np.ndarray, labels: np.ndarray, same: bool, k: int, least: list[int] | None = None, most: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, product) of the k best rows of each query, of its own label or of the
        others, with products from least to most."""
        n = len(queries)
        q = queries.astype(np.float64)
        length = np.sqrt((q * q).sum(axis=1))
        reach = float(length.max(initial=0.0)) * self.longest
        plain = reach * max(1, q.shape[1]) < _EXACT
        kind = np.int64 if plain else object
        # How far a bound may be off: by rounding, and by doubles where products are larger.
        slack = 1e-6 * (1 + length * (1 + self.longest)) + (0.0 if plain else 2.0**-48 * max(1, q.shape[1]) * length * self.longest)
        x = self.whole.astype(np.float64) if plain else self.whole.astype(object)
        asked = q if plain else queries.astype(object)
        low, high = (np.array([float(v) for v in b]) if b is not None else np.full(n, s) for b, s in ((least, -np.inf), (most, np.inf)))
        low_, high_ = (np.array(b, dtype=kind) if b is not None else None for b in (least, most))
        scores, found = np.zeros((n, k), kind), np.zeros((n, k), np.int64)
        filled = np.zeros(n, np.int64)
        kth, kth_id = np.full(n, -np.inf), np.full(n, _LONG)

        def leaf(start: int, end: int, at: np.ndarray) -> None:
            self.computed += len(at) * (end - start)
            s = asked[at] @ x[start:end].T
            s = s.astype(np.int64) if plain else s
            fits = (self.labels[start:end][None, :] == labels[at][:, None]) == same
            fits &= self.ids[start:end][None, :] != own[at][:, None]
            if low_ is not None:
                fits &= (s >= low_[at][:, None]).astype(bool) & (s <= high_[at][:, None]).astype(bool)
            full = filled[at] == k
            worst = scores[at, k - 1]
            fits &= ~full[:, None] | (s >= worst[:, None]).astype(bool)
            row, col = np.nonzero(fits)
            if not len(row):
                return
            # What is found joins what there is; of each query the first k stay.
            had = np.arange(k)[None, :] < filled[at][:, None]
            old_row, old_col = np.nonzero(had)
            r = np.concatenate((row, old_row))
            v = np.concatenate((s[row, col], scores[at][old_row, old_col]))
            d = np.concatenate((self.ids[start:end][col], found[at][old_row, old_col]))
            order = np.lexsort((d, -v, r)) if plain else np.array(sorted(range(len(r)), key=lambda i: (r[i], -v[i], d[i])))
            r, v, d = r[order], v[order], d[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            keep = place < k
            r, v, d, place = at[r[keep]], v[keep], d[keep], place[keep]
            scores[r, place], found[r, place] = v, d
            filled[r] = np.maximum(filled[r], place + 1)
            done = at[filled[at] == k]
            kth[done], kth_id[done] = scores[done, k - 1].astype(np.float64), found[done, k - 1]

        todo = [(0, np.arange(n))] if self.nodes else []
        while todo:
            node, at = todo.pop()
            start, end, centre, radius, least_id, children = self.nodes[node]
            mid, wide = q[at] @ centre, length[at] * radius + slack[at]
            top = mid + wide
            # Whole products that are at the k-th at most, and come after it by their ids.
            late = plain & (np.floor(top) <= kth[at]) & (least_id > kth_id[at])
            beneath = (top < kth[at]) | late
            at = at[~beneath & (top >= low[at]) & (mid - wide <= high[at])]
            if not len(at):
                continue
            if not children:
                leaf(start, end, at)
                continue
            a, b = children
            nearer = q[at] @ (self.nodes[a][2] - self.nodes[b][2]) >= 0
            todo += [(b, at[nearer]), (a, at[~nearer]), (b, at[~nearer]), (a, at[nearer])]
            todo = [t for t in todo if len(t[1])]
        row, place = np.nonzero(np.arange(k)[None, :] < filled[:, None])
        return row, found[row, place], scores[row, place]


def clamped(scores: np.ndarray) -> pa.Array:
    return pa.array([max(-_LONG, min(_LONG, int(s))) for s in scores.tolist()], pa.int64())


def mine(rows: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str | Column = "label", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchor: a
    condition on rows; label: a whole number."""
    kind = F.col(label) if isinstance(label, str) else label
    made = rows.select(F.col(vec_id).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v"), kind.cast("long").alias("label"), anchor.alias("asked"))
    made = made.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.col("label").isNotNull()).withColumn("dim", F.size("v"))
    asked = made.where("asked").select("id", "v", "dim", "label").distinct()

    def grow(t: pa.Table) -> bytes:
        return BallTree(matrix(t.column("v"), t.column("dim")[0].as_py()), t.column("id").to_numpy(), t.column("label").to_numpy()).packed()

    shards = Shards(made.select("id", "v", "dim", "label"), grow, "label long")

    def nearest(blob: bytes | None, t: pa.Table) -> pa.Table:
        parts = []
        if blob is not None:
            tree, own, labels = BallTree.unpacked(blob), t.column("id").to_numpy(), t.column("label").to_numpy()
            q, anchors = matrix(t.column("v"), t.column("dim")[0].as_py()), t.column("anchor").to_numpy()
            for k in range(0, len(q), TOGETHER):
                row, d, s = tree.search(q[k : k + TOGETHER], own[k : k + TOGETHER], labels[k : k + TOGETHER], True, positives)
                parts.append(pa.table({"anchor": pa.array(anchors[k : k + TOGETHER][row]), "positive_id": pa.array(d), "score": clamped(s)}))
        return pa.concat_tables(parts) if parts else pa.table({c: pa.array([], pa.int64()) for c in ("anchor", "positive_id", "score")})

    def window(blob: bytes | None, t: pa.Table) -> pa.Table:
        parts = []
        if blob is not None:
            tree, own, labels = BallTree.unpacked(blob), t.column("id").to_numpy(), t.column("label").to_numpy()
            q, anchors = matrix(t.column("v"), t.column("dim")[0].as_py()), t.column("anchor").to_numpy()
            # A query for each positive: its window of whole products.
            found = t.column("scores").combine_chunks()
            sizes = np.diff(found.offsets.to_numpy())
            each, score = np.repeat(np.arange(len(q)), sizes), found.flatten().to_numpy()
            place = np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            for k in range(0, len(each), TOGETHER):
                some, pos = each[k : k + TOGETHER], [int(v) for v in score[k : k + TOGETHER].tolist()]
                row, d, s = tree.search(q[some], own[some], labels[some], False, negatives, [-(-low * p // 100) for p in pos], [high * p // 100 for p in pos])
                cols = {"anchor": pa.array(anchors[some][row]), "place": pa.array(place[k : k + TOGETHER][row]), "negative_id": pa.array(d), "negative_score": clamped(s)}
                parts.append(pa.table(cols))
        return pa.concat_tables(parts) if parts else pa.table({c: pa.array([], pa.int64()) for c in ("anchor", "place", "negative_id", "negative_score")})

    # Anchors by number: an id may stand for several vectors.
    asked = written(shards.homes(asked.withColumn("anchor", F.monotonically_increasing_id()), "label long, anchor long"), "anchors")
    schema = "anchor long, positive_id long, score long"
    near = shards.searched(asked, nearest, schema, "near")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive_id")
    if shards.n_routes > 1:  # else the first search has met every row
        kth = near.withColumn("place", F.row_number().over(order)).where(F.col("place") == positives).select("anchor", F.col("score").alias("least"))
        away = shards.reached(asked.join(kth, "anchor", "left").withColumn("most", F.lit(None).cast("double")).select("id", "v", "dim", "label", "anchor", "route", "least", "most"), "label long, anchor long")
        near = near.unionByName(shards.searched(away, nearest, schema, "nearer"))
    chosen = written(near.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < positives), "positives")
    # Of each anchor as many scores as it has positives.
    each = chosen.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda p: p["score"]).alias("scores"))
    edge = lambda find, percent: find(F.transform("scores", lambda s: s.cast("double") * percent / 100))
    windows = asked.drop("route").join(each, "anchor").withColumns({"least": edge(F.array_min, low), "most": edge(F.array_max, high)})
    sent = shards.reached(windows.select("id", "v", "dim", "label", "anchor", "scores", "least", "most"), "label long, anchor long, scores array<bigint>")
    hard = shards.searched(sent, window, "anchor long, place long, negative_id long, negative_score long", "hard")
    best = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    named = chosen.join(asked.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return named.join(hard, ["anchor", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("score").alias("positive_score"), "negative_score")
