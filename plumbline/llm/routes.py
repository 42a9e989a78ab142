"""Vectors in shards of near ones, and blocks of queries sent to the shards they may need.

Vectors are dealt to the nearest of some routing vectors, a sample of ROUTES at most. A
route knows how far its vectors lie from it and how long they are, which bounds every
product from above and below: <q, r> - |q| radius <= <q, x> <= <q, r> + |q| radius, and
|<q, x>| <= |q| |x|. A route of more than SHARD vectors has several shards, each of which
is built into a search tree once and written. Queries meet a shard in blocks of BLOCK.

The routing vectors are the first few by hash, taken with a limit, so each task of the draw
keeps no more than that many. Vectors of a length that the draw missed share one route of
unknown radius, which every query of that length visits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written

#: Vectors in a shard, about; queries in a block; routing vectors at most.
SHARD, BLOCK, ROUTES = 8192, 8192, 4096


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null where the vector takes no part."""
    usable = vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(usable, F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long")))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def by_dim(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The vectors v of each length dim, with their rows."""
    dims = b.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, matrix(b.column("v").take(pa.array(at)), dim)


class Routes:
    """Routing vectors of each length, with what is known of the vectors dealt to them."""

    def __init__(self, sample: list[tuple[int, list[int]]]):
        self.by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim in sorted({d for d, _ in sample}):
            mine = [i for i, (d, _) in enumerate(sample) if d == dim]
            self.by_dim[dim] = np.array(mine), np.array([sample[i][1] for i in mine], np.float64).reshape(len(mine), dim)
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def learn(self, far: dict[int, float], longest: dict[int, float]) -> None:
        """How far the vectors of each route lie from it, and how long they are."""
        for dim, (names, _) in self.by_dim.items():
            self.known[dim] = tuple(np.array([m.get(int(n), -1.0) for n in names]) for m in (far, longest))

    def nearest(self, dim: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The route of each vector and its distance from it. Lengths without routes have one of their own."""
        if dim not in self.by_dim:
            return np.full(len(x), -1 - dim), np.full(len(x), np.inf)
        names, r = self.by_dim[dim]
        d2 = (x * x).sum(axis=1)[:, None] + (r * r).sum(axis=1)[None, :] - 2 * (x @ r.T)
        at = d2.argmin(axis=1)
        return names[at], np.sqrt(((x - r[at]) ** 2).sum(axis=1))

    def reached(self, dim: int, q: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of q and routes that may hold a product from least to most of the row."""
        if dim not in self.by_dim:
            return np.arange(len(q)), np.full(len(q), -1 - dim)
        (names, r), (radius, longest) = self.by_dim[dim], self.known[dim]
        length = np.sqrt((q * q).sum(axis=1))[:, None]
        mid, reach = q @ r.T, length * radius[None, :]
        slack = 1e-6 * (1 + length * (1 + np.maximum(longest, 0))[None, :])
        high = np.minimum(mid + reach, length * longest[None, :])
        low = np.maximum(mid - reach, -length * longest[None, :])
        row, at = np.nonzero((radius >= 0)[None, :] & (high + slack >= least[:, None]) & (low - slack <= most[:, None]))
        return row, names[at]


class Shards:
    """rows: id, v, dim and more, without nulls in the three; dealt once and written.
    grow: makes a shard's rows, an Arrow table, into the bytes of its tree."""

    def __init__(self, rows: DataFrame, grow: Callable[[pa.Table], bytes], also: str = ""):
        """also: the columns beside id, v and dim, as DDL."""
        also = f", {also}" if also else ""
        n = rows.count()
        wanted = min(ROUTES, -(-n // SHARD))
        drawn = rows.select("dim", "v", F.xxhash64("id", "v", F.lit("route")).alias("h")).orderBy("h", "dim", "v").limit(wanted) if wanted else None
        routes = Routes([(r.dim, r.v) for r in drawn.collect()] if wanted else [])
        names = rows.columns

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                route, far, long = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows), np.zeros(b.num_rows)
                for dim, at, x in by_dim(b):
                    x = x.astype(np.float64)
                    route[at], far[at] = routes.nearest(dim, x)
                    long[at] = np.sqrt((x * x).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(route), pa.array(far), pa.array(long)], names=[*names, "route", "far", "long"])

        dealt = rows.mapInArrow(deal, f"id long, v array<bigint>, dim int{also}, route long, far double, long double")
        self.rows = written(dealt, "dealt")
        # A row for each route: ROUTES at most, and one for each length that the draw missed.
        self.parts = self.rows.groupBy("route").agg(F.max("far").alias("far"), F.max("long").alias("long"), F.ceil(F.count("*") / SHARD).alias("parts"))
        self.parts = written(self.parts, "routes")
        facts = self.parts.where("route >= 0").collect()
        routes.learn({r.route: r.far for r in facts}, {r.route: r.long for r in facts})
        self.routes, self.n_routes = routes, self.parts.count()

        def one(key: tuple, t: pa.Table) -> pa.Table:
            return pa.table({"route": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int64()), "tree": pa.array([grow(t)], pa.large_binary()).cast(pa.binary())})

        # The place of a row in the written files, so that a task that runs again deals alike.
        placed = self.rows.withColumn("place", F.xxhash64("id", F.monotonically_increasing_id()))
        dealt_out = placed.join(self.parts.select("route", "parts"), "route").withColumn("part", F.pmod("place", "parts")).select("route", "part", *names)
        self.trees = written(dealt_out.groupBy("route", "part").applyInArrow(one, "route long, part long, tree binary"), "trees")

    def homes(self, queries: DataFrame, also: str = "") -> DataFrame:
        """queries (id, v, dim and the columns also) with the route that is nearest to each."""
        routes, names = self.routes, queries.columns

        def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                route = np.zeros(b.num_rows, np.int64)
                for dim, at, x in by_dim(b):
                    route[at] = routes.nearest(dim, x.astype(np.float64))[0]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(route)], names=[*names, "route"])

        return queries.mapInArrow(home, f"id long, v array<bigint>, dim int{', ' + also if also else ''}, route long")

    def reached(self, queries: DataFrame, also: str = "") -> DataFrame:
        """queries (id, v, dim, the columns also, least, most and perhaps a route that is left
        out) with each route that may hold a product from least to most. Null: no bound."""
        routes = self.routes
        kept = [c for c in queries.columns if c not in ("least", "most", "route")]
        homed = "route" in queries.columns

        def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                least, most = (b.column(c).cast(pa.float64()).fill_null(x).to_numpy(zero_copy_only=False) for c, x in (("least", -np.inf), ("most", np.inf)))
                for dim, at, x in by_dim(b):
                    for k in range(0, len(at), 1024):  # bounds the matrix of products
                        some = at[k : k + 1024]
                        row, route = routes.reached(dim, x[k : k + 1024].astype(np.float64), least[some], most[some])
                        row = some[row]
                        if homed:
                            away = route != b.column("route").to_numpy()[row]
                            row, route = row[away], route[away]
                        out = b.select(kept).take(pa.array(row, pa.int64()))
                        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(route, pa.int64())], names=[*kept, "route"])

        return queries.mapInArrow(others, f"id long, v array<bigint>, dim int{', ' + also if also else ''}, route long")

    def searched(self, sent: DataFrame, solve: Callable[[bytes, pa.Table], pa.Table], schema: str, name: str) -> DataFrame:
        """What solve(tree, queries) gives for every block of queries and every shard of the
        route that they are sent to, written. sent: queries with route."""
        columns = [c for c in sent.columns if c != "route"]
        sent = written(sent.join(self.parts.select("route", "parts"), "route"), f"sent-{name}")
        blocks = sent.groupBy("route").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        sent = sent.join(blocks, "route").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        met = self.trees.join(blocks, "route").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        key = ["route", "part", "block"]

        def both(at: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            return solve(left.column("tree")[0].as_py() if len(left) and len(right) else None, right)

        found = met.select(*key, "tree").groupBy(*key).cogroup(sent.select(*key, *columns).groupBy(*key))
        return written(found.applyInArrow(both, schema), name)
