"""A stored inverted-file index of vectors: cells of near directions, searched exactly or by probes.

Vectors are dealt to the nearest of some centroids (spherical k-means over a bounded sample)
and written in folders by cell. A cell's radius is the largest angle between its centroid and
a vector of its own, so no vector of a cell is nearer to a query than the angle between them
less the radius. The exact search visits the PROBES nearest cells of a query, whose k-th score
then shows which others may hold a better one. The approximate search visits as many cells as
``probes`` says; how many give a recall is measured at building, over some stored vectors.

Only folders of visited cells are read. A cell's vectors meet its queries in blocks, as one
product of matrices for each; large cells are divided into parts of PART vectors. Scores are
cosine similarities, rounded to 9 decimals so that ties go to the smaller id.

Defined results: null vectors, those with null or non-finite components, and those without a
direction take no part, also as queries; all others have one length, or the search fails.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.sources.stores import stored

#: Cells at most; sampled vectors for each cell, and sampled values at most; rounds of k-means.
CELLS, SAMPLE, VALUES, ROUNDS = 4096, 32, 16_000_000, 8
#: Vectors of a part, queries of a block, cells that the exact search begins with.
PART, BLOCK, PROBES = 8192, 1024, 2
#: Stored vectors over which the recall of probes is measured, and the recall wanted.
MEASURED, RECALL = 64, 0.95
#: What an angle may be off by rounding.
_SLACK = 1e-7


def usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None] if len(x) else x


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def centroids(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means, begun from different vectors. Cells that lose all theirs stay where they are."""
    x = _unit(sample)
    different = np.unique(x, axis=0)
    c = different[np.random.default_rng(7).permutation(len(different))[:cells]]
    for _ in range(ROUNDS if len(x) else 0):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.sqrt((sums * sums).sum(axis=1))
        c = np.where((size > 0)[:, None], sums / np.maximum(size, 1e-300)[:, None], c)
    return c


@dataclass(frozen=True)
class VectorIndex:
    """lists: id, v, the columns kept beside, cell, in folders by cell; cells: cell, centroid,
    radius, n, parts, probes (the measured number for the wanted recall), a row for each cell."""

    lists: DataFrame
    cells: DataFrame

    def _known(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = self.cells.orderBy("cell").collect()  # CELLS rows at most
        return np.array([r.cell for r in rows]), np.array([r.centroid for r in rows], np.float64), np.array([r.radius for r in rows])

    def probes(self) -> int:
        row = self.cells.agg(F.max("probes")).first()
        return int(row[0] or 1)

    def _sent(self, queries: DataFrame, first: int | None, skip: int = 0) -> DataFrame:
        """Queries with the cells they visit: the first nearest ones, or else those that may hold a
        score of at least the column least, beyond the skip nearest."""
        names, c, radius = self._known()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, BLOCK):
                    part = b.slice(at, BLOCK)
                    angle = _angle(_unit(_matrix(part.column("qv"))) @ c.T) if len(names) and part.num_rows else np.zeros((part.num_rows, 0))
                    order = np.argsort(angle, axis=1, kind="stable")
                    if first is not None:
                        take = np.zeros(angle.shape, bool)
                        np.put_along_axis(take, order[:, :first], True, axis=1)
                    else:
                        least = part.column("least").fill_null(-1.0).to_numpy(zero_copy_only=False)
                        take = np.cos(np.maximum(0.0, angle - radius[None, :] - _SLACK)) >= least[:, None] - 2e-9
                        np.put_along_axis(take, order[:, :skip], False, axis=1)
                    row, cell = np.nonzero(take)
                    out = part.select(["qid", "qv"]).take(pa.array(row, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(names[cell], pa.int32())], names=["qid", "qv", "cell"])

        kind = queries.schema["qid"].dataType.simpleString()
        return queries.mapInArrow(run, f"qid {kind}, qv array<double>, cell int")

    def _best(self, sent: DataFrame, k: int, where: Column | None) -> DataFrame:
        """qid, id, score: of every query and every part that it visits the k best."""
        sent = stored(sent, "probes")
        visited = [r.cell for r in sent.select("cell").distinct().collect()]  # CELLS at most
        lists = self.lists.where(F.col("cell").isin(visited)) if visited else self.lists.where("false")
        lists = lists if where is None else lists.where(where)
        blocks = sent.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        parts = self.cells.select("cell", "parts")
        left = lists.join(F.broadcast(parts.join(blocks, "cell")), "cell")  # a row for each cell
        left = left.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        right = sent.join(F.broadcast(parts.join(blocks, "cell")), "cell").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")))
        right = right.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        kind = sent.schema["qid"].dataType.simpleString()

        def score(a: pa.Table, b: pa.Table) -> pa.Table:
            rows, found, scores = [], [], []
            if len(a) and len(b):
                ids, x, q = a.column("id").to_numpy(), _matrix(a.column("v")), _matrix(b.column("qv"))
                each = np.round((q @ x.T) / np.sqrt((q * q).sum(axis=1))[:, None] / np.sqrt((x * x).sum(axis=1))[None, :], 9)
                for i, s in enumerate(each):
                    some = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.arange(len(s))
                    best = some[np.lexsort((ids[some], -s[some]))[:k]]
                    rows += [i] * len(best)
                    found.append(ids[best])
                    scores.append(s[best])
            at = pa.array(rows, pa.int64())
            return pa.table({"qid": b.column("qid").take(at), "id": pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)), "score": pa.array(np.concatenate(scores) if scores else np.zeros(0))})

        key = ["cell", "part", "block"]
        pairs = left.select(*key, "id", "v").groupBy(*key).cogroup(right.select(*key, "qid", "qv").groupBy(*key))
        return stored(pairs.applyInArrow(score, f"qid {kind}, id long, score double"), "found")

    def top(self, queries: DataFrame, k: int = 30, probes: int | None = None, where: Column | None = None) -> DataFrame:
        """qid, id, score, rank of the k best. queries: qid, qv. probes: visit so many cells only;
        exact without. where: a condition on what is kept beside the vectors, such as a level."""
        asked = queries.where(usable(F.col("qv"))).select("qid", F.col("qv").cast("array<double>").alias("qv"))
        order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
        # So few vectors that one block has room for them are all visited at once.
        few = probes is None and self.cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] <= PART
        first = self._best(self._sent(asked, CELLS if few else probes or PROBES), k, where)
        ranked = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if few or probes is not None:
            return ranked.select("qid", "id", "score", "rank")
        kth = ranked.where(F.col("rank") == k).select("qid", F.col("score").alias("least"))
        rest = self._best(self._sent(asked.join(kth, "qid", "left"), None, PROBES), k, where)
        both = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return both.select("qid", "id", "score", "rank")


def build(vectors: DataFrame, path: str, cells: int | None = None, recall: float = RECALL, k: int = 30) -> VectorIndex:
    """vectors: id, v and what is kept beside. Written under path."""
    good = vectors.where(usable(F.col("v")) & F.col("id").isNotNull())
    n, dim = good.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    cells = max(1, min(CELLS, cells or int(np.sqrt(n)), n))
    most = min(SAMPLE * cells, max(cells, VALUES // dim))
    # The first by hash, with a limit: no task keeps more.
    drawn = good.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(most).collect()
    c = centroids(np.array([r.v for r in drawn], np.float64).reshape(len(drawn), dim), cells)
    columns = good.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cosine = _unit(_matrix(b.column("v"))) @ c.T if b.num_rows else np.zeros((0, max(1, len(c))))
            near = cosine.argmax(axis=1)
            angle = _angle(cosine[np.arange(len(near)), near])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32()), pa.array(angle, pa.float64())], names=[*columns, "cell", "angle"])

    schema = T.StructType([*good.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    lists = stored(good.mapInArrow(deal, schema).hint("rebalance", "cell"), "lists", path, "cell")
    spark = vectors.sparkSession
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)] if n else [], "cell int, centroid array<double>")
    seen = lists.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n"), F.ceil(F.count("*") / PART).alias("parts"))
    known = stored(table.join(seen, "cell"), "seen", path)
    some = good.orderBy(F.xxhash64("id", F.lit("measure")), "id").limit(MEASURED).select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    needed = _measured(VectorIndex(lists, known.withColumn("probes", F.lit(1))), some, c, k, recall) if n else 1
    return VectorIndex(lists, stored(known.withColumn("probes", F.lit(needed)), "cells", path))


def _measured(index: VectorIndex, queries: DataFrame, c: np.ndarray, k: int, recall: float) -> int:
    """How many nearest cells hold the wanted share of the k best, over MEASURED queries."""
    best = index.top(queries, k).join(index.lists.select("id", "cell"), "id").groupBy("qid").agg(F.collect_list("cell").alias("cells"))
    names = index._known()[0]
    places, found = [], 0
    for r in queries.join(best, "qid").collect():  # MEASURED rows of k cells
        angle = _angle(_unit(np.array([r.qv], np.float64)) @ c[names].T)[0]
        place = dict(zip(names[np.argsort(angle, kind="stable")].tolist(), range(len(names))))
        places += [place[x] for x in r.cells]
        found += len(r.cells)
    return int(np.sort(places)[max(0, int(np.ceil(recall * found)) - 1)]) + 1


def opened(spark: SparkSession, path: str) -> VectorIndex:
    return VectorIndex(spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/cells"))
