"""Filter interaction audit: what every order of some filters would remove, from one count.

Each document gets a mask of the filters that it fails. Counts of masks by part are all that
the audit needs: a superset-zeta transform turns them into the survivors of every subset of
the filters (those whose mask avoids the subset), with one pass for each filter instead of a
sum for each subset. A step of an order then is the difference between the survivors of two
neighbouring subsets, the filters before it and those with it; the same holds for documents
that are labelled good or toxic. So 120 orders of five filters cost 32 counters for a part.

Filters are named conditions; ``document_filters`` are those of the query. Whether a text
repeats one of a smaller id is found by its SHA-256: the least id of each digest, in one
aggregation, joined back for digests that occur more than once. Hot digests and parts meet
only in aggregations and in a plain join, which Spark divides where it is skewed.

Defined results: a null text is empty; a null part is the empty string; a null id is never
smaller than another, has no smaller one and no label; rows that repeat an id and a text do
not fail for each other; of repeated labels of an id, any counts; an empty table gives an
empty result; columns beside id, text and part play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, whole, words, written

#: The limits of the filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 50, 65, 5, "[#$%&*|]"
COUNTS = ("n", "good", "toxic")


def document_filters(text: str = "text") -> dict[str, Column]:
    """Failure conditions of single documents, by letter."""
    t = whole(F.col(text).cast("string"))
    n = F.regexp_count(t, F.lit(WORD))
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words(t))) < LEAST_DISTINCT * n,
        "C": 100 * F.regexp_count(t, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(t),
        "D": t.rlike(SIGNS),
    }


def masked(docs: DataFrame, filters: dict[str, Column], repeats: str | None = "E", doc_id: str = "doc_id", text: str = "text", part: str = "source") -> tuple[DataFrame, str]:
    """doc_id, part and mask (bit i: the i-th filter fails), and the filters' letters in
    order. repeats: the letter of the filter that a text fails if a smaller id has it."""
    letters = "".join(filters)
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(filters.values())), F.lit(0))
    digest = F.unhex(F.sha2(whole(F.col(text).cast("string")), 256))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), bits.alias("mask"), *([digest.alias("digest")] if repeats else []))
    if not repeats:
        return rows, letters
    rows = written(rows, "masks")  # texts are read once
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    # Both sides are plain tables, so that Spark can divide a digest of many copies.
    rows = rows.join(written(first, "repeated"), "digest", "left")
    return rows.select("doc_id", "part", (F.col("mask") + F.when(again, 1 << len(letters)).otherwise(0)).alias("mask")), letters + repeats


def labelled(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """rows with good and toxic (0 or 1)."""
    each = labels.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return rows.join(each, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in COUNTS[1:]})


def counted(rows: DataFrame) -> DataFrame:
    """part, mask and the counts: all that is kept of the documents."""
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.sum(c).cast("long").alias(c) for c in COUNTS[1:]))


def survivors(counts: np.ndarray) -> np.ndarray:
    """counts: over masks, the last axis. For each subset of the filters, the sum over the
    masks that avoid it: a zeta transform over subsets of the complement."""
    f = counts.copy()
    n = f.shape[-1].bit_length() - 1
    for b in range(n):
        halves = f.reshape(*f.shape[:-1], -1, 2, 1 << b)
        # Afterwards index bit b says that filter b is *allowed* to fail.
        halves[..., 1, :] += halves[..., 0, :]
    return f[..., ::-1]  # the complement of s stands at the mirrored place


def orders(letters: str) -> list[tuple[str, int, int, int]]:
    """(order, step, subset before, filter's place) of every step of every order."""
    out = []
    for order in permutations(letters):
        before = 0
        for step, c in enumerate(order):
            at = letters.index(c)
            out.append(("".join(order), step + 1, before, at))
            before |= 1 << at
    return out


def steps(counts: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order and step: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley. counts: as counted() gives them."""
    size, n = 1 << len(letters), len(letters)
    plan = orders(letters)
    before, at = np.array([p[2] for p in plan]), np.array([p[3] for p in plan])
    after = before | (1 << at)
    names, places = pa.array([p[0] for p in plan]), pa.array([p[1] for p in plan], pa.int32())
    # How many orders have a given subset before a given filter.
    weight = np.array([factorial(bin(s).count("1")) * factorial(n - 1 - bin(s).count("1")) if s != size - 1 else 0 for s in range(size)])
    pairs = [(np.array([s for s in range(size) if not s >> i & 1]), i) for i in range(n)]
    everything = size - 1
    result = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for k in range(whole_batch.num_rows):  # a part has n! * n rows of its own
                b = whole_batch.slice(k, 1)
                table = np.zeros((len(COUNTS), size), np.int64)
                rows = b.column("rows")[0].values
                table[:, rows.field("mask").to_numpy()] = [rows.field(c).to_numpy() for c in COUNTS]
                f, good, toxic = survivors(table)
                alone = f[0] - f[1 << np.arange(n)]
                unique = f[everything ^ (1 << np.arange(n))] - f[everything]
                shapley = np.array([(weight[s] * (f[s] - f[s | 1 << i])).sum() for s, i in pairs])
                removed = f[before] - f[after]
                cols = [f[after], removed, alone[at] - removed, unique[at], good[before] - good[after], toxic[before] - toxic[after], shapley[at]]
                part = pa.array([b.column("part")[0].as_py()] * len(plan), pa.string())
                yield pa.RecordBatch.from_arrays([part, names, places, *(pa.array(c, pa.int64()) for c in cols)], names=["part", "filter_order", "step", *result])

    # At most one row for each mask in a part's list.
    each = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("rows"))
    return each.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in result))


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, repeats: str | None = "E", doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Every step of every order of the filters, by part."""
    rows, letters = masked(docs, filters if filters is not None else document_filters(text), repeats, doc_id, text, part)
    return steps(counted(labelled(rows, labels, doc_id)), letters)
