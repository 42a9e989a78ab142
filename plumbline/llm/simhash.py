"""SimHash near-duplicates: fingerprints, and a forest of vantage-point trees.

A fingerprint has 64 bits; two documents are linked when theirs differ in at most
RADIUS bits, and a class is what links reach. Equal fingerprints meet in one
aggregation first, so copies never multiply.

The join over distinct fingerprints is exact. Random 64-bit fingerprints lie nearly
all 32 bits apart, where one tree with radius 3 prunes next to nothing (a query
crosses 1.6 of two branches at each level). So there are TREES trees, each over one
half of the bits: a pair within 3 bits is within 3 // 2 = 1 in some half, and there
a query crosses 1.27 of two branches. Each tree

* is fitted on a bounded sample of fingerprints on the driver (SAMPLE for each shard,
  SAMPLE * MOST_SHARDS at most): vantage points, and thresholds at the median distance;
* gives each fingerprint one home shard, and sends it besides to the shards that
  the triangle bound doesn't exclude (|d(x, v) - threshold| within the radius);
* is continued inside a shard, until pages are small enough to scan; where a half no
  longer divides them, by the whole fingerprint.

A shard returns links that connect what it found close, never all pairs.

``representatives`` finds texts whose sets of five-word shingles have a Jaccard similarity
of 0.8 or more. Such pairs lie 4 to 14 of 64 bits apart, where no tree over all documents
prunes anything. So there the shards are dealt out by min-hashes (BANDS keys of ROWS
min-hashes each: a pair of 0.8 shares one with a probability of 0.99, of 0.9 with 0.9999),
and the vantage-point trees work inside a shard, over WIDE words of fingerprint, with a
radius that such pairs exceed once in a million. What they find is compared by the whole
shingle sets. A shard of more than MOST sets is solved in parts, and to the end: leaders of
the classes found so far meet in new parts while that joins many, and then every part meets
every other, except those that hold one and the same class. So a group of near copies of
any size becomes one class at little cost; what grows with the square of a shard, in blocks,
are sets beyond MOST that share a key and are not alike.

Defined results: a null or blank text has fingerprint zero and is linked like any
other; texts of fewer words than a shingle have one shingle; repeated rows share
their class; a null doc_id takes part and is never the smallest. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.llm.common import written
from plumbline.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
TREES = 2
#: The trees are fitted on SAMPLE fingerprints for each shard, and on one in SAMPLE_RATE at most.
SAMPLE, SAMPLE_RATE = 8, 4
#: Fingerprints in a shard, about, and shards of a tree at most.
SHARD, MOST_SHARDS = 1024, 65536
#: Inside a shard, fingerprints that are compared without further branching.
PAGE = 1024
_CHUNK, ROWS_AT_ONCE = 1 << 14, 128
#: Near copies: words of a shingle, the least similarity of two shingle sets.
NEAR_SHINGLE, SIMILARITY = 5, 0.8
#: Keys of min-hashes, min-hashes of a key, documents of a shard that one task solves.
BANDS, ROWS, MOST = 9, 4, 4096
#: Words of a fingerprint, and the bits in which near copies differ at most (0.8: 39 of 256, give or take 6).
WIDE, WIDE_RADIUS = 4, 68
_ODD = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS + WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's word shingles, repeats included, in parts; letters A-Z count as lower case."""
    found = (text or "").encode().lower().split()
    if not found:
        return
    whole = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(found))
    digest, n = xxhash.xxh64_intdigest, len(found) - k + 1
    for at in range(0, n, _CHUNK):  # bounds the memory that a very long text takes
        to = min(n, at + _CHUNK)
        yield np.array([digest(whole[s:e], SEED) for s, e in zip(starts[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist())], np.uint64)


def majority(parts: Iterator[np.ndarray]) -> int:
    """The bits that are set in over half of the hashes."""
    bits, n = np.zeros(64, np.int64), 0
    for h in parts:
        bits += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **also: Column) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer, and the columns also."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *b.columns[2:]], names=names)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *(c.alias(k) for k, c in also.items()))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("fp", T.LongType()), *(rows.schema[k] for k in also)])
    names = schema.names
    return rows.mapInArrow(run, schema)


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b))


def wide_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for fingerprints of several words, which are the last axis."""
    return np.bitwise_count(np.bitwise_xor(a, b)).sum(axis=-1, dtype=np.int64)


def half(fps: np.ndarray, tree: int) -> np.ndarray:
    """The bits that a tree looks at."""
    width = 64 // TREES
    return (fps >> np.uint64(tree * width)) & np.uint64((1 << width) - 1)


class VantageTree:
    """The upper levels of a vantage-point tree: node i has a vantage point, a
    threshold and two children; a negative child -1-s stands for shard s."""

    def __init__(self, sample: np.ndarray, shard: int, radius: int):
        self.radius, self.nodes, self.shards = radius, [], 0
        self.root = self._grow(np.unique(sample), max(2, shard), np.random.default_rng(SEED))

    def _grow(self, points: np.ndarray, shard: int, rng: np.random.Generator) -> int:
        split = vantage(points, rng) if len(points) > shard else None
        if split is None:
            self.shards += 1
            return -self.shards
        v, at, d = split
        me = len(self.nodes)
        self.nodes.append(None)
        self.nodes[me] = (v, at, self._grow(points[d <= at], shard, rng), self._grow(points[d > at], shard, rng))
        return me

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, shards, and whether the shard is the row's home. A row visits, besides
        its home, those shards of a larger number that its ball may reach: of two close
        points in different shards, one visits the other's home."""
        out, todo = [], [(self.root, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            node, rows, home = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out.append((rows, np.full(len(rows), -1 - node), home))
                continue
            v, at, inner, outer = self.nodes[node]
            d = distance(points[rows], v).astype(np.int64)
            a, b = d <= at + self.radius, d > at - self.radius
            todo.append((inner, rows[a], home[a] & (d[a] <= at)))
            todo.append((outer, rows[b], home[b] & (d[b] > at)))
        rows, shards, home = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        own = np.zeros(len(points), np.int64)
        own[rows[home.astype(bool)]] = shards[home.astype(bool)]
        keep = home.astype(bool) | (shards > own[rows.astype(np.int64)])
        return rows[keep], shards[keep], home[keep].astype(bool)


def vantage(points: np.ndarray, rng: np.random.Generator, measure=distance) -> tuple[np.uint64, int, np.ndarray] | None:
    """Of a few points the one whose distances are most spread, its median distance,
    and all distances; None if no threshold divides the points."""
    best = None
    for v in points[rng.integers(0, len(points), 6)]:
        d = measure(points, v)
        at = int(np.median(d))
        at -= at == d.max()
        if d.min() <= at and (best is None or d.std() > best[2].std()):
            best = (v, at, d)
    return best


def _scan(fps: np.ndarray, home: np.ndarray, visit: np.ndarray, radius: int, measure=distance) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Close pairs of one page, in blocks: home with home, and visitors with home."""
    rows = max(1, (1 << 20 if measure is distance else 1 << 17) // max(1, len(home)))
    for at in range(0, len(home), rows):
        block = home[at : at + rows]
        i, j = np.nonzero(measure(fps[block][:, None], fps[home[at:]][None, :]) <= radius)
        keep = i < j
        yield block[i[keep]], home[at:][j[keep]]
    for at in range(0, len(visit), rows):
        block = visit[at : at + rows]
        i, j = np.nonzero(measure(fps[block][:, None], fps[home][None, :]) <= radius)
        yield block[i], home[j]


def close_pairs(fps: np.ndarray, keys: np.ndarray, home: np.ndarray, near: int, radius: int, measure=distance) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The vantage-point tree inside a shard. keys: the bits that the tree looks at,
    near: its radius. Branches go on until a page is small or can't be divided."""
    rng = np.random.default_rng(SEED)
    todo = [(np.flatnonzero(home), np.flatnonzero(~home), False)]
    while todo:
        h, v, whole = todo.pop()
        if not len(h) or len(h) + len(v) < 2:
            continue
        if len(h) <= PAGE:
            yield from _scan(fps, h, v, radius, measure)
            continue
        seen, reach = (fps, radius) if whole else (keys, near)
        split = vantage(seen[h], rng, measure)
        if split is None or max((split[2] <= split[1]).sum(), (split[2] > split[1]).sum()) > 0.9 * len(h):
            if whole:
                yield from _scan(fps, h, v, radius, measure)
            else:  # equal, or nearly so, in the bits that the tree looks at
                todo.append((h, v, True))
            continue
        p, at, dh = split
        dv = measure(seen[v], p).astype(np.int64)
        dh = dh.astype(np.int64)
        # Of two home points on different sides, the outer one visits the inner side.
        todo.append((h[dh <= at], np.concatenate((v[dv <= at + reach], h[(dh > at) & (dh <= at + reach)])), whole))
        todo.append((h[dh > at], v[dv > at - reach], whole))


def connect(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n items the smallest item that the pairs join it to."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            keep = a != b
            if not keep.any():
                break
            i, j = i[keep], j[keep]
            np.minimum.at(root, np.maximum(a, b)[keep], np.minimum(a, b)[keep])
            while not np.array_equal(root[root], root):
                root = root[root]
    return root


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fps: a written table of distinct fingerprints fp. Gives links (a, b) whose
    classes are those of all pairs within the radius."""
    n = fps.count()
    near = radius // TREES
    shards = int(min(MOST_SHARDS, max(1, n // SHARD)))
    drawn = fps.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE_RATE)) == 0).orderBy(F.xxhash64("fp", F.lit(1))).limit(max(1024, SAMPLE * shards))
    sample = np.array([r.fp for r in drawn.select("fp").collect()], np.int64).view(np.uint64)
    trees = [VantageTree(half(sample, t), -(-len(sample) // shards), near) for t in range(TREES)]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for t, tree in enumerate(trees):
                rows, shard, home = tree.route(half(x, t))
                cols = [pa.array(shard * TREES + t, pa.int64()), pa.array(x[rows].view(np.int64)), pa.array(home)]
                yield pa.RecordBatch.from_arrays(cols, names=["shard", "fp", "home"])

    def solve(key: tuple, group: pa.Table) -> pa.Table:
        x = group.column("fp").to_numpy().view(np.uint64)
        home = group.column("home").to_numpy()
        root = connect(len(x), close_pairs(x, half(x, key[0].as_py() % TREES), home, near, radius))
        i = np.flatnonzero(root != np.arange(len(x)))
        return pa.table({"a": x[i].view(np.int64), "b": x[root[i]].view(np.int64)})

    routed = fps.select("fp").mapInArrow(route, "shard long, fp long, home boolean")
    return routed.groupBy("shard").applyInArrow(solve, "a long, b long")


def _grouped(marked: DataFrame, first: Column, radius: int) -> DataFrame:
    """marked: a written table of rows with fp. Gives each fp with its class root, and the aggregate first of its rows."""
    fps = written(marked.groupBy("fp").agg(first.alias("first")), "distinct")
    roots = components(links(fps, radius))
    # Few fingerprints have neighbours; the others are their own class.
    return fps.join(roots, fps.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id, a row for each row of docs."""
    marked = written(fingerprints(docs, doc_id, text), "fingerprints")
    grouped = _grouped(marked, F.min("doc_id"), radius)
    least = written(grouped.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")), "classes")
    named = grouped.join(least.where("n > 1").drop("n"), "root", "left")
    named = written(named.select("fp", F.coalesce("component_id", "first").alias("component_id")), "named")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def shingle_set(text: str | None, shingle: int = NEAR_SHINGLE) -> np.ndarray:
    """The different shingle hashes of a text, ascending."""
    parts = [np.unique(h) for h in shingle_hashes(text, shingle)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def min_keys(found: np.ndarray) -> list[int]:
    """A key for each band: its ROWS least hashes under odd multipliers, as one."""
    if not len(found):
        return []
    least = [int((found * m).min()) for m in _ODD[: BANDS * ROWS]]
    return [int.from_bytes(xxhash.xxh64_digest(np.array(least[i * ROWS : (i + 1) * ROWS], "<u8").tobytes(), i), "little", signed=True) for i in range(BANDS)]


def slim(found: np.ndarray) -> np.ndarray:
    """The set by the upper halves of its hashes, ascending: what is compared. Two of a
    text's shingles share one once in 2 ** 32 pairs."""
    return np.unique((found >> np.uint64(32)).astype(np.uint32))


def wide_print(found: np.ndarray) -> np.ndarray:
    """The SimHash of a shingle set, WIDE words: each of the hashes mixed in its own way."""

    def mixed(m: np.uint64) -> Iterator[np.ndarray]:
        for at in range(0, len(found), _CHUNK):
            h = found[at : at + _CHUNK]
            h = (h ^ (h >> np.uint64(31))) * m
            yield h ^ (h >> np.uint64(29))

    return np.array([majority(mixed(m)) for m in _ODD[BANDS * ROWS :]], np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def alike(prints: np.ndarray, sets: list[np.ndarray], least: float, known: list[int] | None = None) -> np.ndarray:
    """For each document of a shard the first one that similar pairs join it to. known:
    for each document an earlier one, or itself, that it is joined to already."""
    root = list(range(len(sets))) if known is None else list(known)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in close_pairs(prints, prints, np.ones(len(sets), bool), WIDE_RADIUS, WIDE_RADIUS, wide_distance):
        flat = np.array([find(x) for x in range(len(sets))])
        apart = flat[i] != flat[j]
        for x, y in zip(i.compress(apart).tolist(), j.compress(apart).tolist()):
            a, b = find(x), find(y)
            # The sizes bound the similarity; joined documents need no comparison.
            if a != b and min(len(sets[x]), len(sets[y])) >= least * max(len(sets[x]), len(sets[y])) and similarity(sets[x], sets[y]) >= least:
                root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(len(sets))])


_SHARD = ["band", "key"]


def _solved(rows: DataFrame, details: DataFrame, least: float, by: list[str]) -> DataFrame:
    """Links (a, b) that join the alike sets of each group, written. rows: node, class (that
    of nodes joined already) and the columns of by."""

    def solve(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        nodes, classes = group.column("node").to_pylist(), group.column("class").to_pylist()
        first: dict[str, int] = {}
        known = [first.setdefault(c, i) for i, c in enumerate(classes)]
        prints = np.array([np.frombuffer(x.as_py(), "<u8") for x in group.column("print")], np.uint64).reshape(len(group), WIDE)
        root = alike(prints, [np.frombuffer(x.as_py(), "<u4") for x in group.column("shingles")], least, known)
        # One link for each class that joined another.
        new = [i for i in sorted(first.values()) if root[i] != i]
        return pa.table({"a": pa.array([nodes[i] for i in new], pa.string()), "b": pa.array([nodes[root[i]] for i in new], pa.string())})

    whole = rows.join(details, "node").select(*by, "node", "class", "print", "shingles")
    return written(whole.groupBy(*by).applyInArrow(solve, "a string, b string"), "solved")


def _classed(members: DataFrame, found: DataFrame) -> DataFrame:
    """members with the class that the links found so far give them."""
    roots = components(found)
    return written(members.join(roots, "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root"), "classed")


def near_links(marked: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """marked: a written table with node (a digest of the shingle set), keys, print and
    shingles. Gives links (a, b) between the nodes of similar sets, never all pairs. Only
    the sets of documents that share a key with another are dealt out."""
    members = marked.select("node", F.posexplode("keys").alias("band", "key")).distinct()
    counts = members.groupBy(*_SHARD).agg(F.count("*").alias("n")).where("n > 1")
    shared = written(members.join(written(counts, "counts"), _SHARD), "shared")
    if shared.isEmpty():
        return marked.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")
    # Of each node once, before anything is dealt out: copies don't gather in a task.
    once = marked.groupBy("node").agg(F.first("print").alias("print"), F.first("shingles").alias("shingles"))
    details = written(once.join(shared.select("node").distinct(), "node", "left_semi"), "details")
    part = F.pmod(F.xxhash64("node", "band"), F.ceil(F.col("n") / MOST))
    found = [_solved(shared.withColumns({"part": part, "class": F.col("node")}), details, least, [*_SHARD, "part"])]
    hot = written(shared.where(F.col("n") > MOST).drop("n"), "hot")

    def linked() -> DataFrame:
        out = found[0]
        for df in found[1:]:
            out = out.unionByName(df)
        return out.distinct()

    if hot.isEmpty():
        return linked()
    turn = 0
    while True:
        # The least node of each class, in shards that are not one class yet.
        classed = _classed(hot, linked())
        leaders = classed.groupBy(*_SHARD, "class").agg(F.min("node").alias("node"))
        left = leaders.groupBy(*_SHARD).agg(F.count("*").alias("n")).where("n > 1")
        leaders = written(leaders.join(written(left, "left"), _SHARD), "leaders")
        if leaders.isEmpty():
            return linked()
        turn += 1
        part = F.pmod(F.xxhash64("node", "band", F.lit(turn)), F.ceil(F.col("n") / MOST))
        new = _solved(leaders.withColumn("part", part), details, least, [*_SHARD, "part"])
        found.append(new)
        # While a round joins a tenth of the leaders, another one is cheaper than all parts.
        if 10 * new.count() < leaders.count():
            break
    found.append(_crossed(_classed(hot, linked()), details, least))
    return linked()


def _crossed(classed: DataFrame, details: DataFrame, least: float) -> DataFrame:
    """Links between the sets of shards that are solved in parts: every part with every
    other. Classes that fill a part have parts of their own, which don't meet each other."""
    size = MOST // 2
    sizes = classed.groupBy(*_SHARD, "class").agg(F.count("*").alias("n"))
    large = F.when(F.col("n") >= size, F.col("class")).otherwise("")
    parts = sizes.withColumn("own", large).groupBy(*_SHARD, "own").agg(F.ceil(F.sum("n") / size).alias("parts"))
    many = written(sizes.where(F.col("n") >= size).select(*_SHARD, "class", F.lit(True).alias("large")), "large")
    parts = written(parts, "parts")
    place = F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts"))
    rows = classed.join(many, [*_SHARD, "class"], "left").withColumn("own", F.when(F.col("large"), F.col("class")).otherwise(""))
    rows = rows.join(parts, [*_SHARD, "own"]).select(*_SHARD, "node", "class", F.struct("own", place.alias("place")).alias("part"))
    each = parts.select(*_SHARD, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda i: F.struct("own", i.alias("place")))).alias("part"))
    # A row for two parts, not for two sets.
    one, two = each.withColumnRenamed("part", "one"), each.withColumnRenamed("part", "two")
    both = one.join(two, _SHARD).where((F.col("one") < F.col("two")) & ((F.col("one.own") != F.col("two.own")) | (F.col("one.own") == "")))
    alone = parts.groupBy(*_SHARD).agg(F.sum("parts").alias("n")).where("n = 1").join(each, _SHARD).select(*_SHARD, F.col("part").alias("one"), F.col("part").alias("two"))
    pairs = both.unionByName(alone)
    sent = pairs.select(*_SHARD, "one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("part"))
    return _solved(sent.join(rows, [*_SHARD, "part"]), details, least, [*_SHARD, "one", "two"])


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = NEAR_SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """docs without all but one document of each class of near copies: that of the smallest
    id, null ids last. Of rows that repeat this id, the one of the smallest hash stays.
    Texts without words are copies of each other; those of fewer words than a shingle are
    copies if all their words agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A few rows at a time: their sets are several times their texts.
        for b in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
            sets = [shingle_set(t.as_py(), shingle) for t in b.column(1)]
            raw = [x.astype("<u8").tobytes() for x in sets]
            cols = [
                pa.array([xxhash.xxh3_128_hexdigest(x) for x in raw]), pa.array([min_keys(x) for x in sets], pa.list_(pa.int64())),
                pa.array([wide_print(x).astype("<u8").tobytes() for x in sets]), pa.array([slim(x).astype("<u4").tobytes() for x in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *cols], names=["doc_id", "said", "node", "keys", "print", "shingles"])

    said = F.coalesce(F.md5(F.col(text).cast("string")), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), said.alias("said"))
    made = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("said string, node string, keys array<bigint>, print binary, shingles binary").fields])
    marked = written(rows.mapInArrow(run, made), "shingles")
    roots = components(near_links(marked, least))
    # A class is its root, not its smallest id: ids may be null or repeat in other classes.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "said")).alias("first")
    nodes = marked.groupBy("node").agg(first).withColumnRenamed("node", "_node")
    keep = nodes.join(roots, nodes._node == roots.node, "left").groupBy(F.coalesce("root", "_node").alias("root")).agg(F.min("first").alias("first"))
    keep = keep.select(_key("first.doc_id").alias("_key"), F.col("first.said").alias("_said"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), _key(doc_id).alias("_key"), said.alias("_said"))
    # Join and window have one key, so texts are dealt out once. Only rows of one id and text meet in it.
    same = Window.partitionBy("_key", "_said").orderBy(F.lit(1))
    kept = rows.join(written(keep, "keep"), ["_key", "_said"], "left_semi")
    return kept.withColumn("_n", F.row_number().over(same)).where("_n = 1").select("_row.*")


def _key(doc_id: str) -> Column:
    """An id as a string that is never null."""
    return F.when(F.col(doc_id).isNull(), "").otherwise(F.concat(F.lit("="), F.col(doc_id).cast("string")))
