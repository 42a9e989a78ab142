"""Retrieval as set-oriented plans: a table of queries against a table of texts.

Every function takes visible texts only (see access.visible) and any number of
queries. Ties are broken by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import text
from plumbline.operators import expansion
from plumbline.sources.stores import stored

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K, VECTOR_WEIGHT, BM25_WEIGHT = 60, 0.7, 0.3
TOP_K, RERANK_K = 30, 10
#: Folders of postings.
BUCKETS = 64
#: The most queries that are sent to every task. Beyond it, Spark chooses the joins.
MOST_BROADCAST = 10_000
#: The most texts of a block and the fewest, and its most queries, where there are many of both.
BLOCK, LEAST_BLOCK, QUERIES = 20_000, 1000, 200_000
#: The most different tokens that are sent to every task.
MOST_TOKENS = 500_000
#: In a block, tokens that more than this share of texts have are kept by text, so many at most;
#: the cells in which its best sums are sought; and what sums may err by with each token, as a share.
DENSE, MOST_DENSE, CELLS, ERROR = 0.04, 512, 256, 2e-7


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df, to be broadcast if it has no more rows than this."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def top(df: DataFrame, k: int, score: str, by: str = "qid", tie: str = "id", rank: str = "rank") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


# -- BM25 ------------------------------------------------------------------------


@dataclass(frozen=True)
class Index:
    """A stored BM25 index. postings: bucket, token, id, tf, in folders by bucket of the
    token; tokens: bucket, token, n_docs_with, idf; lengths: id, dl of every text; stats:
    one row of n_docs, avgdl, n_tokens, mean_idf. key: what names a text in postings and
    lengths; postings of texts that lengths don't have are passed over."""

    postings: DataFrame
    tokens: DataFrame
    lengths: DataFrame
    stats: DataFrame
    key: tuple[str, ...] = ("id",)


def bucket(token: Column | str = "token") -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def build_index(texts: DataFrame, path: str | None = None, rows: Callable[[DataFrame], DataFrame] = text.token_rows, epsilon: float = EPSILON) -> Index:
    """texts: id and text. They are tokenised once, by rows; all else is read from the
    postings, which are dealt out by token with large buckets divided. Written under
    path, or in the shared folder."""
    # Texts are dealt out by id before they are cut, so that their many tokens are counted where they are.
    counts = rows(texts.select("id", "text").repartition("id")).groupBy("id", "token").agg(F.count("*").alias("tf"))
    placed = counts.select("token", "id", F.col("tf").cast("int").alias("tf"), bucket().alias("bucket"))
    postings = stored(placed.hint("rebalance", "bucket"), "postings", path, "bucket")
    every = postings.select("id", "tf").unionByName(texts.select("id", F.lit(0).alias("tf")))
    lengths = stored(every.groupBy("id").agg(F.sum("tf").alias("dl")), "lengths", path)
    n = lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    vocab = postings.groupBy("bucket", "token").agg(F.count("*").alias("n_docs_with"))
    tokens, stats = rated_tokens(vocab, n, path, epsilon)
    return Index(postings, tokens, lengths, stored(stats, "stats", path))


def rated_tokens(vocab: DataFrame, totals: DataFrame, path: str | None = None, epsilon: float = EPSILON) -> tuple[DataFrame, DataFrame]:
    """vocab: bucket, token, n_docs_with; totals: one row of n_docs, avgdl. Gives the tokens
    with their idf, and the row of statistics. Idf below zero becomes a share of the mean."""
    df = F.col("n_docs_with")
    # One row of totals.
    rated = stored(vocab.join(F.broadcast(totals), F.lit(True)).withColumn("raw", F.log(F.col("n_docs") - df + 0.5) - F.log(df + 0.5)), "rated", path)
    mean = rated.agg(F.count("*").alias("n_tokens"), F.avg("raw").alias("mean_idf"))
    stats = totals.join(F.broadcast(mean), F.lit(True))
    idf = F.when(F.col("raw") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("raw"))
    tokens = rated.join(F.broadcast(mean.select("mean_idf")), F.lit(True)).select("bucket", "token", "n_docs_with", idf.alias("idf"))
    return tokens, stats


def open_index(spark: SparkSession, path: str, epsilon: float = EPSILON) -> Index:
    """An index that build_index wrote under path."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    stats = read("stats")
    idf = F.when(F.col("raw") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("raw"))
    tokens = read("rated").join(F.broadcast(stats.select("mean_idf")), F.lit(True)).select("bucket", "token", "n_docs_with", idf.alias("idf"))
    return Index(read("postings"), tokens, read("lengths"), stats)


def bm25(index: Index, queries: DataFrame, tokenizer: Callable[[Column], Column] = text.tokens, k1: float = K1, b: float = B) -> DataFrame:
    """qid, id, score of the texts that share a token with the query. queries: qid and
    query. A token that a query repeats counts as often. Only folders with an asked
    token are read, as the asked tokens are broadcast where they are few."""
    asked = small(asked_tokens(queries, tokenizer))
    hits = index.postings.join(asked, ["bucket", "token"]).join(index.tokens.drop("n_docs_with"), ["bucket", "token"])
    # Rounded, so that ties do not depend on the order in which parts are added.
    return _parts(index, hits, k1, b).groupBy("qid", "id").agg(F.round(F.sum(F.col("part") * F.col("n_q")), 9).alias("score"))


def asked_tokens(queries: DataFrame, tokenizer: Callable[[Column], Column] = text.tokens) -> DataFrame:
    """qid, token, n_q (how often the query has it) and the token's bucket."""
    counts = queries.select("qid", F.explode(tokenizer(F.col("query"))).alias("token")).groupBy("qid", "token").agg(F.count("*").alias("n_q"))
    return counts.withColumn("bucket", bucket())


def _parts(index: Index, hits: DataFrame, k1: float, b: float) -> DataFrame:
    """hits (postings with idf) with part: what the token adds to the score of its text."""
    rated = hits.join(index.lengths, list(index.key)).join(F.broadcast(index.stats.select("avgdl")), F.lit(True))
    return rated.withColumn("part", F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))))


def bm25_single(index: Index, asked: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """qid, id, score of the k best texts of each query that has one token. The best texts are
    sought once for each token, k of them kept in every task, so the rows are those of its
    postings, however many queries there are. asked: as asked_tokens() gives it."""
    words = asked.select("bucket", "token", "n_q").distinct()
    hits = index.postings.join(words, ["bucket", "token"]).join(index.tokens.drop("n_docs_with"), ["bucket", "token"])
    rated = _parts(index, hits, k1, b).select("token", "n_q", "id", F.round(F.col("part") * F.col("n_q"), 9).alias("score"))
    order = Window.partitionBy("token", "n_q").orderBy(F.desc("score"), "id")
    best = rated.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
    return asked.select("qid", "token", "n_q").join(best, ["token", "n_q"]).select("qid", "id", "score")


class _Texts:
    """The postings of a block of texts in memory, by text and by token. texts: seg, id, code
    and tf of each posting, and of each living text a row of code -1 with its length as tf."""

    def __init__(self, texts: pa.Table, k1: float, b: float, avgdl: float):
        own = texts.filter(pc.less(texts["code"], 0)).sort_by("id")
        self.ids, segs, dl = (own[c].to_numpy() for c in ("id", "seg", "tf"))
        self.words = np.unique(texts["code"].to_numpy())
        self.words = self.words[self.words >= 0]
        docs, cols, gains = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0)]
        # Batch by batch, as few numbers of a posting are kept.
        for batch in texts.to_batches() if len(own) else []:
            seg, ids, code, tf = (batch[c].to_numpy() for c in ("seg", "id", "code", "tf"))
            doc = np.minimum(np.searchsorted(self.ids, ids), len(own) - 1)
            # Postings of texts that are gone are passed over.
            alive = (code >= 0) & (self.ids[doc] == ids) & (segs[doc] == seg)
            doc, tf = doc[alive], tf[alive]
            docs.append(doc.astype(np.int32))
            cols.append(np.searchsorted(self.words, code[alive]).astype(np.int32))
            gains.append(tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[doc] / avgdl)))
        doc, col, gain = np.concatenate(docs), np.concatenate(cols), np.concatenate(gains)
        del docs, cols, gains
        key = doc.astype(np.int64) * max(1, len(self.words)) + col
        order = np.argsort(key, kind="stable")
        key = key[order]
        # What a text repeats is added up, so that it stands once under a token.
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else order
        self.gain = np.add.reduceat(gain[order], first) if len(key) else gain
        doc, col = doc[order][first], col[order][first]
        del key, order, first, gain
        self.col, self.row = col, np.append(0, np.cumsum(np.bincount(doc, minlength=len(own))))
        n = np.bincount(col, minlength=len(self.words))
        # Sums are taken in cells of neighbouring texts, so many that the best of each bound the k-th score.
        self.width = max(1, len(own) // CELLS)
        self.sums, self.weight = np.zeros(-(-len(own) // self.width) * self.width, np.float32), np.zeros(len(self.words))
        often = np.argsort(-n, kind="stable")[:MOST_DENSE]
        often = often[n[often] > len(own) * DENSE]
        self.line = np.full(len(self.words), -1)
        self.line[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), len(self.sums)), np.float32)
        line = self.line[col]
        at = np.flatnonzero(line >= 0)
        self.dense[line[at], doc[at]] = self.gain[at]
        at = np.flatnonzero(line < 0)
        at = at[np.argsort(col[at], kind="stable")]
        self.doc, self.about = doc[at], self.gain[at].astype(np.float32)
        n[often] = 0
        self.start = np.append(0, np.cumsum(n))

    def add(self, c: int, w: float) -> None:
        """Adds what a token gives to the sums of its texts."""
        if self.line[c] >= 0:
            self.sums += self.dense[self.line[c]] * np.float32(w)
        else:
            at = slice(self.start[c], self.start[c + 1])
            self.sums[self.doc[at]] += self.about[at] * np.float32(w)

    def having(self, c: int) -> np.ndarray:
        """The texts that have a token."""
        return np.flatnonzero(self.dense[self.line[c]]) if self.line[c] >= 0 else self.doc[self.start[c] : self.start[c + 1]]

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Whole scores of texts, of one at least, by the weights that are set."""
        n = self.row[docs + 1] - self.row[docs]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(self.row[docs] - ends + n, n)
        return np.add.reduceat(self.weight[self.col[at]] * self.gain[at], ends - n)

    def best(self, cols: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best texts of a query. Sums of less precision tell which
        texts may be among them, by more than they can err; those are scored."""
        self.weight[cols] = weights
        if weights.min() > 0:
            for c, w in zip(cols.tolist(), weights.tolist()):
                self.add(c, w)
            tops = self.sums.reshape(-1, self.width).max(axis=1)
            least = float(np.partition(tops, -k)[-k]) if len(tops) > k else 0.0
            hit = np.flatnonzero(self.sums >= np.float32(max(least * (1 - ERROR * (len(cols) + 10)) - 1e-8, 1e-30)))
            self.sums.fill(0)
        else:
            hit = np.unique(np.concatenate([self.having(c) for c in cols]))
        score = np.round(self.scores(hit), 9) if len(hit) else np.zeros(0)
        self.weight[cols] = 0
        if len(hit) > k:
            kept = score >= np.partition(score, -k)[-k]
            hit, score = hit[kept], score[kept]
        order = np.lexsort((self.ids[hit], -score))[:k]
        return self.ids[hit[order]], score[order]


def bm25_blocks(index: Index, asked: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """qid, id, score of the k best texts of each query, for many queries. Queries of the same
    tokens are answered once. Texts are dealt into blocks, and all queries, as rows of numbers,
    come to each block, whose task keeps k rows for each. So a posting is dealt out once (once
    for each QUERIES different queries), and no row is made for a pair of query and text.
    asked: as asked_tokens() gives it."""
    spark, stats = asked.sparkSession, index.stats.head()  # one row
    # Small tables have as many blocks as keep all cores busy, unless these would have few texts.
    left = max(-(-stats.n_docs // BLOCK), min(2 * spark.sparkContext.defaultParallelism, -(-stats.n_docs // LEAST_BLOCK)), 1)
    wanted = asked.select("bucket", "token").distinct().join(index.tokens.drop("n_docs_with"), ["bucket", "token"])
    wanted = stored(wanted.withColumn("code", F.monotonically_increasing_id()), "wanted")
    words = F.array_sort(F.collect_list(F.struct("code", (F.col("idf") * F.col("n_q")).alias("weight"))))
    bags = asked.join(wanted, ["bucket", "token"]).groupBy("qid").agg(words.alias("w"))
    bags = stored(bags.select("qid", F.col("w.code").alias("codes"), F.col("w.weight").alias("weights")), "bags")
    once = stored(bags.groupBy("codes", "weights").agg(F.min("qid").alias("first")), "bags")
    right = max(-(-once.count() // QUERIES), 1)

    names = [c for c in index.key if c != "id"]
    hits = index.postings.join(small(wanted.select("bucket", "token", "code"), MOST_TOKENS), ["bucket", "token"])
    rows = hits.select(*names, "id", "code", F.col("tf").cast("int").alias("tf"))
    rows = rows.unionByName(index.lengths.select(*names, "id", F.lit(-1).cast("long").alias("code"), F.col("dl").cast("int").alias("tf")))
    if names:
        # A row for each segment, by a number.
        rows = rows.join(F.broadcast(index.lengths.select(*names).distinct().withColumn("seg", F.row_number().over(Window.orderBy(*names)))), names)
    else:
        rows = rows.withColumn("seg", F.lit(0))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    texts = rows.select(place("id", left).alias("x"), every(right).alias("y") if right > 1 else F.lit(0).alias("y"), "seg", "id", "code", "tf")
    queries = once.select(every(left).alias("x"), place("first", right).alias("y"), "first", "codes", "weights")
    kind, avgdl = asked.schema["qid"].dataType.simpleString(), stats.avgdl

    def run(texts: pa.Table, queries: pa.Table) -> pa.Table:
        ids, scores, sizes = [np.zeros(0, np.int64)], [np.zeros(0)], np.zeros(queries.num_rows, np.int64)
        if texts.num_rows and queries.num_rows:
            block = _Texts(texts, k1, b, avgdl)
            codes, weights = (queries[c].combine_chunks() for c in ("codes", "weights"))
            query = np.repeat(np.arange(len(codes)), codes.value_lengths().to_numpy(zero_copy_only=False))
            codes, weights = codes.flatten().to_numpy(), weights.flatten().to_numpy()
            cols = np.searchsorted(block.words, codes)
            known = np.append(block.words, -1)[cols] == codes
            query, cols, weights = query[known], cols[known], weights[known]
            starts = np.searchsorted(query, np.arange(queries.num_rows + 1))
            for i in np.unique(query):
                at = slice(starts[i], starts[i + 1])
                found, score = block.best(cols[at], weights[at], k)
                ids.append(found)
                scores.append(score)
                sizes[i] = len(found)
        first = queries["first"].take(pa.array(np.repeat(np.arange(queries.num_rows), sizes)))
        return pa.table({"first": first, "id": pa.array(np.concatenate(ids)), "score": pa.array(np.concatenate(scores))})

    found = texts.groupBy("x", "y").cogroup(queries.groupBy("x", "y")).applyInArrow(run, f"first {kind}, id long, score double")
    same = bags.join(once, ["codes", "weights"]).select("qid", "first")
    return same.join(top(found, k, "score", by="first"), "first").select("qid", "id", "score")


def bm25_top(index: Index, queries: DataFrame, k: int = TOP_K, tokenizer: Callable[[Column], Column] = text.tokens, **how) -> DataFrame:
    """The k best texts of each query; texts without a common token fill up with score
    0, in order of their ids. Those are sought among the first 2k ids only, as fewer
    than k of them can be hits where filling is needed."""
    asked = asked_tokens(queries, tokenizer)
    if asked.limit(MOST_BROADCAST + 1).count() > MOST_BROADCAST:
        asked = stored(asked, "asked")
        n = asked.groupBy("qid").agg(F.count("*").alias("n"))
        one = bm25_single(index, asked.join(n.where("n = 1").select("qid"), "qid", "left_semi"), k, **how)
        rest = stored(asked.join(n.where("n > 1").select("qid"), "qid", "left_semi"), "asked")
        scored = one.unionByName(bm25_blocks(index, rest, k, **how)) if rest.head() else one
    else:
        scored = bm25(index, queries, tokenizer, **how)
    best = top(scored, k, "score").drop("rank")
    first = index.lengths.select("id").orderBy("id").limit(2 * k)
    fill = first.join(small(queries.select("qid")), F.lit(True)).join(best, ["qid", "id"], "left_anti").withColumn("score", F.lit(0.0))
    return top(best.unionByName(fill.select("qid", "id", "score")), k, "score")


def with_positions(hits: DataFrame, index: Index) -> DataFrame:
    """hits with position: the place of the text in the corpus by id, from 1. Each id of the
    corpus counts for the first hit that is not before it, in its own task; a hit's place is the
    sum up to it. ids: whole numbers; those of the hits, a few for each query, go to every task."""
    hits = stored(hits, "hits")
    ids = sorted(r.id for r in hits.select("id").distinct().collect())
    steps = np.array(ids, np.int64)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(steps, b.column(0).to_numpy(zero_copy_only=False))
            slot, n = np.unique(at, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n)], names=["slot", "n"])

    counts = index.lengths.select(F.col("id").cast("long").alias("id")).mapInArrow(slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    places, total = [], 0
    found = {r.slot: r.n for r in counts.where(F.col("slot") < len(ids)).collect()}  # a row for each hit
    for slot, i in enumerate(ids):
        total += found.get(slot, 0)
        places.append((i, total))
    return hits.join(small(hits.sparkSession.createDataFrame(places, "id long, position long")), "id")


# -- vectors ---------------------------------------------------------------------


def norm(v: str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def vector_top(vectors: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """Exact cosine similarity of every vector and query, for few of either; VectorIndex.top
    gives the same of many. vectors: id, v. queries: qid, qv. Each task keeps k rows of
    each query before the shuffle."""
    right = small(queries.select("qid", "qv").withColumn("qn", norm("qv")))
    left = vectors.select("id", "v").withColumn("n", norm("v"))
    dot = F.aggregate(F.zip_with("v", "qv", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    scored = left.join(right, F.lit(True)).select("qid", "id", F.round(dot / (F.col("n") * F.col("qn")), 9).alias("score"))
    return top(scored, k, "score")


# -- fusion, calibration, thresholds -----------------------------------------------


def rrf(vector: DataFrame, words: DataFrame, w_vector: float = VECTOR_WEIGHT, w_words: float = BM25_WEIGHT, k: int = RRF_K) -> DataFrame:
    """Sides with qid, id, rank, score. Sums w / (k + rank) over the sides; the score is
    the vector side's where it has the text."""
    side = lambda df, w, t: df.select("qid", "id", (F.lit(w) / (k + F.col("rank"))).alias("part"), F.lit(t).alias("side"), "score")
    both = side(vector, w_vector, "vector").unionByName(side(words, w_words, "bm25"))
    sides = F.array_join(F.array_sort(F.collect_set("side")), "+").alias("sides")
    fused = both.groupBy("qid", "id").agg(F.round(F.sum("part"), 12).alias("rrf_score"), sides, F.max_by("score", "side").alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("rrf_score"), "id")
    return fused.withColumn("rank", F.row_number().over(order))


def calibrate_exp(df: DataFrame, logit: str = "logit", by: str = "qid") -> DataFrame:
    """exp(100 s), scaled to 0..10 over the candidates of a query; 5 if all are equal.
    Differences are taken before the exponential, so nothing overflows."""
    w = Window.partitionBy(by)
    hi, lo, s = F.max(logit).over(w), F.min(logit).over(w), F.col(logit)
    floor = F.exp(100 * (lo - hi))
    score = F.when(hi == lo, 5.0).otherwise((F.exp(100 * (s - hi)) - floor) / (1 - floor) * 10)
    return df.withColumn("rerank_score", score)


def calibrate_linear(df: DataFrame, logit: str = "logit", by: str = "qid") -> DataFrame:
    w = Window.partitionBy(by)
    hi, lo = F.max(logit).over(w), F.min(logit).over(w)
    return df.withColumn("rerank_score", F.when(hi == lo, 5.0).otherwise((F.col(logit) - lo) / (hi - lo) * 10))


def fallback_scores(df: DataFrame, k: int = RERANK_K) -> DataFrame:
    """Without a reranker the first k candidates get 0.5."""
    return df.where(F.col("rank") <= k).withColumn("rerank_score", F.lit(0.5))


def fallback_falling(df: DataFrame, k: int = RERANK_K) -> DataFrame:
    """The same, with scores that fall from 5 by a tenth."""
    return df.where(F.col("rank") <= k).withColumn("rerank_score", 5.0 - 0.1 * (F.col("rank") - 1))


def adaptive_threshold(df: DataFrame, score: str = "rerank_score", by: str = "qid") -> DataFrame:
    """Keeps scores near the best; how near depends on their range."""
    w = Window.partitionBy(by)
    best, spread = F.max(score).over(w), F.max(score).over(w) - F.min(score).over(w)
    limit = F.when(spread > 2, best * 0.8).when(spread > 1, best * 0.7).otherwise(best - 0.1)
    return df.withColumn("threshold", limit).where(F.col(score) >= F.col("threshold"))


def overlap_logit(query: Column, body: Column, tokenizer: Callable[[Column], Column] = text.tokens) -> Column:
    """A stand-in for a cross-encoder, which this package does not have: the share of
    query tokens that the text has, a tenth of it, so that scores spread."""
    q = F.array_distinct(tokenizer(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokenizer(body))) / F.size(q) / 10).otherwise(0.0)


def reranked(hits: DataFrame, texts: DataFrame, queries: DataFrame, k: int | None = RERANK_K, logit: Callable[[Column, Column], Column] = overlap_logit) -> DataFrame:
    """Candidates rated by a reranker over (query, text), calibrated over all of them, the best k (None: all)."""
    full = hits.join(texts.select("id", "text"), "id").join(small(queries.select("qid", "query")), "qid")
    rated = calibrate_exp(full.withColumn("logit", logit(F.col("query"), F.col("text"))))
    rated = rated.withColumn("rerank_score", F.round("rerank_score", 6))
    order = Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "rank", "id")
    rated = rated.withColumn("final_rank", F.row_number().over(order)).drop("query")
    return rated if k is None else rated.where(F.col("final_rank") <= k)


def sides(
    index: Index, nearest: Callable[[DataFrame, int], DataFrame] | None, queries: DataFrame, synonyms: DataFrame | None, top_k: int = TOP_K, tokenizer: Callable[[Column], Column] = text.tokens
) -> tuple[DataFrame, DataFrame]:
    """The hits of both sides: qid, id, rank, score by vector and by words. Without nearest,
    words alone; without synonyms, queries as they are."""
    asked = queries.select("qid", "query")
    if synonyms is not None:
        asked = expansion.expand_smart(asked, synonyms).select("qid", F.col("expanded").alias("query"))
    words = bm25_top(index, asked, top_k, tokenizer=tokenizer).select("qid", "id", "rank", "score")
    vector = words.where("false") if nearest is None else nearest(queries.where(F.col("qv").isNotNull()).select("qid", "qv"), top_k)
    return vector.select("qid", "id", "rank", "score"), words


def hybrid(
    index: Index, texts: DataFrame, nearest: Callable[[DataFrame, int], DataFrame] | None, queries: DataFrame, synonyms: DataFrame | None, top_k: int = TOP_K, rerank_k: int = RERANK_K,
    tokenizer: Callable[[Column], Column] = text.tokens, logit: Callable[[Column, Column], Column] = overlap_logit,
) -> DataFrame:
    """Vector and BM25 search, fusion, reranking, threshold, for all queries in one plan.
    nearest: the k best of each query by vector, such as VectorIndex.top. queries: qid,
    query, qv; those without a vector are answered by words alone. BM25 scores the query
    expanded by synonyms, the reranker the query as it is."""
    fused = rrf(*sides(index, nearest, queries, synonyms, top_k, tokenizer))
    best = adaptive_threshold(reranked(fused, texts, queries, rerank_k, logit))
    return best.select("qid", "id", "text", "sides", "score", "rrf_score", "rerank_score", "final_rank")


#: The stages of a traced search, in order.
STAGES = ("vector", "bm25", "fused", "rerank", "final")


def traced(
    index: Index, texts: DataFrame, nearest: Callable[[DataFrame, int], DataFrame] | None, queries: DataFrame, synonyms: DataFrame | None, top_k: int = TOP_K,
    tokenizer: Callable[[Column], Column] = text.tokens, logit: Callable[[Column, Column], Column] = overlap_logit,
) -> DataFrame:
    """qid, stage, rank, id, score: what every stage of one search gave. All candidates are
    reranked and then cut by the threshold. Each stage is written as it is found, a few rows
    for each query, and the next reads that, so nothing is searched twice."""
    keep = lambda df, stage, rank, score: df.select("qid", F.lit(stage).alias("stage"), F.col(rank).cast("int").alias("rank"), "id", F.col(score).cast("double").alias("score"))
    vector, words = (stored(df, "side") for df in sides(index, nearest, queries, synonyms, top_k, tokenizer))
    fused = stored(rrf(vector, words), "fused")
    rated = stored(reranked(fused, texts, queries, None, logit).drop("text"), "rated")
    last = adaptive_threshold(rated)
    stages = [(vector, "rank", "score"), (words, "rank", "score"), (fused, "rank", "rrf_score"), (rated, "final_rank", "rerank_score"), (last, "final_rank", "rerank_score")]
    out = [keep(df, name, rank, score) for name, (df, rank, score) in zip(STAGES, stages)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


#: Fixed value: the longest query.
MOST_QUERY = 2000


def query_error(query: Column) -> Column:
    """Why a query is not answered, or null."""
    return F.when(query.isNull() | (F.trim(query) == ""), "empty query").when(F.length(query) > MOST_QUERY, "query too long")


def hybrid_batch(queries: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A row for each query: qid, success, error, n_results, best_score. Queries in error
    are set apart, so they don't touch the others. search: hybrid() over a table of queries."""
    marked = queries.withColumn("error", query_error(F.col("query")))
    found = search(marked.where(F.col("error").isNull()).drop("error")).groupBy("qid").agg(F.count("*").alias("n"), F.max("rerank_score").alias("best_score"))
    out = marked.select("qid", "error").join(found, "qid", "left")
    return out.select("qid", F.col("error").isNull().alias("success"), "error", F.coalesce("n", F.lit(0)).alias("n_results"), "best_score")


def search_statistics(index: Index, chunks: DataFrame) -> DataFrame:
    """One row: whether there is an index, its texts and tokens, the chunks of the
    collection, the methods and their weights."""
    n = chunks.agg(F.count("*").alias("n_chunks"))
    one = index.stats.select((F.col("n_docs") > 0).alias("bm25_initialized"), F.col("n_docs").alias("bm25_docs_count"), "n_tokens")
    return one.join(F.broadcast(n), F.lit(True)).select(
        "*", F.lit("vector,bm25,hybrid").alias("search_methods"), F.lit(VECTOR_WEIGHT).alias("vector_weight"), F.lit(BM25_WEIGHT).alias("bm25_weight")
    )
