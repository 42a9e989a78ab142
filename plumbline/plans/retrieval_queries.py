"""Queries of search: expansion, both sides, fusion, reranking, context."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import access, catalog, context, diagnostics, expansion, people, retrieval
from plumbline.operators.segments import Segments
from plumbline.plans.tables import CHUNKS, DOCS, LEVEL, Q_SQL, chunks, documents, load, queries, search_index, stored_vectors, vectors
from plumbline.plans.text_queries import _TOKENS
from plumbline.sources.stores import fresh, shared_dir, stored

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = (run, sql)
        return run

    return add


def _texts(spark, sf):
    return access.visible(documents(spark, sf), LEVEL)


_VISIBLE = f"{DOCS}, {_TOKENS}, vt AS (SELECT id, tokens, len(tokens) AS dl FROM tok WHERE access_level <= {LEVEL})"
_VOCAB = f"""{_VISIBLE}, voc AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT id, unnest(tokens) AS token FROM vt) GROUP BY token),
st AS (SELECT (SELECT count(*) FROM vt) AS n, (SELECT avg(dl) FROM vt) AS avgdl),
idf0 AS (SELECT token, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM voc, st), mi AS (SELECT avg(raw) AS mean FROM idf0),
idf AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM idf0, mi)"""
_QTOK = f"""qt AS (SELECT qid, token, count(*) AS nq FROM (SELECT qid, unnest(tokens) AS token FROM (SELECT qid AS id, tokens FROM qtok) AS x(qid, tokens)) GROUP BY qid, token)"""
_QTOKENS = "qtok AS (SELECT id, tokens FROM (" + _TOKENS.split("AS (", 1)[1].rsplit(")", 1)[0].replace("FROM docs", f"FROM (SELECT qid AS id, query AS text, 0 AS access_level FROM {Q_SQL}) AS docs") + "))"
_BM25 = f"""{_VOCAB}, {_QTOKENS}, {_QTOK.replace("SELECT qid AS id, tokens FROM qtok", "SELECT id, tokens FROM qtok")},
tf AS (SELECT id, dl, token, count(*) AS tf FROM (SELECT id, dl, unnest(tokens) AS token FROM vt) WHERE token IN (SELECT token FROM qt) GROUP BY id, dl, token),
sc AS (SELECT qid, id, round(sum(nq * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM tf JOIN idf USING (token) JOIN qt USING (token), st GROUP BY qid, id),
bm AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM
  (SELECT q.qid, vt.id, coalesce(score, 0) AS score FROM {Q_SQL} CROSS JOIN vt LEFT JOIN sc ON sc.qid = q.qid AND sc.id = vt.id))"""
_VEC = f"""vq AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id < 4),
ve AS (SELECT qid, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], qv), 9) AS score FROM embeddings, vq WHERE vec_id % 100 + 1 <= {LEVEL}),
vr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM ve)"""


_index = search_index


def _bm25(spark, sf, k=retrieval.TOP_K):
    return retrieval.bm25_top(_index(spark, sf), queries(spark, sf), k)


def _nearest(spark, sf, **how):
    visible = F.col("access_level") <= LEVEL
    return lambda asked, k: stored_vectors(spark, sf).top(asked, k, where=visible, **how)


def _vector(spark, sf, k=retrieval.TOP_K):
    return _nearest(spark, sf)(queries(spark, sf), k)


@query(f"WITH {_VOCAB} SELECT n AS n_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM voc) AS n_tokens FROM st")
def bm25_build(spark, sf):
    """Tokenises and writes the index, if no query of this state of the table has done so."""
    return _index(spark, sf).stats.select("n_docs", F.round("avgdl", 6).alias("avgdl"), "n_tokens")


def _maintained(spark, sf):
    """An index built over even ids, to which the others are appended, and some of both twice; ids divisible by 7 are deleted."""
    docs = documents(spark, sf)
    kept = Segments(spark, f"{shared_dir(spark)}/kept-{fresh()}")
    kept.append(docs.where("id % 2 = 0").withColumn("text", F.when(F.col("id") % 10 == 0, "an older text").otherwise(F.col("text"))))
    kept.append(docs.where("id % 2 = 1 OR id % 10 = 0"))
    kept.delete(docs.where("id % 7 = 0").select("id"))
    return kept


_LEFT = f"access_level <= {LEVEL}"


@query(f"WITH {_BM25.replace(_LEFT, _LEFT + ' AND id % 7 > 0')} SELECT qid, id, rank, round(score, 6) AS score FROM bm WHERE rank <= 30")
def bm25_segments(spark, sf):
    """BM25 after appends, replacements and deletes: what a new index would give."""
    index, _ = _maintained(spark, sf).view(LEVEL, time.time())
    return retrieval.bm25_top(index, queries(spark, sf)).select("qid", "id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_BM25.replace(_LEFT, 'access_level <= 20 AND id % 7 > 0')} SELECT qid, id, rank, round(score, 6) AS score FROM bm WHERE rank <= 30")
def bm25_compacted(spark, sf):
    """The same of another level, once the segments are compacted and old files swept."""
    kept = _maintained(spark, sf)
    kept.compact(least=10**9)
    kept.sweep()
    index, _ = kept.view(20, time.time())
    return retrieval.bm25_top(index, queries(spark, sf)).select("qid", "id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_VOCAB} SELECT token, df AS n_docs_with FROM voc")
def doc_frequency(spark, sf):
    return _index(spark, sf).tokens.select("token", "n_docs_with")


@query(f"WITH {_VOCAB} SELECT n AS n_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM voc) AS n_tokens, round(mean, 6) AS mean_idf FROM st, mi")
def corpus_stats(spark, sf):
    s = _index(spark, sf).stats
    return s.select("n_docs", F.round("avgdl", 6).alias("avgdl"), "n_tokens", F.round("mean_idf", 6).alias("mean_idf"))


@query(f"WITH {_VOCAB} SELECT token, round(idf, 6) AS idf FROM idf")
def bm25_index(spark, sf):
    return _index(spark, sf).tokens.select("token", F.round("idf", 6).alias("idf"))


@query(f"WITH {_BM25}, pos AS (SELECT id, row_number() OVER (ORDER BY id) AS position FROM vt) SELECT qid, id, rank, position FROM bm JOIN pos USING (id) WHERE rank <= 30")
def bm25_positions(spark, sf):
    """The place of each hit in the corpus, beside its true rank."""
    index = _index(spark, sf)
    return retrieval.with_positions(retrieval.bm25_top(index, queries(spark, sf)), index).select("qid", "id", "rank", "position")


@query(f"WITH {_BM25} SELECT qid, id, rank, round(score, 6) AS score FROM bm WHERE rank <= 30")
def bm25_topk(spark, sf):
    return _bm25(spark, sf).select("qid", "id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_VEC} SELECT qid, id, rank, round(score, 6) AS score FROM vr WHERE rank <= 30 AND qid = 0")
def vector_topk(spark, sf):
    """One query against every vector, without an index."""
    v = access.visible(vectors(spark, sf), LEVEL)
    return retrieval.vector_top(v, queries(spark, sf).where("qid = 0")).select("qid", "id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_VEC} SELECT qid, id, rank, round(score, 6) AS score FROM vr WHERE rank <= 30")
def vector_topk_batch(spark, sf):
    return _vector(spark, sf).select("qid", "id", "rank", F.round("score", 6).alias("score"))


_MANY = """q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT qid, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], qv), 9) AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)"""


def _many(spark, sf):
    return vectors(spark, sf).where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("qv"))


@query(f"WITH {_MANY} SELECT qid, id, rank, round(score, 6) AS score FROM r WHERE rank <= 10")
def vector_index_topk(spark, sf):
    """A twentieth of all vectors as queries against all, exact, through the stored index."""
    return stored_vectors(spark, sf).top(_many(spark, sf), 10).select("qid", "id", "rank", F.round("score", 6).alias("score"))


@query()
def vector_probe(spark, sf):
    """The same by the nearest cells alone, as many as their measured recall asks for."""
    index = stored_vectors(spark, sf)
    return index.top(_many(spark, sf), 10, probes=index.probes()).select("qid", "id", "rank", F.round("score", 6).alias("score"))


_RRF = f"""{_BM25}, {_VEC}, parts AS (SELECT qid, id, 0.7::DOUBLE / (60 + rank) AS p, 'vector' AS s, score FROM vr WHERE rank <= 30 UNION ALL SELECT qid, id, 0.3::DOUBLE / (60 + rank), 'bm25', score FROM bm WHERE rank <= 30),
rr AS (SELECT qid, id, round(sum(p), 12) AS rrf_score, string_agg(s, '+' ORDER BY s) AS sides, arg_max(score, s) AS score FROM parts GROUP BY qid, id),
fu AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, id) AS rank FROM rr)"""


@query(f"WITH {_RRF} SELECT qid, id, round(rrf_score, 9) AS rrf_score, round(score, 6) AS score, sides, rank FROM fu")
def rrf_fusion(spark, sf):
    return retrieval.rrf(_vector(spark, sf), _bm25(spark, sf)).select("qid", "id", F.round("rrf_score", 9).alias("rrf_score"), F.round("score", 6).alias("score"), "sides", "rank")


_RERANK = f"""{_RRF}, lg AS (SELECT fu.qid, fu.id, fu.sides, fu.score, fu.rrf_score, fu.rank, CASE WHEN len(qtok.tokens) > 0 THEN len(list_intersect(list_distinct(qtok.tokens), tok.tokens)) / len(list_distinct(qtok.tokens)) / 10.0 ELSE 0 END AS s
  FROM fu JOIN tok ON tok.id = fu.id JOIN qtok ON qtok.id = fu.qid WHERE tok.access_level <= {LEVEL}),
mm AS (SELECT *, max(s) OVER (PARTITION BY qid) AS hi, min(s) OVER (PARTITION BY qid) AS lo FROM lg),
ca AS (SELECT *, round(CASE WHEN hi = lo THEN 5.0 ELSE (exp(100 * (s - hi)) - exp(100 * (lo - hi))) / (1 - exp(100 * (lo - hi))) * 10 END, 6) AS rerank_score,
  CASE WHEN hi = lo THEN 5.0 ELSE (s - lo) / (hi - lo) * 10 END AS linear FROM mm),
fr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, rank, id) AS final_rank FROM ca),
tk AS (SELECT *, max(rerank_score) OVER (PARTITION BY qid) AS best, max(rerank_score) OVER (PARTITION BY qid) - min(rerank_score) OVER (PARTITION BY qid) AS spread FROM fr WHERE final_rank <= 10),
hy AS (SELECT * FROM tk WHERE rerank_score >= CASE WHEN spread > 2 THEN best * 0.8 WHEN spread > 1 THEN best * 0.7 ELSE best - 0.1 END)"""


def _hybrid(spark, sf):
    fused = retrieval.rrf(_vector(spark, sf), _bm25(spark, sf))
    return retrieval.reranked(fused, _texts(spark, sf), queries(spark, sf))


@query(f"WITH {_RERANK} SELECT qid, id, rerank_score, final_rank FROM fr WHERE final_rank <= 10")
def rerank_calibrate_exp(spark, sf):
    return _hybrid(spark, sf).select("qid", "id", "rerank_score", "final_rank")


@query(f"WITH {_RERANK} SELECT qid, id, round(linear, 6) AS score FROM ca")
def rerank_calibrate_linear(spark, sf):
    fused = retrieval.rrf(_vector(spark, sf), _bm25(spark, sf))
    full = fused.join(_texts(spark, sf).select("id", "text"), "id").join(queries(spark, sf).select("qid", "query"), "qid")
    rated = full.withColumn("logit", retrieval.overlap_logit(F.col("query"), F.col("text")))
    return retrieval.calibrate_linear(rated).select("qid", "id", F.round("rerank_score", 6).alias("score"))


@query(f"WITH {_RERANK} SELECT qid, id, rerank_score FROM hy")
def adaptive_threshold(spark, sf):
    return retrieval.adaptive_threshold(_hybrid(spark, sf)).select("qid", "id", "rerank_score")


_SYN = "(VALUES " + ", ".join(f"('{t}', {s})" for t, s in expansion.SAMPLE.items()) + ") AS s(term, synonyms)"
_TERMS = rf"""w AS (SELECT qid, query, regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM {Q_SQL}),
t AS (SELECT DISTINCT qid, unnest(list_concat(w, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS term FROM w)"""


def _expand_sql(most: str) -> str:
    return f"""WITH {_TERMS}, a AS (SELECT DISTINCT t.qid, unnest(s.synonyms[1:{most}]) AS x FROM t JOIN {_SYN} ON s.term = t.term JOIN w ON w.qid = t.qid),
b AS (SELECT qid, string_agg(x, ' ' ORDER BY x) AS added FROM a GROUP BY qid) SELECT w.qid, query || ' ' || coalesce(added, '') AS expanded FROM w LEFT JOIN b USING (qid)"""


_SMART = "CASE WHEN regexp_matches(lower(w.query), 'api|server|database|token|код|систем') THEN 3 ELSE 2 END"
_EXPANDED = _expand_sql(_SMART).replace("WITH ", "", 1).replace("SELECT w.qid, query || ' ' || coalesce(added, '') AS expanded FROM w LEFT JOIN b USING (qid)", "").rstrip() + """,
ex AS (SELECT w.qid AS id, query || ' ' || coalesce(added, '') AS text, 0 AS access_level FROM w LEFT JOIN b USING (qid))"""
#: BM25 over the expanded queries, all else over the queries as they are.
_EX_TOKENS = "extok AS (SELECT id, tokens FROM (" + _TOKENS.split("AS (", 1)[1].rsplit(")", 1)[0].replace("FROM docs", "FROM ex AS docs") + "))"
_HYBRID = f"""{_EXPANDED}, {_RERANK.replace(_QTOKENS, _QTOKENS + ", " + _EX_TOKENS).replace("SELECT id, tokens FROM qtok) AS x(qid, tokens)", "SELECT id, tokens FROM extok) AS x(qid, tokens)")}"""


def _search(spark, sf):
    texts, synonyms = _texts(spark, sf), expansion.synonyms(spark, expansion.SAMPLE)
    index = search_index(spark, sf)
    return lambda asked: retrieval.hybrid(index, texts, _nearest(spark, sf), asked, synonyms)


@query(f"WITH {_HYBRID} SELECT qid, id, sides, round(score, 6) AS score, round(rrf_score, 9) AS rrf_score, rerank_score, final_rank FROM hy")
def hybrid_search(spark, sf):
    """The flagship: all queries, both sides, expansion, in one plan."""
    out = _search(spark, sf)(queries(spark, sf)).drop("text")
    return out.withColumn("rrf_score", F.round("rrf_score", 9)).withColumn("score", F.round("score", 6))


_ODD_QUERIES = [(10, ""), (11, None), (12, "x" * 2001)]


@query(f"""WITH {_HYBRID}, g AS (SELECT qid, count(*) AS n_results, max(rerank_score) AS best_score FROM hy GROUP BY qid), al AS (SELECT qid, NULL AS error FROM {Q_SQL} UNION ALL (VALUES (10, 'empty query'), (11, 'empty query'), (12, 'query too long')))
SELECT qid::BIGINT AS qid, error IS NULL AS success, error, coalesce(n_results, 0) AS n_results, best_score FROM al LEFT JOIN g USING (qid)""")
def hybrid_batch(spark, sf):
    """Queries in error beside others, which they don't touch."""
    odd = spark.createDataFrame(_ODD_QUERIES, "qid long, query string").withColumn("qv", F.lit(None).cast("array<float>"))
    return retrieval.hybrid_batch(queries(spark, sf).unionByName(odd), _search(spark, sf))


@query(f"""WITH {_HYBRID}, so AS (SELECT hy.qid, hy.id, final_rank, docs.text, coalesce(CASE WHEN docs.id % 3 > 0 THEN source END, 'Неизвестный документ') AS title, rerank_score FROM hy JOIN docs ON docs.id = hy.id),
g AS (SELECT qid, md5(string_agg('[Источник ' || final_rank || ': ' || title || ']' || chr(10) || text || chr(10), chr(10) ORDER BY final_rank)) AS context_digest, string_agg(id || ':' || title, ',' ORDER BY final_rank) AS sources,
  count(*) AS filtered_count, arg_min(rerank_score, final_rank) AS best_relevance_score FROM so GROUP BY qid)
SELECT q.qid::BIGINT AS qid, coalesce(context_digest, md5('')) AS context_digest, coalesce(sources, '') AS sources, coalesce(filtered_count, 0) AS filtered_count, best_relevance_score, filtered_count IS NULL AS relevance_filtered,
  CASE WHEN filtered_count IS NULL THEN 'All results filtered by SearchService adaptive thresholds' ELSE 'Results processed by adaptive filtering in SearchService' END AS reason FROM {Q_SQL} LEFT JOIN g USING (qid)""")
def search_task(spark, sf):
    """Hybrid search as a task's answer, with titles looked up."""
    titles = documents(spark, sf).select("id", F.when(F.col("id") % 3 > 0, F.col("source")).alias("title"))
    asked = queries(spark, sf)
    hits = context.with_titles(_search(spark, sf)(asked), titles, "id")
    out = context.task_result(asked.select("qid"), hits)
    names = F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["chunk_id"], s["document_title"])), ",")
    return out.withColumn("context_digest", F.md5("context")).withColumn("sources", names).drop("context")


@query(f"""WITH {DOCS}, {_VEC} SELECT vr.qid, vr.id, rank, round(score, 6) AS similarity_score, md5(docs.text) AS text_digest, docs.source AS title, docs.access_level FROM vr JOIN docs ON docs.id = vr.id WHERE rank <= 30""")
def knowledge_base_query(spark, sf):
    """Vector hits with their texts and metadata."""
    hits = _vector(spark, sf).join(documents(spark, sf), "id")
    return hits.select("qid", "id", "rank", F.round("score", 6).alias("similarity_score"), F.md5("text").alias("text_digest"), F.col("source").alias("title"), "access_level")


@query(f"WITH {_VOCAB}, {CHUNKS.split(DOCS + ',', 1)[1]} SELECT n > 0 AS bm25_initialized, n AS bm25_docs_count, (SELECT count(*) FROM voc) AS n_tokens, (SELECT count(*) FROM chunks) AS n_chunks, 'vector,bm25,hybrid' AS search_methods, 0.7 AS vector_weight, 0.3 AS bm25_weight FROM st")
def search_stats(spark, sf):
    return retrieval.search_statistics(_index(spark, sf), chunks(spark, sf))


_RAG = f"""{DOCS}, {_TOKENS}, {_VEC}, {_QTOKENS}, lg AS (SELECT vr.qid, vr.id, vr.rank, CASE WHEN len(qtok.tokens) > 0 THEN len(list_intersect(list_distinct(qtok.tokens), tok.tokens)) / len(list_distinct(qtok.tokens)) / 10.0 ELSE 0 END AS s
  FROM vr JOIN tok ON tok.id = vr.id JOIN qtok ON qtok.id = vr.qid WHERE vr.rank <= 30 AND tok.access_level <= {LEVEL}),
mm AS (SELECT *, max(s) OVER (PARTITION BY qid) AS hi, min(s) OVER (PARTITION BY qid) AS lo FROM lg),
ca AS (SELECT *, round(CASE WHEN hi = lo THEN 5.0 ELSE (exp(100 * (s - hi)) - exp(100 * (lo - hi))) / (1 - exp(100 * (lo - hi))) * 10 END, 6) AS rerank_score FROM mm),
fr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, rank, id) AS final_rank FROM ca)"""


def _rag(spark, sf):
    hits = _vector(spark, sf)
    return retrieval.reranked(hits, _texts(spark, sf), queries(spark, sf))


@query(f"""WITH {_RAG} SELECT qid, md5(string_agg('[Источник ' || final_rank || ': ' || source || ']' || chr(10) || text || chr(10), chr(10) ORDER BY final_rank)) AS context_digest
FROM fr JOIN docs USING (id) WHERE final_rank <= 10 GROUP BY qid""")
def rag_query(spark, sf):
    """Vector hits, reranked, as a context; no words and no threshold."""
    titled = _rag(spark, sf).join(documents(spark, sf).select("id", F.col("source").alias("title")), "id")
    return context.context(titled).select("qid", F.md5("context").alias("context_digest"))


_GROUPS = f"""{_RERANK}, hit AS (SELECT fr.*, id % 3 AS doc_id FROM fr WHERE final_rank <= 10)"""


@query(f"""WITH {_GROUPS}, g AS (SELECT qid, doc_id, max(rerank_score) AS best_score, count(*) AS n_chunks FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, id) AS n FROM hit WHERE rerank_score >= 2) WHERE n <= 10 GROUP BY qid, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY best_score DESC, doc_id) AS doc_rank FROM g) SELECT * FROM r WHERE doc_rank <= 2""")
def group_by_document(spark, sf):
    hits = _hybrid(spark, sf).withColumn("doc_id", F.col("id") % 3)
    return context.best_documents(hits, min_score=2.0)


@query(f"""WITH {_GROUPS}, w AS (SELECT hit.*, length(text) AS len, max(rerank_score) OVER (PARTITION BY qid, doc_id) AS b2, max(rerank_score) OVER (PARTITION BY qid, doc_id) - min(rerank_score) OVER (PARTITION BY qid, doc_id) AS sp FROM hit JOIN docs USING (id)),
k AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY rerank_score DESC, id) AS position FROM w WHERE rerank_score >= greatest(CASE WHEN sp > 0.1 THEN b2 - sp * 0.3 WHEN sp > 0.05 THEN b2 - sp * 0.5 ELSE b2 - 0.02 END, b2 * 0.4)),
r AS (SELECT *, sum(len) OVER (PARTITION BY qid, doc_id ORDER BY position)::BIGINT AS running_length FROM k WHERE position <= CASE WHEN sp > 0.1 THEN 2 ELSE 3 END)
SELECT qid, doc_id, id, position, running_length FROM r WHERE running_length <= 8000""")
def select_chunks(spark, sf):
    hits = _hybrid(spark, sf).withColumn("doc_id", F.col("id") % 3)
    return context.select_chunks(hits).select("qid", "doc_id", "id", "position", "running_length")


@query(f"""WITH {_VEC}, {DOCS}, h AS (SELECT qid, vr.id, rank, text FROM vr JOIN docs ON docs.id = vr.id WHERE rank <= 30), r AS (SELECT *, sum(length(text)) OVER (PARTITION BY qid ORDER BY rank)::BIGINT AS running_length FROM h)
SELECT qid, id, running_length FROM r WHERE running_length <= 20000""")
def context_budget(spark, sf):
    hits = _vector(spark, sf).join(documents(spark, sf).select("id", "text"), "id")
    return context.within_budget(hits, 20000, ["qid"], [F.col("rank")]).select("qid", "id", "running_length")


@query(f"""WITH {DOCS}, h AS (SELECT id % 97 AS qid, id, text FROM docs), r AS (SELECT *, row_number() OVER (PARTITION BY qid, trim(text) ORDER BY id) AS n FROM h) SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY id) AS number FROM r WHERE n = 1""")
def dedupe_context(spark, sf):
    hits = documents(spark, sf).select((F.col("id") % 97).alias("qid"), "id", "text")
    return context.without_repeats(hits, "qid", "id").select("qid", "id", "number")


@query("""WITH s AS (SELECT user_id % 50 AS qid, event_id AS place, event_id // 3 % 9 AS doc, event_id % 4 AS chunk_index, event_id * 7 % 31 AS chunk_id FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, doc, chunk_index ORDER BY place) AS a, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY place) AS b FROM s) SELECT qid, place FROM r WHERE a = 1 AND b = 1""")
def dedupe_sources(spark, sf):
    """First wins, on document and chunk number, or on the chunk's id."""
    e = F.col("event_id")
    s = load(spark, sf, "events").select((F.col("user_id") % 50).alias("qid"), e.alias("place"), (F.floor(e / 3) % 9).alias("doc"), (e % 4).alias("chunk_index"), (e * 7 % 31).alias("chunk_id"))
    return context.unique_sources(s, "qid", "place", ("doc", "chunk_index"), ("chunk_id",)).select("qid", "place")


@query(f"""WITH {_RERANK}, g AS (SELECT qid, count(*) AS n, max(rerank_score) AS best FROM fr WHERE final_rank <= 10 GROUP BY qid)
SELECT qid, '(' || n || ' из 30 частей, score: ' || printf('%.3f', best) || ')' AS coverage, CASE WHEN n = 0 THEN 'no_results' WHEN best < 7 THEN 'low_relevance' ELSE 'ok' END AS reason FROM g""")
def answer_coverage(spark, sf):
    g = _hybrid(spark, sf).groupBy("qid").agg(F.count("*").alias("n"), F.max("rerank_score").alias("best"))
    return g.select("qid", context.coverage(F.col("n"), F.lit(30), F.col("best")).alias("coverage"), context.no_answer_reason(F.col("best"), F.col("n")).alias("reason"))


# -- a search with all its stages ----------------------------------------------------

_TRACE = f"""{_HYBRID}, fa AS (SELECT *, max(rerank_score) OVER (PARTITION BY qid) AS top, max(rerank_score) OVER (PARTITION BY qid) - min(rerank_score) OVER (PARTITION BY qid) AS wide FROM fr),
lim AS (SELECT *, CASE WHEN wide > 2 THEN top * 0.8 WHEN wide > 1 THEN top * 0.7 ELSE top - 0.1 END AS threshold FROM fa),
tr AS (SELECT qid, 'vector' AS stage, rank, id, score FROM vr WHERE rank <= 30 UNION ALL SELECT qid, 'bm25', rank, id, score FROM bm WHERE rank <= 30 UNION ALL SELECT qid, 'fused', rank, id, rrf_score FROM fu
  UNION ALL SELECT qid, 'rerank', final_rank, id, rerank_score FROM fr UNION ALL SELECT qid, 'final', final_rank, id, rerank_score FROM lim WHERE rerank_score >= threshold)"""


def _traced(spark, sf):
    synonyms = expansion.synonyms(spark, expansion.SAMPLE)
    found = retrieval.traced(search_index(spark, sf), _texts(spark, sf), _nearest(spark, sf), queries(spark, sf), synonyms)
    return stored(found, "trace")


@query(f"WITH {_TRACE} SELECT qid::BIGINT AS qid, stage, rank::INT AS rank, id, round(score, 6) AS score FROM tr")
def search_trace(spark, sf):
    """What every stage of one search gave."""
    return _traced(spark, sf).select("qid", "stage", "rank", "id", F.round("score", 6).alias("score"))


@query(f"""WITH {_TRACE}, ag AS (SELECT qid, count(*) FILTER (stage = 'vector') AS n_vector, count(*) FILTER (stage = 'bm25') AS n_bm25, count(*) FILTER (stage = 'fused') AS n_fused, count(*) FILTER (stage = 'rerank') AS n_rerank,
  count(*) FILTER (stage = 'final') AS n_final, max(score) FILTER (stage = 'rerank') AS best, min(score) FILTER (stage = 'rerank') AS worst FROM tr GROUP BY qid),
bo AS (SELECT qid, count(*) AS n_both FROM (SELECT qid, id FROM tr WHERE stage IN ('vector', 'bm25') GROUP BY qid, id HAVING count(*) = 2) GROUP BY qid),
fi AS (SELECT tr.qid, tr.rank, tr.score, regexp_split_to_array(lower(q.query), '[ \n]+') AS a, regexp_split_to_array(lower(docs.text), '[ \n]+') AS b FROM tr JOIN docs USING (id) JOIN {Q_SQL} ON q.qid = tr.qid WHERE stage = 'final'),
iq AS (SELECT qid, max(score) AS hi, avg(score) AS mean, max(score) - min(score) AS spread, count(*) FILTER (rank <= 3 AND NOT list_has_any(a, b)) AS missed FROM fi GROUP BY qid)
SELECT q.qid::BIGINT AS qid, n_vector, n_bm25, n_fused, n_rerank, n_final, coalesce(n_both, 0) AS n_both, round(best, 6) AS best, round(best - worst, 6) AS spread,
  round(CASE WHEN best - worst > 2 THEN best * 0.8 WHEN best - worst > 1 THEN best * 0.7 ELSE best - 0.1 END, 6) AS threshold, round(1 - n_final / n_rerank, 6) AS filtered_ratio,
  concat_ws(',', CASE WHEN hi < 3 THEN 'low_max' END, CASE WHEN mean < 2 THEN 'low_mean' END, CASE WHEN iq.spread < 0.5 THEN 'flat_scores' END, CASE WHEN missed > 0 THEN 'no_query_words' END) AS issues,
  concat_ws(',', CASE WHEN best < 2 THEN 'rebuild_index' WHEN best < 4 THEN 'rephrase' END, CASE WHEN 1 - n_final / n_rerank > 0.8 THEN 'threshold_too_strict' END, CASE WHEN n_vector = 0 OR n_bm25 = 0 THEN 'one_side_empty' END,
    CASE WHEN len(regexp_split_to_array(trim(query), '\\s+')) < 3 THEN 'query_too_short' END) AS advice
FROM {Q_SQL} JOIN ag ON ag.qid = q.qid LEFT JOIN bo ON bo.qid = q.qid LEFT JOIN iq ON iq.qid = q.qid""")
def diagnose(spark, sf):
    """A diagnosis of each query from the stages of one search."""
    return diagnostics.diagnosis(_traced(spark, sf), _texts(spark, sf), queries(spark, sf))


@query(f"""WITH {_TRACE}, kw AS (SELECT qid, list_filter(string_split(lower(query), ' '), lambda w: length(w) > 3) AS words FROM {Q_SQL}),
lh AS (SELECT tr.*, len(list_filter(words, lambda w: contains(lower(docs.text), w))) > 0 AS hit FROM tr JOIN docs USING (id) JOIN kw ON kw.qid = tr.qid),
ls AS (SELECT qid, count(*) FILTER (lost) AS n_lost_stages FROM (SELECT qid, stage, count(*) FILTER (NOT hit) > count(*) FILTER (hit) AS lost FROM lh GROUP BY qid, stage) GROUP BY qid),
lf AS (SELECT qid, count(*) FILTER (stage = 'rerank' AND NOT hit AND score > 5) AS n_high_irrelevant, count(*) FILTER (stage = 'final' AND NOT hit) AS n_final_irrelevant,
  round(max(score) FILTER (stage = 'rerank') - min(score) FILTER (stage = 'rerank'), 6) AS score_range, round(min(score) FILTER (stage = 'final'), 6) AS lowest_final FROM lh GROUP BY qid)
SELECT qid::BIGINT AS qid, n_high_irrelevant, n_final_irrelevant, score_range, lowest_final, n_lost_stages, CASE WHEN n_final_irrelevant > 0 THEN 'critical' WHEN n_high_irrelevant > 0 OR n_lost_stages > 0 THEN 'leak'
  WHEN coalesce(score_range, 0) < 1 OR coalesce(lowest_final, 0) < 3 THEN 'warning' ELSE 'ok' END AS summary FROM lf JOIN ls USING (qid)""")
def leak_analysis(spark, sf):
    """Where irrelevant hits get through, over the stages of one search."""
    keywords = F.filter(F.split(F.lower("query"), " "), lambda w: F.length(w) > 3)
    return diagnostics.leak_report(diagnostics.with_texts(_traced(spark, sf), _texts(spark, sf), queries(spark, sf), keywords))


# -- people ----------------------------------------------------------------------------

#: Capitalised Latin words of the user's messages among the last five of each conversation, in order.
_NAMED = r"""nm AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
nl AS (SELECT conv_id, turn, list_filter(regexp_extract_all(text, '\p{L}+'), lambda w: regexp_full_match(w, '[A-Z][a-z]+') AND length(w) > 2) AS ws FROM nm WHERE back <= 5 AND role = 'user'),
na AS (SELECT conv_id, unnest(ws) AS name, turn, generate_subscripts(ws, 1) AS p FROM nl),
nd AS (SELECT conv_id, name, min(turn * 1000000 + p) AS first_at FROM na GROUP BY conv_id, name),
ne AS (SELECT conv_id, name, row_number() OVER (PARTITION BY conv_id ORDER BY first_at) - 1 AS place FROM nd), names AS (SELECT DISTINCT name AS qid, name AS query FROM ne)"""


def _named(spark, sf):
    return people.participants(load(spark, sf, "conversations"), names=lambda c: text.people(c, text.LATIN, 1))


@query(f"WITH {_NAMED} SELECT conv_id, string_agg(name, ',' ORDER BY place) AS people FROM ne GROUP BY conv_id")
def mentioned_people(spark, sf):
    found = catalog.mentioned(load(spark, sf, "conversations"), names=lambda c: text.people(c, text.LATIN, 1)).where(F.size("people") > 0)
    return found.select("conv_id", F.array_join("people", ",").alias("people"))


_PEOPLE = _RERANK.replace(Q_SQL, "names AS q").replace("vec_id < 4", "vec_id < 0").replace("rank <= 30", "rank <= 10").replace("final_rank <= 10", "final_rank <= 5")


@query(rf"""WITH {_NAMED}, {_PEOPLE}, pb AS (SELECT qid, count(*) AS n, string_agg(text, chr(10) || chr(10) ORDER BY final_rank) AS body FROM hy JOIN docs ON docs.id = hy.id WHERE trim(text, ' ') <> '' GROUP BY qid),
pe AS (SELECT qid, n, regexp_extract_all(body, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS ms FROM pb),
pm AS (SELECT qid, m, min(i) AS i FROM (SELECT qid, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM pe) GROUP BY qid, m),
pl AS (SELECT qid, string_agg(m, ',' ORDER BY i) AS mails FROM pm GROUP BY qid)
SELECT conv_id, count(*) AS n_people, sum(coalesce(n, 0))::BIGINT AS n_sources, coalesce(string_agg(ne.name || '=' || mails, ';' ORDER BY place), '') AS employees FROM ne LEFT JOIN pe ON pe.qid = ne.name LEFT JOIN pl ON pl.qid = ne.name GROUP BY conv_id""")
def employee_search(spark, sf):
    """One search for each person that a conversation names, put back by conversation."""
    index, texts = search_index(spark, sf), _texts(spark, sf)
    search = lambda asked: retrieval.hybrid(index, texts, None, asked, None, people.TOP, people.RERANKED)
    found = people.search_people(_named(spark, sf), search)
    with_some = F.filter("employees", lambda e: F.size(e["employees"]) > 0)
    said = F.transform(with_some, lambda e: F.concat(e["name"], F.lit("="), F.array_join(F.transform(e["employees"], lambda x: x["email"]), ",")))
    total = F.aggregate("employees", F.lit(0).cast("long"), lambda a, e: a + e["n_sources"])
    return found.select("conv_id", F.size("employees").cast("long").alias("n_people"), total.alias("n_sources"), F.array_join(said, ";").alias("employees"))


# -- expansion ---------------------------------------------------------------------

#: Queries are what users began their conversations with; terms are their longer words with a t.
_TALK = "(SELECT conv_id AS qid, text AS query FROM conversations WHERE role = 'user' AND turn = 0) AS q"
_WORDS = r"[\p{L}]{6,}"
_TALK_SYN = rf"""sy AS (SELECT term, list_slice([term || 'a', term || 'b', term || 'c', term || 'd'], 1, 1 + length(term) % 4) AS synonyms
  FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(query), '{_WORDS}')) AS term FROM {_TALK}) WHERE contains(term, 't'))"""


def _talk(spark, sf):
    return load(spark, sf, "conversations").where("role = 'user' AND turn = 0").select(F.col("conv_id").alias("qid"), F.col("text").alias("query"))


def _dictionary(spark, sf):
    words = _talk(spark, sf).select(F.explode(F.regexp_extract_all(F.lower("query"), F.lit(_WORDS), F.lit(0))).alias("term")).distinct().where(F.contains("term", F.lit("t")))
    every = F.array(*(F.concat("term", F.lit(x)) for x in "abcd"))
    return words.select("term", F.slice(every, F.lit(1), 1 + F.length("term") % 4).alias("synonyms"))


def _talk_sql(sql: str) -> str:
    return f"WITH {_TALK_SYN}, " + sql.removeprefix("WITH ").replace(Q_SQL, _TALK).replace(_SYN, "sy AS s")


@query(_talk_sql(f"WITH {_TERMS} SELECT qid, term FROM t"))
def query_terms(spark, sf):
    return _talk(spark, sf).select("qid", F.explode(expansion.terms(F.col("query"))).alias("term"))


@query(_talk_sql(_expand_sql("2")))
def expand_query(spark, sf):
    return expansion.expand(_talk(spark, sf), _dictionary(spark, sf)).select("qid", "expanded")


@query(_talk_sql(_expand_sql(_SMART)))
def expand_query_smart(spark, sf):
    return expansion.expand_smart(_talk(spark, sf), _dictionary(spark, sf)).select("qid", "expanded")


@query(_talk_sql("WITH ad AS (SELECT term, ['own'] AS synonyms FROM sy WHERE length(term) % 2 = 0 UNION ALL SELECT 'new term', ['x', 'y']), al AS (SELECT * FROM sy WHERE term NOT IN (SELECT term FROM ad) UNION ALL SELECT * FROM ad) SELECT term, array_to_string(synonyms, ',') AS synonyms FROM al"))
def added_synonyms(spark, sf):
    """Terms added while the dictionary is in use take the place of those of the same name."""
    table = _dictionary(spark, sf)
    own = table.where(F.length("term") % 2 == 0).select("term", F.array(F.lit("own")).alias("synonyms"))
    added = own.unionByName(expansion.synonyms(spark, {"new term": ["x", "y"]}))
    return expansion.with_added(table, added).select("term", F.array_join("synonyms", ",").alias("synonyms"))


@query(f"WITH {_TALK_SYN} SELECT count(*) AS n_terms, sum(len(synonyms))::BIGINT AS n_synonyms, avg(len(synonyms)) AS avg_synonyms FROM sy")
def synonym_stats(spark, sf):
    return expansion.statistics(_dictionary(spark, sf))
