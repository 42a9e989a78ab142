"""Queries over documents, users, sessions and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import access, catalog, context
from plumbline.plans.tables import CHUNKS, DOCS, LEVEL, chunks, documents, load
from plumbline.sources import stores

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = (run, sql)
        return run

    return add


def _messages(spark, sf):
    return load(spark, sf, "conversations")


def _users(spark, sf):
    c = load(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), "c_name", (F.col("c_custkey") % 100 + 1).cast("int").alias("access_level"))


@query(f"WITH {DOCS} SELECT id, source, access_level FROM docs WHERE access_level <= {LEVEL}")
def visible_documents(spark, sf):
    return access.visible(documents(spark, sf), LEVEL).select("id", "source", "access_level")


@query(f"WITH {DOCS} SELECT id, source, access_level FROM docs WHERE access_level <= {LEVEL} ORDER BY id DESC LIMIT 20 OFFSET 20")
def documents_page(spark, sf):
    rows = access.visible(documents(spark, sf), LEVEL).select("id", "source", "access_level")
    return catalog.page(rows, [F.desc("id")], 2, 20)


@query(f"WITH {DOCS} SELECT id, source, length(text)::INT AS n FROM docs WHERE id = 42 AND access_level <= {LEVEL}")
def document_lookup(spark, sf):
    return access.visible(documents(spark, sf), LEVEL).where("id = 42").select("id", "source", F.length("text").alias("n"))


@query(f"WITH {DOCS} SELECT id, uploaded_by = 3 AS may_edit, uploaded_by = 3 OR lang = 'de' AS may_edit_de FROM docs")
def owner_or_admin(spark, sf):
    role = F.when(F.col("lang") == "de", "ADMIN").otherwise("USER")
    d = documents(spark, sf)
    return d.select("id", access.owner_or_admin(F.lit("USER"), F.lit(3), F.col("uploaded_by")).alias("may_edit"), access.owner_or_admin(role, F.lit(3), F.col("uploaded_by")).alias("may_edit_de"))


_ROUTES = ", ".join(f"('{r}', {n})" for r, n in access.ROUTE_LEVELS)


@query(f"SELECT c_custkey AS user_id, route, (c_custkey % 100 + 1) >= min_level AS allowed FROM customer, (VALUES {_ROUTES}) AS r(route, min_level)")
def route_gates(spark, sf):
    return access.gates(_users(spark, sf)).select("user_id", "route", "allowed")


@query("SELECT c_custkey AS user_id, w.w AS wanted, w.w BETWEEN 1 AND 100 AND w.w <= c_custkey % 100 + 1 AS may FROM customer, (VALUES (0), (1), (50), (100), (101)) AS w(w)")
def reachable_levels(spark, sf):
    u = _users(spark, sf).select("user_id", "access_level", F.explode(F.array(*map(F.lit, (0, 1, 50, 100, 101)))).alias("wanted"))
    return u.select("user_id", "wanted", access.may_reach(F.col("access_level"), F.col("wanted")).alias("may"))


@query(f"WITH {DOCS} SELECT l.l AS level, count(*) AS n, max(access_level) AS highest FROM docs, (VALUES (1), (10), (50), (100)) AS l(l) WHERE access_level <= l.l GROUP BY l.l")
def access_boundary(spark, sf):
    d = documents(spark, sf)
    # One pass: each document counts for the levels that see it.
    d = d.select("access_level", F.explode(F.array(*map(F.lit, (1, 10, 50, 100)))).alias("level")).where("access_level <= level")
    return d.groupBy("level").agg(F.count("*").alias("n"), F.max("access_level").alias("highest"))


@query("""SELECT conv_id, turn, concat_ws(',', CASE WHEN length(text) NOT BETWEEN 1 AND 2000 THEN 'message' END,
  CASE WHEN turn / 4.0 > 1 THEN 'weight' END, CASE WHEN turn * 30 NOT BETWEEN 1 AND 100 THEN 'top_k' END,
  CASE WHEN turn * 10 NOT BETWEEN 1 AND 50 THEN 'rerank_top_k' END, CASE WHEN turn * 20 NOT BETWEEN 1 AND 100 THEN 'limit' END) AS errors FROM conversations""")
def request_validation(spark, sf):
    t = F.col("turn")
    errors = access.request_errors(F.col("text"), t / 4, t * 30, t * 10, t * 20)
    return _messages(spark, sf).select("conv_id", "turn", F.array_join(errors, ",").alias("errors"))


@query("SELECT p_partkey, concat_ws(',', CASE WHEN length(trim(p_name)) = 0 OR length(p_name) > 255 THEN 'title' END, CASE WHEN p_size * 3 NOT BETWEEN 1 AND 100 THEN 'level' END) AS errors FROM part")
def upload_validation(spark, sf):
    p = load(spark, sf, "part")
    return p.select("p_partkey", F.array_join(access.upload_errors(F.col("p_name"), F.col("p_size") * 3), ",").alias("errors"))


@query(f"WITH {DOCS} SELECT id, source, c_name AS owner FROM docs LEFT JOIN customer ON c_custkey = uploaded_by WHERE access_level <= {LEVEL}")
def documents_with_owner(spark, sf):
    d, u = access.visible(documents(spark, sf), LEVEL), _users(spark, sf)
    return d.join(u, F.col("uploaded_by") == F.col("user_id"), "left").select("id", "source", F.col("c_name").alias("owner"))


@query(f"WITH {CHUNKS} SELECT (SELECT count(*) FROM docs WHERE access_level <= {LEVEL}) AS n_documents, (SELECT count(*) FROM chunks WHERE access_level <= {LEVEL}) AS n_chunks, (SELECT count(*) FROM conversations) AS n_messages")
def dashboard_counts(spark, sf):
    one = lambda df, name: df.agg(F.count("*").alias(name))
    d, c = access.visible(documents(spark, sf), LEVEL), access.visible(chunks(spark, sf), LEVEL)
    both = one(d, "n_documents").join(F.broadcast(one(c, "n_chunks")), F.lit(True))
    return both.join(F.broadcast(one(_messages(spark, sf), "n_messages")), F.lit(True))


@query(f"WITH {DOCS}, t AS (SELECT count(*) AS total FROM docs WHERE access_level <= {LEVEL}) SELECT total, ceil(total / 20.0)::BIGINT AS total_pages, 2 < ceil(total / 20.0) AS has_next, TRUE AS has_prev FROM t")
def pagination_meta(spark, sf):
    total = access.visible(documents(spark, sf), LEVEL).agg(F.count("*").alias("total"))
    return catalog.page_meta(total, 2, 20)


@query("SELECT conv_id, arg_max(role, turn) AS last_role, arg_max(text, turn) AS last_text FROM conversations GROUP BY conv_id")
def sessions_latest_message(spark, sf):
    m = _messages(spark, sf)
    return catalog.with_latest(m.select("conv_id").distinct(), m, "conv_id", "turn", "role", "text")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS position FROM r WHERE r <= 4""")
def history_last_n(spark, sf):
    return catalog.last_n(_messages(spark, sf), "conv_id", "turn", 4).select("conv_id", "turn", "role", "position")


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 1 ORDER BY turn LIMIT 50")
def session_messages_page(spark, sf):
    return catalog.page(_messages(spark, sf).where("conv_id = 1").select("conv_id", "turn", "role", "text"), [F.col("turn")], 1, 50)


@query("SELECT conv_id, turn FROM conversations WHERE conv_id % 3 <> 0")
def cascade_delete(spark, sf):
    m = _messages(spark, sf)
    sessions = m.select("conv_id").distinct()
    return catalog.cascade(sessions, sessions.where("conv_id % 3 = 0"), "conv_id", (m.select("conv_id", "turn"), "conv_id"))[1]


@query(f"""WITH {CHUNKS}, o AS (SELECT * FROM chunks WHERE id % 2 = 0), n AS (SELECT * FROM chunks WHERE id % 3 = 0)
SELECT coalesce(o.chunk_id, n.chunk_id) AS chunk_id, CASE WHEN n.chunk_id IS NOT NULL THEN 'new ' || n.text ELSE o.text END AS text,
  coalesce(o.start, n.start + 1)::INT AS start FROM o FULL JOIN n ON o.chunk_id = n.chunk_id""")
def upsert_chunks(spark, sf):
    c = chunks(spark, sf).select("chunk_id", "text", "start", "id")
    new = c.where("id % 3 = 0").select("chunk_id", F.concat(F.lit("new "), "text").alias("text"), (F.col("start") + 1).cast("int").alias("start"))
    return catalog.upsert(c.where("id % 2 = 0").drop("id"), new, "chunk_id", ["text"])


@query(f"WITH {CHUNKS} SELECT count(*) AS n_left, count(*) FILTER (id = 7) AS n_of_document FROM chunks WHERE id <> 7")
def delete_by_document(spark, sf):
    gone = chunks(spark, sf).where("id = 7").select("id")
    left = catalog.cascade(chunks(spark, sf), gone, "id")[0]
    return left.agg(F.count("*").alias("n_left"), F.count_if(F.col("id") == 7).alias("n_of_document"))


@query(f"WITH {CHUNKS}, n AS (SELECT id, count(*) AS chunk_count, count(*) FILTER (chunk_index % 2 = 1) AS lost FROM chunks GROUP BY id) SELECT id, chunk_count - lost AS chunk_count FROM n")
def chunk_count_decrement(spark, sf):
    c = chunks(spark, sf)
    counts = c.groupBy("id").agg(F.count("*").alias("chunk_count"))
    return catalog.decrement_counts(counts, c.where("chunk_index % 2 = 1"), "id")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'pending' END AS status FROM orders""")
def document_status(spark, sf):
    o = load(spark, sf, "orders")
    docs = o.select("o_orderkey", F.lit("pending").alias("status"))
    early = o.where("o_orderstatus in ('O', 'F')").select("o_orderkey", F.lit("processing").alias("status"), F.lit(1).alias("at"))
    late = o.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("completed").alias("status"), F.lit(2).alias("at"))
    return catalog.set_status(docs, early.unionByName(late), "o_orderkey", "at")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, upper(c_name) FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0")
def seed_users(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_name")
    return catalog.insert_absent(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0").withColumn("c_name", F.upper("c_name")), "c_custkey")


@query(f"WITH {CHUNKS} SELECT chunk_id, chunk_index FROM chunks WHERE id IN (SELECT id FROM docs WHERE access_level <= {LEVEL}) ")
def chunks_of_visible(spark, sf):
    d = access.visible(documents(spark, sf), LEVEL)
    return chunks(spark, sf).join(d.select("id"), "id", "left_semi").select("chunk_id", "chunk_index")


@query("SELECT count(*) AS n_vectors, 'cosine' AS metric FROM embeddings")
def collection_stats(spark, sf):
    return load(spark, sf, "embeddings").agg(F.count("*").alias("n_vectors"), F.lit("cosine").alias("metric"))


@query("SELECT 'documents' AS name, TRUE AS present, (SELECT count(*) FROM documents) AS n_rows UNION ALL SELECT 'labels', TRUE, (SELECT count(*) FROM labels) UNION ALL SELECT 'users', FALSE, NULL")
def required_tables(spark, sf):
    """Which of the tables that are needed a folder has, and their rows."""
    return stores.audit_folder(spark, sf, ["documents", "labels", "users"])


@query(f"""WITH {DOCS} SELECT id, CASE WHEN id % 5 = 0 THEN 'content ' || id || ' by 2' ELSE text END AS content, (CASE WHEN id % 5 = 0 THEN length('content ' || id || ' by 2') ELSE length(text) END)::INT AS char_count,
  CASE WHEN id % 3 = 0 THEN 'm' || id ELSE source END AS metadata FROM docs""")
def partial_update(spark, sf):
    """Changes of content, of metadata, or of both; of two of one chunk the later one counts."""
    d = documents(spark, sf)
    k = F.col("id").cast("string")
    chunks = d.select("id", F.col("text").alias("content"), F.length("text").alias("char_count"), F.col("source").alias("metadata"))
    change = lambda at: d.where("id % 5 = 0 OR id % 3 = 0").select("id", F.when(F.col("id") % 5 == 0, F.concat(F.lit("content "), k, F.lit(f" by {at}"))).alias("content"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("m"), k)).alias("metadata"), F.lit(at).alias("at"))
    return catalog.update_chunks(chunks, change(1).unionByName(change(2)), "id")


@query("""WITH c AS (SELECT event_id, user_id, CASE event_id % 4 WHEN 0 THEN ['s' || event_type] END AS s, CASE WHEN event_id % 3 = 0 THEN [event_type, 'x'] END AS t FROM events)
SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'user ' || user_id END AS document_title, s IS NULL AND t IS NULL AS no_keywords, array_to_string(CASE WHEN s IS NOT NULL OR t IS NOT NULL THEN coalesce(s, []) END, ',') AS semantic,
  array_to_string(CASE WHEN s IS NOT NULL OR t IS NOT NULL THEN coalesce(t, []) END, ',') AS technical FROM c""")
def chunk_reshape(spark, sf):
    """Titles of documents, and keywords out of JSON; none of the three lists makes a null."""
    e = load(spark, sf, "events")
    k = F.col("event_id")
    meta = F.to_json(F.struct(F.when(k % 4 == 0, F.array(F.concat(F.lit("s"), "event_type"))).alias("semantic_keywords"), F.when(k % 3 == 0, F.array("event_type", F.lit("x"))).alias("technical_keywords"), F.col("props").alias("other")))
    titles = e.select("user_id").distinct().where("user_id % 2 = 0").select("user_id", F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("title"))
    out = catalog.reshaped(e.select(k, "user_id", meta.alias("metadata")), titles, "user_id")
    lists = (F.array_join(F.col("keywords")[c], ",").alias(n) for c, n in (("semantic_keywords", "semantic"), ("technical_keywords", "technical")))
    return out.select("event_id", "document_title", F.col("keywords").isNull().alias("no_keywords"), *lists)


@query(f"""SELECT event_id, CASE WHEN event_id % 5 > 0 THEN CASE WHEN event_id % 2 = 0 THEN CASE event_id % 3 WHEN 0 THEN '{context.ANSWERS["General chat detected"]}' WHEN 1 THEN '{context.ANSWERS["Low relevance"]}' ELSE '{context.NOTHING_FITS}' END
  ELSE '{context.NOTHING_FOUND}' END END AS answer FROM events""")
def no_context_answers(spark, sf):
    """What is answered without a context, by the reason that a search gave."""
    k = F.col("event_id")
    reason = F.when(k % 3 == 0, "General chat detected (0.9)").when(k % 3 == 1, "Low relevance: 0.1")
    return load(spark, sf, "events").select(k, context.no_context_answer(F.when(k % 5 == 0, F.col("event_type")).otherwise(" "), k % 2 == 0, reason).alias("answer"))


@query("SELECT conv_id, sum(ceil(length(text) / 4.0))::BIGINT AS n_tokens, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY conv_id")
def token_totals(spark, sf):
    from plumbline.functions.text import token_estimate

    return _messages(spark, sf).groupBy("conv_id").agg(F.sum(token_estimate(F.col("text"))).alias("n_tokens"), F.sum(F.length("text")).alias("n_chars"))
