"""Queries of streams: lines of answers, activity, ingest with retries, cache figures.

Those that run a stream read the table as one, until all there is has been read, and give what
came out of it; their SQL says the same of the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import catalog, diagnostics, retrieval
from plumbline.plans.retrieval_queries import _BM25, _TALK
from plumbline.plans.tables import Q_SQL, load, search_index
from plumbline.sources.stores import fresh, is_folder, shared_dir
from plumbline.streaming import answers, jobs, sessions
from plumbline.streaming.retries import Ingest

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = (run, sql)
        return run

    return add


def _stream(spark, sf, name):
    """A table as a stream."""
    reader, at = spark.readStream.schema(load(spark, sf, name).schema), f"{sf}/{name}.parquet"
    # A table that is one file is read from the folder that it lies in.
    return reader.parquet(at) if is_folder(spark, at) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _streamed(spark, sf, name, job):
    """Runs job over the table as a stream; gives what it wrote."""
    place = f"{shared_dir(spark)}/stream-{fresh()}"
    out = job(_stream(spark, sf, name))
    out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/out")


#: Fifty events in a row are an answer. A purchase ends a line in the middle of its piece.
_LINES = """WITH e AS (SELECT event_id // 50 AS answer_id, event_id, epoch_us(ts) AS us, event_type = 'purchase' AS p, CASE WHEN event_type = 'purchase' THEN 'b' || event_id || chr(10) || 'n' || event_id || ' ' ELSE event_type || event_id || ' ' END AS piece FROM events),
a AS (SELECT answer_id, string_split(string_agg(piece, '' ORDER BY event_id), chr(10)) AS ls, list(us ORDER BY event_id) FILTER (p) AS stamps FROM e GROUP BY answer_id)
SELECT answer_id, i - 1 AS line_no, ls[i] AS line, stamps[i] AS us FROM (SELECT *, unnest(range(1, len(ls))) AS i FROM a)"""


def _pieces(events):
    e = F.col("event_id")
    said = F.when(F.col("event_type") == "purchase", F.concat(F.lit("b"), e, F.lit("\nn"), e, F.lit(" "))).otherwise(F.concat("event_type", e, F.lit(" ")))
    return events.select(F.floor(e / 50).alias("answer_id"), (e % 50).alias("number"), F.col("ts").cast("timestamp").alias("ts"), said.alias("piece"))


def _shown(lines):
    return lines.select("answer_id", F.col("line_no").cast("long").alias("line_no"), "line", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@query(_LINES)
def stream_lines(spark, sf):
    """Lines out of pieces, as a table."""
    return _shown(answers.lines(_pieces(load(spark, sf, "events"))))


@query(_LINES)
def stream_lines_state(spark, sf):
    """The same as a stream that keeps unfinished lines as state."""
    return _shown(_streamed(spark, sf, "events", lambda df: answers.line_stream(_pieces(df))))


@query("""WITH e AS (SELECT event_id // 50 AS answer_id, event_id, epoch_us(ts) / 1e6 AS s, event_type = 'purchase' AS p FROM events),
n AS (SELECT answer_id, min(event_id) FILTER (p) AS last, arg_min(s, event_id) AS asked FROM e GROUP BY answer_id)
SELECT answer_id, count(*) AS n_tokens, round(min(s) - any_value(asked), 6) AS first_token_s, round(max(s) - any_value(asked), 6) AS total_s, bool_or(p) AS done,
  CASE WHEN max(s) - any_value(asked) <> 0 THEN round(count(*) / (max(s) - any_value(asked)), 6) END AS tokens_per_s
FROM e JOIN n USING (answer_id) WHERE last IS NULL OR event_id <= last GROUP BY answer_id""")
def answer_timings(spark, sf):
    """Each event is a token, as a JSON line cut before its end; a purchase is the last one."""
    e = load(spark, sf, "events")
    line = F.to_json(F.struct(F.col("event_type").alias("response"), (F.col("event_type") == "purchase").alias("done")))
    piece = e.select(F.floor(F.col("event_id") / 50).alias("answer_id"), (F.col("event_id") % 50).alias("number"), F.col("ts").cast("timestamp").alias("ts"), F.concat(line, F.lit("\n")).alias("piece"))
    asked = piece.where("number = 0").select("answer_id", F.col("ts").alias("asked_at"))
    return answers.timings(answers.tokens(answers.lines(piece)), asked)


_ACTIVITY = "SELECT user_id, epoch_us(max(ts)) AS updated_us, count(*) AS n_messages FROM events GROUP BY user_id"


def _activity_shown(df):
    return df.select("user_id", F.unix_micros("updated_at").alias("updated_us"), "n_messages")


@query(_ACTIVITY)
def session_activity(spark, sf):
    return _activity_shown(sessions.activity(load(spark, sf, "events"), "user_id"))


@query(_ACTIVITY)
def session_activity_state(spark, sf):
    """The same from the updates of a stream with state."""
    return _activity_shown(sessions.current(_streamed(spark, sf, "events", lambda df: sessions.activity_stream(df, "user_id")), "user_id"))


@query("SELECT user_id, epoch_us(max(ts)) AS updated_us, count(*) AS n_messages FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 20 OFFSET 20")
def sessions_page(spark, sf):
    """The second page of sessions by last activity, found behind the last row of the first."""
    table = sessions.activity(load(spark, sf, "events"), "user_id")
    first = catalog.page_after(table, "updated_at", "user_id", 20).collect()  # a page
    after = (first[-1].updated_at, first[-1].user_id) if first else None
    return _activity_shown(catalog.page_after(table, "updated_at", "user_id", 20, after))


@query("""SELECT doc_id, CASE WHEN doc_id % 6 > 3 THEN 'error' ELSE 'completed' END AS status, CASE WHEN doc_id % 6 > 3 THEN 4 END AS attempts,
  CASE WHEN doc_id % 6 > 3 THEN 0 ELSE len(string_split(coalesce(text, ''), chr(10))) END AS n_chunks FROM documents""")
def ingest_retries(spark, sf):
    """Documents as files, each of which fails as often as its id by 6 leaves: those that fail
    over three times again end in the dead letters, and nothing of them is kept."""

    def process(files):
        number = F.regexp_extract("path", r"(\d+)$", 1).cast("long")
        failed = F.col("attempt") <= number % 6
        chunks = files.select("path", F.lit(None).cast("string").alias("error"), F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("chunk_index", "text"))
        return chunks.unionByName(files.where(failed).select("path", F.lit("failed").alias("error"), F.lit(-1).alias("chunk_index"), F.lit(None).cast("string").alias("text")))

    docs = load(spark, sf, "documents")
    job = Ingest(spark, f"{shared_dir(spark)}/ingest-{fresh()}", process)
    job.step(docs.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content")), 0, 0.0)
    for k in range(1, 4):
        job.drain(60.0 * k)
    number = F.regexp_extract("path", r"(\d+)$", 1).cast("long").alias("doc_id")
    kept = job.living().groupBy("path").agg(F.count("*").alias("n_chunks")).select(number, F.lit("completed").alias("status"), F.lit(None).cast("int").alias("attempts"), "n_chunks")
    return kept.unionByName(job.dead().select(number, F.lit("error").alias("status"), "attempts", F.lit(0).cast("long").alias("n_chunks")))


@query("""WITH n AS (SELECT floor(epoch(max(ts)))::BIGINT AS now FROM events), c AS (SELECT CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'bm25' ELSE 'other' END AS prefix, floor(epoch(ts))::BIGINT AS made, user_id || ':' || event_id AS k,
  CASE event_type WHEN 'view' THEN 86400 WHEN 'click' THEN 604800 ELSE 3600 END AS ttl FROM events)
SELECT prefix, count(*) AS n_keys, count(*) FILTER (now - made < ttl) AS n_alive, max(now - made) FILTER (now - made < ttl) AS oldest_s, min(ttl - (now - made)) FILTER (now - made < ttl) AS next_expiry_s,
  round(avg(now - made) FILTER (now - made < ttl), 6) AS mean_age_s, coalesce(sum(length(k)) FILTER (now - made < ttl), 0)::BIGINT AS n_bytes FROM c, n GROUP BY prefix""")
def cache_statistics(spark, sf):
    """Keys by prefix, those alive at the time of the last event, with ages and expiry."""
    e = load(spark, sf, "events")
    kind = F.col("event_type")
    entries = e.select(
        F.concat(F.when(kind == "view", "search").when(kind == "click", "bm25").otherwise("other"), F.lit(":"), F.col("user_id"), F.lit(":"), F.col("event_id")).alias("key"),
        F.unix_timestamp("ts").alias("written"), F.when(kind == "view", 86400).when(kind == "click", 604800).otherwise(3600).alias("ttl"), F.concat_ws(":", "user_id", "event_id").alias("value"),
    )
    now = e.agg(F.max(F.unix_timestamp("ts")).alias("now"))
    return diagnostics.cache_statistics(entries.join(F.broadcast(now), F.lit(True)), F.col("now"))


_ASKED = _BM25.replace(Q_SQL, _TALK)


@query(f"WITH {_ASKED} SELECT qid, id, rank::INT AS rank, round(score, 6) AS score, CASE WHEN qid % 3 = 0 THEN 'search' ELSE 'rag' END AS kind FROM bm WHERE rank <= 3")
def answered_queries(spark, sf):
    """What users began their conversations with, as a stream of queries of two kinds, each
    answered into a folder of its kind by the stored index."""
    index = search_index(spark, sf)
    asked = _stream(spark, sf, "conversations").where("role = 'user' AND turn = 0")
    asked = asked.select(F.col("conv_id").alias("qid"), F.col("text").alias("query"), F.when(F.col("conv_id") % 3 == 0, "search").otherwise("rag").alias("kind"))
    place = f"{shared_dir(spark)}/answers-{fresh()}"
    search = lambda q: retrieval.bm25_top(index, q, 3).select("qid", "id", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))
    jobs.answers(asked, search, f"{place}/out", f"{place}/state").awaitTermination()
    return spark.read.schema("qid long, id long, rank int, score double, kind string, batch int").parquet(f"{place}/out").drop("batch")
