"""Documents, chunks, sessions and messages as tables: pages, counts, changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.text import people, session_title


def page(df: DataFrame, order: list[Column], number: int, limit: int) -> DataFrame:
    """Page number (from 1) of a limit of at most 100 rows."""
    limit = min(limit, 100)
    return df.orderBy(*order).offset((number - 1) * limit).limit(limit)


def page_after(df: DataFrame, newest: str, key: str, limit: int, after: tuple | None = None) -> DataFrame:
    """The next `limit` rows (100 at most), newest first and equal times by key, behind the row
    `after`, its (time, key). The filter stands in the scan, and no page before it is read,
    sorted or skipped, however deep it lies; rows that came meanwhile shift nothing."""
    if after is not None:
        at, last = F.lit(after[0]), F.lit(after[1])
        df = df.where((F.col(newest) <= at) & ((F.col(newest) < at) | (F.col(key) > last)))
    return df.orderBy(F.desc(newest), key).limit(min(limit, 100))


def page_meta(total: DataFrame, number: int, limit: int, count: str = "total") -> DataFrame:
    pages = F.ceil(F.col(count) / F.lit(limit))
    return total.select(count, pages.alias("total_pages"), (F.lit(number) < pages).alias("has_next"), F.lit(number > 1).alias("has_prev"))


def with_latest(parents: DataFrame, children: DataFrame, key: str, order: str, *fields: str) -> DataFrame:
    """Each parent with the fields of its last child, if it has one."""
    last = children.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("_last"))
    return parents.join(last, key, "left").select(*parents.columns, *(F.col(f"_last.{f}").alias(f"last_{f}") for f in fields))


def last_n(messages: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n messages of each session; rank 1 is the oldest of them."""
    recent = Window.partitionBy(key).orderBy(F.desc(order))
    back = Window.partitionBy(key).orderBy(order)
    kept = messages.withColumn("_r", F.row_number().over(recent)).where(F.col("_r") <= n).drop("_r")
    return kept.withColumn("position", F.row_number().over(back))


def upsert(old: DataFrame, new: DataFrame, key: str, updated: list[str]) -> DataFrame:
    """Rows of new replace the columns named in updated of rows that exist, and are added otherwise."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    pick = lambda c: F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*(pick(c).alias(c) if c in updated else F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in old.columns))


def update_chunks(chunks: DataFrame, changes: DataFrame, key: str = "chunk_id") -> DataFrame:
    """chunks (key, content, char_count, metadata) with the changes (key, content, metadata) that
    are not null put in place; new content has a new char_count. Of changes of one chunk the
    last one counts, by their column at. Changes of unknown chunks change nothing."""
    last = changes.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct("content", "metadata"), "at").alias("_new"))
    df = chunks.join(last, F.col(key) == F.col("_key"), "left")
    put = {
        "content": F.coalesce("_new.content", "content"),
        "char_count": F.when(F.col("_new.content").isNotNull(), F.length("_new.content")).otherwise(F.col("char_count")),
        "metadata": F.coalesce("_new.metadata", "metadata"),
    }
    return df.select(*(put[c].alias(c) if c in put else F.col(c) for c in chunks.columns))


#: The lists of keywords in a chunk's metadata.
KEYWORDS = ("semantic_keywords", "technical_keywords", "all_keywords")


def reshaped(chunks: DataFrame, titles: DataFrame, doc: str = "document_id") -> DataFrame:
    """chunks with document_title, and keywords lifted out of their JSON metadata: a struct of
    three lists, those that are absent empty, or null if all three are. titles: doc, title."""
    found = F.from_json("metadata", "struct<" + ", ".join(f"{k}: array<string>" for k in KEYWORDS) + ">")
    named = titles.select(F.col(doc).alias("_doc"), F.col("title").alias("document_title"))
    df = chunks.withColumn("_k", found).join(named, F.col(doc) == F.col("_doc"), "left")
    none = F.array().cast("array<string>")
    lifted = F.struct(*(F.coalesce(F.col("_k")[k], none).alias(k) for k in KEYWORDS))
    some = F.coalesce(*(F.col("_k")[k] for k in KEYWORDS)).isNotNull()
    return df.select(*chunks.columns, "document_title", F.when(some, lifted).alias("keywords"))


def replace_document(chunks: DataFrame, new: DataFrame, doc: str = "document_id") -> DataFrame:
    """All chunks of the documents in new are replaced, so none is left over."""
    return chunks.join(new.select(doc).distinct(), doc, "left_anti").unionByName(new)


def cascade(parent: DataFrame, gone: DataFrame, key: str, *children: tuple[DataFrame, str]) -> list[DataFrame]:
    """What stays of a parent and its children when the parents in gone are deleted."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    keep = lambda df, k: df.join(ids, F.col(k) == F.col("_gone"), "left_anti")
    return [keep(parent, key), *(keep(df, k) for df, k in children)]


def insert_absent(table: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    return table.unionByName(seed.join(table.select(key), key, "left_anti").select(*table.columns))


def decrement_counts(docs: DataFrame, deleted: DataFrame, doc: str, count: str = "chunk_count") -> DataFrame:
    lost = deleted.groupBy(doc).agg(F.count("*").alias("_lost"))
    return docs.join(lost, doc, "left").withColumn(count, F.greatest(F.lit(0), F.col(count) - F.coalesce("_lost", F.lit(0)))).drop("_lost")


def set_status(docs: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last change of each document decides its status."""
    last = changes.groupBy(key).agg(F.max_by("status", order).alias("_status"))
    return docs.join(last, key, "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def set_processed(docs: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last change of each document decides its status, when it was processed and its
    number of chunks. changes: key, status, at, chunk_count and what orders them."""
    last = changes.groupBy(key).agg(F.max_by(F.struct("status", "at", "chunk_count"), order).alias("_last"))
    done = F.col("_last.status") == "completed"
    return docs.join(last, key, "left").select(
        *(c for c in docs.columns if c != "status"), F.coalesce("_last.status", "status").alias("status"), F.coalesce(done, F.lit(False)).alias("processed"),
        F.when(done, F.col("_last.at")).alias("processed_at"), F.col("_last.chunk_count").alias("chunk_count"),
    )


def append_turns(sessions: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All sessions, and the messages of the requests. A request whose session is not its
    user's own, or is not named, opens one, with an id that a retry gives again.
    sessions: session_id, user_id, title. requests: request_id, user_id, session_id,
    question, answer."""
    own = sessions.select(F.col("session_id").alias("_session"), F.col("user_id").alias("_user"))
    df = requests.join(own, (F.col("session_id") == F.col("_session")) & (F.col("user_id") == F.col("_user")), "left")
    made = F.md5(F.concat_ws(":", F.col("user_id").cast("string"), F.col("request_id").cast("string")))
    df = df.select("request_id", "user_id", "question", "answer", F.coalesce("_session", made).alias("session_id"), F.col("_session").isNull().alias("is_new"))
    opened = df.where("is_new").select("session_id", "user_id", session_title(F.col("question")).alias("title"))
    turns = F.array(F.struct(F.lit(0).alias("place"), F.lit("user").alias("role"), F.col("question").alias("text")), F.struct(F.lit(1).alias("place"), F.lit("assistant").alias("role"), F.col("answer").alias("text")))
    return sessions.select("session_id", "user_id", "title").unionByName(opened), df.select("session_id", "request_id", F.inline(turns))


def mentioned(messages: DataFrame, n: int = 5, names: Callable[[Column], Column] = people) -> DataFrame:
    """conv_id and the people named in the user's messages among the last n, in order."""
    recent = last_n(messages, "conv_id", "turn", n).where("role = 'user'")
    each = F.array_sort(F.collect_list(F.struct("turn", names(F.coalesce("text", F.lit(""))).alias("names"))))
    named = recent.groupBy("conv_id").agg(F.flatten(F.transform(each, lambda x: x["names"])).alias("names"))
    return named.select("conv_id", F.array_distinct("names").alias("people"))
