"""From hits to a context: documents, chunks within a budget, sources without repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What a hit needs, how many hits and documents are kept, how long a context may be.
MIN_SCORE, MOST_HITS, MOST_DOCS, BUDGET = 7.0, 10, 2, 8000


def best_documents(hits: DataFrame, min_score: float = MIN_SCORE, hit_limit: int = MOST_HITS, docs: int = MOST_DOCS, score: str = "rerank_score") -> DataFrame:
    """qid, doc_id, best_score, n_chunks, doc_rank of each query's best documents."""
    order = Window.partitionBy("qid").orderBy(F.desc(score), "id")
    kept = hits.where(F.col(score) >= min_score).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= hit_limit)
    by_doc = kept.groupBy("qid", "doc_id").agg(F.max(score).alias("best_score"), F.count("*").alias("n_chunks"))
    rank = Window.partitionBy("qid").orderBy(F.desc("best_score"), "doc_id")
    return by_doc.withColumn("doc_rank", F.row_number().over(rank)).where(F.col("doc_rank") <= docs)


def select_chunks(hits: DataFrame, budget: int = BUDGET, score: str = "rerank_score") -> DataFrame:
    """The chunks of each (query, document) that are near its best and fit the budget
    together: the wider the scores, the fewer chunks and the nearer."""
    group = Window.partitionBy("qid", "doc_id")
    best, spread = F.max(score).over(group), F.max(score).over(group) - F.min(score).over(group)
    wide, middle = spread > 0.1, spread > 0.05
    near = F.when(wide, best - spread * 0.3).when(middle, best - spread * 0.5).otherwise(best - 0.02)
    limit = F.greatest(near, best * 0.4)
    order = group.orderBy(F.desc(score), "id")
    df = hits.withColumn("_limit", limit).withColumn("_most", F.when(wide, 2).otherwise(3)).where(F.col(score) >= F.col("_limit"))
    df = df.withColumn("position", F.row_number().over(order)).where(F.col("position") <= F.col("_most"))
    return within_budget(df, budget, ["qid", "doc_id"], [F.col("position")]).drop("_limit", "_most")


def within_budget(df: DataFrame, budget: int, by: list[str], order: list[Column], text: str = "text") -> DataFrame:
    """The longest beginning of each group whose lengths add up to the budget at most."""
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("running_length", F.sum(F.length(F.coalesce(text, F.lit("")))).over(run)).where(F.col("running_length") <= budget)


def joined(df: DataFrame, by: list[str], order: str, text: Column, separator: str, name: str) -> DataFrame:
    """Texts of a group in order, as one string."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(rows, lambda r: r["t"]), separator).alias(name))


def context(df: DataFrame, order: str = "final_rank", title: str = "title", text: str = "text") -> DataFrame:
    """The numbered sources of a query as one string."""
    line = F.concat(F.lit("[Источник "), F.col(order).cast("string"), F.lit(": "), F.col(title), F.lit("]\n"), F.col(text), F.lit("\n"))
    return joined(df, ["qid"], order, line, "\n", "context")


#: The title of a document that has none, and what a task says of its hits.
NO_TITLE = "Неизвестный документ"
FILTERED = "All results filtered by SearchService adaptive thresholds"
PROCESSED = "Results processed by adaptive filtering in SearchService"


def with_titles(df: DataFrame, titles: DataFrame, key: str) -> DataFrame:
    """df with the title of its document, a default where there is none. titles: key and title."""
    named = titles.select(F.col(key).alias("_key"), F.col("title").alias("_title"))
    return df.join(named, F.col(key) == F.col("_key"), "left").withColumn("title", F.coalesce("_title", F.lit(NO_TITLE))).drop("_key", "_title")


def task_result(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """A row for each query: context, sources, filtered_count, best_relevance_score,
    relevance_filtered, reason. hits: qid, id, title, text, rerank_score, final_rank."""
    source = F.struct("final_rank", F.col("id").alias("chunk_id"), F.col("title").alias("document_title"), "rerank_score", "text")
    line = lambda s: F.concat(F.lit("[Источник "), s["final_rank"].cast("string"), F.lit(": "), s["document_title"], F.lit("]\n"), s["text"], F.lit("\n"))
    found = hits.groupBy("qid").agg(F.array_sort(F.collect_list(source)).alias("sources"))
    df = queries.join(found, "qid", "left").withColumn("_none", F.col("sources").isNull())
    return df.select(
        *queries.columns, F.coalesce(F.array_join(F.transform("sources", line), "\n"), F.lit("")).alias("context"), F.coalesce("sources", F.array().cast(found.schema["sources"].dataType)).alias("sources"),
        F.coalesce(F.size("sources"), F.lit(0)).cast("long").alias("filtered_count"), F.get("sources", 0)["rerank_score"].alias("best_relevance_score"),
        F.col("_none").alias("relevance_filtered"), F.when(F.col("_none"), FILTERED).otherwise(PROCESSED).alias("reason"),
    )


def coverage(found: Column, total: Column, score: Column) -> Column:
    return F.format_string("(%d из %d частей, score: %.3f)", found, total, score)


def without_repeats(df: DataFrame, by: str, order: str, text: str = "text") -> DataFrame:
    """The first of equal texts of a query, renumbered."""
    same = Window.partitionBy(by, F.trim(text)).orderBy(order)
    kept = df.withColumn("_n", F.row_number().over(same)).where(F.col("_n") == 1).drop("_n")
    return kept.withColumn("number", F.row_number().over(Window.partitionBy(by).orderBy(order)))


def unique_sources(df: DataFrame, by: str, order: str, *keys: tuple[str, ...]) -> DataFrame:
    """The sources of a query that have no source before them with an equal key, by any of the keys."""
    for i, key in enumerate(keys):
        df = df.withColumn(f"_n{i}", F.row_number().over(Window.partitionBy(by, *key).orderBy(order)))
    names = [f"_n{i}" for i in range(len(keys))]
    return df.where(F.greatest(F.lit(1), *names) == 1).drop(*names)


def no_answer_reason(best: Column, n_hits: Column) -> Column:
    return F.when(F.coalesce(n_hits, F.lit(0)) == 0, "no_results").when(best < MIN_SCORE, "low_relevance").otherwise("ok")


#: What is answered without a context, by the reason that a search gives.
ANSWERS = {
    "General chat detected": "Привет! Я помощник по работе с базой знаний. Задайте мне вопрос по загруженным документам, и я помогу найти нужную информацию.",
    "Low relevance": "Ваш вопрос не связан с информацией в базе знаний. Попробуйте переформулировать запрос или задать вопрос по содержимому загруженных документов.",
}
NOTHING_FITS = "К сожалению, я не нашел релевантной информации в базе знаний для вашего вопроса."
NOTHING_FOUND = NOTHING_FITS + " Возможно, стоит переформулировать запрос или проверить уровень доступа к документам."


def no_context_answer(context: Column, filtered: Column, reason: Column) -> Column:
    """The answer to a query without a context, by why it has none; null where it has one."""
    why = None
    for said, answer in ANSWERS.items():
        hit = F.contains(F.coalesce(reason, F.lit("")), F.lit(said))
        why = F.when(hit, answer) if why is None else why.when(hit, answer)
    return F.when(F.trim(F.coalesce(context, F.lit(""))) == "", F.when(F.coalesce(filtered, F.lit(False)), why.otherwise(NOTHING_FITS)).otherwise(NOTHING_FOUND))


def grouped_line(number: Column, title: Column, found: Column, total: Column, score: Column) -> Column:
    """The head line of a document's chunks in a context."""
    return F.concat(F.lit("[Источник "), number.cast("string"), F.lit(": "), title, F.lit(" "), coverage(found, total, score), F.lit("]"))


#: Models of large contexts, and their budget.
LARGE, LARGE_BUDGET = "20b", 16000


def budget_of(model: Column) -> Column:
    return F.when(F.contains(F.lower(model), F.lit(LARGE)), LARGE_BUDGET).otherwise(BUDGET)
