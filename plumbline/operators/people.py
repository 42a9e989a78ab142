"""Employee search: every person that a session names, searched in one plan and put back by session.

A session fans out into one search for each of its participants. A name that many sessions
mention is searched once. Search is hybrid, TOP candidates of which RERANKED go on; the texts
of the hits are joined in their order, and ``extract`` finds employees in them. A language
model's answer about a text is a parameter (``functions.text.employees`` reads it); the
default takes the e-mail addresses of the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import people
from plumbline.operators import catalog, context
from plumbline.sources.stores import stored

#: Candidates of a search, hits that are read, recent messages that name people.
TOP, RERANKED, RECENT = 10, 5, 5
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
EMPLOYEE = "array<struct<name:string,email:string,department:string,position:string>>"


def participants(messages: DataFrame, n: int = RECENT, names: Callable[[Column], Column] = people) -> DataFrame:
    """conv_id, place (from 0) and name of the people named in the user's last messages."""
    named = catalog.mentioned(messages, n, names)
    return named.select("conv_id", F.posexplode("people").alias("place", "name"))


def addresses(name: Column, body: Column) -> Column:
    """Employees by the different addresses of a text, in order, under the name that was searched."""
    found = F.array_distinct(F.regexp_extract_all(body, F.lit(EMAIL), F.lit(0)))
    return F.transform(found, lambda e: F.struct(name.alias("name"), e.alias("email"), F.lit("").alias("department"), F.lit("").alias("position"))).cast(EMPLOYEE)


def completed(name: Column, found: Column) -> Column:
    """Employees of a model's answer: those with an address, the searched name where they have none."""
    good = F.filter(found, lambda e: F.contains(e["email"], F.lit("@")))
    filled = lambda e: F.struct(
        F.coalesce(F.nullif(e["name"], F.lit("")), name).alias("name"), e["email"].alias("email"), F.coalesce(e["department"], F.lit("")).alias("department"), F.coalesce(e["position"], F.lit("")).alias("position")
    )
    return F.coalesce(F.transform(good, filled), F.array().cast(EMPLOYEE))


def search_people(named: DataFrame, search: Callable[[DataFrame], DataFrame], extract: Callable[[Column, Column], Column] = addresses) -> DataFrame:
    """conv_id and employees: for each name, in order of place, a struct of place, name,
    n_sources and employees. named: conv_id, place, name. search: hits (qid, text,
    final_rank) of queries (qid, query); called once, for all different names together."""
    asked = stored(named.select(F.col("name").alias("qid"), F.col("name").alias("query")).distinct(), "people")
    hits = search(asked).where(F.trim("text") != "")
    bodies = context.joined(hits, ["qid"], "final_rank", F.col("text"), "\n\n", "body")
    counts = hits.groupBy("qid").agg(F.count("*").alias("n_sources"))
    answers = bodies.join(counts, "qid").select(F.col("qid").alias("name"), "n_sources", extract(F.col("qid"), F.col("body")).alias("employees"))
    each = named.join(answers, "name", "left")
    row = F.struct("place", "name", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.coalesce("employees", F.array().cast(EMPLOYEE)).alias("employees"))
    return each.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("employees"))
