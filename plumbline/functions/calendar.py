"""Calendar commands as parsers of a model's answer, which is a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import any_of, json_object

MINUTES = 60
#: Stems of calendar requests, and words that stand for people named before.
STEMS = ["встреч", "совещан", "поставь", "назначь", "создай"]
THEM = ["с ними", "с ним"]


def is_command(question: Column) -> Column:
    return any_of(question, STEMS)


def command(answer: Column, message: Column, mentioned: Column) -> Column:
    """title, start, end, participants, location of a meeting; null if a required field
    is missing or the time cannot be read. Without participants, those mentioned before
    are meant where the message says so."""
    p = json_object(answer, "title string, datetime string, participants array<string>, location string, duration double")
    named = F.filter(p["participants"], lambda x: x.isNotNull() & (F.trim(x) != ""))
    who = F.when((F.size(p["participants"]) == 0) & any_of(message, THEM), mentioned).otherwise(named)
    start = F.try_to_timestamp(p["datetime"])
    minutes = F.when(p["duration"] > 0, p["duration"]).otherwise(F.lit(float(MINUTES)))
    end = F.timestamp_seconds(F.unix_timestamp(start) + minutes * 60)
    ok = (F.coalesce(p["title"], F.lit("")) != "") & p["participants"].isNotNull() & start.isNotNull()
    title = F.when(F.trim(p["title"]) == "", "Встреча").otherwise(F.trim(p["title"]))
    return F.when(ok, F.struct(title.alias("title"), start.alias("start"), end.alias("end"), who.alias("participants"), F.trim(p["location"]).alias("location")))


def action(answer: Column) -> Column:
    """Fields of an action that an answer carries; null unless all are there."""
    get = lambda p: F.nullif(F.regexp_extract(answer, p, 1), F.lit(""))
    title, day, time, who = (get(p) for p in (r"EVENT_TITLE:\s*(.+)", r"EVENT_DATE:\s*(\d{4}-\d{2}-\d{2})", r"EVENT_TIME:\s*(\d{2}:\d{2})", r"ATTENDEES:\s*(.+)"))
    ok = answer.rlike(r"CALENDAR_ACTION:\s*CREATE_EVENT") & title.isNotNull() & day.isNotNull() & time.isNotNull() & who.isNotNull()
    people = F.transform(F.split(who, ","), lambda x: F.trim(x))
    return F.when(ok, F.struct(F.trim(title).alias("title"), day.alias("day"), time.alias("time"), people.alias("attendees")))


def document_of(chunk_id: Column) -> Column:
    return F.split_part(chunk_id, F.lit("_"), F.lit(1))
