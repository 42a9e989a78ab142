import pytest
from pyspark.sql import functions as F

from plumbline.functions import calendar
from plumbline.operators import keywords, structure
from plumbline.sources import stores


def test_diverse_prefers_high_scores_without_shared_words():
    terms = [(10.0, "red car"), (9.5, "red"), (9.0, "car"), (5.0, "tree"), (1.0, "leaf")]
    assert keywords.diverse(terms, 3, 0.5) == ["red car", "tree", "red"]
    assert keywords.diverse(terms, 2, 0.0) == ["red car", "red"]
    assert keywords.diverse([], 3, 0.5) == []


def test_mmr_and_backfill(spark):
    docs = spark.createDataFrame([("a", "alpha beta alpha beta gamma common"), ("b", "common word common word"), ("c", "")], "id string, text string")
    out = {r.id: r["keywords"] for r in keywords.mmr_keywords(docs).collect()}
    assert out["a"][:2] == ["beta", "alpha"] and set(out) == {"a", "b"}
    long = "The Python service writes app.py and calls load() on PostgreSQL, again and again."
    df = spark.createDataFrame([(1, long, None), (2, long, ["old"]), (3, "Python", [])], "id int, text string, keywords array<string>")
    got = {r.id: r["keywords"] for r in keywords.backfill(df).collect()}
    assert got[2] == ["old"] and got[3] == [] and {"python", "app.py", "load()", "postgresql"} <= set(got[1])


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    chunks = spark.createDataFrame([("a_0", 10, ["x", "y"]), ("a_1", 60, [])], "chunk_id string, access_level int, keywords array<string>")
    vectors = spark.createDataFrame([("a_0", [1.0]), ("a_1", [2.0])], "chunk_id string, v array<double>")
    assert stores.write_chunks(chunks, vectors, path) == 2
    with pytest.raises(ValueError):
        stores.write_chunks(chunks, vectors.limit(1), path)
    seen = stores.read_chunks(spark, path, 50, "chunk_id")
    assert [r.chunk_id for r in seen.collect()] == ["a_0"]
    assert "PushedFilters: [IsNotNull(access_level), LessThanOrEqual(access_level,50)]" in seen._jdf.queryExecution().executedPlan().toString()
    assert [r["keywords"] for r in stores.for_flat_store(chunks).orderBy("chunk_id").collect()] == ["x,y", ""]
    stores.write_report(chunks, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2
    chunks.createOrReplaceTempView("chunks_here")
    assert {r.name: r.present for r in stores.audit(spark, ["chunks_here", "absent"]).collect()} == {"chunks_here": True, "absent": False}


def test_calendar(spark):
    answer = '{"title": " Встреча по плану ", "datetime": "2024-05-01T10:00:00", "participants": ["", "Анна"], "location": " зал "}'
    rows = [(answer, "назначь"), ('{"title": "x", "datetime": "soon", "participants": []}', ""), ('{"title": "x", "datetime": "2024-05-01T10:00:00", "participants": []}', "Создай С НИМИ"), ("none", "")]
    df = spark.createDataFrame(rows, "a string, m string")
    out = [r.c for r in df.select(calendar.command(F.col("a"), F.col("m"), F.array(F.lit("Пётр"))).alias("c")).collect()]
    assert out[0].title == "Встреча по плану" and out[0].participants == ["Анна"] and out[0].location == "зал" and (out[0].end - out[0].start).seconds == 3600
    assert out[1] is None and out[2].participants == ["Пётр"] and out[3] is None
    text = "CALENDAR_ACTION: CREATE_EVENT\nEVENT_TITLE: Sync \nEVENT_DATE: 2024-05-01\nEVENT_TIME: 10:30\nATTENDEES: a@x, b@y"
    got = spark.createDataFrame([(text,), ("CALENDAR_ACTION: CREATE_EVENT",)], "a string").select(calendar.action(F.col("a")).alias("c")).collect()
    assert got[0].c.title == "Sync" and got[0].c.attendees == ["a@x", "b@y"] and got[1].c is None


def test_grouped_rows_and_text_around_tables(spark):
    rows = spark.createDataFrame([("t", i, f"r{i}") for i in range(1, 11)], "id string, row_index int, text string")
    out = [r.text for r in structure.grouped_rows(rows).orderBy("group_no").collect()]
    assert out == ["\n".join(f"r{i}" for i in range(1, 9)), "(продолжение)\nr9\nr10"]
    found = spark.createDataFrame([("d", 1, 10, "a" * 300 + "T" * 50 + "b" * 100 + "U" * 50 + "c" * 250)], "id string, section_no int, start int, content string")
    tables = spark.createDataFrame([("d", 1, 310, 50), ("d", 1, 460, 50)], "id string, section_no int, position int, size int")
    got = [(r.chunk_type, r.text[0], len(r.text)) for r in structure.around_tables(found, tables).orderBy("from").collect()]
    assert got == [("text_before_table", "a", 300), ("text_after_table", "c", 250)]
