import io
import json
import zipfile

from pyspark.sql import functions as F

from plumbline.operators import structure
from plumbline.sources import files
from plumbline.streaming import jobs

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(*parts):
    para = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{para(t)}</w:tc>"
    body = "".join(para(p) if isinstance(p, str) else "<w:tbl>" + "".join("<w:tr>" + "".join(map(cell, r)) + "</w:tr>" for r in p) + "</w:tbl>" for p in parts)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files_become_texts(spark, tmp_path):
    (tmp_path / "a.DOCX").write_bytes(docx("Hello  world", [["h1", "h2"], ["", ""], ["1", ""]], "end"))
    (tmp_path / "b.csv").write_bytes("имя;город\nАнна;Москва\n;\nПётр;\n".encode("cp1251"))
    deep = {"k": "v"}
    for _ in range(11):
        deep = {"d": deep}
    (tmp_path / "c.json").write_text(json.dumps({"a": {"b": [1, {"c": True}]}, "n": None, "e": " ", "f": False, "deep": deep}))
    (tmp_path / "d.pdf").write_text("x")
    (tmp_path / "e.json").write_text("{broken")
    (tmp_path / "f.csv").write_text("")
    out = {r.path[-5:].lower(): r for r in files.extracted(files.read(spark, str(tmp_path))).collect()}
    assert out[".docx"[-5:]].text == "Hello world\n[Заголовки таблицы: h1 | h2]\n[Строка 1: 1]\nend"
    assert out["b.csv"].text == "Заголовки: имя, город\nСтрока 1: имя: Анна; город: Москва\nСтрока 3: имя: Пётр"
    body = files.json_lines({"a": {"b": [1, {"c": True}]}, "n": None, "e": " ", "f": False, "deep": deep})
    assert body[:3] == ["a.b[0]: 1", "a.b[1].c: да", "f: нет"] and body[3].endswith("[слишком глубокая вложенность]")
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in files.extracted(files.read(spark, str(tmp_path))).collect()}
    assert errors["d.pdf"] == "unsupported" and "f.csv" not in errors and "JSONDecodeError" in errors["e.json"] and errors["a.DOCX"] is None


def test_csv_note_after_the_first_rows(spark):
    rows = "a,b\n" + "".join(f"{i},x\n" for i in range(1001))
    got = files.csv_file_text(rows.encode()).split("\n")
    assert len(got) == 1002 and got[-1].startswith("... (файл")
    df = spark.createDataFrame([("t", i + 1, str(i), "x") for i in range(1001)], "t string, n int, a string, b string")
    assert files.csv_text(df, "t", "n", ["a", "b"]).first().text.split("\n") == got
    assert files.json_lines([1, [2]]) == ["элемент_0: 1", "элемент_1[0]: 2"]


def test_ingest_is_idempotent_and_replaces(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()

    def process(batch):
        docs = batch.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("id"), F.col("content").cast("string").alias("text"))
        return structure.fixed_chunks(docs).withColumnRenamed("id", "document_id")

    def go():
        stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(src)
        jobs.ingest(stream, process, out, state).awaitTermination()
        return jobs.current(spark.read.parquet(out))

    (tmp_path / "in/a.txt").write_text("x" * 2500)
    assert go().count() == 3
    assert go().count() == 3
    (tmp_path / "in/b.txt").write_text("hello")
    assert sorted(r.document_id for r in go().collect()) == ["a", "a", "a", "b"]


def test_rate_limit_stream_equals_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") % 3).alias("user_id"), "event_id", "ts")
    want = sorted((r.user_id, r.event_id, r.accepted) for r in jobs.rate_limited(e, window=200_000.0).collect())
    assert {w[2] for w in want} == {True, False}
    ordered = e.orderBy("ts", "event_id")
    half = ordered.limit(500)
    src = str(tmp_path / "ev")
    half.coalesce(1).write.parquet(src + "/1")
    ordered.join(half.select("event_id"), "event_id", "left_anti").select(e.columns).coalesce(1).write.parquet(src + "/2")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    q = jobs.rate_limited_stream(stream, window=200_000.0).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.user_id, r.event_id, r.accepted) for r in spark.table("limited").collect()) == want


def test_fresh_results(spark, tmp_path):
    rows = [(f"k{i % 2}", f"2024-01-01 00:0{i}:00") for i in range(6)]
    df = spark.createDataFrame(rows, "cache_key string, ts string").select("cache_key", F.col("ts").cast("timestamp").alias("ts"))
    df.write.parquet(str(tmp_path / "r"))
    q = jobs.fresh_results(spark.readStream.schema(df.schema).parquet(str(tmp_path / "r"))).writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("fresh").count() == 2


def test_rate_limit_equals_brute_force(spark):
    """Users with pauses, a busy user, ties, null users and times."""
    import random

    rng = random.Random(2)
    rows = [(rng.choice([1, 2, 3, 3, 3, 3, None]), i, rng.choice([None] + [rng.randint(0, 4000)] * 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "user_id int, event_id int, s int").selectExpr("user_id", "event_id", "timestamp_seconds(s) AS ts")
    got = {r.event_id: r.accepted for r in jobs.rate_limited(df, window=60.0, most=5).collect()}
    want = {}
    for u in (1, 2, 3, None):
        mine = sorted((s, i) for v, i, s in rows if v == u and s is not None)
        ok, _ = jobs.accepted([float(s) for s, _ in mine], [], 60.0, 5)
        want |= {i: a and u is not None for (_, i), a in zip(mine, ok)} | {i: False for v, i, s in rows if v == u and s is None}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_cached_takes_the_newest_living_result(spark):
    at = lambda df: df.withColumn("ts", F.timestamp_seconds("ts"))
    requests = at(spark.createDataFrame([(1, "a", 100), (2, "a", 4000), (3, "b", 10), (4, None, 5), (5, "a", 50)], "n int, cache_key string, ts long"))
    results = at(spark.createDataFrame([("a", 60, "old"), ("a", 100, "new"), ("b", 11, "late")], "cache_key string, ts long, result string"))
    assert {r.n: r.result for r in jobs.cached(requests, results).collect()} == {1: "new", 2: None, 3: None, 4: None, 5: None}
    assert jobs.without_prefix(results, "a").count() == 1


def test_queries_of_a_stream_are_answered_by_kind(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("q", "out", "state"))
    asked = spark.createDataFrame([(1, "x", "search"), (2, "y", "batch")], "qid long, query string, kind string")
    asked.write.parquet(src)
    for _ in range(2):
        stream = spark.readStream.schema(asked.schema).parquet(src)
        jobs.answers(stream, lambda q: q.select("qid", F.upper("query").alias("text")), out, state).awaitTermination()
    assert {(r.qid, r.text, r.kind) for r in spark.read.parquet(out).collect()} == {(1, "X", "search"), (2, "Y", "batch")}


def test_docx_styles_and_tables(spark, tmp_path):
    body = (
        '<w:p><w:pPr><w:pStyle w:val="h2"/><w:jc w:val="center"/></w:pPr><w:r><w:rPr><w:b/><w:i w:val="0"/></w:rPr><w:t>Title</w:t></w:r></w:p>'
        '<w:p><w:r><w:rPr><w:i/></w:rPr><w:t>body</w:t></w:r></w:p>'
        '<w:tbl><w:tr><w:tc><w:p/></w:tc><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t> b  c</w:t></w:r></w:p><w:p><w:r><w:t>d</w:t></w:r></w:p></w:tc></w:tr>'
        '<w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>'
    )
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{W}"><w:style w:styleId="h2"><w:name w:val="heading 2"/></w:style></w:styles>')
    (tmp_path / "a.docx").write_bytes(raw.getvalue())
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.csv").write_text("a")
    out = {r.path[-6:]: r for r in files.docx_structure(files.read(spark, str(tmp_path))).collect()}
    assert set(out) == {"a.docx", "b.docx"} and "BadZipFile" in out["b.docx"].error
    one, two = out["a.docx"].paragraphs
    assert (one.style_name, one.is_heading, one.heading_level, one.is_bold, one.is_italic, one.alignment) == ("heading 2", True, 2, True, False, "center")
    assert (two.text, two.is_heading, two.heading_level, two.is_italic) == ("body", False, None, True)
    (t,) = out["a.docx"].tables
    assert (t.headers, t.rows, t.row_count, t.col_count, t.has_merged_cells) == (["a", "b c d"], [["1"], ["2", ""]], 4, 2, True)
    assert t.structured_rows == [{"a": "2", "b c d": ""}]
