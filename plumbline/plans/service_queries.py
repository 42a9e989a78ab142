"""Queries of the services round search: orders in Russian, keywords, chats, stores, tables."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.functions import calendar, text
from plumbline.operators import access, catalog, context, diagnostics, keywords, retrieval, structure
from plumbline.plans.tables import CHUNKS, DOCS, LEVEL, chunks, documents, load
from plumbline.sources import files, stores

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = (run, sql)
        return run

    return add


def quoted(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else quoted(v) for v in r) + ")" for r in rows) + f") AS v({names})"


# -- documents in Russian, on the shipped patterns -------------------------------------

#: Forms that the table of orders fills in: {k} is the order, {c} its customer, {d} its day.
ORDERS = [
    (1, "ООО «Ромашка»\nИНН 77{k} КПП 770101001 ОГРН 1027700132195\nЮридический адрес: г. Москва, ул. Ленина, 1\n№ {k}-К от «{d}» марта 2024 г.\nО внесении изменений в штатное расписание\nПРИКАЗЫВАЮ:\n1. Утвердить новое расписание {c}.\n1.1. Ввести две должности.\nа) инженер\nб) техник\n2. Контроль оставляю за собой.\nДиректор Петров И.И."),
    (2, "Должностная инструкция инженера\nОБЩИЕ ПОЛОЖЕНИЯ\n1. Инженер {c} подчиняется директору.\nПрава инженера:\n- требовать\n[Заголовки таблицы: Имя | Роль]\n[Строка 1: Иван | инженер]"),
    (3, "ДОГОВОР № {k}\nЗАО \"Север\" и ИП Иванов\nФактический адрес: г. Тверь\nПРЕДМЕТ ДОГОВОРА\nПоставка товара {c} до «{d}» мая 2025 г\nРуководитель отдела Сидоров А.Б."),
    (4, "Заметка без особых примет\nпросто текст {k}.5"),
    (5, ""),
]
_FORM = "CASE o_orderkey % 5 " + " ".join(f"WHEN {i % 5} THEN {quoted(t)}" for i, t in ORDERS) + " END"
_ORDERS = f"od AS (SELECT o_orderkey AS id, replace(replace(replace({_FORM}, '{{k}}', lpad(o_orderkey::VARCHAR, 8, '1')), '{{c}}', o_custkey::VARCHAR), '{{d}}', day(o_orderdate)::VARCHAR) AS text FROM orders)"
_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(upper(text), {quoted('|'.join(p))}) THEN '{n}'" for n, p in structure.TYPES) + " ELSE 'GENERAL' END"
_KIND = "CASE " + " ".join(
    f"WHEN regexp_matches(t, {quoted(p)})" + (f" AND length(t) < {n}" if n else "") + f" THEN '{k}'" for k, p, n in structure.LINES
) + " WHEN kind = 'ORDER' AND contains(upper(t), 'ПРИКАЗЫВАЮ') THEN 'order_directive' WHEN kind = 'ORDER' AND regexp_matches(t, '^(Директор|Генеральный директор)') THEN 'signatures' ELSE 'paragraph' END"
_OLINES = f"""{_ORDERS}, ok AS (SELECT *, {_TYPE} AS kind FROM od),
ol AS (SELECT id, kind, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM ok),
ot AS (SELECT *, trim(line) AS t, coalesce(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM ol),
oc AS (SELECT *, {_KIND} AS type FROM ot),
ov AS (SELECT *, CASE type WHEN 'numbered_item' THEN len(string_split(regexp_extract(t, '^(\\d+(?:\\.\\d+)*)\\.', 1), '.')) WHEN 'lettered_item' THEN 3 WHEN 'subheader' THEN 2 ELSE 1 END AS level FROM oc)"""


def _orders(spark, sf):
    o = load(spark, sf, "orders")
    form = None
    for i, t in ORDERS:
        form = F.when(F.col("o_orderkey") % 5 == i % 5, t) if form is None else form.when(F.col("o_orderkey") % 5 == i % 5, t)
    filled = {"{k}": F.lpad(F.col("o_orderkey").cast("string"), 8, "1"), "{c}": F.col("o_custkey").cast("string"), "{d}": F.dayofmonth("o_orderdate").cast("string")}
    for place, c in filled.items():
        form = F.replace(form, F.lit(place), c)
    return o.select(F.col("o_orderkey").alias("id"), form.alias("text"))


@query(f"WITH {_ORDERS} SELECT id, {_TYPE} AS type FROM od")
def order_types(spark, sf):
    return _orders(spark, sf).select("id", structure.document_type(F.col("text")).alias("type"))


@query(
    f"""WITH {_ORDERS} SELECT id, {", ".join(f"nullif(trim(regexp_extract(text, {quoted(p)}, 1)), '') AS {k}" for k, p in structure.FIELDS.items())},
  CASE WHEN regexp_matches(text, {quoted(structure.DATE)}) THEN concat_ws(' ', regexp_extract(text, {quoted(structure.DATE)}, 1), regexp_extract(text, {quoted(structure.DATE)}, 2), regexp_extract(text, {quoted(structure.DATE)}, 3)) END AS date,
  array_to_string(regexp_extract_all(text, {quoted(structure.SIGNATORY)}, 1), ',') AS signatories, array_to_string(regexp_extract_all(text, {quoted(structure.ADDRESS)}, 1), ',') AS addresses FROM od"""
)
def order_metadata(spark, sf):
    d = _orders(spark, sf).select("id", structure.metadata(F.col("text")).alias("m")).select("id", "m.*")
    return d.withColumn("signatories", F.array_join("signatories", ",")).withColumn("addresses", F.array_join("addresses", ","))


@query(f"WITH {_OLINES} SELECT id, line_no::INT AS line_no, start, type, level::INT AS level FROM ov")
def order_lines(spark, sf):
    d = _orders(spark, sf)
    kinds = d.select("id", "text", structure.document_type(F.col("text")).alias("kind"))
    return structure.lines(kinds, kind=F.col("kind")).select("id", "line_no", "start", "type", F.col("level").cast("int").alias("level"))


@query(
    f"""WITH {_OLINES}, os AS (SELECT *, sum((type <> 'paragraph')::INT) OVER (PARTITION BY id ORDER BY line_no) AS section_no FROM ov)
SELECT id, section_no::BIGINT AS section_no, CASE WHEN section_no = 0 THEN 'Документ' ELSE arg_min(t, line_no) END AS title, arg_min(type, line_no) AS type, arg_min(level, line_no)::INT AS level, min(start) AS start,
  max(start + length(line))::BIGINT AS "end", trim(string_agg(t, chr(10) ORDER BY line_no)) AS content FROM os GROUP BY id, section_no HAVING trim(string_agg(t, chr(10) ORDER BY line_no)) <> ''"""
)
def order_sections(spark, sf):
    kinds = _orders(spark, sf).select("id", "text", structure.document_type(F.col("text")).alias("kind"))
    s = structure.sections(kinds, kind=F.col("kind"))
    return s.select("id", "section_no", "title", "type", F.col("level").cast("int").alias("level"), "start", "end", "content")


@query(
    f"""WITH {_OLINES}, os AS (SELECT *, sum((type <> 'paragraph')::INT) OVER (PARTITION BY id ORDER BY line_no) AS section_no FROM ov)
SELECT id::VARCHAR AS id, section_no::INT AS section_no, 1 AS part, 1 AS total_parts, min(start) AS start, max(start + length(line))::BIGINT AS "end", 'complete_section' AS chunk_type,
  CASE WHEN section_no = 0 THEN 'Документ' ELSE arg_min(t, line_no) END AS title, arg_min(type, line_no) AS type, trim(string_agg(t, chr(10) ORDER BY line_no)) AS text FROM os GROUP BY id, section_no HAVING trim(string_agg(t, chr(10) ORDER BY line_no)) <> ''"""
)
def order_chunks(spark, sf):
    """Sections of the shipped patterns; each is short enough to be one chunk."""
    kinds = _orders(spark, sf).select("id", "text", structure.document_type(F.col("text")).alias("kind"))
    return structure.section_chunks(structure.sections(kinds, kind=F.col("kind")))


# -- keywords ----------------------------------------------------------------------------

_SEMANTIC = "[a-z]{9,}"
_TECHNICAL = "[A-Z]{3,5}"
_UNITED = f"""kw AS (SELECT doc_id AS id, length(trim(text)) >= 50 AS long, regexp_extract_all(text, '{_SEMANTIC}') AS s, regexp_extract_all(text, '{_TECHNICAL}') AS t FROM documents),
ku AS (SELECT id, CASE WHEN long THEN list_sort(list_distinct(s)) ELSE [] END[1:10] AS semantic, CASE WHEN long THEN list_sort(list_distinct(t)) ELSE [] END[1:10] AS technical FROM kw),
kx AS (SELECT id, semantic, technical, list_sort(list_distinct(list_concat(semantic, technical)))[1:20] AS every FROM ku)"""


def _united(d):
    some = lambda p: F.slice(F.sort_array(F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(p), F.lit(0)))), 1, 10)
    return d.select("*", keywords.united(F.col("text"), some(_SEMANTIC), some(_TECHNICAL)).alias("k"))


@query(f"WITH {_UNITED} SELECT id, array_to_string(semantic, ',') AS semantic, array_to_string(technical, ',') AS technical, array_to_string(every, ',') AS every FROM kx UNION ALL SELECT -1, '', '', ''")
def united_keywords(spark, sf):
    """A batch: a text that is null gives an empty row and spoils no other."""
    d = documents(spark, sf).select("id", "text")
    odd = spark.createDataFrame([(-1, None)], "id long, text string")
    k = _united(d.unionByName(odd))
    return k.select("id", *(F.array_join(F.col("k")[c], ",").alias(n) for c, n in (("semantic_keywords", "semantic"), ("technical_keywords", "technical"), ("all_keywords", "every"))))


@query(
    f"""WITH {_UNITED}, {CHUNKS}, ck AS (SELECT chunk_id, c.id, chunk_index, length(trim(text)) >= 50 AS long, regexp_extract_all(text, '{_SEMANTIC}') AS s, regexp_extract_all(text, '{_TECHNICAL}') AS t FROM chunks c)
SELECT chunk_id, CASE WHEN id % 3 > 0 THEN 'src ' || id ELSE 'Неизвестный документ' END AS doc_title, id % 4 > 0 AS has_tables, (id % 4 + 1)::INT AS content_parts_count,
  array_to_string(CASE WHEN long THEN list_sort(list_distinct(list_concat(list_sort(list_distinct(s))[1:10], list_sort(list_distinct(t))[1:10])))[1:20] ELSE [] END, ',') AS all_keywords FROM ck"""
)
def enriched_chunks(spark, sf):
    c = _united(chunks(spark, sf).drop("access_level"))
    d = documents(spark, sf)
    titles = d.select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("src "), F.col("id").cast("string"))).alias("title"))
    parts = d.select("id", (F.col("id") % 4).alias("n_tables"), (F.col("id") % 4 + 1).cast("int").alias("n_parts"))
    out = structure.enriched(c, titles, parts, "k")
    return out.select("chunk_id", "doc_title", "has_tables", "content_parts_count", F.array_join("all_keywords", ",").alias("all_keywords"))


@query(
    f"""WITH {CHUNKS}, k AS (SELECT id, 'semantic' AS class, unnest(regexp_extract_all(lower(text), '[a-z]{{8,}}')) AS keyword FROM chunks UNION ALL SELECT id, 'technical', unnest(regexp_extract_all(text, '[A-Z]{{2,6}}')) FROM chunks),
c AS (SELECT id, class, keyword, count(*) AS n FROM k GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id, class ORDER BY n DESC, keyword) AS r FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY class, r) AS place FROM r WHERE r <= 15) SELECT id, string_agg(keyword, ',' ORDER BY place) AS keywords FROM o WHERE place <= 20 GROUP BY id"""
)
def document_keywords(spark, sf):
    of = lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(0))
    c = chunks(spark, sf).select("id", of(F.lower("text"), "[a-z]{8,}").alias("semantic"), of(F.col("text"), "[A-Z]{2,6}").alias("technical"))
    return diagnostics.keyword_classes(c, ["semantic", "technical"])


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'kept' WHEN length(p_name) < 20 AND p_partkey % 3 = 1 THEN '' ELSE 'handle_it(),python,redis,service,v1.2.3' END AS keywords
FROM part"""
)
def keyword_backfill(spark, sf):
    """Chunks without keywords get technical terms, short ones none; the others stay."""
    p = load(spark, sf, "part")
    k = F.col("p_partkey") % 3
    said = F.when((k == 1) & (F.length("p_name") < 20), "Python v1.2.3").otherwise(F.lit("one more service in Python, with Redis behind handle_it() as of v1.2.3"))
    made = p.select("p_partkey", said.alias("text"), F.when(k == 0, F.array(F.lit("kept"))).when(k == 2, F.array().cast("array<string>")).alias("keywords"))
    return keywords.backfill(made).select("p_partkey", F.array_join("keywords", ",").alias("keywords"))


# -- queries, answers, chats -----------------------------------------------------------------


@query(r"SELECT doc_id AS id, array_to_string(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: length(t) > 2), ' ') AS tokens FROM documents")
def fallback_tokens(spark, sf):
    return documents(spark, sf).select("id", F.array_join(text.simple_tokens(F.col("text")), " ").alias("tokens"))


@query(
    f"""SELECT conv_id, turn, CASE WHEN len(regexp_extract_all(text, '[Ѐ-ӿ]')) > 0.3 * len(regexp_extract_all(text, '\\p{{L}}')) THEN {quoted(text.PREFIX["ru"])} ELSE {quoted(text.PREFIX["en"])} END || text AS prefixed FROM conversations
UNION ALL SELECT -1, 0, {quoted(text.PREFIX["ru"])} || 'Где приказ №5?'"""
)
def query_prefix(spark, sf):
    c = load(spark, sf, "conversations").select("conv_id", "turn", "text")
    more = spark.createDataFrame([(-1, 0, "Где приказ №5?")], "conv_id long, turn long, text string")
    return c.unionByName(more).select("conv_id", "turn", text.prefixed(F.col("text")).alias("prefixed"))


@query(
    r"""WITH m AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '<|im_start|>assistant: Hello! ' WHEN 1 THEN ' User : привет, ' WHEN 2 THEN '' ELSE '<|end|>' END || CASE WHEN turn % 5 = 4 THEN 'short' ELSE text END AS answer FROM conversations),
a AS (SELECT conv_id, turn, regexp_replace(answer, '<\|[^|]*\|>', '', 'g') AS x FROM m), b AS (SELECT conv_id, turn, regexp_replace(x, '^\s*(assistant|user|system)\s*:\s*', '', 'i') AS x FROM a),
c AS (SELECT conv_id, turn, trim(regexp_replace(x, '^\s*(hello|hi|здравствуйте|привет)[!,.]?\s*', '', 'i')) AS x FROM b)
SELECT conv_id, turn, CASE WHEN length(x) < 10 THEN 'Извините, не удалось сформировать ответ.' ELSE x END AS answer FROM c"""
)
def answer_clean(spark, sf):
    t = F.col("turn")
    lead = F.when(t % 4 == 0, "<|im_start|>assistant: Hello! ").when(t % 4 == 1, " User : привет, ").when(t % 4 == 2, "").otherwise("<|end|>")
    c = load(spark, sf, "conversations")
    said = F.concat(lead, F.when(t % 5 == 4, "short").otherwise(F.col("text")))
    return c.select("conv_id", "turn", text.clean_answer(said).alias("answer"))


@query(
    f"""WITH h AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations),
l AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'Вопрос' ELSE 'Ответ' END || ': ' || CASE WHEN role = 'assistant' THEN '[Ответил про: ' || substr(text, 1, 200) || '...]' ELSE text END || chr(10), '' ORDER BY turn) AS hist FROM h WHERE r <= 4 GROUP BY conv_id)
SELECT conv_id, md5({quoted(text.PROMPT[0])} || chr(10) || chr(10) || 'Предыдущие сообщения:' || chr(10) || hist || {quoted(text.PROMPT[1])} || 'context of ' || conv_id || {quoted(text.PROMPT[2])} || 'What now?' || {quoted(text.PROMPT[3])}) AS digest FROM l"""
)
def chat_prompt(spark, sf):
    """The prompt of each session, with its last four messages."""
    recent = catalog.last_n(load(spark, sf, "conversations"), "conv_id", "turn", 4)
    said = recent.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("history"))
    made = text.prompt(F.lit("What now?"), F.concat(F.lit("context of "), F.col("conv_id").cast("string")), F.col("history"))
    return said.select("conv_id", F.md5(made).alias("digest"))


_REQUESTS = """rq AS (SELECT event_id AS request_id, user_id, CASE WHEN event_id % 3 = 0 THEN 's' || (user_id % 7) WHEN event_id % 3 = 1 THEN 'gone' END AS session_id, 'Question ' || repeat('long ', (event_id % 20)::INT) || event_id AS question, 'answer' AS answer FROM events),
se AS (SELECT DISTINCT 's' || (user_id % 7) AS session_id, user_id, 'old' AS title FROM events WHERE user_id % 2 = 0),
rs AS (SELECT rq.*, se.session_id IS NULL AS is_new, coalesce(se.session_id, md5(rq.user_id || ':' || request_id)) AS session FROM rq LEFT JOIN se ON se.session_id = rq.session_id AND se.user_id = rq.user_id)"""


def _turns(spark, sf):
    e = load(spark, sf, "events")
    own = F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string"))
    asked = F.concat(F.lit("Question "), F.repeat(F.lit("long "), (F.col("event_id") % 20).cast("int")), F.col("event_id").cast("string"))
    wanted = F.when(F.col("event_id") % 3 == 0, own).when(F.col("event_id") % 3 == 1, "gone")
    requests = e.select(F.col("event_id").alias("request_id"), "user_id", wanted.alias("session_id"), asked.alias("question"), F.lit("answer").alias("answer"))
    sessions = e.where("user_id % 2 = 0").select(own.alias("session_id"), "user_id", F.lit("old").alias("title")).distinct()
    return catalog.append_turns(sessions, requests)


@query(f"WITH {_REQUESTS} SELECT session_id, user_id, title FROM se UNION ALL SELECT session, user_id, CASE WHEN length(question) > 50 THEN substr(question, 1, 50) || '...' ELSE question END FROM rs WHERE is_new")
def sessions_after_turns(spark, sf):
    return _turns(spark, sf)[0]


@query(f"WITH {_REQUESTS} SELECT session AS session_id, request_id, 0 AS place, 'user' AS role, question AS text FROM rs UNION ALL SELECT session, request_id, 1, 'assistant', answer FROM rs")
def messages_after_turns(spark, sf):
    return _turns(spark, sf)[1]


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN 'Meet ' || p_name END AS title, CASE WHEN p_partkey % 3 > 0 THEN '2025-03-0' || (p_partkey % 9 + 1) END AS day, CASE WHEN p_partkey % 3 > 0 THEN '10:30' END AS time,
  CASE WHEN p_partkey % 3 > 0 THEN 'a@x.io|b ' || p_partkey END AS attendees FROM part"""
)
def calendar_actions(spark, sf):
    k = F.col("p_partkey")
    said = F.concat(
        F.lit("Done.\nCALENDAR_ACTION: "), F.when(k % 3 > 0, "CREATE_EVENT").otherwise("NONE"), F.lit("\nEVENT_TITLE: Meet "), F.col("p_name"),
        F.lit("\nEVENT_DATE: 2025-03-0"), (k % 9 + 1).cast("string"), F.lit("\nEVENT_TIME: 10:30\nATTENDEES: a@x.io , b "), k.cast("string"),
    )
    a = load(spark, sf, "part").select("p_partkey", calendar.action(said).alias("a"))
    return a.select("p_partkey", "a.title", "a.day", "a.time", F.array_join(F.col("a.attendees"), "|").alias("attendees"))


# -- tables, files, stores ---------------------------------------------------------------------


@query(
    f"""WITH {DOCS}, s AS (SELECT id, i AS section_no, i * 500 AS start, i * 500 + 499 AS "end" FROM docs, range(0, 6) AS r(i) WHERE length(text) > i * 500), t AS (SELECT id, j AS table_no, (id * 37 + j * 700) % 2600 AS position FROM docs, range(0, 2) AS r(j))
SELECT t.id, table_no, position, section_no FROM t JOIN s ON t.id = s.id AND position BETWEEN start AND "end" """
)
def table_sections(spark, sf):
    d = documents(spark, sf)
    each = d.select("id", F.length("text").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("section_no"))
    found = each.where(F.col("n") > F.col("section_no") * 500).select("id", "section_no", (F.col("section_no") * 500).alias("start"), (F.col("section_no") * 500 + 499).alias("end"))
    tables = d.select("id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("table_no")).withColumn("position", (F.col("id") * 37 + F.col("table_no") * 700) % 2600)
    return structure.tables_in_sections(tables, found)


@query(
    r"""WITH d AS (SELECT doc_id AS id, text, (length(text) // 3)::INT AS s, (length(text) // 2)::INT AS e FROM documents), x AS (SELECT id, regexp_replace(substr(text, greatest(1, s - 199), least(s, 200)), '^\s+|\s+$', '', 'g') AS before, regexp_replace(substr(text, e + 1, 100), '^\s+|\s+$', '', 'g') AS after FROM d),
l AS (SELECT *, trim(string_split(before, chr(10))[-1]) AS last FROM x) SELECT id, before, after, CASE WHEN length(last) BETWEEN 4 AND 149 THEN regexp_replace(last, ':$', '') ELSE 'Таблица' END AS title,
  'Таблица в Раздел ' || id || chr(10) || after AS fallback FROM l"""
)
def table_contexts(spark, sf):
    d = documents(spark, sf).withColumn("n", F.length("text"))
    c = d.select("id", structure.table_context(F.col("text"), F.floor(F.col("n") / 3).cast("int"), F.floor(F.col("n") / 2).cast("int")).alias("c")).select("id", "c.*")
    return c.withColumn("fallback", structure.fallback_table(F.col("after"), F.concat(F.lit("Раздел "), F.col("id").cast("string"))))


_PLAIN = r"[^\x00-\x7F]"


@query(r"SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN text ELSE 'Приказ ' || doc_id || ': ' || regexp_replace(text, '[^\x00-\x7F]', '', 'g') END AS text FROM documents")
def decoded_files(spark, sf):
    """Bytes in one encoding or another, as text."""
    k = F.col("doc_id")
    said = F.concat(F.lit("Приказ "), k.cast("string"), F.lit(": "), F.regexp_replace("text", _PLAIN, ""))
    content = F.when(k % 3 == 0, F.encode("text", "UTF-8")).when(k % 3 == 1, F.encode(said, "UTF-8")).otherwise(_cp1251(said))
    return files.decoded(load(spark, sf, "documents").select(k.alias("id"), content.alias("content")))


def _cp1251(c):
    """Text of ASCII and Cyrillic letters in that code page: each letter's byte by its distance from А."""
    letters = "".join(map(chr, range(0x410, 0x450)))
    return F.encode(F.translate(c, letters, "".join(map(chr, range(0xC0, 0x100)))), "ISO-8859-1")


_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _as_docx(rows):
    """id and content of word files: two paragraphs around a table. rows: id, name."""

    def run(batches):
        for b in batches:
            out = []
            for k, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                para = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
                cells = lambda r: "<w:tr>" + "".join(f"<w:tc>{para(x)}</w:tc>" for x in r) + "</w:tr>"
                table = "<w:tbl>" + "".join(map(cells, [["имя", "ключ"], [name, str(k)], ["", ""], ["", f"x{k}"]])) + "</w:tbl>"
                made = io.BytesIO()
                with zipfile.ZipFile(made, "w") as z:
                    z.writestr("word/document.xml", f'<w:document xmlns:w="{_W}"><w:body>{para(f"Документ   {k}")}{table}{para("конец")}</w:body></w:document>')
                out.append(made.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "content"])

    return rows.mapInArrow(run, "id long, content binary")


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 7 = 6 THEN 'unsupported' ELSE ['json', 'csv', 'docx', 'json'][(doc_id % 4 + 1)::INT] END AS format,
  CASE WHEN doc_id % 7 = 6 THEN NULL WHEN doc_id % 4 = 0 THEN 'id: ' || doc_id || chr(10) || 'source: ' || source || chr(10) || 'tags[0]: a' || doc_id || chr(10) || 'tags[1].ok: да' || chr(10) || 'deep.none.x: v'
    WHEN doc_id % 4 = 1 THEN 'Заголовки: имя, город' || chr(10) || 'Строка 1: имя: N' || doc_id || '; город: Москва' || chr(10) || 'Строка 3: имя: Анна' || doc_id
    WHEN doc_id % 4 = 2 THEN 'Документ ' || doc_id || chr(10) || '[Заголовки таблицы: имя | ключ]' || chr(10) || '[Строка 1: ' || source || ' | ' || doc_id || ']' || chr(10) || '[Строка 2: x' || doc_id || ']' || chr(10) || 'конец' END AS text,
  CASE WHEN doc_id % 7 = 6 THEN 'unsupported' WHEN doc_id % 4 = 3 THEN 'JSONDecodeError' END AS error FROM documents""")
def extracted_files(spark, sf):
    """A file of each document, in several formats and encodings, one in seven of none that is
    known, and broken ones: what comes of each, without one spoiling another."""
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    k = F.col("id").cast("string")
    data = F.to_json(
        F.struct(
            "id", "source", F.lit(" ").alias("blank"), F.array(F.concat(F.lit("a"), k)).alias("tags"),
            F.struct(F.struct(F.lit("v").alias("x")).alias("none")).alias("deep"),
        )
    )
    # The second tag is an object, so the list holds two kinds.
    data = F.replace(data, F.concat(F.lit('["a'), k, F.lit('"]')), F.concat(F.lit('["a'), k, F.lit('", {"ok": true, "no": null}]')))
    table = _cp1251(F.concat(F.lit("имя;город\nN"), k, F.lit(";Москва\n;\nАнна"), k, F.lit(";\n")))
    kind = F.col("id") % 4
    plain = d.where(kind != 2).select("id", F.when(kind == 0, F.encode(data, "UTF-8")).when(kind == 1, table).otherwise(F.encode(F.lit("{broken"), "UTF-8")).alias("content"))
    both = plain.unionByName(_as_docx(d.where(kind == 2).select("id", "source")))
    ending = F.when(F.col("id") % 7 == 6, ".exe").otherwise(F.get(F.array(*map(F.lit, (".json", ".CSV", ".docx", ".Json"))), kind.cast("int")))
    path = F.concat(F.lit("/in/f"), k, ending)
    named = both.select(path.alias("path"), files.processor(path).alias("format"), "content", F.when(files.processor(path) == "unsupported", "unsupported").alias("error"))
    out = files.extracted(named)
    number = F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long").alias("id")
    return out.select(number, "format", "text", F.regexp_extract("error", r"^\w+", 0).alias("error")).withColumn("error", F.nullif("error", F.lit("")))


@query("SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'missing' WHEN page_id % 5 = 0 THEN 'empty' WHEN page_id % 3 = 0 THEN 'unsupported' ELSE 'ok' END AS verdict FROM pages")
def file_verdicts(spark, sf):
    k = F.col("page_id")
    named = load(spark, sf, "pages").select("page_id", F.concat(F.lit("/in/f"), k.cast("string"), F.when(k % 3 == 0, ".exe").otherwise(".CSV")).alias("path"), F.when(k % 7 == 0, None).otherwise(F.when(k % 5 == 0, 0).otherwise(F.length("html"))).alias("length"))
    return named.select("page_id", files.verdict(F.col("path"), F.col("length")).alias("verdict"))


@query(f"WITH {CHUNKS} SELECT chunk_id, md5(text) AS digest, id % 5 AS v FROM chunks WHERE access_level <= {LEVEL}")
def chunk_store(spark, sf):
    """Chunks and vectors written to a store, and the visible ones read from it."""
    c = chunks(spark, sf)
    path = f"{stores.shared_dir(spark)}/store-{stores.fresh()}"
    stores.write_chunks(c.select("chunk_id", "text", "access_level"), c.select("chunk_id", F.array((F.col("id") % 5).cast("float")).alias("v")), path)
    back = stores.read_chunks(spark, path, LEVEL)
    return back.select("chunk_id", F.md5("text").alias("digest"), F.col("v")[0].cast("long").alias("v"))


@query(f"""WITH {CHUNKS}, t AS (SELECT *, CASE WHEN length(text) < 300 THEN 'short' WHEN length(text) < 1000 THEN 'part' ELSE 'full' END AS chunk_type, ['header', 'paragraph', 'table'][(chunk_index % 3 + 1)::INT] AS section_type FROM chunks)
SELECT 'chunk_type' AS class, chunk_type AS value, count(*) AS n FROM t GROUP BY chunk_type UNION ALL SELECT 'section_type', section_type, count(*) FROM t GROUP BY section_type
UNION ALL SELECT 'completeness', CASE WHEN chunk_type = 'full' THEN 'partial' ELSE 'complete' END, count(*) FROM t GROUP BY ALL""")
def chunk_histograms(spark, sf):
    n = F.length("text")
    kind = F.when(n < 300, "short").when(n < 1000, "part").otherwise("full")
    t = chunks(spark, sf).select(kind.alias("chunk_type"), F.get(F.array(*map(F.lit, ("header", "paragraph", "table"))), F.col("chunk_index") % 3).alias("section_type"), (kind != "full").alias("is_complete_section"))
    return structure.chunk_histograms(t)


@query(f"""WITH {CHUNKS} SELECT chunk_id, chunk_index FROM chunks WHERE id = 3 ORDER BY chunk_index LIMIT 50""")
def chunks_page(spark, sf):
    c = chunks(spark, sf).where("id = 3").select("chunk_id", "chunk_index")
    return catalog.page(c, [F.col("chunk_index")], 1, 50)


@query("SELECT conv_id, turn FROM conversations WHERE conv_id % 4 = 1 AND conv_id = 5")
def own_session_messages(spark, sf):
    """The messages of a session, for its owner only."""
    m = load(spark, sf, "conversations").withColumn("owner", F.col("conv_id") % 4)
    return access.own(m, "owner", F.lit(1)).where("conv_id = 5").select("conv_id", "turn")


# -- figures --------------------------------------------------------------------------------------

_MEMORY = "r AS (SELECT event_type || '-' || (user_id % 4) AS operation, value AS duration, (value * 1.5 - 40) AS memory, ts, event_id, user_id FROM events)"


def _memory(spark, sf):
    e = load(spark, sf, "events")
    return e.select(F.concat_ws("-", "event_type", (F.col("user_id") % 4).cast("string")).alias("operation"), F.col("value").alias("duration"), (F.col("value") * 1.5 - 40).alias("memory"), F.struct("ts", "event_id").alias("ts"))


@query(f"""WITH {_MEMORY}, l AS (SELECT operation, arg_max(memory, (ts, event_id)) AS memory FROM r GROUP BY operation) SELECT operation, round(memory, 6) AS memory, memory > 100 AS heavy,
  round(max(memory) OVER (), 6) AS peak, round(sum(memory) OVER (), 6) AS total FROM l""")
def memory_summary(spark, sf):
    return diagnostics.memory_summary(_memory(spark, sf))


@query(f"""WITH {_MEMORY}, m AS (SELECT operation, avg(duration) AS mean FROM r GROUP BY operation) SELECT operation, round(mean, 6) AS mean FROM m ORDER BY m.mean DESC, operation LIMIT 5""")
def slowest_operations(spark, sf):
    return diagnostics.slowest(_memory(spark, sf))


@query("""WITH p AS (SELECT user_id, sum(value) AS total FROM events GROUP BY user_id) SELECT count(*) AS n_runs, round(avg(total), 6) AS avg, round(min(total), 6) AS min, round(max(total), 6) AS max FROM p""")
def pipeline_statistics(spark, sf):
    e = load(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("value").alias("duration"))
    return diagnostics.pipeline_statistics(e)


#: Words of categories, put before names of parts.
_HEADS = ("api", "база данных", "клиент", "маркетинг", "дизайн", "license")


@query("SELECT (count(*) FILTER (p_partkey % 6 < 2))::BIGINT AS tech_terms, (count(*) FILTER (p_partkey % 6 IN (2, 3)))::BIGINT AS business_terms, (count(*) FILTER (p_partkey % 6 = 4))::BIGINT AS design_terms FROM part")
def synonym_categories(spark, sf):
    from plumbline.operators import expansion

    p = load(spark, sf, "part")
    head = F.get(F.array(*map(F.lit, _HEADS)), (F.col("p_partkey") % 6).cast("int"))
    return expansion.categories(p.select(F.concat_ws(" ", head, F.col("p_partkey").cast("string")).alias("term"), F.array("p_type").alias("synonyms")))


@query(
    f"""WITH {CHUNKS}, p AS (SELECT *, lag(text) OVER (PARTITION BY id ORDER BY chunk_index) AS prev FROM chunks),
w AS (SELECT id, text, list_filter(regexp_split_to_array(lower(substr(text, 1, 50)), '[ \\n\\t]+'), lambda x: length(x) > 3) AS h, list_filter(regexp_split_to_array(lower(right(prev, 50)), '[ \\n\\t]+'), lambda x: length(x) > 3) AS t FROM p)
SELECT id, count(*) FILTER (coalesce(len(list_filter(h, lambda x: list_contains(t, x))), 0) > 2) AS n_overlapping, round(avg(length(text)))::BIGINT AS mean_chars FROM w GROUP BY id"""
)
def overlap_summary(spark, sf):
    return structure.overlap_summary(chunks(spark, sf).select("id", "chunk_index", "text"))


@query("SELECT event_type, sum(ceil(length(props) / 4.0))::BIGINT AS n_tokens, round(sum(ceil(length(props) / 4.0)) / sum(value), 6) AS tokens_per_second FROM events GROUP BY event_type")
def token_rate(spark, sf):
    e = load(spark, sf, "events")
    return e.groupBy("event_type").agg(F.sum(text.token_estimate(F.col("props"))).alias("n_tokens"), text.token_rate(F.col("props"), F.col("value")).alias("tokens_per_second"))


@query("SELECT o_orderkey, o_orderstatus = 'F' AS processed, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS processed_at, CASE WHEN o_orderstatus = 'F' THEN (o_orderkey % 7)::INT END AS chunk_count FROM orders")
def processed_documents(spark, sf):
    """The last status of each document, with when it was processed and its chunks."""
    o = load(spark, sf, "orders")
    docs = o.select("o_orderkey", F.lit("pending").alias("status"))
    early = o.select("o_orderkey", F.lit("processing").alias("status"), F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("int").alias("chunk_count"), F.lit(1).alias("n"))
    late = o.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("completed").alias("status"), F.col("o_orderdate").alias("at"), (F.col("o_orderkey") % 7).cast("int").alias("chunk_count"), F.lit(2).alias("n"))
    out = catalog.set_processed(docs, early.unionByName(late), "o_orderkey", "n")
    return out.select("o_orderkey", "processed", "processed_at", "chunk_count")


@query("SELECT p_partkey, p_size BETWEEN 1 AND 10 AS ok FROM part")
def batch_validation(spark, sf):
    return load(spark, sf, "part").select("p_partkey", access.batch_ok(F.col("p_size")).alias("ok"))


@query("WITH r AS (SELECT p_partkey % 40 AS qid, p_partkey AS id, row_number() OVER (PARTITION BY p_partkey % 40 ORDER BY p_partkey) AS rank FROM part) SELECT qid, id, (5.0 - 0.1 * (rank - 1))::DOUBLE AS rerank_score FROM r WHERE rank <= 10")
def rerank_fallback(spark, sf):
    from pyspark.sql.window import Window

    p = load(spark, sf, "part").select((F.col("p_partkey") % 40).alias("qid"), F.col("p_partkey").alias("id"))
    ranked = p.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("id")))
    return retrieval.fallback_falling(ranked).select("qid", "id", "rerank_score")


@query(f"""WITH {DOCS} SELECT id, '[Источник ' || (id % 5 + 1) || ': ' || source || ' (' || (id % 9 + 1) || ' из ' || (id % 9 + 10) || ' частей, score: ' || printf('%.3f', (id % 101) / 10.0) || ')]' AS line, CASE WHEN lang = 'de' THEN 16000 ELSE 8000 END AS budget FROM docs""")
def grouped_context(spark, sf):
    """The head line of a document's chunks in a context, and the budget of its model."""
    k = F.col("id")
    line = context.grouped_line(k % 5 + 1, F.col("source"), (k % 9 + 1).cast("int"), (k % 9 + 10).cast("int"), k % 101 / 10)
    model = F.when(F.col("lang") == "de", "gpt-oss-20b").otherwise("small")
    return documents(spark, sf).select("id", line.alias("line"), context.budget_of(model).alias("budget"))
