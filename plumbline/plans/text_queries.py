"""Queries over texts: cleaning, terms, structure, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import calendar, lemmas, text
from plumbline.operators import diagnostics, keywords, structure
from plumbline.plans.tables import CHUNKS, DOCS, chunks, documents, load
from plumbline.sources import files

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = (run, sql)
        return run

    return add


@query("""SELECT doc_id AS id, list_aggregate(list_filter(list_transform(string_split(replace(text, chr(13), chr(10)), chr(10)),
  lambda x: trim(regexp_replace(x, '[\\s\\x{00a0}]+', ' ', 'g'))), lambda x: x <> ''), 'string_agg', chr(10)) AS cleaned FROM documents""")
def clean_text(spark, sf):
    return documents(spark, sf).select("id", text.clean(F.col("text")).alias("cleaned"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP)
_KEYWORD_STOP = ", ".join(f"'{w}'" for w in text.KEYWORD_STOP)
#: The mask of decimals needs look-ahead, which DuckDB lacks: years before a point are set apart first.
_MASKED = r"""replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '\b\d{4}-\d{2}-\d{2}\b', 'DATE', 'g'), '\b\d{2}\.\d{2}\.\d{4}\b', 'DATE', 'g'),
  '\b((?:19|20)\d{2})\.', '\1' || chr(57344) || '.', 'g'), '\b\d+\.\d+\b', 'NUMBER', 'g'), chr(57344), '')"""
_TOKENS = rf"""tok AS (SELECT id, list_filter(list_filter(flatten(list_transform(
    list_filter(regexp_extract_all({_MASKED}, '[\p{{L}}\p{{M}}\p{{N}}_-]+'), lambda t: length(t) >= 2),
    lambda t: CASE WHEN contains(t, '-') AND length(t) > 3 THEN string_split(t, '-') ELSE [t] END)), lambda t: length(t) >= 2),
    lambda t: t NOT IN ({_STOP}) AND NOT regexp_full_match(t, '\p{{Nd}}+')) AS tokens, access_level FROM docs)"""


@query(f"WITH {DOCS}, {_TOKENS} SELECT id, len(tokens)::INT AS n_tokens, md5(list_aggregate(tokens, 'string_agg', ' ')) AS digest FROM tok WHERE len(tokens) > 0")
def tokenize(spark, sf):
    t = documents(spark, sf).select("id", text.tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    return t.select("id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query(rf"""SELECT doc_id AS id, CASE WHEN len(regexp_extract_all(text, '[Ѐ-ӿ]')) > 0.3 * len(regexp_extract_all(text, '\p{{L}}')) THEN 'ru' ELSE 'en' END AS lang,
  CASE WHEN regexp_matches(text, '[^\x00-\x7F]') THEN 'ru' ELSE 'en' END AS crude FROM documents""")
def detect_language(spark, sf):
    return documents(spark, sf).select("id", text.language(F.col("text")).alias("lang"), text.crude_language(F.col("text")).alias("crude"))


@query(r"""SELECT conv_id, turn, regexp_matches(text, '\b\d{1,2}\.\d{1,2}\.\d{4}\b|\b\d{4}-\d{2}-\d{2}\b') AS dated, length(text)::INT AS n_chars,
  len(string_split(text, ' '))::INT AS n_words, regexp_matches(text, '[0-9]') AS digits FROM conversations""")
def query_analysis(spark, sf):
    c = F.col("text")
    return load(spark, sf, "conversations").select("conv_id", "turn", text.has_dates(c).alias("dated"), F.length(c).alias("n_chars"), F.size(F.split(c, " ")).alias("n_words"), c.rlike("[0-9]").alias("digits"))


@query()
def technical_terms(spark, sf):
    """Without SQL: the families differ in how the engines read word borders."""
    return documents(spark, sf).select("id", F.array_join(text.technical_terms(F.col("text")), ",").alias("terms"))


@query(f"""SELECT p_partkey, p_name AS word, length(p_name) >= 3 AND p_size / 50.0 > 0.3 AND lower(p_name) NOT IN ({_KEYWORD_STOP}) AND NOT regexp_matches(p_name, '^[0-9]')
  AND NOT contains(p_name, '___') AND len(string_split(p_name, ' ')) <= 2 AS kept FROM part""")
def keyword_filter(spark, sf):
    p = load(spark, sf, "part")
    return p.select("p_partkey", F.col("p_name").alias("word"), text.keep_keyword(F.col("p_name"), F.col("p_size") / 50).alias("kept"))


@query(f"""WITH {CHUNKS}, k AS (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z]{{7,}}')) AS keyword FROM chunks),
c AS (SELECT id, keyword, count(*) AS n FROM k GROUP BY id, keyword), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, keyword) AS r FROM c)
SELECT id, string_agg(keyword, ',' ORDER BY r) AS keywords FROM r WHERE r <= 15 GROUP BY id""")
def keyword_summary(spark, sf):
    c = chunks(spark, sf).select("id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0)).alias("keywords"))
    return diagnostics.keyword_summary(c)


_KINDS = [("LICENSE", ["LICENSED UNDER", "COPYRIGHT"]), ("SECRET", [r"PASSWORD\s*[=:]", "API_KEY"]), ("CONTACT", ["@"])]


@query(r"""SELECT doc_id AS id, CASE WHEN regexp_matches(upper(text), 'LICENSED UNDER|COPYRIGHT') THEN 'LICENSE' WHEN regexp_matches(upper(text), 'PASSWORD\s*[=:]|API_KEY') THEN 'SECRET'
  WHEN regexp_matches(upper(text), '@') THEN 'CONTACT' ELSE 'GENERAL' END AS type FROM documents""")
def doc_type(spark, sf):
    return documents(spark, sf).select("id", structure.document_type(F.col("text"), _KINDS).alias("type"))


@query(r"""SELECT doc_id AS id, nullif(regexp_extract(text, '([a-z0-9._]+@[a-z0-9.]+)', 1), '') AS email, nullif(regexp_extract(text, 'Licensed under ([A-Z0-9. -]+)', 1), '') AS license,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 10 AND NOT regexp_matches(x, '^[0-9]'))[1] AS title FROM documents""")
def doc_metadata(spark, sf):
    fields = {"email": r"([a-z0-9._]+@[a-z0-9.]+)", "license": r"Licensed under ([A-Z0-9. -]+)"}
    d = documents(spark, sf).select("id", structure.metadata(F.col("text"), fields).alias("m"), structure.title(F.col("text")).alias("title"))
    return d.select("id", F.col("m.email").alias("email"), F.col("m.license").alias("license"), "title")


#: Latin patterns, so that the driver's texts have headers.
_RULES = [("header", r"^[A-Z !]{6,}$", None), ("subheader", r"^[A-Z][a-z ]+\.$", 40)]
_LINES = r"""l AS (SELECT id, line_no::INT - 1 AS line_no, line FROM (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM docs)),
c AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
  CASE WHEN regexp_matches(trim(line), '^[A-Z !]{6,}$') THEN 'header' WHEN regexp_matches(trim(line), '^[A-Z][a-z ]+\.$') AND length(trim(line)) < 40 THEN 'subheader' ELSE 'paragraph' END AS type FROM l)"""


@query(f"WITH {DOCS}, {_LINES} SELECT id, line_no, start, type FROM c")
def classify_lines(spark, sf):
    return structure.lines(documents(spark, sf), rules=_RULES).select("id", "line_no", "start", "type")


@query(f"""WITH {DOCS}, {_LINES}, s AS (SELECT *, sum((type <> 'paragraph')::INT) OVER (PARTITION BY id ORDER BY line_no) AS section_no FROM c)
SELECT id, section_no::BIGINT AS section_no, min(start) AS start, max(start + length(line))::BIGINT AS "end", arg_min(type, line_no) AS type,
  length(trim(string_agg(trim(line), chr(10) ORDER BY line_no)))::INT AS n FROM s GROUP BY id, section_no HAVING trim(string_agg(trim(line), chr(10) ORDER BY line_no)) <> ''""")
def build_sections(spark, sf):
    s = structure.sections(documents(spark, sf), rules=_RULES)
    return s.select("id", "section_no", "start", "end", "type", F.length("content").alias("n"))


_SIZE = """WITH k AS (SELECT p_partkey, length(p_name) * p_size AS n, ['header', 'numbered_item', 'signatures', 'table', 'lettered_item', 'paragraph'][(p_partkey % 6 + 1)::INT] AS t FROM part)
SELECT p_partkey, CASE WHEN t = 'header' THEN least(500, n + 100) WHEN t = 'numbered_item' AND n < 300 THEN n + 50 WHEN t = 'numbered_item' AND n < 800 THEN 600
  WHEN t = 'signatures' THEN least(300, n + 50) WHEN t = 'table' THEN least(1500, n + 200) ELSE 1000 END::INT AS size,
  t <> 'table' AND (n < 200 OR t IN ('header', 'signatures', 'lettered_item') OR (t = 'numbered_item' AND n < 500)) AS whole FROM k"""


@query(_SIZE)
def section_size_policy(spark, sf):
    kinds = F.array(*map(F.lit, ("header", "numbered_item", "signatures", "table", "lettered_item", "paragraph")))
    p = load(spark, sf, "part").select("p_partkey", (F.length("p_name") * F.col("p_size")).alias("n"), F.get(kinds, (F.col("p_partkey") % 6).cast("int")).alias("t"))
    return p.select("p_partkey", structure.optimal_size(F.col("t"), F.col("n")).cast("int").alias("size"), structure.keep_together(F.col("t"), F.col("n")).alias("whole"))


@query(f'WITH {CHUNKS} SELECT chunk_id, chunk_index, start, "end", md5(text) AS digest FROM chunks')
def fixed_chunks(spark, sf):
    return chunks(spark, sf).select("chunk_id", "chunk_index", "start", "end", F.md5("text").alias("digest"))


@query(f"""WITH {CHUNKS}, p AS (SELECT *, lag("end") OVER w AS pe, lag(start) OVER w AS ps, count(*) OVER (PARTITION BY id) AS total_chunks FROM chunks WINDOW w AS (PARTITION BY id ORDER BY chunk_index))
SELECT chunk_id, total_chunks, CASE WHEN pe IS NULL THEN 0 ELSE greatest(0, least("end", pe) - greatest(start, ps)) END::INT AS overlap_prev, 0 AS overlap_next FROM p""")
def chunk_metadata(spark, sf):
    return structure.with_overlaps(chunks(spark, sf)).select("chunk_id", "total_chunks", F.coalesce("overlap_prev", F.lit(0)).alias("overlap_prev"), "overlap_next")


@query(rf"""WITH {DOCS}, {_LINES}, s AS (SELECT *, sum((type <> 'paragraph')::INT) OVER (PARTITION BY id ORDER BY line_no) AS section_no FROM c),
b AS (SELECT id, section_no, min(start) AS a, max(start + length(line)) AS z, arg_min(trim(line), line_no) AS t, arg_min(type, line_no) AS k, trim(string_agg(trim(line), chr(10) ORDER BY line_no)) AS body FROM s GROUP BY id, section_no),
r AS (SELECT *, lag(a) OVER w AS pa, lag(z) OVER w AS pz, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY id) AS n FROM b WHERE body <> '' WINDOW w AS (PARTITION BY id ORDER BY section_no))
SELECT r.id::VARCHAR AS doc_id, i::INT AS chunk_index, access_level, a::BIGINT AS char_start, z::BIGINT AS char_end, '2025-01-01T00:00:00' AS created_at, length(body)::INT AS char_count,
  (CASE WHEN pz IS NULL THEN 0 ELSE greatest(0, least(z, pz) - greatest(a, pa)) END)::BIGINT AS overlap_prev, 0 AS overlap_next, n AS total_chunks, CASE WHEN section_no = 0 THEN 'Документ' ELSE t END AS section_title, k AS section_type,
  CASE WHEN k = 'subheader' THEN 2 ELSE 1 END AS section_level, 'complete_section' AS chunk_type, TRUE AS is_complete_section,
  CASE WHEN regexp_matches(upper(text), 'LICEN[CS]E') THEN 'LICENSE' WHEN regexp_matches(upper(text), '@[A-Z]') THEN 'MAIL' ELSE 'GENERAL' END AS document_type, '' AS document_title,
  coalesce(trim(nullif(regexp_extract(text, 'Licensed under ([A-Z0-9. -]+)', 1), '')), '') AS document_number, '' AS document_date, coalesce(trim(nullif(regexp_extract(text, '([a-z0-9._]+@[a-z0-9.]+)', 1), '')), '') AS document_organization, md5(body) AS digest
FROM r JOIN docs ON docs.id = r.id""")
def chunk_records(spark, sf):
    """The whole record of each chunk, where every section is one chunk."""
    fields = {"number": r"Licensed under ([A-Z0-9. -]+)", "organization": r"([a-z0-9._]+@[a-z0-9.]+)"}
    types = [("LICENSE", ["LICEN[CS]E"]), ("MAIL", ["@[A-Z]"])]
    m = structure.metadata(F.col("text"), fields)
    known = F.struct(structure.document_type(F.col("text"), types).alias("type"), F.lit(None).cast("string").alias("title"), m["number"].alias("number"), m["date"].alias("date"), m["organization"].alias("organization"))
    docs = documents(spark, sf).select("id", "text", "access_level", known.alias("document"))
    found = structure.sections(docs, rules=_RULES, carry=("access_level", "document"))
    parts = found.select("*", F.lit(1).alias("part"), F.lit("complete_section").alias("chunk_type"), F.col("content").alias("text"))
    return structure.chunk_records(parts, F.lit("2025-01-01T00:00:00")).withColumn("digest", F.md5("text")).drop("text")


@query()
def semantic_chunk_records(spark, sf):
    """The same of chunks as they are split. Without SQL: each piece begins where the last one ended."""
    known = F.struct(*(F.lit(None).cast("string").alias(c) for c in ("type", "title", "number", "date", "organization")))
    docs = documents(spark, sf).select("id", "text", "access_level", known.alias("document"))
    carry = ("access_level", "document", "level")
    parts = structure.section_chunks(structure.sections(docs, rules=_RULES, carry=carry[:2]), carry=carry)
    return structure.chunk_records(parts, F.lit("2025-01-01T00:00:00"))


@query(f"""WITH {CHUNKS}, p AS (SELECT chunk_id, lag(text) OVER (PARTITION BY id ORDER BY chunk_index) AS t, text FROM chunks),
w AS (SELECT chunk_id, t, list_filter(regexp_split_to_array(lower(right(t, 50)), '[ \\n\\t]+'), lambda x: length(x) > 3) AS tail,
  list_filter(regexp_split_to_array(lower(substr(text, 1, 50)), '[ \\n\\t]+'), lambda x: length(x) > 3) AS head FROM p)
SELECT chunk_id, CASE WHEN t IS NULL THEN 0 ELSE len(list_filter(head, lambda x: list_contains(tail, x))) END::INT AS shared_words FROM w""")
def neighbour_overlap(spark, sf):
    return structure.neighbour_overlap(chunks(spark, sf)).select("chunk_id", "shared_words")


@query(f"WITH {CHUNKS} SELECT count(*) AS n_chunks, round(avg(length(text)), 6) AS avg_size, min(length(text))::INT AS min_size, max(length(text))::INT AS max_size, sum(length(text))::BIGINT AS total_size FROM chunks")
def chunk_stats(spark, sf):
    return structure.chunk_statistics(chunks(spark, sf))


@query("""SELECT o_orderkey AS id, 1 AS row_index, 'Контекст документа: order' || chr(10) || 'Таблица: ' || o_orderpriority || chr(10) || 'Столбцы таблицы: status | priority | total' || chr(10) ||
  'Строка 1: status: ' || o_orderstatus || ' | priority: ' || o_orderpriority || CASE WHEN o_custkey % 2 = 0 THEN ' | total: ' || o_custkey ELSE '' END AS text FROM orders""")
def table_row_chunks(spark, sf):
    o = load(spark, sf, "orders")
    total = F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise("  ")
    tables = o.select(
        F.col("o_orderkey").alias("id"), F.array(F.lit("status"), F.lit("priority"), F.lit("total")).alias("headers"),
        F.array(F.array("o_orderstatus", "o_orderpriority", total), F.array(F.lit(" "), F.lit(""))).alias("rows"),
        F.col("o_orderpriority").alias("title"), F.lit("order").alias("before"), F.lit("").alias("after"),
    )
    return structure.table_rows(tables)


@query("""SELECT n_nationkey AS id, '[Заголовки таблицы: name | key]' || chr(10) || '[Строка 1: ' || n_name || ' | ' || n_nationkey || ']' || chr(10) || '[Строка 2: ' || n_regionkey || ']' AS text FROM nation""")
def table_text(spark, sf):
    n = load(spark, sf, "nation")
    cell = lambda c: F.col(c).cast("string")
    rows = F.array(F.array(F.lit("  "), F.lit("")), F.array(F.lit("name"), F.lit(" key ")), F.array(cell("n_name"), cell("n_nationkey")), F.array(F.lit(""), cell("n_regionkey")))
    return n.select(F.col("n_nationkey").alias("id"), structure.table_text(rows).alias("text"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_linestatus) AS n FROM lineitem)
SELECT l_returnflag, 'Заголовки: l_orderkey, l_linestatus, note' || chr(10) || string_agg('Строка ' || n || ': l_orderkey: ' || l_orderkey || '; l_linestatus: ' || l_linestatus ||
  CASE WHEN l_linenumber = 1 THEN '; note: first' ELSE '' END, chr(10) ORDER BY n) FILTER (n <= 1000) || CASE WHEN max(n) > 1000 THEN chr(10) || '... (файл содержит больше строк, показаны первые 1000)' ELSE '' END AS text
FROM r GROUP BY l_returnflag""")
def csv_row_text(spark, sf):
    from pyspark.sql.window import Window

    order = Window.partitionBy("l_returnflag").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_linestatus")
    every = load(spark, sf, "lineitem")
    r = every.withColumn("n", F.row_number().over(order)).where(F.col("n") <= files.MOST_ROWS)
    r = r.withColumn("note", F.when(F.col("l_linenumber") == 1, "first").otherwise(" "))
    totals = every.groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return files.csv_text(r, "l_returnflag", "n", ["l_orderkey", "l_linestatus", "note"], totals=totals)


@query("SELECT event_id, 'k: ' || (props->>'k') AS text FROM events")
def json_flatten_props(spark, sf):
    return load(spark, sf, "events").select("event_id", files.flat_json(F.col("props")).alias("text"))


@query("""SELECT page_id, coalesce(nullif(regexp_extract(lower(url), '\\.[^./]+$'), ''), '') AS ext,
  CASE regexp_extract(lower(url), '\\.[^./]+$') WHEN '.docx' THEN 'docx' WHEN '.csv' THEN 'csv' WHEN '.json' THEN 'json' ELSE 'unsupported' END AS format FROM pages""")
def file_dispatch(spark, sf):
    return load(spark, sf, "pages").select("page_id", files.extension(F.col("url")).alias("ext"), files.processor(F.col("url")).alias("format"))


@query("""SELECT conv_id, turn, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS title,
  CASE WHEN role = 'assistant' THEN '[Ответил про: ' || substr(text, 1, 200) || '...]' ELSE text END AS history FROM conversations""")
def chat_text(spark, sf):
    m = load(spark, sf, "conversations")
    return m.select("conv_id", "turn", text.session_title(F.col("text")).alias("title"), text.history_line(F.col("role"), F.col("text")).alias("history"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'CALENDAR' WHEN event_id % 4 = 1 THEN 'RAG' WHEN event_id % 4 = 2 THEN 'RAG' ELSE 'RAG' END AS type,
  CASE WHEN event_id % 4 = 0 THEN 0.9 WHEN event_id % 4 = 1 THEN 0.8 WHEN event_id % 4 = 2 THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence FROM events""")
def request_classification(spark, sf):
    answers = ['So: {"type": "calendar", "confidence": 0.9} ok', '{"type": "RAG"}', '{"type": "OTHER", "confidence": 1}', "no json"]
    e = load(spark, sf, "events").select("event_id", F.get(F.array(*map(F.lit, answers)), (F.col("event_id") % 4).cast("int")).alias("a"))
    return e.select("event_id", text.request_type(F.col("a")).alias("r")).select("event_id", "r.type", "r.confidence")


@query("SELECT event_id, 'search:' || md5(lower(trim(event_type)) || '|' || (user_id % 100 + 1) || '|30') AS key FROM events")
def cache_key(spark, sf):
    e = load(spark, sf, "events")
    return e.select("event_id", text.cache_key("search:", F.col("event_type"), F.col("user_id") % 100 + 1, F.lit("30")).alias("key"))


@query("SELECT c_custkey, string_split(c_name, '#')[1] AS head, lower(c_name) || '@x.org' AS email FROM customer WHERE c_custkey % 2 = 0")
def employee_rows(spark, sf):
    c = load(spark, sf, "customer")
    email = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lower("c_name"), F.lit("@x.org"))).otherwise("none")
    answer = F.concat(F.lit('Found: [{"name": "'), F.split_part("c_name", F.lit("#"), F.lit(1)), F.lit('", "email": "'), email, F.lit('"}] done'))
    return c.select("c_custkey", F.inline(text.employees(answer))).select("c_custkey", F.col("name").alias("head"), "email")


_RULES_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in lemmas.RULES.items()) + ") AS ru(ending, ending_to)"
_ODD_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in lemmas.IRREGULAR.items()) + ") AS od(word, lemma)"
_LEMMAS = f"""{DOCS}, {_TOKENS}, lw AS (SELECT DISTINCT unnest(tokens) AS token FROM tok),
lc AS (SELECT token, left(token, (length(token) - length(ending))::BIGINT) || ending_to AS made, length(ending) AS n FROM lw, {_RULES_SQL} WHERE ends_with(token, ending) AND length(token) >= length(ending) + {lemmas.STEM}),
lr AS (SELECT token, arg_max(made, n) AS made FROM lc GROUP BY token),
le AS (SELECT lw.token, coalesce(od.lemma, lr.made, lw.token) AS lemma FROM lw LEFT JOIN lr USING (token) LEFT JOIN {_ODD_SQL} ON od.word = lw.token)"""


@query(f"WITH {_LEMMAS} SELECT token, lemma FROM le")
def lemma_words(spark, sf):
    """The lemma of each different token of the documents."""
    return lemmas.lemma_table(text.token_rows(documents(spark, sf)), lemmas.exceptions(spark))


@query(f"WITH {_LEMMAS}, lt AS (SELECT id, unnest(tokens) AS token FROM tok), ld AS (SELECT id, lemma FROM lt JOIN le USING (token) WHERE length(lemma) >= 2 AND lemma NOT IN {text.STOP} AND NOT regexp_full_match(lemma, '[0-9]+')) SELECT lemma, count(DISTINCT id) AS n_docs_with, count(*) AS n FROM ld GROUP BY lemma")
def lemma_frequency(spark, sf):
    """Texts and places of each lemma: tokens that are lemmas, as an index takes them."""
    rows = lemmas.lemma_counts(documents(spark, sf), lemmas.exceptions(spark))
    each = rows.groupBy("token", "id").agg(F.sum("n").alias("n"))
    return each.groupBy(F.col("token").alias("lemma")).agg(F.count("*").alias("n_docs_with"), F.sum("n").alias("n"))


@query()
def semantic_chunks(spark, sf):
    """Without SQL: each piece begins where the last one ended."""
    return structure.section_chunks(structure.sections(documents(spark, sf), rules=_RULES))


@query()
def basic_chunks(spark, sf):
    return structure.basic_chunks(documents(spark, sf))


@query()
def mmr_keywords(spark, sf):
    """Without SQL: each choice depends on those before it."""
    return keywords.mmr_keywords(documents(spark, sf))


@query("""SELECT conv_id, turn, turn % 2 = 0 AS is_command, CASE WHEN turn % 3 = 0 THEN 'Sync ' || conv_id END AS title,
  CASE WHEN turn % 3 = 0 THEN TIMESTAMP '2024-05-01 10:00:00' + to_minutes(CASE WHEN turn = 0 THEN 60 ELSE 30 END) END AS "end" FROM conversations""")
def calendar_commands(spark, sf):
    m = load(spark, sf, "conversations")
    answer = F.when(
        F.col("turn") % 3 == 0,
        F.concat(F.lit('Вот: {"title": "Sync '), F.col("conv_id").cast("string"), F.lit('", "datetime": "2024-05-01T10:00:00", "participants": [], "duration": '), F.when(F.col("turn") == 0, "0").otherwise("30"), F.lit("}")),
    ).otherwise('{"title": "x"}')
    asked = F.when(F.col("turn") % 2 == 0, "Назначь ВСТРЕЧУ с ними").otherwise("что нового")
    c = m.select("conv_id", "turn", calendar.is_command(asked).alias("is_command"), calendar.command(answer, asked, F.array(F.lit("A"))).alias("c"))
    return c.select("conv_id", "turn", "is_command", "c.title", F.col("c.end").cast("timestamp_ntz").alias("end"))


@query(f"WITH {CHUNKS} SELECT chunk_id, string_split(chunk_id, '_')[1] AS document_id FROM chunks")
def document_of_chunk(spark, sf):
    return chunks(spark, sf).select("chunk_id", calendar.document_of(F.col("chunk_id")).alias("document_id"))


@query(f"""WITH {CHUNKS}, g AS (SELECT id, (chunk_index // 8)::INT AS group_no, string_agg(text, chr(10) ORDER BY chunk_index) AS text FROM chunks GROUP BY id, chunk_index // 8)
SELECT id, group_no, md5(CASE WHEN group_no > 0 THEN '(продолжение)' || chr(10) || text ELSE text END) AS digest FROM g""")
def grouped_rows(spark, sf):
    rows = chunks(spark, sf).select("id", (F.col("chunk_index") + 1).alias("row_index"), "text")
    return structure.grouped_rows(rows).select("id", "group_no", F.md5("text").alias("digest"))


@query(r"""WITH s AS (SELECT doc_id AS id, text, length(text) AS n FROM documents WHERE length(text) > 1200),
t AS (SELECT id, text, n, 300 AS pos, 150 AS size FROM s UNION ALL SELECT id, text, n, 800, 100 FROM s WHERE id % 2 = 0),
c AS (SELECT id, text, coalesce(lag(pos + size) OVER (PARTITION BY id ORDER BY pos), 0) AS a, pos AS z, 'text_before_table' AS chunk_type FROM t
  UNION ALL SELECT id, any_value(text), max(pos + size), any_value(n), 'text_after_table' FROM t GROUP BY id),
x AS (SELECT id, a, z, chunk_type, regexp_replace(substr(text, (a + 1)::BIGINT, (z - a)::BIGINT), '^\s+|\s+$', '', 'g') AS text FROM c WHERE z > a)
SELECT id, a::BIGINT AS a, z::BIGINT AS z, chunk_type, md5(text) AS digest FROM x WHERE length(text) >= 200""")
def text_around_tables(spark, sf):
    d = documents(spark, sf).where(F.length("text") > 1200)
    found = d.select("id", F.lit(0).alias("section_no"), F.lit(0).alias("start"), F.col("text").alias("content"))
    at = F.when(F.col("id") % 2 == 0, F.array(F.struct(F.lit(300).alias("position"), F.lit(150).alias("size")), F.struct(F.lit(800).alias("position"), F.lit(100).alias("size"))))
    tables = d.select("id", F.lit(0).alias("section_no"), F.inline(F.coalesce(at, F.array(F.struct(F.lit(300).alias("position"), F.lit(150).alias("size"))))))
    out = structure.around_tables(found, tables)
    return out.select("id", F.col("from").cast("long").alias("a"), F.col("to").cast("long").alias("z"), "chunk_type", F.md5("text").alias("digest"))
