import random

import regex
from pyspark.sql import functions as F

from plumbline.functions import lemmas, text
from plumbline.operators import structure

ORDER = """ООО «Ромашка»
ИНН 1234567890 КПП 123456789 ОГРН 1234567890123
ПРИКАЗ № 12-К от «05» марта 2024 г.
Об утверждении правил внутреннего распорядка
ПРИКАЗЫВАЮ:
1. Утвердить правила.
1.1. Довести до сведения.
а) всех сотрудников;
Директор завода Иванов И.И."""


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "c string").select(column(F.col("c")).alias("x")).first().x


def test_clean(spark):
    assert one(spark, "﻿a  b\r\n\r\n \t c\rd\x00e\n", text.clean) == "a b\nc\nde"
    assert one(spark, None, text.clean) is None


def test_tokens(spark):
    got = one(spark, "The Well-Known report of 2024-05-06, 12.03.2023 and 3.14 or 42: ab-c x", text.tokens)
    assert got == ["the", "well", "known", "report", "of", "DATE", "DATE", "and", "NUMBER", "or", "ab"]
    assert one(spark, "Приказ №5 о ёлках", text.tokens) == ["приказ", "ёлках"]


def test_language_and_dates(spark):
    assert one(spark, "Привет world", text.language) == "ru" and one(spark, "12 34", text.language) == "en"
    assert one(spark, "до 5 марта", text.has_dates) and not one(spark, "версия 5.2", text.has_dates)
    assert one(spark, "Привет", text.prefixed).endswith("Привет")


def test_technical_terms(spark):
    got = one(spark, "We use PYTHON and postgresql with API v1.2.3, MyClass and call() in app.py over 10 MB", text.technical_terms)
    assert got == sorted(["10 MB", "API", "MyClass", "app.py", "call()", "postgresql", "python", "v1.2.3"])


def test_answers(spark):
    assert one(spark, "<|im_start|>assistant: Привет! Вот правильный ответ.", text.clean_answer) == "Вот правильный ответ."
    assert one(spark, "ok", text.clean_answer).startswith("Извините")
    assert one(spark, "Пригласи Иванова и Петрову Анну, Иванова", text.people) == ["Пригласи Иванова", "Петрову Анну", "Иванова"]


def test_order_document(spark):
    docs = spark.createDataFrame([("d", ORDER)], "id string, text string")
    row = docs.select(structure.document_type(F.col("text")).alias("t"), structure.metadata(F.col("text")).alias("m"), structure.title(F.col("text")).alias("title")).first()
    assert row.t == "ORDER" and row.m.inn == "1234567890" and row.m.kpp == "123456789" and row.m.ogrn == "1234567890123"
    assert row.m.number == "12-К" and row.m.date == "05 марта 2024" and row.m.organization == "Ромашка" and row.m.signatories == ["Иванов И.И."]
    assert row.title == "ПРИКАЗ № 12-К от «05» марта 2024 г."
    kinds = [r.type for r in structure.lines(docs, structure.document_type(F.col("text"))).orderBy("line_no").collect()]
    assert kinds == ["paragraph", "paragraph", "paragraph", "subheader", "header", "numbered_item", "numbered_item", "lettered_item", "signatures"]
    found = structure.sections(docs, structure.document_type(F.col("text"))).orderBy("section_no").collect()
    assert [s.level for s in found] == [1, 2, 1, 1, 2, 3, 1]
    assert found[0].title == "Документ" and found[2].content == "ПРИКАЗЫВАЮ:"
    assert all(ORDER[s.start : s.end].strip() == s.content for s in found)


def test_pieces_overlap_and_end_at_sentences():
    body = "Первое предложение о чём-то важном и т.д. следует дальше без конца. " * 40
    parts = structure.pieces(body, structure.Sizes())
    assert parts[0][0] == 0 and all(z - a <= 1001 for a, z, _ in parts)
    for (a, z, _), (b, _, _) in zip(parts, parts[1:]):
        assert b == z - 100
    assert all(p[2].endswith("конца.") for p in parts[:-1])
    assert structure.pieces("short", structure.Sizes()) == [(0, 5, "short")]
    assert structure.pieces("x" * 2500, structure.Sizes())[-1][1] == 2500
    items = "1. one two.\n" * 120
    assert all(items[:z].endswith(".\n") for _, z, _ in structure.pieces(items, structure.Sizes(), items=True)[:-1])


def test_section_chunks(spark):
    long = "Длинный раздел. " * 100
    df = spark.createDataFrame([("d", 1, "Раздел", "paragraph", 10, 10 + len(long), long.strip()), ("d", 2, "Б", "header", 0, 5, "краткий")], "id string, section_no int, title string, type string, start long, end long, content string")
    out = structure.section_chunks(df).orderBy("section_no", "part").collect()
    assert [r.chunk_type for r in out] == ["section_part"] * (len(out) - 1) + ["complete_section"]
    assert out[0].text.startswith("[Раздел]\n") and out[1].text.startswith("[Раздел (продолжение)]\n") and out[0].total_parts == len(out) - 1


def test_tables(spark):
    t = spark.createDataFrame([("d", ["a", "b"], [["1", ""], ["", " "], ["2"], ["3", "4"]], "T", "before", "")], "id string, headers array<string>, rows array<array<string>>, title string, before string, after string")
    out = [r.text for r in structure.table_rows(t).orderBy("row_index").collect()]
    head = "Контекст документа: before\nТаблица: T\nСтолбцы таблицы: a | b\n"
    assert out == [head + "Строка 1: a: 1", head + "Строка 3: 2", head + "Строка 4: a: 3 | b: 4"]
    row = spark.createDataFrame([("x" * 300 + "\nGoods:\n", 309, 320)], "c string, s int, e int").select(structure.table_context(F.col("c"), F.col("s"), F.col("e")).alias("x")).first().x
    assert row.title == "Goods"
    tables = spark.createDataFrame([("d", 0, 5), ("d", 1, 50), ("e", 0, 5)], "id string, table_no int, position int")
    secs = spark.createDataFrame([("d", 0, 0, 10), ("d", 1, 40, 60)], "id string, section_no int, start int, end int")
    assert sorted((r.id, r.table_no, r.section_no) for r in structure.tables_in_sections(tables, secs).collect()) == [("d", 0, 0), ("d", 1, 1)]


def test_tokens_equal_their_definition(spark):
    """Runs, hyphens, numbers, marks: the one pattern against the definition, step by step."""
    rng = random.Random(1)
    texts = ["".join(rng.choices("аbя1９2-_é\u0301 ,-", k=rng.randrange(0, 40))) for _ in range(400)] + ["a-b ab-c -- --- ---- 12 1-2 12-34 12-a4 -ab ab- x1-22-zz", "и в не-что", "２３ ²³ a²"]
    want = []
    for t in texts:
        out = []
        for run in regex.findall(r"[\p{L}\p{M}\p{N}_-]+", t.lower()):
            parts = run.split("-") if "-" in run and len(run) > 3 else [run]
            out += [p for p in parts if len(p) >= 2 and p not in text.STOP and not regex.fullmatch(r"\p{Nd}+", p)]
        want.append(out)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert [r[0] for r in df.orderBy("id").select(text.tokens(F.col("text"))).collect()] == want
    rows = {}
    for r in text.token_rows(df).collect():
        rows.setdefault(r.id, []).append(r.token)
    assert [rows.get(i, []) for i in range(len(texts))] == want


def test_running_sums(spark):
    rng = random.Random(2)
    arrays = [[rng.randrange(100) for _ in range(n)] for n in (0, 1, 2, 3, 9, 10, 99, 1000)]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "id int, a array<int>")
    got = [r[0] for r in df.orderBy("id").select(text.running(F.col("a"))).collect()]
    assert got == [[sum(a[:i]) for i in range(len(a))] for a in arrays]


def test_lemmas_by_rules_and_exceptions(spark):
    words = ["cats", "parties", "classes", "boxes", "wishes", "glass", "this", "making", "red", "договоров", "новыми", "делали", "инструкции", "важностью", "решениями", "были", "children", "да", "ab"]
    want = ["cat", "party", "class", "box", "wish", "glass", "this", "mak", "red", "договор", "новый", "делать", "инструкция", "важность", "решение", "быть", "child", "да", "ab"]
    df = spark.createDataFrame([(w,) for w in words * 2], "token string")
    got = {r.token: r.lemma for r in lemmas.lemma_table(df, lemmas.exceptions(spark)).collect()}
    assert got == dict(zip(words, want))
    docs = spark.createDataFrame([(1, "Cats cat были 12 не cats"), (2, ""), (3, None)], "id int, text string")
    assert sorted(r.token for r in lemmas.lemma_rows(docs, lemmas.exceptions(spark)).collect()) == ["cat", "cat", "cat"]
    assert len(lemmas.RULES) < 200


def test_patterns_made_sooner_find_the_same(spark):
    odd = ["xPython python JAVAscript Java2 _go go", "é.pdf a.b.PDF read_me.docx .csv x.jsonx файл.txt", "call() a.b() ( ) __x__() é()", "SQL Server sql serverless ASP.NET aspxnet C++ C# c", "KKit ſql ﬁ Ruby\nrust", "", "v1.2 HTTPS/https-API UI ux"]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    for p in [*("(?i)" + x for x in text.FAMILIES), *text.SHAPES]:
        fast = "(?i)" + text.sooner(p[4:]) if p.startswith("(?i)") else text.sooner(p)
        assert df.select(F.regexp_extract_all("t", F.lit(p), F.lit(0))).collect() == df.select(F.regexp_extract_all("t", F.lit(fast), F.lit(0))).collect(), p
    assert sum(text.sooner(p) != p for p in [*text.FAMILIES, *text.SHAPES]) == 10
