"""Searches that fan out by person, and searches that keep their stages."""

from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import catalog, diagnostics, expansion, people, retrieval

CHAT = [
    (1, 1, "user", "Поставь встречу с Иван Петров завтра"), (1, 2, "assistant", "Пётр Великий добавлен"), (1, 3, "user", "И позови Анна Каренина, Иван Петров"), (2, 1, "user", "Можешь найти Сергей"),
    (2, 2, "user", "а"), (2, 3, "user", "б"), (2, 4, "user", "в"), (2, 5, "user", "Встреча с Ольга"), (2, 6, "user", "Дай Почту"), (3, 1, "user", None), (3, 2, "user", "Ольга"),
]


def chat(spark):
    return spark.createDataFrame(CHAT, "conv_id int, turn int, role string, text string")


def test_people_of_recent_messages_in_order(spark):
    got = {r.conv_id: r.people for r in catalog.mentioned(chat(spark)).collect()}
    assert got == {1: ["Иван Петров", "Анна Каренина"], 2: ["Ольга", "Дай Почту"], 3: ["Ольга"]}
    latin = spark.createDataFrame([(1, "Ann Lee met Zoé, Bob and Éva O.")], "id int, c string").select(text.people(F.col("c"), text.LATIN, 2)).first()[0]
    assert latin == ["Ann Lee", "Bob"]


def test_each_name_is_searched_once_and_put_back_by_session(spark):
    asked = []

    def search(queries):
        asked.append(sorted(r.query for r in queries.collect()))
        hits = [("Ольга", "first o@x.io, then b@y.org and o@x.io", 1), ("Ольга", "c@z.net", 2), ("Ольга", "  ", 3), ("Иван Петров", "no address", 1)]
        return spark.createDataFrame(hits, "qid string, text string, final_rank int")

    rows = {r.conv_id: r.employees for r in people.search_people(people.participants(chat(spark)), search).collect()}
    assert asked == [["Анна Каренина", "Дай Почту", "Иван Петров", "Ольга"]]
    olga = [("Ольга", m, "", "") for m in ("o@x.io", "b@y.org", "c@z.net")]
    found = {c: [(e.place, e.name, e.n_sources, [tuple(x) for x in e.employees]) for e in es] for c, es in rows.items()}
    assert found == {1: [(0, "Иван Петров", 1, []), (1, "Анна Каренина", 0, [])], 2: [(0, "Ольга", 2, olga), (1, "Дай Почту", 0, [])], 3: [(0, "Ольга", 2, olga)]}


def test_a_models_answer_about_the_texts(spark):
    answer = 'Here: [{"name":"","email":"a@b.c","position":"boss"},{"name":"X","email":"none"},{"name":"Y","email":"y@b.c"}]'
    typed = lambda name, body: F.transform(text.employees(F.lit(answer)), lambda e: F.struct(e["name"].alias("name"), e["email"].alias("email"), F.lit(None).cast("string").alias("department"), e["position"].alias("position")))
    one = spark.createDataFrame([("Ольга", "t")], "n string, t string").select(people.completed(F.col("n"), typed(F.col("n"), F.col("t")))).first()[0]
    assert [tuple(x) for x in one] == [("Ольга", "a@b.c", "", "boss"), ("Y", "y@b.c", "", "")]


def test_a_trace_searches_once_and_keeps_every_stage(spark):
    texts = spark.createDataFrame([(i, f"alpha {'beta ' * (i % 4)} {'gamma ' * (i % 3)} w{i}") for i in range(40)], "id long, text string")
    vectors = spark.createDataFrame([(i, [1.0, float(i % 9)]) for i in range(40)], "id long, v array<double>")
    queries = spark.createDataFrame([(1, "beta gamma", [1.0, 3.0]), (2, "zzz", None), (3, "alpha w7", [1.0, 0.0])], "qid long, query string, qv array<double>")
    calls = []

    def nearest(asked, k):
        calls.append(k)
        return retrieval.vector_top(vectors, asked, k)

    index, synonyms = retrieval.build_index(texts), expansion.synonyms(spark, expansion.SAMPLE)
    trace = retrieval.traced(index, texts, nearest, queries, synonyms, 8)
    rows = trace.collect()
    assert calls == [8]
    at = lambda q, s: {r.id: r.score for r in rows if r.qid == q and r.stage == s}
    for q in (1, 2, 3):
        assert set(at(q, "fused")) == set(at(q, "vector")) | set(at(q, "bm25")) == set(at(q, "rerank"))
        assert set(at(q, "final")) <= set(at(q, "rerank")) and len(at(q, "bm25")) == 8
        assert min(at(q, "final").values()) >= max([v for i, v in at(q, "rerank").items() if i not in at(q, "final")], default=-1)
    assert not at(2, "vector")
    report = {r.qid: r for r in diagnostics.diagnosis(trace, texts, queries.select("qid", "query")).collect()}
    assert report[2].n_vector == 0 and "one_side_empty" in report[2].advice and "no_query_words" in report[2].issues
    assert report[1].n_both == len(set(at(1, "vector")) & set(at(1, "bm25"))) and report[1].n_final == len(at(1, "final"))
    none = spark.createDataFrame([(9, "q")], "qid long, query string")
    empty = diagnostics.diagnosis(trace.where("false"), texts, none).first()
    assert (empty.n_rerank, empty.issues) == (0, "no_results") and "rebuild_index" in empty.advice
