"""State streams against their batch twins, cut and dealt in any way; ingest with failures."""

import json
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import catalog
from plumbline.streaming import answers, jobs, sessions
from plumbline.streaming.retries import Ingest

PIECES = "answer_id long, number long, ts timestamp, piece string"


def at(second):
    return datetime(2024, 1, 1) + timedelta(seconds=second)


def cut(rng, text):
    places = sorted(rng.sample(range(len(text) + 1), min(len(text), rng.randrange(1, 12))))
    return [text[i:j] for i, j in zip([0, *places], [*places, len(text)])]


def run(spark, tmp_path, name, batches, schema, job):
    """Feeds the batches one by one through a file stream; gives what came out, by batch."""
    src, out = tmp_path / f"{name}-in", []
    src.mkdir()
    made = job(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src)))
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}-{i}"))
        part = next((tmp_path / f"{name}-{i}").glob("part-*"))
        part.rename(src / f"{i:03}.parquet")
        q = made.writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        out.append(spark.read.parquet(str(tmp_path / f"{name}-out")).count())
    return spark.read.parquet(str(tmp_path / f"{name}-out")), out


def test_lines_cut_anywhere_are_whole_again(spark, tmp_path):
    rng, rows, want = random.Random(3), [], {}
    for a in range(8):
        said = [json.dumps({"response": f"tök{a}.{i} ", "done": i == 5}) if a % 2 else "data: " + json.dumps({"choices": [{"delta": {"content": f"t{i}"}, "finish_reason": None}]}) for i in range(6)]
        said += ["", "data: [DONE]"] if a % 2 == 0 else []
        text = "\n".join(said) + ("\n" if a != 3 else "")
        pieces = cut(rng, text)
        rows += [(a, n, at(a * 10 + n), p) for n, p in enumerate(pieces)]
        ends = [i for i, c in enumerate(text) if c == "\n"]
        sizes = pd.Series([len(p) for p in pieces]).cumsum().tolist()
        want[a] = [(said[k], at(a * 10 + next(n for n, s in enumerate(sizes) if s > e))) for k, e in enumerate(ends)]
    rows.append((2, 0, at(500), "a repeated piece\n"))
    rows += [(50, 0, at(1), "one\ntwo\nthr"), (50, 2, at(3), "never\n"), (51, 1, at(3), "no beginning\n")]
    want[50] = [("one", at(1)), ("two", at(1))]
    show = lambda df: {k: v for k, v in ((a, [(r.line, r.ts) for r in sorted((x for x in df if x.answer_id == a), key=lambda x: x.line_no)]) for a in {r.answer_id for r in df})}
    assert show(answers.lines(spark.createDataFrame(rows, PIECES)).collect()) == want
    # Pieces in the order of arrival, some before their turn, over four batches.
    late = rows[:-4] + rows[-3:]
    rng.shuffle(late)
    got, _ = run(spark, tmp_path, "lines", [late[i::4] for i in range(4)], PIECES, answers.line_stream)
    assert show(got.collect()) == want
    said = answers.tokens(answers.lines(spark.createDataFrame(rows, PIECES)))
    asked = spark.createDataFrame([(a, at(a * 10 - 2)) for a in [*range(8), 99]], "answer_id long, asked_at timestamp")
    times = {r.answer_id: r for r in answers.timings(said, asked).collect()}
    for a in range(8):
        n = 5 if a == 3 else 6
        assert times[a].n_tokens == n and times[a].done == (a != 3) and times[a].first_token_s == (want[a][0][1] - at(a * 10 - 2)).total_seconds()
    assert (times[99].n_tokens, times[99].first_token_s, times[99].done) == (0, None, False)


def test_state_of_an_answer_ends(spark, tmp_path):
    """After a pause beyond the watermark, the half line is forgotten: a later beginning is a new answer."""
    batches = [[(1, 0, at(0), "half"), (2, 0, at(0), "a\n")], [(2, 1, at(5000), "b\n")], [(2, 2, at(5001), "c\n")], [(1, 0, at(5002), "new\n")]]
    got, _ = run(spark, tmp_path, "idle", batches, PIECES, lambda df: answers.line_stream(df, late="10 seconds", idle_s=60))
    lines = sorted((r.answer_id, r.line_no, r.line) for r in got.collect())
    assert (1, 0, "new") in lines and not any("half" in x[2] for x in lines)


def test_activity_stream_equals_batch_and_closes(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randrange(6), at(i * 60 + rng.randrange(50))) for i in range(60)] + [(None, at(5)), (3, None), (77, at(10))]
    schema = "session_id long, ts timestamp"
    # A shuffle of messages inside of batches: none is later than the watermark allows.
    batches = [rows[:20] + rows[60:], rows[20:40], rows[40:60], [(0, at(900_000))], [(0, at(900_001))]]
    got, _ = run(spark, tmp_path, "activity", batches, schema, lambda df: sessions.activity_stream(df, late="1 hour", idle_s=3600))
    twin = sessions.activity(spark.createDataFrame([r for b in batches for r in b], schema))
    show = lambda df: sorted((r.session_id, r.updated_at, r.n_messages) for r in df.collect())
    assert show(sessions.current(got)) == show(twin)
    closed = {r.session_id for r in got.where("closed").collect()}
    assert closed >= {77} and closed <= {0, 1, 2, 3, 4, 5, 77} and len(closed) >= 6


def test_pages_by_key_meet_every_row_once(spark):
    rows = [(i, at(i // 4)) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, updated_at timestamp")
    seen, after = [], None
    while True:
        page = catalog.page_after(df, "updated_at", "id", 7, after).collect()
        if not page:
            break
        seen += [r.id for r in page]
        after = (page[-1].updated_at, page[-1].id)
    assert seen == [i for i, _ in sorted(rows, key=lambda r: (-r[1].timestamp(), r[0]))]
    plan = catalog.page_after(df, "updated_at", "id", 7, after)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "Window" not in plan


@pytest.fixture
def job(spark, tmp_path):
    tries = {"twice.txt": 3, "always.txt": 99}

    def process(files):
        name = F.regexp_extract("path", r"([^/]+)$", 1)
        least = F.create_map(*(F.lit(x) for kv in tries.items() for x in kv))
        failed = F.col("attempt") < F.coalesce(F.try_element_at(least, name), F.lit(1))
        body = F.col("content").cast("string")
        chunks = files.select("path", F.when(failed, F.lit(None)).otherwise(F.lit(None)).cast("string").alias("error"), F.posexplode(F.split(body, " ")).alias("chunk_index", "text"))
        errors = files.where(failed).select("path", F.concat(F.lit("attempt "), F.col("attempt")).alias("error"), F.lit(None).cast("int").alias("chunk_index"), F.lit(None).cast("string").alias("text"))
        return chunks.unionByName(errors)

    return Ingest(spark, str(tmp_path / "store"), process)


def test_failed_files_are_tried_again_or_given_up(spark, tmp_path, job):
    src = tmp_path / "in"
    src.mkdir()
    put = lambda name, text: (src / name).write_text(text)
    put("good.txt", "a b")
    put("twice.txt", "c d e")
    put("always.txt", "f g")
    clock = [1000.0]

    def go():
        stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.txt").load(str(src))
        q = job.start(stream, str(tmp_path / "state"), lambda: clock[0])
        q.awaitTermination(120)
        assert q.exception() is None

    show = lambda: sorted((r.path.rsplit("/", 1)[1], r.chunk_index, r.text) for r in job.living().collect())
    good = [("good.txt", 0, "a"), ("good.txt", 1, "b")]
    go()
    assert show() == good and job.waiting().count() == 2 and job.dead().count() == 0
    assert job.drain(clock[0] + 59) == 2 and {r.attempt for r in job.waiting().collect()} == {1}  # not due yet
    assert job.drain(clock[0] + 60) == 2 and show() == good
    again = job.last()
    job.step(spark.createDataFrame([], "path string, content binary"), again, clock[0] + 60)  # the batch runs once more
    assert {r.attempt for r in job.waiting().collect()} == {2}
    assert job.drain(clock[0] + 200) == 1
    twice = [("twice.txt", i, c) for i, c in enumerate("cde")]
    assert show() == good + twice
    assert job.drain(clock[0] + 300) == 0
    assert [(r.path.rsplit("/", 1)[1], r.attempts, r.error) for r in job.dead().collect()] == [("always.txt", 4, "attempt 4")]
    assert show() == good + twice and not any("always" in r.path for r in spark.read.parquet(f"{job.target}/chunks").collect())


def test_a_new_version_replaces_the_one_that_waits_or_was_given_up(spark, job):
    files = lambda *rows: spark.createDataFrame([(p, t.encode()) for p, t in rows], "path string, content binary")
    job.step(files(("x/good.txt", "old text"), ("x/twice.txt", "first")), 0, 0.0)
    job.step(files(("x/good.txt", "new"), ("x/twice.txt", "second")), 1, 100.0)
    assert [(r.content, r.attempt) for r in job.waiting().collect()] == [(b"second", 1)]
    assert [(r.path, r.text) for r in job.living().collect()] == [("x/good.txt", "new")]
    job.step(files(("x/always.txt", "never")), 2, 100.0)
    for k in range(3, 6):
        job.step(files(), k, 1000.0 * k)
    assert job.waiting().count() == 0 and [r.path for r in job.dead().collect()] == ["x/always.txt"]
    assert sorted(r.text for r in job.living().collect()) == ["new", "second"]


def test_hot_users_are_limited_as_one_by_one(spark):
    """A third of all events are one user's; sessions cross ranges; null users and times."""
    rng = random.Random(8)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    rows, t = [], 0.0
    for i in range(900):
        t += rng.choice([0, 1, 5, 30, 61, 200])
        rows.append((1 if rng.random() < 0.34 else rng.randrange(2, 9), i, at(t)))
    rows += [(None, 9001, at(3)), (4, 9002, None)]
    try:
        got = {r.event_id: r.accepted for r in jobs.rate_limited(spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp"), most=3).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {9001: False, 9002: False}
    for user in range(1, 9):
        kept = []
        for _, event, when in sorted((r for r in rows if r[0] == user and r[2]), key=lambda r: (r[2], r[1])):
            recent = [x for x in kept if (when - x).total_seconds() < 60]
            want[event] = len(recent) < 3
            kept += [when] if want[event] else []
    assert got == want and 100 < sum(got.values()) < 890


def test_cached_results_across_spans(spark):
    rng = random.Random(9)
    asked = [(i, rng.choice(["hot", "hot", "k"]), at(rng.randrange(20_000))) for i in range(300)] + [(301, None, at(50))]
    given = [(rng.choice(["hot", "k"]), at(rng.randrange(20_000)), i) for i in range(60)] + [(None, at(20), 77)]
    out = jobs.cached(spark.createDataFrame(asked, "id long, cache_key string, ts timestamp"), spark.createDataFrame(given, "cache_key string, ts timestamp, result long"), ttl_s=1000)
    want = {}
    for i, key, when in asked:
        live = [(s, r) for k, s, r in given if k == key and 0 <= (when - s).total_seconds() < 1000]
        want[i] = max(live)[1] if live else None
    assert {r.id: r.result for r in out.collect()} == want and out.columns == ["id", "cache_key", "ts", "result"]


def test_files_that_wait_are_not_written_again_to_be_tried(spark, tmp_path):
    from plumbline.sources.stores import listed

    def process(files):
        failed = F.col("attempt") < 3
        chunks = files.select("path", F.lit(None).cast("string").alias("error"), F.col("content").cast("string").alias("text"))
        return chunks.unionByName(files.where(failed).select("path", F.lit("failed").alias("error"), F.lit(None).cast("string").alias("text")))

    job = Ingest(spark, str(tmp_path / "store"), process)
    job.step(spark.createDataFrame([("a", b"x"), ("b", b"y")], "path string, content binary"), 0, 0.0)
    assert job.drain(60.0) == 2 and job.drain(120.0) == 0
    assert [n for n in listed(spark, f"{job.target}/scratch") if n.startswith("tried")] == ["tried-0"]
    assert spark.read.parquet(f"{job.target}/scratch/made-0").where("error IS NULL").count() == 0  # a failed file's chunks
    assert sorted((r.path, r.text) for r in job.living().collect()) == [("a", "x"), ("b", "y")]
