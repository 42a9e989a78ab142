"""A kept index against a new one over what is left, after any changes."""

import random

import pytest

from plumbline.functions import text
from plumbline.operators import retrieval
from plumbline.operators.segments import Segments

WORDS = [f"word{i}" for i in range(40)]
QUERIES = [(1, "word1 word2 word3"), (2, "word7"), (3, "absent"), (4, "word5 word5 word9")]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, v) for i, (t, v) in texts.items()], "id long, text string, access_level int")


def said(rng):
    return " ".join(rng.choices(WORDS, weights=range(40, 0, -1), k=rng.randrange(0, 30)))


def same(spark, index, texts, level):
    """Statistics, idf and ranking equal those of an index built anew."""
    left = frame(spark, texts).where(f"access_level <= {level}")
    new = retrieval.build_index(left)
    cols = ["n_docs", "avgdl", "n_tokens", "mean_idf"]
    assert [round(float(x or 0), 9) for x in index.stats.select(*cols).first()] == [round(float(x or 0), 9) for x in new.stats.select(*cols).first()]
    idf = lambda i: sorted((r.token, r.n_docs_with, round(r.idf, 9)) for r in i.tokens.collect())
    assert idf(index) == idf(new)
    asked = spark.createDataFrame(QUERIES, "qid long, query string")
    top = lambda i: sorted(tuple(r) for r in retrieval.bm25_top(i, asked, 10).select("qid", "rank", "id", "score").collect())
    assert top(index) == top(new)


def test_changes_in_any_order_equal_a_new_index(spark, tmp_path):
    rng, now, texts = random.Random(4), {}, None
    kept = Segments(spark, f"{tmp_path}/index")
    assert kept.version() == 0 and kept.manifest() == []
    for step in ("append", "append", "delete", "append", "compact", "delete", "sweep", "append"):
        if step == "append":  # new texts, and new texts of old ids, some with another level
            texts = {i: (said(rng), rng.randrange(1, 100)) for i in rng.sample(range(60), 25)}
            kept.append(frame(spark, texts))
            now |= texts
        elif step == "delete":
            ids = rng.sample(range(60), 15)
            kept.delete(spark.createDataFrame([(i,) for i in [*ids, 999]], "id long"))
            now = {i: t for i, t in now.items() if i not in ids}
        elif step == "compact":
            kept.compact()
            assert [k for k, _, _ in kept.manifest()] == ["segment"]
        else:
            assert kept.sweep() and kept.sweep() == []
    for level in (100, 40):
        same(spark, kept.view(level, now=1000)[0], now, level)


def test_old_texts_are_not_read_again(spark, tmp_path):
    """Each batch is tokenised once; deletes, compaction and views tokenise nothing and read the index only."""
    seen = []

    def rows(df):
        seen.append(sorted(r[0] for r in df.select("id.id").collect()))
        return text.token_rows(df)

    kept = Segments(spark, f"{tmp_path}/index", rows)
    kept.append(frame(spark, {i: (f"word{i % 7} text", 1) for i in range(10)}))
    kept.append(frame(spark, {i: (f"word{i % 7} text", 1) for i in range(8, 14)}))
    kept.delete(spark.createDataFrame([(3,)], "id long"))
    index, _ = kept.view(100, now=1)
    kept.compact()
    again, _ = kept.view(100, now=1)
    assert seen == [list(range(10)), list(range(8, 14))]
    for i in (index, again):
        files = [f for df in (i.postings, i.tokens, i.lengths, i.stats) for f in df.inputFiles()]
        assert files and all(f"{tmp_path}/index/" in f for f in files)
    # Folders of postings that no query asks for are pruned.
    plan = index.postings.where("bucket = 3")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_views_live_until_a_change_or_their_age(spark, tmp_path):
    kept = Segments(spark, f"{tmp_path}/index")
    kept.append(frame(spark, {1: ("one two", 1), 2: ("two three", 60)}))
    assert kept.view(50, now=100)[1] is False
    assert kept.view(50, now=100 + 7199)[1] is True
    assert kept.view(60, now=100)[1] is False  # another level
    assert kept.view(50, now=100 + 7200)[1] is False  # too old
    kept.append(frame(spark, {3: ("four", 1)}))
    index, old = kept.view(50, now=100 + 7201)
    assert old is False and index.stats.first().n_docs == 2
    assert kept.delete(spark.createDataFrame([(77,)], "id long")) == kept.version()
    assert kept.view(50, now=100 + 7300)[1] is True


def test_empty_texts_everything_deleted_and_two_writers(spark, tmp_path):
    kept = Segments(spark, f"{tmp_path}/index")
    kept.append(frame(spark, {1: ("", 1), 2: (None, 1), 3: ("word1", 1)}))
    same(spark, kept.view(9, now=1)[0], {1: ("", 1), 2: (None, 1), 3: ("word1", 1)}, 9)
    kept.delete(spark.createDataFrame([(1,), (2,), (3,)], "id long"))
    index, _ = kept.view(9, now=2)
    assert index.stats.first().n_docs == 0 and index.tokens.count() == 0 and index.lengths.count() == 0
    kept.compact()
    assert kept.view(9, now=3)[0].stats.first().n_docs == 0
    before = kept.manifest()
    with pytest.raises(Exception, match="(?i)already.?exists"):
        kept._commit(before, kept.version() - 1)
    assert kept.manifest() == before
