import random
import re
import unicodedata
import zlib

from pyspark.sql import functions as F

from plumbline.llm import language, queries
from tests.llm.helpers import ODD, empty, odd


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.held_out(F.col("doc_id"))
    known = language.learn(docs.where(~out))
    assert {k for k, _ in known} == {"en", "de", "fr", "es"} and all(len(d) <= language.DICTIONARY for _, d in known)
    rows = language.predict(docs.withColumn("held_out", out), known, carry=("doc_id", "held_out", "lang")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 250 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    sure = [r for r in held if not r.rejected]
    assert len(sure) > 0.9 * len(held) and sum(r.lang == r.lang_pred for r in sure) / len(sure) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)
    again = language.learn(docs.where(~out))
    assert again == known


def test_odd_rows_and_empty(spark):
    docs = odd(spark)
    known = language.learn(docs)
    rows = language.predict(docs, known, carry=("doc_id", "kept")).collect()
    assert len(rows) == len(ODD)
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5)} == {"und"}
    assert all(r.lang_pred in {"en", "de", "fr"} for r in rows if r.doc_id not in (3, 4, 5))
    assert language.learn(empty(spark)) == []
    assert {r.lang_pred for r in language.predict(docs, [], carry=("doc_id",)).collect()} == {"und"}
    one = language.predict(docs, [("en", b"the quick brown fox")], carry=("doc_id",)).where("doc_id = 1").first()
    assert (one.lang_pred, one.score, one.rejected) == ("en", 1.0, False)
    assert language.predict(empty(spark), known, carry=("doc_id",)).count() == 0


def test_no_letter_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "\u00b2\u00b2 \u00bd 12 ___", "a"), (2, "\u2460", "a"), (3, "haus \u00b2", "a")], "doc_id long, text string, Score string")
    out = {r.doc_id: r for r in language.predict(docs, [("de", b"das haus"), ("en", b"the house")], carry=("doc_id", "Score")).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und", "und", "de"] and out[1].Score_carried == "a"


def test_the_sample_is_that_of_the_smallest_hashes(spark, monkeypatch):
    """With many documents, with ids that repeat, and with null ids."""
    monkeypatch.setattr(language, "SAMPLE", 20)
    rows = [(i, f"wort{i}", "de") for i in range(3000)] + [(7, f"mot{i}", "fr") for i in range(900)] + [(None, f"word{i}", "en") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = dict(language.learn(docs))
    hashed = docs.selectExpr("lang", "xxhash64(cast(doc_id as string), 'lang') as h", "text").collect()
    for k in ("de", "fr", "en"):
        want = [r.text for r in sorted((r for r in hashed if r.lang == k), key=lambda r: (r.h, r.text))][:20]
        assert found[k] == b"\n".join(map(language.levelled, want))


def learned(rows, most=language.DICTIONARY):
    """rows: (lang, hash, text). The dictionaries as the definition says, without Spark."""
    found = {}
    for lang in {r[0] for r in rows if r[0] is not None and r[2] is not None}:
        mine = sorted((h, t[: language.SLICE]) for k, h, t in rows if k == lang and t is not None)
        found[lang] = (len(mine), b"\n".join(x for x in (plainly(t) for _, t in mine[: language.SAMPLE]) if x)[:most])
    return found


def plainly(text):
    """Lower case, runs of what is no letter as one space."""
    out, space = [], False
    for c in text.lower():
        if (c.isalnum() or unicodedata.category(c) in ("Mn", "Mc")) and not c.isdecimal() and re.match(r"\w", c):
            out += [" ", c] if space and out else [c]
            space = False
        else:
            space = True
    return "".join(out).encode() if any(c.isalpha() for c in out) else b""


def test_every_row_equals_compression_one_by_one(spark, sf):
    """Dictionaries, compressed sizes, prediction, score and rejection of every document, computed a second way."""
    import zstandard

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    hashed = docs.selectExpr("doc_id", "lang", "xxhash64(cast(doc_id as string), 'lang') as h", "text").collect()
    teach = [(r.lang, r.h, r.text) for r in hashed if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    want = learned(teach)
    params = dict(strategy=zstandard.STRATEGY_GREEDY, min_match=4, window_log=18, hash_log=17, chain_log=17, search_log=4, write_content_size=0, write_checksum=0, write_dict_id=0)
    how = zstandard.ZstdCompressionParameters(**params)
    got = {r.doc_id: r for r in queries.op3_zstd_language(spark, sf).collect()}
    assert len(got) == len(hashed)
    for r in hashed:
        body = plainly(r.text or "")
        sizes = []
        for lang, (n, content) in want.items():
            fresh = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)
            sizes.append((len(fresh.compress(body)), -n, lang))
        best, second = sorted(sizes)[:2]
        row, score = got[r.doc_id], (second[0] - best[0]) / second[0]
        assert row.lang_pred == (best[2] if body else "und"), r.doc_id
        assert abs(row.score - (score if body else 0)) < 1e-12 and row.rejected == (row.score < language.NARROW)


def test_every_label_is_learned(spark, monkeypatch):
    """More labels than their dictionaries have room for: each has a share, and is predicted."""
    monkeypatch.setattr(language, "BUDGET", 600 * 900)
    rng = random.Random(3)
    words = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(40)] for _ in range(600)]
    rows = [(k * 3 + c, " ".join(rng.choices(words[k], k=45 if c < 2 else 90)), f"l{k:03}") for k in range(600) for c in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = language.learn(docs.where("doc_id % 3 < 2"))
    assert len(known) == 600 and all(0 < len(c) <= 900 for _, c in known)
    asked = docs.where("doc_id % 3 = 2 and doc_id % 60 = 2")
    held = language.predict(asked, known, carry=("lang",)).collect()
    assert len(held) == 30 and sum(r.lang == r.lang_pred for r in held) >= 29
