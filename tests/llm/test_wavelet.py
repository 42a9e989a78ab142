import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from plumbline.llm import wavelet
from plumbline.llm.common import tokenizer_file
from tests.llm.helpers import ODD, empty, odd

FILE = tokenizer_file("word_bpe_49k.json")


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (7, 3), (5000, 49408), (300_000, 300), (70_000, 1 << 20)])
def test_every_operation_matches_the_plain_array(n, top):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % top).astype(np.uint32)
    s = wavelet.Shard(wavelet.build(ids, [1, None], np.array([n, 0])))
    assert np.array_equal(s.ids(), ids) and s.doc_ids == [1, None] and s.lengths.tolist() == [n, 0]
    for i in rng.integers(0, max(1, n), 60).tolist() if n else []:
        assert s.access(i) == ids[i]
    for t in {*ids[:5].tolist(), 0, top, 1 << 25}:
        places = np.flatnonzero(ids == t)
        assert s.count(t) == len(places)
        lo, hi = n // 3, n // 2
        assert s.count(t, lo, hi) == ((places >= lo) & (places < hi)).sum()
        for k in {0, len(places) // 2, len(places) - 1}:
            if 0 <= k < len(places):
                assert s.select(t, k) == places[k]
        if len(places) < 50:
            assert s.occurrences(t) == places.tolist()
    with pytest.raises(IndexError):
        s.access(n)
    with pytest.raises(IndexError):
        s.select(0, n + 1)


def test_pieces_are_encoded_as_whole_texts_are(spark, sf):
    tool = Tokenizer.from_file(FILE)
    texts = ["", " ", "It's  DON'T\tstop\x1cnow", "a\u00a0b\u2003c", "ΟΔΟΣ İstanbul ǅ ﬁ", "e\u0301 \u0301x", "<|endoftext|> x<|startoftext|>y", "日本 語\U0001f600", "a\0b", "x" * 5000, "'ll 'S we'VE", "a's'tx'' 'll1st2 $$$a,b;", "x\x7fy a\x01b", "a<|b|>c <|endoftext|>"]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [np.array(tool.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    tool = wavelet.Encoder(FILE)
    assert [tool.encode(t) for t in texts] == want


def test_plain_texts_are_cut_as_the_tokenizer_cuts_them():
    tool, whole, rng = Tokenizer.from_file(FILE), wavelet.Encoder(FILE), random.Random(4)
    signs = [chr(c) for c in (*range(9, 14), *range(32, 127), *range(0xC0, 0x100))] + ["'s", "'LL", "é", "ß", "12", "the "] * 4
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(whole.encode(t), "<u4").tolist() == tool.encode(t, add_special_tokens=False).ids, t


def brute(rows):
    tool, at, out = Tokenizer.from_file(FILE), 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tool.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=str)


@pytest.mark.parametrize("shard", [500, 1 << 20])
def test_round_trip_of_documents(spark, sf, shard):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(wavelet.round_trip(docs, FILE, shard=shard)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows_and_empty(spark):
    assert got(wavelet.round_trip(odd(spark), FILE)) == brute([r[:2] for r in ODD])
    assert wavelet.round_trip(empty(spark), FILE).count() == 0


def test_a_file_with_another_cut_is_taken_as_it_is(spark):
    file = tokenizer_file("byte_bpe_50k.json")
    tool, own = Tokenizer.from_file(file), wavelet.Encoder(file)
    for t in ["It's  DON'T\tstop", "Straße 12", " a  b ", "日本 語\U0001f600", ""]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == tool.encode(t, add_special_tokens=False).ids


def test_parts_grow_with_the_bytes_and_repeated_ids_are_divided(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(wavelet, "PART", 4000)
    df = spark.createDataFrame([(7 if i % 2 else None, f"text {i} " + "word " * 20) for i in range(400)], "doc_id long, text string")
    wavelet.write_shards(df, FILE, f"{tmp_path}/w")
    parts = spark.read.parquet(f"{tmp_path}/w").groupBy("part").agg({"n_docs": "sum"}).collect()
    assert len(parts) > 8 and max(r[1] for r in parts) < 120 and sum(r[1] for r in parts) == 400
    out = wavelet.read_documents(spark, f"{tmp_path}/w").orderBy("start").collect()
    assert [r.doc_id for r in out] == [None] * 200 + [7] * 200
    assert [r.start for r in out] == [sum(x.n_tokens for x in out[:i]) for i in range(400)]
