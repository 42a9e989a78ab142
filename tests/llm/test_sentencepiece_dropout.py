import random

import pytest
import sentencepiece

from plumbline.llm import sentencepiece_dropout as S
from plumbline.llm.common import tokenizer_file
from tests.llm.helpers import ODD, empty, odd

MODEL = tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return S.Pieces(MODEL)


TEXTS = ["", " ", "   ", "  a  b\n\tc ", "ﬁ é x", "日本 \U0001f600", "a\0b", "<s>x</s>", "e" * 3000, "日本" * 3000, "<0x41>", "Größe über"]


def test_without_dropout_it_is_the_library(pieces, spark, sf):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = S.encode_many(pieces, texts, [0] * len(texts), 1, 0.0, [])
    assert [x.tolist() for x in got] == sp.encode(texts)


@pytest.mark.parametrize("rate", [0.1, 0.5, 1.0])
def test_dropout_varies_and_is_lossless(pieces, rate):
    texts = [*TEXTS, "a▁b ▁", "\U0010ffff" * 5 + " the end"]
    a, again, b = (S.encode_many(pieces, texts, list(range(len(texts))), seed, rate, []) for seed in (1, 1, 2))
    assert [x.tolist() for x in a] == [x.tolist() for x in again]
    for x in (*a, *b):
        assert S.decode(pieces, x.tolist()) == texts[([*map(id, a), *map(id, b)].index(id(x))) % len(texts)]
    if rate < 1:
        assert any(x.tolist() != y.tolist() for x, y in zip(a, b))


def test_rounds_equal_the_heap(pieces):
    """The agenda over arrays and the plain heap of one word agree, with and without dropout."""
    rng = random.Random(1)
    words = ["▁" + "".join(rng.choice("theinarost日é▁") for _ in range(rng.randint(0, 40))) for _ in range(800)]
    for rate in (0.0, 0.1, 0.5, 1.0):
        for v in range(3):
            assert S.encode_words(pieces, words, v, 7, rate) == [S.encode_long(pieces, w, v, 7, rate) for w in words]


def test_skipping_is_as_often_as_the_rate(pieces):
    words = [f"▁{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(676)]
    one = [i for i, x in enumerate(S.encode_words(pieces, words, 0, 1, 0.0)) if len(x) == 4]
    kept = sum(len(x[i]) < 12 for v in range(20) for x in [S.encode_words(pieces, words, v, 1, 0.5)] for i in one)
    assert 0.5 < kept / (20 * len(one)) < 0.95


def test_odd_rows_and_empty(spark):
    out = S.encode(odd(spark), MODEL, carry=("doc_id", "kept"))
    rows = out.collect()
    assert len(rows) == len(ODD) and all(r.lossless and r.n_tokens == len(r.ids) for r in rows)
    assert sorted(r.n_tokens for r in rows)[:2] == [0, 0]
    assert S.encode(empty(spark), MODEL, carry=("doc_id",)).count() == 0


def test_each_word_of_a_text_draws_its_own(pieces):
    """Variety grows with the text, and is that of the heap with the word's own key."""
    texts = ["international understanding " * 400, "the same passage of words " * 20, "x" * 50 + " naïve ▁ 日本\ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16")]
    for rate in (0.1, 0.5, 1.0):
        got = S.encode_many(pieces, texts, [5, -6, 7], 3, rate, [])
        for t, d, ids in zip(texts, [5, -6, 7], got):
            w = S.split_words(t)
            each = [S.encode_long(pieces, x, 0, 3, rate, int(k)) for x, k in zip(w, S.word_salts(d, 3, len(w)))]
            assert ids.tobytes() == b"".join(each)
            if rate == 0.1 and t is texts[0]:
                assert len(set(each)) > 8
    passage = "a passage of words that returns in many of the documents"
    first = {S.encode_many(pieces, [passage], [d], 3, 0.1, [])[0].tobytes() for d in range(64)}
    assert len(first) > 30


def test_copies_of_a_text_have_their_own_ids(spark):
    text = "the copies of a document are segmented each in another way " * 5
    docs = spark.createDataFrame([(1, text)] * 3 + [(2, text), (None, text)], "doc_id long, text string")
    alike = S.encode(docs, MODEL, carry=("doc_id",)).where("doc_id = 1")
    assert alike.select("ids").distinct().count() == 1
    out = S.encode(docs, MODEL, carry=("doc_id",), copies=True)
    again = S.encode(docs.repartition(3), MODEL, carry=("doc_id",), copies=True)
    rows = [tuple(r.ids) for r in out.collect()]
    assert len(set(rows)) == len(rows) == 5 and sorted(rows) == sorted(tuple(r.ids) for r in again.collect())
    assert out.where("lossless").count() == 5


def test_a_passage_varies_with_the_documents(pieces):
    passage = "a passage of words that returns in many of the documents"
    got = S.encode_many(pieces, [passage] * 64, [i * 7919 for i in range(64)], 3, 0.1, [])
    assert len({x.tobytes() for x in got}) > 30
