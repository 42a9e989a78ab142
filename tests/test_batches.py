"""Long batches are handled in small parts, and given on part by part."""

import pyarrow as pa
import pytest

from plumbline.functions import batches
from plumbline.plans import catalog


def test_parts_keep_rows_and_order():
    texts = ["a" * n for n in (3, 0, 9, 1, 1, 1, 30)] + [None, "z"]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["id", "text"])
    got = [p.column(1).to_pylist() for p in batches.parts([b, b.slice(0, 0), b.slice(5, 3)], "text", rows=3, size=10)]
    assert [x for p in got for x in p] == texts + texts[5:8] and all(len(p) <= 3 for p in got)
    assert all(len(p) == 1 or sum(len(x or "") for x in p) <= 10 for p in got)


@pytest.mark.parametrize("name", ["basic_chunks", "semantic_chunks", "semantic_chunk_records", "decoded_files"])
def test_a_long_batch_is_not_held_whole(spark, sf, name, monkeypatch):
    steps, real = [], type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, f, schema: steps.append((df, f)) or real(df, f, schema))
    catalog.queries()[name](spark, sf)
    rows, run = steps[-1]
    table = rows.limit(20).toArrow().combine_chunks()
    long = pa.concat_tables([table] * 50).combine_chunks().to_batches()
    assert len(long) == 1 and long[0].num_rows > batches.ROWS
    out = list(run(iter(long)))
    assert len(out) >= long[0].num_rows / batches.ROWS
    once = pa.Table.from_batches(run(iter(table.to_batches())))
    assert sum(b.num_rows for b in out) == 50 * once.num_rows


def test_encoding_holds_few_words_and_gives_the_same(spark, monkeypatch):
    from plumbline.llm import sentencepiece_dropout as spd
    from plumbline.llm.common import tokenizer_file

    pieces = spd.Pieces(tokenizer_file("piece_bpe_32k.model"))
    texts = [" ".join(f"word{i * 7 + j} and{j} more" for j in range(50)) for i in range(40)]
    want = spd.encode_many(pieces, texts, list(range(40)), 1, 0.3, [])
    monkeypatch.setattr(spd, "DRAWN", 64)
    kept, got = [], []
    for i in range(40):
        got += spd.encode_many(pieces, texts[i : i + 1], [i], 1, 0.3, kept, 100)
        assert len(kept[0].at) <= 100 + spd.DRAWN
    assert [x.tolist() for x in got] == [x.tolist() for x in want]


def test_long_texts_are_encoded_a_few_at_a_time(spark, monkeypatch):
    from plumbline.llm import sentencepiece_dropout as spd
    from plumbline.llm.common import tokenizer_file

    steps = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, f, schema: steps.append(f) or df)
    spd.encode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), tokenizer_file("piece_bpe_32k.model"))
    long = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(["word " * 20_000] * 20)], names=["_seed", "_text"])
    monkeypatch.setattr(spd, "encode_many", lambda pieces, texts, *a: [__import__("numpy").zeros(0, "i4")] * len(texts))
    monkeypatch.setattr(spd, "decode", lambda *a: "")
    assert [b.num_rows for b in steps[0](iter([long]))] == [2] * 10
