import corpus_pipeline as P
from plumbline.llm import sentencepiece_dropout as S
from plumbline.llm.common import tokenizer_file
from tests.llm.helpers import ODD, empty, odd


def test_stages_take_effect_and_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = {}
    for name, stage in P.STAGES:
        out = P.written(stage(spark, docs, sf), "test")
        at[name] = (docs, out)
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns and out.schema == docs.schema
        docs = out
    before, after = at["quality rules"]
    assert 0 < after.count() < before.count()
    before, after = at["SimHash near-dedup"]
    assert after.count() == after.select("doc_id").distinct().count() <= before.count()
    before, after = at["PII"]
    assert after.count() == before.count()
    assert after.where("text like '%@mail%.example.com%'").count() == 0
    before, after = at["mixing sources to target weights"]
    assert after.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3
    before, after = at["SentencePiece encoding and decoding"]
    pieces = S.Pieces(tokenizer_file("piece_bpe_32k.model"))
    texts = sorted(r.text for r in before.collect())
    assert sorted(S.decode(pieces, r.ids) for r in after.collect()) == texts
    assert P.run(spark, sf).count() == len(texts)


def test_stages_on_odd_and_empty_tables(spark):
    """Null ids, texts and sources, repeated rows, very long texts and clashing names, through every stage."""
    for docs, least in ((odd(spark), 1), (empty(spark), 0)):
        for name, stage in P.STAGES:
            rows = stage(spark, docs, "")
            if name == P.STAGES[-1][0]:
                assert set(rows.columns) == {"doc_id", "lang", "source", "ids", "n_tokens", "lossless"} and all(r.lossless for r in rows.collect())
            else:
                assert rows.columns == docs.columns and rows.schema.simpleString() == docs.schema.simpleString()
            docs = P.written(rows, "odd")
            assert docs.count() >= least, name
    assert P.quality_rules(spark, odd(spark), "").count() == 4
    kept = sorted(P.near_duplicates(spark, odd(spark), "").select("doc_id").collect(), key=str)
    assert len(kept) == len({(r[1] or "").lower().split().__str__() for r in ODD})
