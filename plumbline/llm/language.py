"""Language identification by compression.

Each language has a zstandard raw-content dictionary. A text is compressed with each,
and the language of the smallest result is the prediction. The score is how much
smaller that is than the next, as a share of the next; predictions of a narrow margin
are marked as rejected. Ties go to the language with more documents to learn from.

Learning takes a bounded sample: of each label the SAMPLE documents of the smallest keyed
hash, at most SLICE characters of each, DICTIONARY bytes in all. Every label is learned:
dictionaries are joined where their documents are, and where there are so many labels that
they would exceed BUDGET bytes together, each has an equal share of it. Texts are compressed
whole. Case and all that is no letter is levelled first, so symbols and numbers don't vote.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is
every text if nothing was learned; with one language learned the score is 1; null
labels teach nothing; repeated rows are predicted alike; a null id is not held out; an
empty table gives an empty result; a carried column that has a result's name gets the
suffix _carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.llm.common import carried

SAMPLE = 400
SLICE = 2000
DICTIONARY = 110_000
#: Bytes of all dictionaries together.
BUDGET = 64_000_000
#: Documents whose hashes are looked at before the smallest are taken, as a multiple of SAMPLE.
MARGIN = 4
#: Margins below this share of the runner-up's size are narrow.
NARROW = 0.03
UND = "und"
NO_LETTER = re.compile(r"[\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def levelled(text: str) -> bytes:
    """Lower case, with a space for what is no letter; empty if there is no letter."""
    out = NO_LETTER.sub(" ", text.lower()).strip()
    return out.encode() if any(map(str.isalpha, out)) else b""


def learn(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, bytes]]:
    """Dictionaries by language, those with more documents first. BUDGET bytes, and a
    count for each label, reach the driver."""
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = known.select(F.col(lang).cast("string").alias("l"), F.xxhash64(F.col(doc_id).cast("string"), F.lit("lang")).alias("h"), F.substring(F.col(text), 1, SLICE).alias("t"))
    sizes = {r.l: r["count"] for r in rows.groupBy("l").count().collect()}
    if not sizes:
        return []
    most = min(DICTIONARY, BUDGET // len(sizes))

    def below(limits: dict[str, int]) -> DataFrame:
        # A row for each label.
        table = labelled.sparkSession.createDataFrame(list(limits.items()), "l string, most long")
        return rows.join(F.broadcast(table), "l").where(F.col("h") <= F.col("most"))

    # Of a common language only hashes below a limit that leaves enough of them are dealt out.
    limits = {k: int(-(2**63) + min(1.0, MARGIN * SAMPLE / n) * (2**64 - 1025)) for k, n in sizes.items()}
    enough = {r.l: r["count"] for r in below(limits).groupBy("l").count().collect()}
    # Repeated ids share a hash, so a limit may leave too few; then all take part.
    limits = {k: m if enough.get(k, 0) >= min(SAMPLE, sizes[k]) else 2**63 - 1 for k, m in limits.items()}
    order = Window.partitionBy("l").orderBy("h", "t")
    found = below(limits).withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE)

    def join(group: pa.Table) -> pa.Table:
        texts = group.sort_by("n").column("t").to_pylist()
        content = b"\n".join(x for x in map(levelled, texts) if x)[:most]
        return pa.table({"l": group.column("l").slice(0, 1).cast(pa.string()), "content": pa.array([content], pa.binary())})

    # SAMPLE rows of a label at most.
    joined = [(r.l, bytes(r.content)) for r in found.groupBy("l").applyInArrow(join, "l string, content binary").collect()]
    return sorted((x for x in joined if x[1]), key=lambda x: (-sizes[x[0]], x[0]))


class Classifier:
    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        import zstandard

        self.names = [k for k, _ in dictionaries]
        self.tools = []
        for _, content in dictionaries:
            how = zstandard.ZstdCompressionParameters(
                strategy=zstandard.STRATEGY_GREEDY, min_match=4, window_log=18, hash_log=17, chain_log=17, search_log=4,
                write_content_size=0, write_checksum=0, write_dict_id=0,
            )
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(compression_params=how)
            self.tools.append(zstandard.ZstdCompressor(dict_data=made, compression_params=how))

    def predict(self, text: str | None) -> tuple[str, float]:
        body = levelled(text) if text else b""
        if not body or not self.tools:
            return UND, 0.0
        sizes = [len(t.compress(body)) for t in self.tools]
        best = int(np.argmin(sizes))
        rest = [s for i, s in enumerate(sizes) if i != best]
        return self.names[best], (min(rest) - sizes[best]) / min(rest) if rest else 1.0


def predict(docs: DataFrame, dictionaries: list[tuple[str, bytes]], text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The columns named in carry, lang_pred, score and rejected."""
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *carry).alias("_row"), F.col(text).cast("string").alias("_text"))
    rows = rows.select("_text", *carried("_row", carry, [f.name for f in made]))
    schema = T.StructType(rows.schema.fields[1:] + made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries)
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column(0)]
            cols = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *cols, pa.array([x[1] < NARROW for x in found])], names=schema.names)

    return rows.mapInArrow(run, schema)
