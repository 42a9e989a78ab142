"""Token ids in wavelet matrix files.

A shard holds the ids of documents in ascending order of id. Its file is one blob: a
header, document ids and lengths, and a wavelet matrix: one plane of bits for each
bit of the ids, with the ids stably partitioned by that bit before the next plane.
Planes are kept in zstandard blocks with a table of offsets, and with counts of ones
before every 512 bits, so that access, rank, count and the places of a token read
few blocks. Each shard is a Parquet file of its own in the shared folder, written by
Spark, so that commits, retries and remote stores are Spark's matter.

A text's ids are those of its pieces between ASCII white space, which the tokenizer's
own splitting never crosses; words and pieces are encoded once for each task and kept.
Documents are dealt into ranges of about PART bytes of text, so tasks stay of one size.

Defined results: a null text is empty and has the end id only; null ids come first;
rows of equal ids are ordered by a hash of their texts; very long texts are one document
of one shard; an empty table writes no shard; other columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.llm.common import shared_dir

END_ID = 2
#: Tokens in a shard, about; bytes of a plane in a compressed block; words kept in a task; bytes of text of a part, about.
SHARD, BLOCK, CACHED, PART = 1 << 20, 1 << 14, 600_000, 1 << 27
MAGIC = b"WMX1"
SPACE = " \t\n\v\f\r"
PLAIN = re.compile("[\t-\r -~\u00c0-\u00ff]*")
#: The tokenizer's own normalizer and cut, and what they come to on such texts once in lower case.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
PARTS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\sa-z\u00df-\u00f6\u00f8-\u00ff0-9]+", re.ASCII)
#: Byte-level vocabularies write a byte as its Latin-1 character if that can be seen, else as one from U+0100 on.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_SIGNS = {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)) - set(_SEEN)))}
_HEAD = "<4sIQII"  # magic, planes, tokens, documents, blocks of a plane


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The file of one shard."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    ids = np.ascontiguousarray(ids, np.uint32)
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    cur = ids.astype(np.uint16) if planes <= 16 else ids
    blocks = -(-(-(-len(ids) // 8)) // BLOCK)
    zeros, ranks, sizes, data = [], [], [], []
    for p in range(planes - 1, -1, -1):
        bit = (cur >> cur.dtype.type(p) & cur.dtype.type(1)).astype(bool)
        raw = np.packbits(bit, bitorder="little")
        whole = np.zeros(-(-len(raw) // 64) * 64, np.uint8)
        whole[: len(raw)] = raw
        ones = np.bitwise_count(whole.view(np.uint64)).reshape(-1, 8).sum(axis=1, dtype=np.uint32)
        ranks.append(np.concatenate(([0], np.cumsum(ones))).astype(np.uint32))
        zeros.append(len(cur) - int(bit.sum()))
        for k in range(blocks):
            data.append(pack(raw[k * BLOCK : (k + 1) * BLOCK].tobytes()))
            sizes.append(len(data[-1]))
        cur = np.concatenate((cur.compress(~bit), cur.compress(bit)))
    known = np.array([d is not None for d in doc_ids], np.uint8)
    named = np.array([d or 0 for d in doc_ids], np.int64)
    side = [pack(x.tobytes()) for x in (known, named, np.asarray(lengths, np.int64), np.array(zeros, np.int64), np.array(sizes, np.uint32), np.array(ranks, np.uint32))]
    head = struct.pack(_HEAD, MAGIC, planes, len(ids), len(doc_ids), blocks) + struct.pack("<6Q", *map(len, side))
    return b"".join((head, *side, *data))


class Shard:
    """Reads a shard's file. Planes are read by block, when asked for."""

    def __init__(self, blob: bytes):
        import zstandard

        self._unpack = zstandard.ZstdDecompressor().decompress
        magic, self.planes, self.n, docs, self.blocks = struct.unpack_from(_HEAD, blob)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        sizes = struct.unpack_from("<6Q", blob, struct.calcsize(_HEAD))
        at, side = struct.calcsize(_HEAD) + 48, []
        for s in sizes:
            side.append(self._unpack(blob[at : at + s]))
            at += s
        known = np.frombuffer(side[0], np.uint8)
        self.doc_ids = [int(d) if k else None for k, d in zip(known, np.frombuffer(side[1], np.int64))]
        self.lengths = np.frombuffer(side[2], np.int64)
        self.zeros = np.frombuffer(side[3], np.int64).tolist()
        each = np.frombuffer(side[4], np.uint32).astype(np.int64)
        self._at = at + np.concatenate(([0], np.cumsum(each)))
        self._ranks = np.frombuffer(side[5], np.uint32).reshape(self.planes, -1)
        self._blob, self._blocks = blob, {}

    def _block(self, plane: int, k: int) -> np.ndarray:
        i = plane * self.blocks + k
        if i not in self._blocks:
            self._blocks[i] = np.frombuffer(self._unpack(self._blob[self._at[i] : self._at[i + 1]]), np.uint8)
        return self._blocks[i]

    def _plane(self, plane: int) -> np.ndarray:
        raw = [self._unpack(self._blob[self._at[i] : self._at[i + 1]]) for i in range(plane * self.blocks, (plane + 1) * self.blocks)]
        return np.unpackbits(np.frombuffer(b"".join(raw), np.uint8), count=self.n, bitorder="little").view(bool)

    def _bit(self, plane: int, i: int) -> int:
        return int(self._block(plane, i // 8 // BLOCK)[i // 8 % BLOCK]) >> (i % 8) & 1

    def rank1(self, plane: int, i: int) -> int:
        """Ones before position i of a plane."""
        from_byte, ones = i // 512 * 64, int(self._ranks[plane, i // 512])
        if i % 512 == 0:
            return ones
        part = self._block(plane, from_byte // BLOCK)[from_byte % BLOCK : from_byte % BLOCK + -(-(i % 512) // 8)].copy()
        if i % 8:
            part[-1] &= (1 << i % 8) - 1
        return ones + int(np.bitwise_count(part).sum())

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for p in range(self.planes):
            b, ones = self._bit(p, i), self.rank1(p, i)
            out = out << 1 | b
            i = self.zeros[p] + ones if b else i - ones
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> self.planes:
            return 0, 0
        for p in range(self.planes):
            a, b = self.rank1(p, lo), self.rank1(p, hi)
            one = token >> (self.planes - 1 - p) & 1
            lo, hi = (self.zeros[p] + a, self.zeros[p] + b) if one else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often a token stands in places lo to hi."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def _select(self, plane: int, one: int, k: int) -> int:
        """The place of the k-th (from 0) one or zero of a plane, by bisection over ranks."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self.rank1(plane, mid + 1)
            if (ones if one else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def select(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of a token."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for p in range(self.planes - 1, -1, -1):
            one = token >> (self.planes - 1 - p) & 1
            i = self._select(p, one, i - self.zeros[p] if one else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def ids(self) -> np.ndarray:
        """All tokens, from the last plane back to the first."""
        out = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for p in range(self.planes - 1, -1, -1):
            bit, z = self._plane(p), self.zeros[p]
            out[z:] |= out.dtype.type(1 << (self.planes - 1 - p))
            back = np.empty_like(out)
            back[np.flatnonzero(~bit)], back[np.flatnonzero(bit)] = out[:z], out[z:]
            out = back
        return out.astype(np.uint32)


class _Words(dict):
    """Ids of words as bytes. A word is sent through the model's merges when it is first met."""

    def __init__(self, model):
        self.model = model

    def __missing__(self, word: str) -> bytes:
        seen = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_SIGNS)
        ids = self[word] = array("I", [t.id for t in self.model.tokenize(seen)]).tobytes()
        return ids


class _Pieces(dict):
    """The same for pieces between white space, by the whole tokenizer."""

    def __init__(self, tool):
        self.tool = tool

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = array("I", self.tool.encode(piece, add_special_tokens=False).ids).tobytes()
        return ids


class Encoder:
    """Ids of texts as bytes of little-endian unsigned 32-bit integers.

    Pieces between ASCII white space go through the tokenizer, once for each task. Where
    the file's own normalizer and cut are NORMALIZER and CUT, they come to lower case and
    PARTS for texts of ASCII and the letters of Latin-1, so there only what the cut leaves,
    the words, goes through the tokenizer's model. With another file texts go through the
    tokenizer as they are."""

    def __init__(self, file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tool = Tokenizer.from_file(file)
        self.words, self.pieces = _Words(tool.model), _Pieces(tool)
        spec = json.loads(tool.to_str())
        self.known = spec["normalizer"] == NORMALIZER and ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [None])[0] == CUT
        self.tool = tool

    def encode(self, text: str) -> bytes:
        if not self.known:
            return array("I", self.tool.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.words) + len(self.pieces) > CACHED:
            self.words.clear(), self.pieces.clear()
        if PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.words.__getitem__, PARTS.findall(text.lower())))
        for c in SPACE[1:]:
            text = text.replace(c, " ")
        return b"".join(map(self.pieces.__getitem__, filter(None, text.split(" "))))


def write_shards(docs: DataFrame, file: str, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, shard: int = SHARD) -> None:
    """Writes the shards of all documents under path, one Parquet file each: part and
    seq (their order), n_docs, n_tokens, blob."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # Few and long tasks at small sizes, as each meets most words once; beyond, parts of PART bytes.
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4, -(-held // PART))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, seq = Encoder(file), TaskContext.get().partitionId(), 0
        ids, body, sizes, held = [], [], [], 0
        end = np.array([end_id], "<u4").tobytes()

        def flush() -> pa.RecordBatch:
            nonlocal seq, held
            blob = build(np.frombuffer(b"".join(body), "<u4"), ids, np.array(sizes))
            row = [pa.array([x], t) for x, t in ((part, pa.int32()), (seq, pa.int32()), (len(ids), pa.int64()), (held, pa.int64()), (blob, pa.binary()))]
            seq, held = seq + 1, 0
            ids.clear(), body.clear(), sizes.clear()
            return pa.RecordBatch.from_arrays(row, names=["part", "seq", "n_docs", "n_tokens", "blob"])

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = tool.encode(t or "")
                ids.append(d), body.append(x + end), sizes.append(len(x) // 4 + 1)
                held += sizes[-1]
                if held >= shard:
                    yield flush()
        if ids:
            yield flush()

    # Null and repeated ids are divided by the hash.
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash").asc_nulls_first()]
    rows = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    made = rows.select("doc_id", "text").mapInArrow(run, "part int, seq int, n_docs long, n_tokens long, blob binary")
    made.write.option("maxRecordsPerFile", 1).mode("overwrite").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """From the shards: doc_id, start, n_tokens, ids_crc32 for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, blob in zip(*(c.to_pylist() for c in b.columns)):
                s = Shard(blob)
                flat = s.ids().astype("<u4")
                ends = np.cumsum(s.lengths)
                starts = ends - s.lengths
                crc = [zlib.crc32(flat[a:z]) for a, z in zip(starts.tolist(), ends.tolist())]
                n = len(s.doc_ids)
                cols = [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(s.doc_ids, pa.int64()), pa.array(starts), pa.array(s.lengths), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])

    shards = spark.read.schema("part int, seq int, n_docs long, n_tokens long, blob binary").parquet(path)
    docs = shards.select("part", "seq", "blob").mapInArrow(run, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")
    # Starts: a running sum over shards within their part, and one over the parts, of which there are few.
    sizes = shards.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    within = sizes.select("part", "seq", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("before"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    starts = within.join(parts, "part").select("part", "seq", (F.col("base") + F.col("before")).alias("base"))
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, file: str, **how) -> DataFrame:
    """Writes the shards to the shared folder and reads the documents back."""
    import uuid

    path = f"{shared_dir(docs.sparkSession)}/wavelet-{uuid.uuid4().hex}"
    write_shards(docs, file, path, **how)
    return read_documents(docs.sparkSession, path)
