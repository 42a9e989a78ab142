"""SentencePiece BPE with seeded merge dropout, and lossless decoding.

A text is encoded by the merges of a SentencePiece BPE model: of all neighbouring
symbols whose union is a piece, the pair of the best score (of equals, the leftmost)
is merged, until none is left. With dropout, a candidate merge is skipped for good if
a keyed hash of (seed, document, copy, ordinal of the word in the text, place of the
left symbol, piece) falls below the rate, so each word of each text draws its own. The
choice needs no generator state: it is the same on a retry, on another executor and in
any order, and other seeds give other segmentations of a text.

Words are those pieces of a text that no merge can cross (a run of meta spaces and what
follows it). What a word becomes without dropout is kept for the task, with the merges
made; only where a choice skips one of these is the word encoded anew, by its own
choices: other skipped candidates would not have been merged anyway.

The agenda runs over many words at once: in each round every word merges its best
live candidate, as arrays; words of over LONG characters have a heap of their own.

Symbols that are no piece become byte pieces; decoding joins the pieces and takes
off the first meta space, so it gives the text back, whatever was skipped. Where a
text has the meta space sign U+2581 itself, it is encoded as its bytes (the library
reads it back as a space).

Defined results: a null or empty text has no ids and decodes to the empty text; very
long texts are encoded in whole; rows that repeat are encoded alike, unless they are
told apart by the number of their copy; an empty table gives an empty result; a carried
column that has a result's name gets the suffix _carried.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.functions.batches import parts
from plumbline.llm.common import carried

META = "▁"
#: Stands for that sign where it is part of a text: no text has a lone surrogate.
_LITERAL = "\ud800"
LONG = 40
DROPOUT = 0.1
SEED = 20240
#: Rows handled at once, and bytes of their texts; words kept in a task; words whose choices are
#: drawn, and encoded, at once.
ROWS, BYTES, CACHED, DRAWN, AGENDA = 64, 1 << 18, 400_000, 1 << 16, 1 << 13
_NONE = np.int64(1 << 40)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Pieces:
    """The model's pieces, and a table of merges: a pair of symbols to their union."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.text) if sp.is_byte(i)}
        self.bytes_of = [p.replace(META, " ").encode() for p in self.text]
        for b, i in self.byte_id.items():
            self.bytes_of[i] = bytes([b])
        ids = {p: i for i, p in enumerate(self.text) if not special[i]}
        self.ids = ids
        # Characters that are only parts of pieces get symbols after the last piece.
        self.symbol = {}
        order = sorted(ids.values(), key=lambda i: (-sp.get_score(i), i))
        self.rank = np.full(n, _NONE)
        self.rank[order] = np.arange(len(order))
        self.base = n
        left, right, made = [], [], []
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                a = self._char(p[:k]) if a is None and k == 1 else a
                b = self._char(p[k:]) if b is None and len(p) == k + 1 else b
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i)
        # Of each code point the symbol, or -1.
        self.symbol_of = np.full(0x110000, -1, np.int64)
        for c, i in [*((p, i) for p, i in ids.items() if len(p) == 1), *self.symbol.items()]:
            self.symbol_of[ord(c)] = i
        key = np.array(left, np.int64) * _WIDE + np.array(right, np.int64)
        at = np.argsort(key)
        self.key, self.made = key[at], np.array(made, np.int64)[at]
        self.pairs = dict(zip(self.key.tolist(), self.made.tolist()))
        # An open-addressing table over the keys, for arrays.
        self.mask = np.uint64((1 << 20) - 1)
        self.slot = np.full(1 << 20, -1, np.int64)
        for i, h in enumerate((mix(self.key.astype(np.uint64)) & self.mask).tolist()):
            while self.slot[h] >= 0:
                h = (h + 1) & ((1 << 20) - 1)
            self.slot[h] = i

    def _char(self, c: str) -> int:
        got = self.ids.get(c)
        return got if got is not None else self.symbol.setdefault(c, self.base + len(self.symbol))

    def in_bytes(self, char: str) -> list[int]:
        return [self.byte_id[b] for b in (META if char == _LITERAL else char).encode()]

    def union(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        key = a * _WIDE + b
        h = mix(key.astype(np.uint64)) & self.mask
        out = np.full(len(key), -1, np.int64)
        todo = np.arange(len(key))
        while len(todo):
            s = self.slot[h[todo]]
            full = s >= 0
            todo, s = todo.compress(full), s.compress(full)
            hit = self.key[s] == key[todo]
            out[todo.compress(hit)] = self.made[s.compress(hit)]
            todo = todo.compress(~hit)
            h[todo] = (h[todo] + np.uint64(1)) & self.mask
        return out


_WIDE = np.int64(1 << 24)
_GONE = -2


def _mix1(x: int) -> int:
    """mix() of one integer."""
    full = (1 << 64) - 1
    x = (x ^ x >> 30) * int(_M1) & full
    x = (x ^ x >> 27) * int(_M2) & full
    return x ^ x >> 31


def word_hashes(code: np.ndarray, place: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes of words from their code points and places; first: where each word begins."""
    return np.add.reduceat(mix(code.astype(np.uint64) | place.astype(np.uint64) << np.uint64(21)), first)


def encode_words(
    pieces: Pieces, words: list[str], variant: int, seed: int, rate: float, salts: np.ndarray | None = None, merges: list | None = None
) -> list[bytes]:
    """Ids of each word as bytes of 32-bit integers. The agenda of all words, in rounds.
    salts: what the choices of each word are keyed by, in place of the word, variant and
    seed. merges: gets arrays of the words and of the merges made in them."""
    if not words:
        return []
    sizes = np.array([*map(len, words)])
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = pieces.symbol_of[code]
    word = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)
    first = ends - sizes
    place = np.arange(len(code)) - first[word]
    salt = mix(word_hashes(code, place, first) ^ np.uint64(_mix1(variant + (seed << 8)))) if salts is None else salts
    limit = np.uint64(min(int(rate * 2**64), 2**64 - 1))

    def candidates(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Merged piece of the symbols at i and j; -1 if there is none or it is skipped."""
        a, b = sym[i], sym[j]
        made = np.full(len(i), -1, np.int64)
        ok = np.flatnonzero((a >= 0) & (b >= 0))
        made[ok] = pieces.union(a[ok], b[ok])
        if rate > 0:
            ok = np.flatnonzero(made >= 0)
            key = mix(salt[word[i[ok]]] + np.uint64(0x9E3779B97F4A7C15) * (place[i[ok]].astype(np.uint64) << np.uint64(20) | made[ok].astype(np.uint64)))
            made[ok[key < limit]] = -1
        return made

    n = len(code)
    nxt = np.arange(1, n + 1)
    nxt[ends - 1] = -1
    prv = np.arange(-1, n - 1)
    prv[first] = -1
    made = np.full(n, -1, np.int64)
    pair = np.flatnonzero(nxt >= 0)
    made[pair] = candidates(pair, nxt[pair])
    cand = pair.compress(made[pair] >= 0)
    alive = np.ones(n, bool)
    while len(cand):
        # The best candidate of each word: smallest rank, then leftmost. cand ascends, so words do.
        rank = pieces.rank[made[cand]]
        w = word[cand]
        starts = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        key = rank << np.int64(24) | np.minimum(place[cand], (1 << 24) - 1)
        best = np.minimum.reduceat(key, starts)
        i = cand.compress(key == np.repeat(best, np.diff(np.append(starts, len(cand)))))
        j = nxt[i]
        if merges is not None:
            merges.append((word[i], place[i] << 20 | made[i]))
        sym[i] = made[i]
        alive[j] = False
        made[j] = -1
        nxt[i] = nxt[j]
        ok = nxt[i] >= 0
        prv[nxt[i[ok]]] = i[ok]
        made[i] = -1
        made[i[ok]] = candidates(i[ok], nxt[i[ok]])
        p = prv[i]
        q = p >= 0
        made[p[q]] = candidates(p[q], i[q])
        cand = np.flatnonzero(made >= 0)
    keep = np.flatnonzero(alive)
    ids, of = sym[keep], word[keep]
    bad = np.flatnonzero((ids < 0) | (ids >= pieces.base))
    if len(bad):  # characters without a piece: their bytes
        kinds, kind = np.unique(code[keep[bad]], return_inverse=True)
        spelt = [pieces.in_bytes(chr(c)) for c in kinds.tolist()]
        size = np.array([*map(len, spelt)])[kind]
        times = np.ones(len(ids), np.int64)
        times[bad] = size
        at = (np.cumsum(times) - times)[bad]
        ids, of = np.repeat(ids, times), np.repeat(of, times)
        for j in range(int(size.max())):
            has = np.flatnonzero(size > j)
            ids[at[has] + j] = np.array([x[j] if len(x) > j else 0 for x in spelt])[kind[has]]
    cuts = (4 * np.searchsorted(of, np.arange(len(words) + 1))).tolist()
    flat = ids.astype(np.int32).tobytes()
    return [flat[a:b] for a, b in zip(cuts, cuts[1:])]


def encode_long(pieces: Pieces, word: str, variant: int, seed: int, rate: float, salt: int | None = None) -> bytes:
    """The same for one word, with a heap: n log n in its length. salt: what the choices
    are keyed by, in place of the word, variant and seed."""
    char = {c: pieces.ids.get(c, pieces.symbol.get(c, -1)) for c in set(word)}
    sym = [char[c] for c in word]
    n = len(sym)
    nxt, prv = [*range(1, n), -1], list(range(-1, n - 1))
    full = (1 << 64) - 1
    code = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
    if salt is None:
        salt = _mix1(int(word_hashes(code, np.arange(n), np.array([0]))[0]) ^ _mix1(variant + (seed << 8)))
    limit = min(int(rate * 2**64), full)
    heap: list[tuple[int, int, int, int, int]] = []

    def push(i: int, j: int) -> None:
        if i < 0 or j < 0 or sym[i] < 0 or sym[j] < 0:
            return
        made = pieces.pairs.get(sym[i] * int(_WIDE) + sym[j])
        if made is not None and (rate <= 0 or _mix1(salt + 0x9E3779B97F4A7C15 * (i << 20 | made) & full) >= limit):
            heapq.heappush(heap, (int(pieces.rank[made]), i, sym[i], sym[j], made))

    for i in range(n - 1):
        push(i, i + 1)
    while heap:
        _, i, a, b, made = heapq.heappop(heap)
        j = nxt[i]
        if sym[i] != a or j < 0 or sym[j] != b:
            continue
        sym[i], sym[j], nxt[i] = made, _GONE, nxt[j]
        if nxt[i] >= 0:
            prv[nxt[i]] = i
        push(prv[i], i)
        push(i, nxt[i])
    out: list[int] = []
    i = 0
    while i >= 0:
        out += [sym[i]] if 0 <= sym[i] < pieces.base else pieces.in_bytes(word[i])
        i = nxt[i]
    return np.array(out, np.int32).tobytes()


def split_words(text: str) -> list[str]:
    """A word is what stands between spaces, with the spaces before it as meta spaces."""
    parts = text.replace(META, _LITERAL).split(" ")
    if "" not in parts:
        return [META + p for p in parts]
    out, lead = [], ""
    for p in parts:
        lead += META
        if p:
            out.append(lead + p)
            lead = ""
    return out + [lead] * bool(lead)


_STEP = np.uint64(0x9E3779B97F4A7C15)


class Known:
    """Words met so far, as they are without dropout: their ids, and the merges made in each."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.size, self.merges = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, pieces: Pieces, words: list[str]) -> None:
        sizes, merges = [self.size], [self.merges]
        for k in range(0, len(words), AGENDA):
            some, made = words[k : k + AGENDA], []
            self.at.update(zip(some, range(len(self.ids), len(self.ids) + len(some))))
            self.ids += encode_words(pieces, some, 0, 0, 0.0, merges=made)
            of, what = (np.concatenate(x) for x in zip(*made)) if made else (np.zeros(0, np.int64),) * 2
            sizes.append(np.bincount(of, minlength=len(some)))
            merges.append(what[np.argsort(of, kind="stable")])
        self.size, self.merges = np.concatenate(sizes), np.concatenate(merges)

    def hit(self, at: np.ndarray, salt: np.ndarray, limit: np.uint64, first: np.ndarray) -> np.ndarray:
        """Which words have a merge that their choices skip. first: where the merges of each known word begin."""
        n = self.size[at]
        of = np.repeat(np.arange(len(at)), n)
        k = np.arange(len(of)) + np.repeat(first[at] - (np.cumsum(n) - n), n)
        skip = mix(salt[of] + _STEP * self.merges[k].astype(np.uint64)) < limit
        out = np.zeros(len(at), bool)
        out[of[skip]] = True
        return out


def word_salts(doc_seed: int, seed: int, n: int) -> np.ndarray:
    """What the choices in each of n words of a text are keyed by."""
    key = np.uint64(_mix1((doc_seed & 0xFFFFFFFFFFFFFFFF) ^ _mix1(seed & 0xFFFFFFFFFFFFFFFF)))
    return mix(key + _STEP * np.arange(1, n + 1, dtype=np.uint64))


def encode_many(pieces: Pieces, texts: list[str | None], doc_seeds: list[int], seed: int, rate: float, kept: list[Known], most: int = CACHED) -> list[np.ndarray]:
    """Ids of each text. kept: empty at first, and kept between calls of one task; begun anew with
    more than so many words."""
    if not kept:
        kept.append(Known())
    known, limit = kept[0], np.uint64(min(max(int(rate * 2**64), 0), 2**64 - 1))
    split = [split_words(t) if t else [] for t in texts]
    words = [x for w in split for x in w]
    salts = np.concatenate([np.zeros(0, np.uint64), *(word_salts(s, seed, len(w)) for s, w in zip(doc_seeds, split))])
    out: list[bytes] = []
    for a in range(0, len(words), DRAWN):
        if len(known.at) > most:
            known.clear()
        some, salt = words[a : a + DRAWN], salts[a : a + DRAWN]
        get = known.at.get
        at = np.fromiter(map(get, some, repeat(-1)), np.int64, len(some))
        new = np.flatnonzero(at < 0)
        if len(new):
            known.add(pieces, list(dict.fromkeys(x for x in map(some.__getitem__, new.tolist()) if len(x) <= LONG)))
            at[new] = [get(some[i], -1) for i in new.tolist()]
        short = np.flatnonzero(at >= 0)
        # Longer words take any place here, and their own ids below.
        got = list(map((known.ids or [b""]).__getitem__, at.tolist()))
        hit = short[known.hit(at[short], salt[short], limit, np.cumsum(known.size) - known.size)] if rate > 0 else short[:0]
        for k in range(0, len(hit), AGENDA):
            i = hit[k : k + AGENDA]
            for x, y in zip(i.tolist(), encode_words(pieces, [some[j] for j in i.tolist()], 0, seed, rate, salt[i])):
                got[x] = y
        for x in np.flatnonzero(at < 0).tolist():
            got[x] = encode_long(pieces, some[x], 0, seed, rate, int(salt[x]))
        out += got
    ends = np.cumsum([0, *map(len, split)]).tolist()
    return [np.frombuffer(b"".join(out[i:j]), np.int32) for i, j in zip(ends, ends[1:])]


def decode(pieces: Pieces, ids) -> str:
    return b"".join(map(pieces.bytes_of.__getitem__, ids)).decode()[1:]


def encode(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), seed: int = SEED, rate: float = DROPOUT, copies: bool = False, most: int = CACHED) -> DataFrame:
    """The columns named in carry, ids, n_tokens, and lossless: whether decoding the ids gives the text.
    copies: rows of one id and text are copies, numbered so that each has its own choices. most: known
    words kept in a task; fewer take less memory and more time, and give the same."""
    made = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("lossless", T.BooleanType())]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *carry).alias("_row"), F.col(doc_id).cast("string").alias("_id"), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, cache = Pieces(model_file), []
        for b in parts(batches, 1, ROWS, BYTES):
            texts = b.column(1).to_pylist()
            ids = encode_many(pieces, texts, b.column(0).to_pylist(), seed, rate, cache, most)
            ok = [decode(pieces, x.tolist()) == (t or "") for x, t in zip(ids, texts)]
            sizes = np.array([len(x) for x in ids], np.int64)
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), pa.array(np.concatenate(ids), pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[2:], lists, pa.array(sizes), pa.array(ok)], names=schema.names)

    key = F.xxhash64("_id", F.lit(seed))
    if copies:
        # Only copies of one text meet in a window.
        same = Window.partitionBy("_id", F.md5("_text")).orderBy(*(F.col("_row")[c] for c in carry), F.lit(1))
        rows = rows.withColumn("_copy", F.row_number().over(same))
        key = F.when(F.col("_copy") == 1, key).otherwise(F.xxhash64("_id", F.lit(seed), F.col("_copy")))
    rows = rows.select(key.alias("_seed"), "_text", *carried("_row", carry, [f.name for f in made]))
    schema = T.StructType(rows.schema.fields[2:] + made)
    return rows.mapInArrow(run, schema)
