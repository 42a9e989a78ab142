"""Secret scans: fixed patterns, and random strings found by their token efficiency.

A tokenizer's vocabulary spends few characters on a token where a string is random.
Candidates are long runs of the characters of keys; after known digests and
identifiers are excluded, those of few characters per token are reported, with kind
``random``, unless a base span overlaps them. Runs of letters of one case are tokenised
less well than others in any language, so they are measured more strictly.

Defined results: a null text is empty; texts are scanned whole, in time that is linear
but for the tokenizer's; repeated rows give equal results; an empty table gives an empty
result; a carried column that has a result's name gets the suffix _carried. Offsets are
code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import carried

#: Base patterns; a match passes by the length of what is kept of it.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that are long enough
MIN_ASSIGN, MIN_ACCESS = 12, 18
#: What an assignment has, in lower case.
HINTS = ("passw", "secret", "token", "api")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")
#: Random strings have fewer characters per token than this; prose, words and paths have more.
MAX_RATIO = 2.2
#: The same for runs of one kind of characters, which have so many characters at least.
ONE_KIND_RATIO, ONE_KIND = 1.8, 20
#: Digests by their hex length (md5, sha1, sha224, sha256, sha384, sha512) and identifiers.
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
IDENTIFIER = re.compile(
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"  # UUID
    r"|[0-9_/+-]+"  # numbers, dates, times
    r"|(?:sha(?:1|256|384|512)|md5)-[A-Za-z0-9+/]+={0,2}"  # integrity values
)
KINDS = ("assign", "access", "hex")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def vocabulary(file: str):
    """A tiktoken vocabulary from its file of ranks."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def looks_random(s: str, vocab) -> bool:
    """Few characters per token, and no known form. A capital at the start is no kind of its own."""
    kinds = (any(c.isdigit() for c in s), any(c.islower() for c in s), sum(c.isupper() for c in s) > 1)
    if not any(kinds) or DIGEST.fullmatch(s) or IDENTIFIER.fullmatch(s):
        return False
    if sum(kinds) < 2:
        return len(s) >= ONE_KIND and len(s) < ONE_KIND_RATIO * len(vocab.encode_ordinary(s))
    return len(s) < MAX_RATIO * len(vocab.encode_ordinary(s))


def method_spans(text: str, base: list[tuple[int, int, str]], vocab) -> list[tuple[int, int, str]]:
    out, k, until = [], 0, -1
    for m in CANDIDATE.finditer(text):
        # base goes by starts: until is how far those reach that begin before the candidate ends.
        while k < len(base) and base[k][0] < m.end():
            until, k = max(until, base[k][1]), k + 1
        if until <= m.start() and looks_random(m[0], vocab):
            out.append((m.start(), m.end(), "random"))
    return out


def said(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, file: str, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The columns named in carry, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    made = [T.StructField(f"n_{k}", T.LongType()) for k in (*KINDS, "random")]
    made += [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *carry).alias("_row"), F.col(text).cast("string").alias("_text"))
    rows = rows.select("_text", *carried("_row", carry, [f.name for f in made]))
    schema = T.StructType(rows.schema.fields[1:] + made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(file)
        for b in batches:
            rows = []
            for t in b.column(0):
                t = t.as_py() or ""
                base = base_spans(t)
                more = method_spans(t, base, vocab)
                every = sorted(base + more, key=lambda s: (s[0], (*KINDS, "random").index(s[2])))
                n = [sum(s[2] == k for s in every) for k in (*KINDS, "random")]
                rows.append((*n, hashlib.sha256(said(base).encode()).hexdigest(), said(every)))
            cols = [pa.array([r[i] for r in rows], pa.int64() if i < 4 else pa.string()) for i in range(6)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *cols], names=schema.names)

    return rows.mapInArrow(run, schema)
