"""Queries without SQL, over whole tables: each row worked out again, the plain and slow way."""

import math
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import keywords, structure
from plumbline.plans import catalog
from plumbline.plans.text_queries import _RULES

SIZE, OVERLAP, LEAST = 1000, 100, 200


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def border(t, at, items):
    """Sign by sign, backwards from where a piece should end."""
    if items:
        for i in range(at - 1, max(0, at - 150) - 1, -1):
            if t[i : i + 2] == ".\n" and regex.match(r"\s*\d+\.", t[i + 2 :]):
                return i + 2
    low, end = max(0, at - 100), min(len(t), at + 2)
    for i in range(min(at, end - 1), low, -1):
        after = t[i + 1] if i + 1 < end else ""
        if t[i] in ".!?" and after.isspace():
            if i < 2 or not any(a in t[max(0, i - 5) : i + 3].lower() for a in structure.ABBREVIATIONS):
                return i + 1
        elif t[i] == "\n" and after.isalnum() and (after.isupper() or after.isdigit()):
            return i + 1
    return next((i for i in range(at, low, -1) if t[i].isspace()), at)


def split(t, size, items, keep_first):
    if len(t) <= size:
        return [(0, len(t), t)]
    out, at, end = [], 0, -1
    while end < len(t):
        end = at + size
        end = len(t) if end >= len(t) else border(t, end, items)
        said = t[at:end].strip()
        if len(said) >= LEAST or keep_first and not out:
            out.append((at, end, said))
        at = max(at + 1, end - OVERLAP)
    return out


def test_basic_chunks_row_by_row(spark, sf, docs):
    got = sorted((int(r.id), r.chunk_index, r.start, r.end, r.text) for r in catalog.queries()["basic_chunks"](spark, sf).collect())
    assert got == sorted((d, i, a, z, x) for d, t in docs for i, (a, z, x) in enumerate(split(t or "", SIZE, False, True)))
    assert len(got) > 3 * len(docs)


def test_semantic_chunks_row_by_row(spark, sf):
    """From the sections, which SQL checks."""
    want = []
    for s in structure.sections(spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("doc_id", "id"), rules=_RULES).collect():
        n = len(s.content)
        size = {"header": min(500, n + 100), "numbered_item": n + 50 if n < 300 else 600 if n < 800 else 1000, "signatures": min(300, n + 50), "table": min(1500, n + 200)}.get(s.type, 1000)
        together = s.type != "table" and (n < 200 or s.type in ("header", "signatures", "lettered_item") or s.type == "numbered_item" and n < 500)
        if together or n <= size:
            want.append((str(s.id), s.section_no, 1, 1, s.start, s.end, "complete_section", s.title, s.type, s.content))
            continue
        parts = split(s.content, size, s.type == "numbered_item", False)
        for k, (a, z, body) in enumerate(parts, 1):
            want.append((str(s.id), s.section_no, k, len(parts), s.start + a, s.start + z, "section_part", s.title, s.type, f"[{s.title}{' (продолжение)' if k > 1 else ''}]\n{body}"))
    got = catalog.queries()["semantic_chunks"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(r.part > 2 for r in got)
    # The records of the same chunks: numbered by place, with their overlaps.
    by_doc = {}
    for w in sorted(want, key=lambda w: (w[0], w[1], w[2])):
        by_doc.setdefault(w[0], []).append(w)
    rows = {(r.doc_id, r.chunk_index): r for r in catalog.queries()["semantic_chunk_records"](spark, sf).collect()}
    assert len(rows) == len(want)
    for doc, chunks in by_doc.items():
        for i, w in enumerate(chunks):
            r, before = rows[doc, i], chunks[i - 1] if i else None
            shared = max(0, min(w[5], before[5]) - max(w[4], before[4])) if before else 0
            assert (r.char_start, r.char_end, r.text, r.char_count, r.total_chunks, r.overlap_prev, r.section_title) == (w[4], w[5], w[9], len(w[9]), len(chunks), shared, w[7])
            assert r.access_level == int(doc) % 100 + 1 and (r.document_type, r.document_title) == ("general", "") and r.is_complete_section == (w[6] == "complete_section")


def test_technical_terms_row_by_row(spark, sf, docs):
    got = {r.id: r.terms for r in catalog.queries()["technical_terms"](spark, sf).collect()}
    for d, t in docs:
        named = [m.group() for p in text.FAMILIES for m in regex.finditer(p, t or "", regex.IGNORECASE | regex.ASCII)]
        named = [x if x == x.upper() and regex.search(r"\p{Lu}", x) and len(x) <= 5 else x.lower() for x in named]
        shaped = [m.group() for p in text.SHAPES for m in regex.finditer(p, t or "", regex.ASCII) if m.group().count("_") <= 1]
        kept = {x for x in named + shaped if len(x) >= 3 and not regex.fullmatch(r"[_\-.]+|[0-9.]+", x) and x.count("_") < len(x) // 2}
        assert got[d] == ",".join(sorted(kept, key=lambda x: x.encode())[: text.MOST_TERMS]), d


def test_keywords_row_by_row(spark, sf, docs):
    words = {r.id: r.w for r in spark.createDataFrame(docs, "id long, text string").select("id", text.tokens(F.col("text")).alias("w")).collect()}
    tf = {d: Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]) for d, w in words.items()}
    df = Counter(t for c in tf.values() for t in c)
    got = {int(r.id): r.keywords for r in catalog.queries()["mmr_keywords"](spark, sf).collect()}
    for d, c in tf.items():
        rated = sorted(((-round(n * math.log((len(docs) + 1) / df[t]), 6), t) for t, n in c.items()), key=lambda x: (x[0], x[1].encode()))[: keywords.CANDIDATES]
        left, out = {t: -s for s, t in rated}, []
        top = max(left.values(), default=1.0) or 1.0
        while left and len(out) < keywords.KEPT:
            def worth(t):
                shared = [len(set(t.split()) & set(o.split())) / len(set(t.split()) | set(o.split())) for o in out]
                return (1 - keywords.DIVERSITY) * left[t] / top - keywords.DIVERSITY * max(shared, default=0.0), t

            best = max(left, key=worth)
            out.append(best)
            del left[best]
        assert got.get(d, []) == out, d
