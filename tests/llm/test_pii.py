import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
import regex
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from plumbline.llm import pii
from tests.llm.helpers import ODD, empty, odd


def luhn(d):
    x = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(v - 9 if v > 9 else v for v in x) % 10 == 0


def brute_spans(text):
    out = []
    for k, p in pii.PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if k == "ip" else 0,
                  "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[k]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


def brute(text):
    out = brute_spans(text)
    said = ",".join(f"{k}:{s}:{e}" for k, s, e in out)
    return (*(sum(o[0] == k for o in out) for k in pii.PATTERNS), hashlib.sha256(said.encode()).hexdigest(), said)


def got(df):
    out = pii.detect(df, carry=("doc_id",)).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out)


def test_odd_rows_and_documents_match_brute_force(spark, sf):
    assert got(odd(spark)) == sorted((-1 if r[0] is None else r[0], *brute(r[1])[:5]) for r in ODD)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted((r.doc_id, *brute(r.text)[:5]) for r in docs.collect())
    assert got(docs) == want and sum(w[1] + w[3] for w in want) > 3
    assert got(empty(spark)) == []


PART = st.sampled_from(["a", "@", ".", "b.c", "-", "_", " ", "1", "10", "255", "256", "4111111111111111", "+", "(", ")", "1.2.3.4", "é", "\U0001f600", "\n", "x@y.zz", "4111 1111-1111 1111", "+1 406 555 0113"])


def test_patterns_match_brute_force_on_adversarial_strings(spark):
    texts = []

    @settings(max_examples=600, suppress_health_check=list(HealthCheck), database=None, derandomize=True)
    @given(st.lists(PART, max_size=25).map("".join))
    def collect(t):
        texts.append(t)

    collect()
    texts += ["1" * 200_000, "a" * 200_000, "+" * 50_000, "1 " * 50_000, "a@b" * 20_000, "1." * 50_000, "a@b." * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.detect(df, carry=("doc_id",)).collect()}
    for i, t in enumerate(texts[:-7]):
        want = brute(t)
        assert (out[i].n_email, out[i].n_ip, out[i].n_card, out[i].n_phone, out[i].base_sha256) == want[:5], t
    n = len(texts) - 7
    assert out[n].n_card == out[n + 1].n_email == out[n + 2].n_phone == out[n + 3].n_card == 0


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def shingle_hash(words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return signed(h)


def brute_terms(texts):
    """Shares of terms, by the formulas of the module, over whole texts in Python."""
    term = regex.compile(r"[\p{L}\p{N}]{3,}")
    cut = re.compile(rf"[^\n]{{1,{pii.PIECE}}}(?=[\x20\x09-\x0D]|\Z)|[^\n]{{{pii.PIECE}}}")
    found = {t: brute_spans(t) for t in {t or "" for t in texts}}
    d, hashes, n_e, n_te, n_t, n = Counter(), defaultdict(Counter), Counter(), Counter(), Counter(), 0
    for t in texts:
        t = t or ""
        w = term.findall(t)
        sketch = sorted({shingle_hash(w[i : i + 3]) for i in range(len(w))})[: pii.SKETCH]
        for e in {t[x:y].lower() for _, x, y in found[t]}:
            d[e] += 1
            hashes[e].update(sketch)
        for line in cut.findall(t):
            n += bool(re.search(r"[^\x20\x09-\x0D]", line))
            n_t.update(set(term.findall(line)))
            spans = brute_spans(line)
            bare = line
            for k in pii.KINDS:  # as many blanks as spans change nothing for terms
                for _, x, y in [s for s in spans if s[0] == k]:
                    bare = bare[:x] + " " * (y - x) + bare[y:]
            for e in {line[x:y].lower() for _, x, y in spans}:
                n_e[e] += 1
                n_te.update((e, x) for x in set(term.findall(bare)))
    out = {}
    for (e, t), n_both in n_te.items():
        if d[e] < pii.SUPPORT or n <= n_e[e]:
            continue
        rho = min(1.0, sum(c * (c - 1) for c in hashes[e].values()) / (d[e] - 1) / sum(hashes[e].values()))
        backed = d[e] / (1 + (d[e] - 1) * rho)
        own = backed * n_both / n_e[e]
        if backed < pii.SUPPORT or own < pii.SUPPORT or not n_t[t]:
            continue
        p = min(1.0, n_both / n_t[t])
        k, z2 = own / p, pii.Z**2
        low = (p + z2 / (2 * k) - pii.Z * math.sqrt(p * (1 - p) / k + z2 / (4 * k * k))) / (1 + z2 / k)
        share = math.log2(low * n / n_e[e]) / math.log2(n / n_e[e])
        if share >= pii.GENERALISE:
            out[t] = max(share, out.get(t, 0))
    return out


def brute_said(text, shares):
    base = brute_spans(text or "")
    more = []
    if shares:
        names = sorted(shares, reverse=True)
        p = regex.compile(r"(?<![\p{L}\p{N}])(?:" + "|".join(names) + r")(?![\p{L}\p{N}])")
        for m in p.finditer(text or ""):
            if not any(x < m.end() and m.start() < y for _, x, y in base):
                more.append(("removed" if shares[m[0]] >= pii.REMOVE else "term", m.start(), m.end()))
    order = (*pii.KINDS, "term", "removed")
    return ",".join(f"{k}:{x}:{y}" for k, x, y in sorted(base + more, key=lambda s: (order.index(s[0]), s[1])))


def planted():
    """Prose without meaning in 4000 texts; a name in other words each time, a contact
    line that many texts share, a name in near copies of one text, and a long line."""
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioustrnlmd") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [prose(rng.randint(5, 30)) for _ in range(4000)]
    rows += [f"{prose(20)}\n{prose(6)} Zorblatt {prose(rng.randint(0, 4))} ceo@corp.example.com {prose(5)}\n{prose(9)}" for _ in range(9)]
    rows += [f"{prose(25)}\nContact Fenwick at 10.1.2.3\n{prose(12)}" for _ in range(30)]
    body = prose(60).split(" ")
    for i in range(40):
        copy = list(body)
        copy[rng.randrange(60)] = f"edit{i}"
        rows.append(" ".join(copy[:30]) + " Quixote windmill@copy.example.com " + " ".join(copy[30:]))
    rows += [prose(900) + " Zorblatt ceo@corp.example.com " + prose(900), "nobody but Zorblatt was there", None, "ask Fenwick, he is in", prose(8) + " solo@one.example.com"]
    return rows


@pytest.mark.parametrize("inline", [5000, 0])
def test_planted_terms_equal_brute_force(spark, monkeypatch, inline):
    monkeypatch.setattr(pii, "INLINE", inline)
    texts = planted()
    shares = brute_terms(texts)
    assert {"Zorblatt", "Fenwick", "Contact"} == set(shares) and shares["Zorblatt"] > pii.REMOVE
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_email string")
    out = {r.doc_id: r for r in pii.detect(df, carry=("doc_id", "n_email")).collect()}
    assert {i: r.spans for i, r in out.items()} == {i: brute_said(t, shares) for i, t in enumerate(texts)}
    assert out[0].n_email_carried == "x" and out[4000].n_terms == 1


def test_documents_terms_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    shares = brute_terms([r.text for r in rows])
    assert {r.doc_id: r.spans for r in pii.detect(docs, carry=("doc_id",)).collect()} == {r.doc_id: brute_said(r.text, shares) for r in rows}


def test_disclosing_terms_are_replaced_and_common_words_stay(spark):
    texts = planted()
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_chars int, _terms string")
    out = {r.doc_id: r for r in pii.sanitised(docs, length="n_chars").collect()}
    assert len(out) == len(texts)
    said = out[texts.index("nobody but Zorblatt was there")]
    assert said.text == "nobody but  was there" and said.n_chars == len(said.text)
    assert out[4038].text == texts[4038].replace("Contact Fenwick", out[4038].text.split("\n")[1].split(" at ")[0]).replace("10.1.2.3", "[IP]")
    assert "Fenwick" not in out[4038].text and "Quixote" in out[4040].text and "windmill" not in out[4040].text
    none = out[texts.index(None)]
    assert none.text is None and none._terms == "x"
    assert out[0].text == texts[0]
    assert "[EMAIL]" in out[4000].text and "corp.example" not in out[4000].text


def test_sanitised_keeps_columns_and_odd_rows(spark):
    out = pii.sanitised(odd(spark))
    assert out.columns == odd(spark).columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[None] == "mail [EMAIL] now, é\U0001f600 call [PHONE] or [IP]"
    assert texts[3] is None and texts[6] == ODD[5][1]
    assert pii.sanitised(empty(spark)).count() == 0


def test_long_texts_are_rebuilt_piece_by_piece(spark):
    """Thousands of spans in one text, at borders of blocks, beside characters of several bytes and units."""
    rng = random.Random(6)
    fill = lambda: "é" + "".join(rng.choices("aé\U0001f600ж \n", k=rng.randrange(0, 40)))
    parts = [(fill(), rng.choice(["bob@example.com", "10.0.0.255", "+1 (406) 555-0113"])) for _ in range(3000)]
    kinds = {"b": "[EMAIL]", "1": "[IP]", "+": "[PHONE]"}
    text = "".join(f"{a} {b} " for a, b in parts) + "end"
    docs = spark.createDataFrame([(1, text), (2, "x" * 5000), (3, ""), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert got == {1: "".join(f"{a} {kinds[b[0]]} " for a, b in parts) + "end", 2: "x" * 5000, 3: "", 4: None}
    row = pii.detect(docs, carry=("doc_id",)).where("doc_id = 1").first()
    at, want = 0, {k: [] for k in ("email", "ip", "phone")}
    for a, b in parts:
        at += len(a) + 1
        want[kinds[b[0]].strip("[]").lower()].append((at, at + len(b)))
        at += len(b) + 1
    said = ",".join(f"{k}:{s}:{e}" for k, v in want.items() for s, e in v)
    assert row.spans == said
