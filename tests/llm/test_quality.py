import re
from collections import Counter

from plumbline.llm import quality
from tests.llm.helpers import ODD, empty, odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = Counter(win)
    covered = {i + j for i, g in enumerate(win) if many[g] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def measures(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in df.collect())


def test_measures_match_brute_force_on_odd_rows(spark):
    assert measures(quality.measured(odd(spark), carry=("doc_id",))) == sorted((-1 if r[0] is None else r[0], *brute(r[1])) for r in ODD)


def test_measures_match_brute_force_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted((r.doc_id, *brute(r.text)) for r in docs.collect())
    assert measures(quality.measured(docs, carry=("doc_id",))) == want


def test_kept_leaves_columns_and_clashing_names_alone(spark):
    out = quality.kept(odd(spark))
    assert out.columns == odd(spark).columns
    rows = out.collect()
    assert {r.doc_id for r in rows} == {1, 2, None, 8}
    assert {r.kept for r in rows} == {"clash"}


def test_empty(spark):
    assert quality.kept(empty(spark)).count() == 0
    assert quality.judge(empty(spark), carry=("doc_id",)).count() == 0


def test_hosts_are_shrunk_and_rejected(spark):
    """A host of failures only is rejected with its good documents; one failure alone is not enough."""
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good + f" g{i}", "fine") for i in range(200)] + [(1000 + i, "short", "bad") for i in range(60)]
    rows += [(2000, good, "bad"), (3000, "short", "new"), (3001, good, "new"), (4000, "short", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in quality.judge(docs, carry=("doc_id",)).collect()}
    assert len(out) == len(rows)
    assert not out[2000].kept and not out[2000].base_failed and not out[2000].host_ok
    assert out[3001].kept and out[0].kept and not out[3000].kept
    rate = {r.source: r.rate for r in quality.host_verdicts(docs.selectExpr("source", "text = 'short' as failed")).collect()}
    assert 0.2 < rate["new"] < 0.5 < rate["bad"] and rate["fine"] < 0.05
