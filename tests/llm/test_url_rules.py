import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from plumbline.llm import queries, url_rules
from tests.llm.helpers import SCHEMA  # noqa: F401

URLS = [
    None, "", "no scheme/com/en/", "http://Example.COM/en/7", "http://example.com/en/8?x=/de/", "https://a.b.net/de/8", "https://www.example.net/de/81#x",
    "http://com/en/", "http://xcom/en/", "http://example.company/en/7", "http://m.site.org/es/1.html", "http://m.site.org/fr/12/", "http://blog.a.example.org/en/5.html",
    "http://blog.a.example.com/fr/5.html", "ftp://tracker.x.io", "http://x.io/LOGIN", "http://x.io/login?next=/", "http://x.io/login", "http://x.io?a=://b.com/en/", "http://x.io/tag/é/feed",
    "http://ads.x.io/", "http://user@host:80/cart/add", "://example.com/en/7", "a://b://c.com/en/", "http://example.net/de/8" + "a" * 50_000, "http://x\n.com/en/y",
]


def brute(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for v, h, p in url_rules.HOST_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((True, len(h + p), h + p, v))
    for v, n, p, _ in url_rules.PATTERN_RULES:
        if re.search(p, host + path):
            fits.append((False, len(n), n, v))
    best = max(fits, default=(False, 0, None, "allow"))
    return host, path, best[2] if best[0] else None, best[3]


def test_urls_match_brute_force(spark, sf):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    out = {r.page.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(df).collect()}
    assert out == {i: brute(u) for i, u in enumerate(URLS)}
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page.page_id: (r.page.url, r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages).collect()}
    assert all(v[1:] == brute(v[0]) for v in got.values()) and len(got) == pages.count()
    assert url_rules.kept(df).columns == df.columns
    assert url_rules.judge(df.where("false")).count() == 0


def test_only_candidates_are_run(spark, sf):
    """A rule is fetched by its rarest token, so most URLs run few of the rules."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = url_rules.judge(pages).agg({"n_candidates": "avg"}).first()[0]
    assert out < 0.4 * len(url_rules.rules())
    filed = url_rules.index(url_rules._targets(pages, "url"), url_rules.as_table(spark, url_rules.rules())).collect()
    seen = Counter(t for h, p in {brute(r.url)[:2] for r in pages.collect()} for t in set(re.findall("[a-z0-9]+", (h + " " + p).lower())))
    rarest = {r.pattern: min(r.tokens, key=lambda t: (seen[t], t)) for r in url_rules.rules()}
    assert {r.rule.pattern: r.token for r in filed} == rarest and len(set(rarest.values())) > 8


@pytest.mark.parametrize("rule", url_rules.rules(), ids=lambda r: r.pattern)
def test_generated_urls_have_the_tokens_of_the_rule(rule):
    """URLs made from the pattern itself, whatever may stand before and behind it."""

    @settings(max_examples=150, database=None, derandomize=True, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(rule.pattern.replace("$", r"\Z"), re.ASCII)))
    def has(target):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in target)
        assert set(rule.tokens) <= set(re.findall("[a-z0-9]+", low)), target

    has()


@pytest.mark.parametrize("most", [50_000, 10])
def test_many_rules_and_rules_without_tokens(spark, monkeypatch, most):
    """2000 more rules, broadcast or dealt out, and one that has no literal token."""
    monkeypatch.setattr(url_rules, "MOST_BROADCAST", most)
    more = [("block", f"p{i}", rf"/shop{i}/item", (f"shop{i}",)) for i in range(2000)] + [("block", "digits", r"/[0-9]{9}$", ())]
    found = url_rules.rules(pattern_rules=url_rules.PATTERN_RULES + more)
    urls = ["http://x.io/shop7/item3", "http://x.io/shop1999/item", "http://x.io/123456789", "http://x.io/shop7/", None, "http://x.io/shop7/item3"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = {r.page.page_id: (r.pattern_rule, r.n_candidates) for r in url_rules.judge(df, found=found).collect()}
    assert out == {0: ("p7", 2), 1: ("p1999", 2), 2: ("digits", 1), 3: (None, 2), 4: (None, 1), 5: ("p7", 2)}


def test_every_rule_needs_its_tokens():
    """A URL that fits a rule has each of the rule's literal tokens, so the index loses none."""
    for u in [x for x in URLS if x]:
        host, path = brute(u)[:2]
        tokens = set(re.findall("[a-z0-9]+", (host + " " + path).lower()))
        for r in url_rules.rules():
            if re.search(r.pattern, host + path):
                assert set(r.tokens) <= tokens, (u, r)


#: URLs that fit a rule by its second alternative, and some that only look like it.
OTHERS = [
    "http://x.io/signin", "http://x.io/a/signin/b", "http://x.io/signing", "http://x.io/ad/1", "http://ad.x.io/", "http://x.ad/en", "http://x.io/ads/1",
    "http://x.io/ad", "http://adx.io/", "http://x.io/login", "http://ads.x.io/signin", "http://x.com/en/ad/1", "http://x.io/bad/1",
]


def test_alternatives_without_a_common_token_equal_sql(spark, tmp_path):
    pd.DataFrame(list(enumerate(OTHERS + [u for u in URLS if u and len(u) < 99 and "\n" not in u])), columns=["page_id", "url"]).to_parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet')")
    df, want = queries.op6_url_rules(spark, str(tmp_path)), duck.sql(queries.oracle_sql()["op6_url_rules"])
    got = {tuple(r) for r in df.select(*want.columns).collect()}
    assert got == set(want.fetchall())
    verdicts = {r[0]: r[5] for r in got}
    assert [verdicts[i] for i in (0, 1, 2, 3, 4)] == ["block", "block", "allow", "block", "block"]
    for u in OTHERS:
        host, path = brute(u)[:2]
        tokens = set(re.findall("[a-z0-9]+", host + " " + path))
        assert all(set(r.tokens) <= tokens for r in url_rules.rules() if re.search(r.pattern, host + path)), u
