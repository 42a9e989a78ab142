"""URL filters: rules indexed by their rarest literal token.

A rule is a regular expression over host and path, with the literal tokens that any
URL it fits must have. Each rule is filed under that of its tokens which the fewest
URLs of the corpus have, a rule without tokens under the empty token, which every URL
has. A URL looks up its own tokens, and only the rules that it finds are run on it. Of
the rules that fit, the longest wins.

Host rules (host/path) come first; the pattern rules decide the other URLs, and a
URL that none fits is allowed.

The index is a table (token, rule) of any size: the tokens of the different URLs are
joined with it, broadcast up to MOST_BROADCAST rules and dealt out beyond, where Spark
splits tokens that many URLs have. Verdicts go back to the pages by host and path.

Defined results: a URL that is null or has no "://" has an empty host and path, fits
no rule but those without tokens and is else allowed; repeated rows are judged alike;
an empty table gives an empty result; other columns pass through, under ``page`` of
``judge``; of equal rules by kind and length, the name decides.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import written

#: Rules that are sent to every task at most.
MOST_BROADCAST = 50_000
TOKEN = r"[a-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Host and path rules: verdict, host (with all subdomains), beginning of the path.
HOST_RULES = [
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
]
#: Pattern rules over host + path: verdict, name, expression, literal tokens that a fitting URL has.
#: Alternatives without a token in common are entries of their own, under one name.
PATTERN_RULES = [
    ("block", "login", r"/login(?:/|$)", ("login",)),
    ("block", "login", r"/signin(?:/|$)", ("signin",)),
    ("block", "logout", r"/logout(?:/|$)", ("logout",)),
    ("block", "ads", r"(?:^|[./])ads[./]", ("ads",)),
    ("block", "ads", r"(?:^|[./])ad[./]", ("ad",)),
    ("block", "tracker", r"^(?:[a-z0-9-]+\.)*tracker\.", ("tracker",)),
    ("block", "tag-feed", r"/tag/[^/]+/feed(?:/|$)", ("tag", "feed")),
    ("block", "cart", r"/cart/(?:add|checkout)(?:/|$)", ("cart",)),
    ("block", "mobile-short", r"^m\..*/[a-z]{2}/[0-9]{1,3}(?:[./]|$)", ("m",)),
    ("block", "blog-html", r"^blog\..*/[0-9]+\.html$", ("blog", "html")),
    ("allow", "blog-en-html", r"^blog\..*\.example\.org/en/[0-9]+\.html$", ("blog", "example", "org", "en", "html")),
]


@dataclass(frozen=True)
class Rule:
    verdict: str
    name: str
    pattern: str
    tokens: tuple[str, ...]
    by_host: bool


def rules(host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> list[Rule]:
    """All rules. A host rule's tokens are those of its host, and those of its path
    that are whole: the last one may go on in the URL."""
    out = []
    for verdict, host, path in host_rules:
        pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
        segments = re.findall(TOKEN, path.lower()) if re.search(r"[^A-Za-z0-9]$", path) else re.findall(TOKEN, path.lower())[:-1]
        out.append(Rule(verdict, host + path, pattern, tuple(re.findall(TOKEN, host) + segments), True))
    out += [Rule(v, n, p, tuple(t), False) for v, n, p, t in pattern_rules]
    return out


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(ascii_lower(F.concat(host, F.lit(" "), path)), F.lit(TOKEN), F.lit(0)))


_RULE = "by_host boolean, size int, name string, verdict string, pattern string"


def as_table(spark: SparkSession, found: list[Rule]) -> DataFrame:
    """A row for each rule: rule, a struct that orders rules by precedence, and tokens.
    Larger sets of rules can be read from a table of these columns."""
    each = [{"rule": {"by_host": r.by_host, "size": len(r.name), "name": r.name, "verdict": r.verdict, "pattern": r.pattern}, "tokens": list(r.tokens)} for r in found]
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(each)), f"array<struct<rule:struct<{_RULE.replace(' ', ':').replace(',:', ',')}>,tokens:array<string>>>")))


def _targets(pages: DataFrame, url: str) -> DataFrame:
    host, path = parts(F.col(url))
    return pages.select(host.alias("host"), path.alias("path")).distinct()


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast if it has MOST_BROADCAST rows at most."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def index(targets: DataFrame, rules_table: DataFrame) -> DataFrame:
    """token, rule: each rule under the token of it that the fewest URLs have."""
    none = F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))
    each = rules_table.select("rule", F.explode(none).alias("token"))
    wanted = _small(each.select("token").distinct())
    counts = targets.select(F.explode(_tokens(F.col("host"), F.col("path"))).alias("token")).join(wanted, "token", "left_semi")
    counts = counts.groupBy("token").agg(F.count("*").alias("n"))
    rated = each.join(counts, "token", "left").select("rule", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token").alias("t"))
    return rated.groupBy("rule").agg(F.min("t").alias("t")).select("t.token", "rule")


def judge(pages: DataFrame, url: str = "url", found: list[Rule] | DataFrame | None = None) -> DataFrame:
    """page (the row as a struct), host, path, rule, pattern_rule, verdict, and
    n_candidates: how many rules were run on the URL."""
    found = rules() if found is None else found
    table = as_table(pages.sparkSession, found) if isinstance(found, list) else found
    targets = _targets(pages, url)
    filed = written(index(targets, table), "rules")
    tokens = F.array_union(F.array(F.lit("")), _tokens(F.col("host"), F.col("path")))
    fetched = targets.select("host", "path", F.explode(tokens).alias("token")).join(_small(filed), "token")
    fits = F.when(F.regexp_like(F.concat("host", "path"), F.col("rule.pattern")), F.col("rule"))
    # Host rules before pattern rules, then the longest; names break ties.
    judged = fetched.groupBy("host", "path").agg(F.max(fits).alias("best"), F.count("*").alias("n"))
    host, path = parts(F.col(url))
    df = pages.select(F.struct(*pages.columns).alias("page"), host.alias("host"), path.alias("path"))
    df = df.join(judged, ["host", "path"], "left")
    return df.select(
        "page", "host", "path", F.when(F.col("best.by_host"), F.col("best.name")).alias("rule"),
        F.when(~F.col("best.by_host"), F.col("best.name")).alias("pattern_rule"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_candidates"),
    )


def kept(pages: DataFrame, url: str = "url") -> DataFrame:
    """The pages whose URLs are allowed."""
    return judge(pages, url).where("verdict = 'allow'").select("page.*")
