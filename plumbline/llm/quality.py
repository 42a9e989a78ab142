"""Quality rules with host-level verdicts.

Each document is measured by itself, in one narrow pass: no window of words
leaves its row. Rule failures are then counted by host, the rates are shrunk
towards the corpus rate by a beta prior whose strength is estimated from the
spread between hosts, and the verdict on a host is joined back to its documents.

Defined results: a null or blank text has no words, so it fails (too few words).
A null host is a host of its own. Repeated rows are judged alike, each counted.
An empty table gives an empty result. Other columns pass through ``kept`` untouched,
also where they bear the names of measures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import SPACE, WORD, carried, whole, words, written

#: Base rules: fewer words than this, or more than this share of words in repeated windows.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Rules that count against a host, but do not reject a document by themselves.
MAX_SYMBOLS_PER_WORD = 0.5
MAX_DUP_LINE_SHARE = 0.5
#: A host is rejected when its failure rate is surely above this: by the posterior mean less
#: SURE standard deviations.
MAX_HOST_RATE, SURE = 0.6, 1.645
#: Bounds of the prior's strength, in documents.
PRIOR_LOW, PRIOR_HIGH = 1.0, 1e6

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _covered(places: Column) -> Column:
    """Words in the windows that begin at these places, which ascend."""
    start = F.struct(F.lit(-WINDOW).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        places,
        start,
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW).cast("long"), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def measured(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The columns named in carry, and the five measures. Windows are compared by
    64-bit hashes within their document."""
    n = F.size("_words")
    df = docs.select(*carry, whole(F.col(text)).alias("_body"), words(F.col(text)).alias("_words"))
    df = df.withColumn(
        "_windows",
        F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))),
    )
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.withColumn(
        "_sorted",
        F.when(again, F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))),
    )
    same = lambda e, k: F.coalesce(F.get("_sorted", k)["h"] == e["h"], F.lit(False))
    twice = F.filter("_sorted", lambda e, k: same(e, k - 1) | same(e, k + 1))
    df = df.withColumn("_places", F.sort_array(F.transform(twice, lambda e: e["i"])))
    df = df.withColumn("_lines", F.filter(F.split("_body", "\n"), lambda x: x.rlike(WORD)))
    return df.select(
        *carry,
        n.cast("long").alias("n_words"),
        (F.length("_body") - F.regexp_count("_body", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("_body", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_places").isNull(), F.lit(0).cast("long")).otherwise(_covered(F.col("_places"))).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rule_failed() -> Column:
    """Any rule that counts against the host."""
    return (
        base_failed()
        | (F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * F.col("n_words"))
        | (F.col("n_dup_lines") > 0) & (F.col("n_dup_lines") * 5 > MAX_DUP_LINE_SHARE * F.col("n_words"))
    )


def host_verdicts(marks: DataFrame, host: str = "source", failed: str = "failed") -> DataFrame:
    """One row for each host: n_docs, n_failed, rate, host_ok.

    Empirical Bayes: the corpus rate m and the variance between hosts, less what
    binomial noise explains, give a beta prior of strength k = m(1-m)/variance - 1;
    a host's rate is the posterior mean r = (failures + k m) / (documents + k), of
    variance r(1-r) / (documents + k + 1). The prior alone rejects no host, however bad
    the corpus: the host's own failures have to say the same, under a flat prior."""
    hosts = marks.groupBy(host).agg(F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    total = hosts.agg(
        F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count("*").alias("hosts"),
        F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("ff"),
    )
    m = F.col("f") / F.col("n")
    noise = m * (1 - m) * (F.col("hosts") - 1) / F.col("n")
    between = F.col("ff") / F.col("n") - m * m - noise
    k = F.when(between > 0, F.greatest(F.lit(PRIOR_LOW), F.least(F.lit(PRIOR_HIGH), m * (1 - m) / between - 1)))
    prior = total.select(m.alias("m"), F.coalesce(k, F.lit(PRIOR_HIGH)).alias("k"))
    # The prior is one row whatever the input.
    rated = hosts.join(F.broadcast(prior), F.lit(True)).withColumn(
        "rate", (F.col("n_failed") + F.col("k") * F.col("m")) / (F.col("n_docs") + F.col("k"))
    )
    above = lambda r, n: r - SURE * F.sqrt(r * (1 - r) / (n + 1)) > MAX_HOST_RATE
    bad = above(F.col("rate"), F.col("n_docs") + F.col("k")) & above((F.col("n_failed") + 1) / (F.col("n_docs") + 2), F.col("n_docs") + 2)
    return rated.select(host, "n_docs", "n_failed", "rate", (~bad).alias("host_ok"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """The columns named in carry, the measures, base_failed, host_ok and kept. A carried
    column that has a result's name gets the suffix _carried.

    The measured rows are written once, as hosts need all of them before any is
    judged. Rejected hosts are joined back by host: Spark broadcasts them if they
    measure small, else it deals both sides out and splits hot hosts."""
    near = docs.select(F.struct(F.lit(0).alias("_"), *carry).alias("_row"), F.col(host).alias("_host"), F.col(text).alias("_text"))
    rows = written(measured(near, "_text", ("_host", "_row")).withColumn("base_failed", base_failed()), "quality")
    verdicts = host_verdicts(rows.select("_host", rule_failed().alias("failed")), "_host")
    bad = written(verdicts.where(~F.col("host_ok")).select(F.col("_host").alias("_bad_host"), F.lit(True).alias("_bad")), "hosts")
    ok = ~F.coalesce("_bad", F.lit(False))
    judged = rows.join(bad, F.col("_host").eqNullSafe(F.col("_bad_host")), "left")
    made = (*MEASURES, "base_failed", "host_ok", "kept")
    return judged.select(*carried("_row", carry, made), *MEASURES, "base_failed", ok.alias("host_ok"), (~F.col("base_failed") & ok).alias("kept"))


def kept(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that pass, with their own columns and no others."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"), F.col(host).alias("_source"))
    return judge(rows, "_text", "_source", ("_row",)).where("kept").select("_row.*")
