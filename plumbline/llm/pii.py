"""Personal data: fixed patterns, and terms that disclose the entities they name.

Base spans come from four patterns. The patterns below find the same matches as the
plain ones in PATTERNS, in time that is linear in the text: runs are taken
possessively, and a run is entered only where it begins.

The method is information-theoretic sanitisation. The contexts are lines, in pieces of
PIECE characters at most. For an entity e and a term t in its contexts, with counts of
contexts over the whole corpus,

    PMI(t; e) = log2(n(t, e) N / (n(t) n(e))),   IC(e) = log2(N / n(e)),

PMI / IC = log2(p(e|t) N / n(e)) / IC is the share of what there is to know about e that
t alone gives away. p(e|t) = n(t, e) / n(t) is an estimate, so its lower confidence bound
(Wilson's, at z) stands in its place. What the bound rests on are documents, and copies
of a document are no new evidence: of d documents with e whose mean similarity is rho,

    d / (1 + (d - 1) rho)

count (Kish's design effect; rho from the SKETCH least hashes of each document's shingles
of three terms), and t has the part n(t, e) / n(e) of them. Pairs with evidence of SUPPORT
documents at least are judged: from GENERALISE on, a term is replaced by its kind, from
REMOVE on it goes, wherever it stands. No pair of documents is formed, and an entity of a
third of all rows is only ever summed up.

Defined results: a null text is empty and stays null when sanitised; repeated rows
are treated alike and count as often as they occur, but are no new evidence; an empty
table gives an empty result; other columns pass through ``sanitised``; a column carried
by ``detect`` that has a result's name gets the suffix _carried. Offsets are code
points, ends exclusive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import bound, running
from plumbline.llm.common import WORD, carried, whole, written

#: The patterns as defined. ip: parts at most 255. card: 16 to 19 digits that pass Luhn. phone: 8 to 15 digits.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches (for card: those of 16 to 19 digits) without backtracking.
LINEAR = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9]{2})(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": PATTERNS["phone"],
}
KINDS = tuple(PATTERNS)
#: The base spans by kind, as columns of their own names.
_KIND = {k: f"_{k}_spans" for k in KINDS}
TERM = r"[\p{L}\p{N}]{3,}"
#: Documents that are no copies of each other, at least, behind a judged pair; hashes of a document's sketch.
SUPPORT, SKETCH = 3, 16
#: Characters of a context at most, and the quantile of the confidence bound (one-sided, 95 %).
PIECE, Z = 2000, 1.645
#: So many disclosing terms at most are sent to every task; beyond, texts are joined with theirs.
INLINE = 5000
GENERALISE, REMOVE = 0.7, 0.9
#: Characters of a block of a text that is put together again.
BLOCK = 1024


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.split(F.reverse(digits), "")
    value = F.transform(
        each,
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(value, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(
            F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", "")),
            lambda p: (F.length(p) <= 3) & (F.coalesce(F.when(F.length(p) <= 3, p.try_cast("int")), F.lit(0)) <= 255),
        )
    if kind == "card":
        return _luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def located(text: Column, pattern: Column | str, kind: str) -> Column:
    """All matches of a pattern as structs start, end, kind, value. The places come from
    running sums over the lengths of matches and of the gaps between them."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    zipped = F.arrays_zip(F.split(text, p, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("value"))
    none = F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>")

    def placed(found: Column) -> Column:
        before = running(F.transform(found, lambda x: F.length(x["gap"]) + F.length(x["value"])))
        at = lambda x, b: (b + F.length(x["gap"])).cast("int")
        return F.zip_with(found, before, lambda x, b: F.struct(at(x, b).alias("start"), (at(x, b) + F.length(x["value"])).alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))

    walk = bound(F.filter(zipped, lambda x: x["value"].isNotNull()), placed)
    return F.when(text.rlike(pattern) if isinstance(pattern, str) else F.regexp_like(text, p), walk).otherwise(none)


def base_spans(text: Column) -> dict[str, Column]:
    """Base spans by kind, in order of their starts."""

    def passing(kind: str) -> Column:
        return F.filter(located(text, LINEAR[kind], kind), lambda s: _passes(kind, s["value"]))

    found = {k: passing(k) for k in KINDS}
    none = F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>")
    return found | {"email": F.when(F.contains(text, F.lit("@")), found["email"]).otherwise(none)}


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def contexts(body: Column) -> Column:
    """Lines; those of more than PIECE characters in pieces that end before white space where they can."""
    return F.regexp_extract_all(body, F.lit(rf"[^\n]{{1,{PIECE}}}(?=[\x20\x09-\x0D]|\z)|[^\n]{{{PIECE}}}"), F.lit(0))


def _entities(spans: Column) -> Column:
    return F.array_distinct(F.transform(spans, lambda x: F.lower(x["value"])))


def evidence(spanned: DataFrame) -> DataFrame:
    """entity and evidence: how many documents stand behind each entity, those alike
    counted as one. Only entities of SUPPORT at least."""
    t = F.col("t")
    shingles = F.transform(t, lambda x, i: F.xxhash64(x, F.get(t, i + 1), F.get(t, i + 2)))
    each = spanned.select(_entities(F.concat(*_KIND.values())).alias("e"), _terms(F.col("_body")).alias("t"))
    each = each.select("e", F.slice(F.sort_array(F.array_distinct(shingles)), 1, SKETCH).alias("s"))
    each = written(each.select(F.explode("e").alias("entity"), "s"), "entities")
    often = each.groupBy("entity").agg(F.count("*").alias("d")).where(F.col("d") >= SUPPORT)
    marks = each.join(often, "entity").select("entity", "d", F.explode("s").alias("h")).groupBy("entity", "d", "h").agg(F.count("*").alias("c"))
    alike = marks.groupBy("entity", "d").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("same"), F.sum("c").alias("all"))
    d = F.col("d").cast("double")
    rho = F.least(F.lit(1.0), F.col("same") / (d - 1) / F.col("all"))
    rated = alike.select("entity", (d / (1 + (d - 1) * rho)).alias("evidence"))
    return written(rated.where(F.col("evidence") >= SUPPORT), "evidence")


def lower_bound(p: Column, n: Column) -> Column:
    """Wilson's lower bound of a share p seen in n cases."""
    z2 = Z * Z
    return (p + z2 / (2 * n) - Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def disclosing_terms(spanned: DataFrame) -> DataFrame:
    """spanned: _body and the arrays of base spans. Gives the terms, each with the
    largest share of an entity's information that it surely discloses."""
    # Only documents with spans are searched again by contexts.
    personal = spanned.where(reduce(lambda a, b: a | b, (F.size(k) > 0 for k in _KIND.values())))
    backed = evidence(personal)
    lines = personal.select(F.explode(contexts(F.col("_body"))).alias("line"))
    # Each different context once, with its number m.
    lines = lines.groupBy(F.xxhash64("line").alias("id")).agg(F.count("*").alias("m"), F.first("line").alias("line"))
    lines = lines.select("*", _entities(F.concat(*base_spans(F.col("line")).values())).alias("e")).where(F.size("e") > 0)
    held = lines.select("id", "m", "line", F.explode("e").alias("entity")).join(backed, "entity")
    held = written(held, "held")
    bare = reduce(lambda c, k: F.regexp_replace(c, LINEAR[k], " "), KINDS, F.col("line"))
    # A context is of bounded length, so are its pairs.
    pairs = held.select("entity", "evidence", "m", F.explode(F.array_distinct(_terms(bare))).alias("term"))
    pairs = pairs.groupBy("entity", "evidence", "term").agg(F.sum("m").alias("n_te"))
    n_e = held.groupBy("entity").agg(F.sum("m").alias("n_e"))
    known = pairs.join(n_e, "entity").withColumn("evidence", F.col("evidence") * F.col("n_te") / F.col("n_e"))
    known = written(known.where(F.col("evidence") >= SUPPORT), "supported")
    # Counts over every context of every document; terms not beside entities are dropped before the shuffle.
    by_line = F.transform(contexts(F.col("_body")), lambda x: F.array_distinct(_terms(x)))
    each = spanned.select(F.explode(F.flatten(by_line)).alias("term"))
    counts = each.join(known.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    total = spanned.agg(F.sum(F.size(F.filter(contexts(F.col("_body")), lambda x: x.rlike(WORD)))).alias("n"))
    n, n_e = F.col("n").cast("double"), F.col("n_e")
    p = F.least(F.lit(1.0), F.col("n_te") / F.col("n_t"))
    share = F.log2(lower_bound(p, F.col("evidence") / p) * n / n_e) / F.log2(n / n_e)
    # One row of totals.
    rated = known.join(counts, "term").join(F.broadcast(total), F.lit(True)).where(n > n_e)
    return written(rated.groupBy("term").agg(F.max(share).alias("share")).where(F.col("share") >= GENERALISE), "disclosing")


def _terms(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TERM), F.lit(0))


def with_spans(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The columns named in carry, _body, the base spans by kind (as in _KIND), and _terms: spans
    of disclosing terms that no base span overlaps, with kind term or removed."""
    spanned = docs.select(*carry, whole(F.col(text)).alias("_body"))
    spanned = spanned.select("*", *(c.alias(_KIND[k]) for k, c in base_spans(F.col("_body")).items()))
    risky = disclosing_terms(spanned)
    none = F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>")
    if risky.limit(INLINE + 1).count() <= INLINE:
        # One row, of INLINE terms at most, goes to every task; texts stay where they are.
        every = risky.agg(F.collect_list("term").alias("_all"), F.collect_list(F.when(F.col("share") >= REMOVE, F.col("term"))).alias("_gone"))
        held = spanned.join(F.broadcast(every), F.lit(True))
        mine = F.when(F.size("_all") > 0, F.array_intersect(_terms(F.col("_body")), "_all"))
        held = held.withColumn("_mine", F.coalesce(mine, F.array().cast("array<string>"))).drop("_all")
    else:
        # Each text with such terms once, whatever its copies.
        has = spanned.select("_body", F.explode(F.array_distinct(_terms(F.col("_body")))).alias("term"))
        by_text = has.join(risky, "term").groupBy(F.sha2("_body", 256).alias("_key"))
        gone = F.collect_set(F.when(F.col("share") >= REMOVE, F.col("term")))
        by_text = written(by_text.agg(F.collect_set("term").alias("_mine"), gone.alias("_gone")), "risky-texts")
        held = spanned.withColumn("_key", F.sha2("_body", 256)).join(by_text, "_key", "left").drop("_key")
        held = held.withColumn("_mine", F.coalesce("_mine", F.array().cast("array<string>")))
    # Longer terms first, so that none hides another that it begins.
    names = F.array_join(F.reverse(F.array_sort("_mine")), "|")
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), names, F.lit(r")(?![\p{L}\p{N}])"))
    base = F.concat(*_KIND.values())
    free = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    marked = F.transform(
        F.filter(located(F.col("_body"), pattern, "term"), free),
        lambda s: s.withField("kind", F.when(F.array_contains("_gone", s["value"]), "removed").otherwise("term")),
    )
    return held.withColumn("_terms", F.when(F.size("_mine") == 0, none).otherwise(marked)).drop("_mine", "_gone")


def detect(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts and spans: n_email, n_ip, n_card, n_phone, base_sha256, spans (by kind, then start), n_terms."""
    rows = docs.select(F.struct(F.lit(0).alias("_"), *carry).alias("_row"), F.col(text).alias("_text"))
    found = with_spans(rows, "_text", ("_row",))
    of_kind = [F.filter("_terms", lambda s: s["kind"] == "term"), F.filter("_terms", lambda s: s["kind"] == "removed")]
    made = {f"n_{k}": F.size(_KIND[k]).cast("long") for k in KINDS} | {
        "base_sha256": F.sha2(_said(F.concat(*_KIND.values())), 256),
        "spans": _said(F.concat(*_KIND.values(), *of_kind)),
        "n_terms": F.size("_terms").cast("long"),
    }
    return found.select(*carried("_row", carry, made), *(c.alias(k) for k, c in made.items()))


def _stand_in(s: Column) -> Column:
    """Entities become their kind; terms become number, name or word, or go."""
    kind = F.when(s["value"].rlike(r"\p{N}"), "[NUMBER]").when(s["value"].rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    return (
        F.when(s["kind"] == "removed", "").when(s["kind"] == "term", kind)
        .otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    )


def sanitised(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """docs with the entities and disclosing terms in their texts replaced. Where
    spans of two kinds overlap, the earlier, then the longer one, stands for both.
    length: a column that follows the new number of characters."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))
    found = with_spans(rows, "_text", ("_row",)).withColumn(
        "_spans",
        F.array_sort(
            F.concat(*_KIND.values(), "_terms"),
            lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]),
        ),
    )
    body = F.col("_body")
    # The spans that stand, each with where the one before it ends; the pieces are joined once.
    none = F.array().cast("array<struct<after:int,start:int,stand:string>>")
    kept = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(a["at"].alias("after"), s["start"].alias("start"), _stand_in(s).alias("stand"))))).alias("out"),
        ),
    )
    whole = F.length(body)

    def part(blocks: Column, at: Column, n: Column) -> Column:
        """n characters from at on, out of the blocks that hold them: a place in a long text is not counted from its beginning."""
        first = F.floor(at / BLOCK)
        some = F.array_join(F.slice(blocks, (first + 1).cast("int"), (F.floor((at + n - 1) / BLOCK) - first + 1).cast("int")), "")
        return F.when(n > 0, F.substring(some, (at - first * BLOCK + 1).cast("int"), n)).otherwise("")

    def joined(blocks: Column, a: Column) -> Column:
        pieces = F.transform(a["out"], lambda x: F.concat(part(blocks, x["after"], x["start"] - x["after"]), x["stand"]))
        return F.concat(F.array_join(pieces, ""), part(blocks, a["at"], whole - a["at"]))

    blocks = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    rebuilt = bound(blocks, lambda cut: bound(kept, lambda a: joined(cut, a)))
    new = F.when(F.col("_row")[text].isNull(), F.lit(None)).when(F.size("_spans") == 0, body).otherwise(rebuilt)
    found = found.withColumn("_new", new)
    put = {text: F.col("_new")} | ({length: F.length("_new").cast(docs.schema[length].dataType)} if length else {})
    return found.select(*(put[c].alias(c) if c in put else F.col("_row")[c].alias(c) for c in docs.columns))
