"""Lemmas by rules of endings, with a dictionary of exceptions.

A word's longest known ending, before which a stem remains, is replaced by that of the lemma.
The rules are written by paradigm: what the lemma ends in, and the endings of its other forms.
They cover the regular declensions and conjugations of Russian and the regular inflections of
English; they know nothing of what a word means, so this is no morphological analysis, and a
better one can stand in its place wherever a lemma is a parameter.

``lemma`` is an expression, for queries. A corpus has each word many times: ``lemma_rows``
lemmatises its different words once and joins them back.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.sources.stores import stored

#: The least letters of a stem.
STEM = 2
#: By what the lemma ends in, the endings of its other forms. Where two paradigms have an
#: ending, the first one counts.
RUSSIAN = {
    "ость": "ости остью остей остям остями остях",
    "ение": "ения ению ением ении ений ениям ениями ениях",
    "ание": "ания анию анием ании аний аниям аниями аниях",
    "ция": "ции цию цией ций циям циями циях",
    "ать": "аю аешь ает аем аете ают ал ала ало али айте",
    "ять": "яю яешь яет яем яете яют ял яла яло яли яйте",
    "ить": "ишь ит ите ят ил ила ило или",
    "овать": "ую уешь ует уем уете уют овал овала овало овали",
    "еть": "еешь еет еем еете еют ел ела ело ели",
    "ться": "ется ются ался алась алось ались ился илась илось ились",
    "ый": "ого ому ым ая ое ые ых ыми ой",
    "ий": "его ему ими их яя юю ее ие",
    "ия": "ии ию ией иям иями иях",
    "ка": "ки ку кой ками ках кам",
    "ь": "ью ям ями ях ем ей",
    "": "ов ев ам ами ах ом у е ы а",
}
ENGLISH = {"": "s ed ing ings", "y": "ies ied", "ss": "sses", "x": "xes", "sh": "shes", "ch": "ches", "e": "izing ized izes", "ize": "izing ized izes"}
#: Endings that look like those above and belong to the word.
WHOLE = ("ss", "us", "is", "ость", "ение", "ание", "ция", "eed")
#: Irregular forms.
IRREGULAR = {
    "были": "быть", "была": "быть", "было": "быть", "люди": "человек", "людей": "человек", "дети": "ребёнок", "детей": "ребёнок", "шёл": "идти", "шла": "идти", "шли": "идти",
    "was": "be", "were": "be", "been": "be", "has": "have", "had": "have", "men": "man", "women": "woman", "children": "child", "feet": "foot", "mice": "mouse", "went": "go", "done": "do",
}


def rules() -> dict[str, str]:
    """ending -> the lemma's ending."""
    out = {w: w for w in WHOLE}
    for paradigms in (RUSSIAN, ENGLISH):
        for to, endings in paradigms.items():
            for ending in endings.split():
                out.setdefault(ending, to)
    return out


RULES = rules()
LONGEST = max(map(len, RULES))


def lemma(word: Column) -> Column:
    """The lemma of a lower-case word by the rules; the word itself where none fits."""
    table = F.create_map(*map(F.lit, chain.from_iterable(RULES.items())))
    n = F.length(word)
    each = [F.when(n >= k + STEM, F.concat(F.substring(word, F.lit(1), n - k), F.try_element_at(table, F.substring(word, n - k + 1, F.lit(k))))) for k in range(LONGEST, 0, -1)]
    return F.coalesce(*each, word)


def exceptions(spark: SparkSession, entries: dict[str, str] = IRREGULAR) -> DataFrame:
    return spark.createDataFrame(list(entries.items()), "token string, lemma string")


def lemma_table(words: DataFrame, irregular: DataFrame | None = None) -> DataFrame:
    """token and lemma of each different token of words. irregular: token, lemma."""
    found = words.select("token").distinct().withColumn("_rule", lemma(F.col("token")))
    if irregular is None:
        return found.withColumnRenamed("_rule", "lemma")
    known = irregular.groupBy("token").agg(F.min("lemma").alias("lemma"))
    return found.join(known, "token", "left").select("token", F.coalesce("lemma", "_rule").alias("lemma"))


def lemma_counts(df: DataFrame, irregular: DataFrame | None = None, column: str = "text", stop: tuple[str, ...] = text.STOP) -> DataFrame:
    """id, token and n: the words of each text as lemmas, a row for each word of a text. Texts are
    dealt out by id before they are cut and counted, once, and written; stop words and numbers are
    sought among the different lemmas."""
    dealt = df.select("id", column).repartition("id")
    counts = stored(text.token_rows(dealt, column, stop=()).groupBy("id", "token").agg(F.count("*").alias("n")), "words")
    kept = lemma_table(counts, irregular).where(text.counts(F.col("lemma"), stop))
    return counts.join(kept, "token").select("id", F.col("lemma").alias("token"), "n")


def lemma_rows(df: DataFrame, irregular: DataFrame | None = None, column: str = "text", stop: tuple[str, ...] = text.STOP) -> DataFrame:
    """id and token, as text.token_rows() gives them, where tokens are lemmas."""
    named = lemma_counts(df, irregular, column, stop)
    return named.select("id", "token", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("id", "token")
