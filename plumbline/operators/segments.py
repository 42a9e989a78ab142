"""A BM25 index that is kept up: segments, deletions, compaction, views by level and age.

A folder holds append-only segments, each tokenised once from the texts of one batch:

    segment/<name>/postings   token, id, tf, level, in folders by bucket of the token
    segment/<name>/lengths    id, dl, level
    segment/<name>/vocab      bucket, token, level, n (texts that have it)
    segment/<name>/totals     level, n_docs, dl
    gone/<name>/...           ids, vocab and totals of texts taken out of segments, counts negative
    manifest/<version>        which segments and deletions there are; written last
    view/<level>/<version>-<time>   statistics merged for readers of a level

Statistics merge by addition, so neither an append nor a delete reads an old text or changes
an old file: a delete reads the postings, which tell the tokens of an id. A text that is
appended again is taken out of its old segment in the same step. Readers see a version from
when its manifest is there; of two writers of one version the second fails. ``compact``
writes small or thinned segments as one, from their postings.

A view has what a query needs beside postings: living lengths, document frequencies, idf,
totals, over texts up to a level. It serves until the index changes or it is TTL seconds old.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators.retrieval import EPSILON, Index, bucket, rated_tokens
from plumbline.sources.stores import exists, fresh, listed, removed, stored

#: Fixed value: seconds that the statistics of a level serve.
TTL = 7200
#: Segments of fewer texts, or with a larger share of them deleted, are compacted.
LEAST, MOST_GONE = 100_000, 0.3
_POSTINGS = "token string, id long, tf int, level int, bucket int"
_LENGTHS = "id long, dl long, level int"
_VOCAB = "bucket int, token string, level int, n long"
_TOTALS = "level int, n_docs long, dl long"


@dataclass(frozen=True)
class Segments:
    """The index under path. rows: from id and text to a row for each token."""

    spark: SparkSession
    path: str
    rows: Callable[[DataFrame], DataFrame] = text.token_rows

    # -- what there is ---------------------------------------------------------------

    def version(self) -> int:
        """The last version; 0 of an index without one."""
        found = [int(n) for n in listed(self.spark, f"{self.path}/manifest") if exists(self.spark, f"{self.path}/manifest/{n}/_SUCCESS")]
        return max(found, default=0)

    def manifest(self, version: int | None = None) -> list[tuple[str, str, int]]:
        """(kind, name, texts) of the segments and deletions of a version; a row for each."""
        at = self.version() if version is None else version
        if not at:
            return []
        rows = self.spark.read.schema("kind string, name string, n long").json(f"{self.path}/manifest/{at:08}").collect()
        return sorted((r.kind, r.name, r.n) for r in rows)

    def _commit(self, entries: list[tuple[str, str, int]], before: int) -> int:
        df = self.spark.createDataFrame(sorted(entries), "kind string, name string, n long")
        df.coalesce(1).write.json(f"{self.path}/manifest/{before + 1:08}")
        return before + 1

    def _read(self, entries: list[tuple[str, str, int]], kind: str, table: str, schema: str) -> DataFrame:
        """A table of all segments, with their names; or of the deletions in living segments."""
        names = [n for k, n, _ in entries if k == kind]
        living = [n for k, n, _ in entries if k == "segment"]
        if kind == "gone":
            parts = [self.spark.read.schema(f"segment string, {schema}").parquet(f"{self.path}/gone/{n}/{table}") for n in names]
        else:
            parts = [self.spark.read.schema(schema).parquet(f"{self.path}/segment/{n}/{table}").withColumn("segment", F.lit(n)) for n in names]
        empty = self.spark.createDataFrame([], f"{schema}, segment string")
        df = reduce(DataFrame.unionByName, parts, empty) if not parts else reduce(DataFrame.unionByName, parts)
        return df.where(F.col("segment").isin(living)) if kind == "gone" and living else df

    def _living(self, entries: list[tuple[str, str, int]]) -> DataFrame:
        lengths = self._read(entries, "segment", "lengths", _LENGTHS)
        return lengths.join(self._read(entries, "gone", "ids", _LENGTHS).select("segment", "id"), ["segment", "id"], "left_anti")

    # -- changes -----------------------------------------------------------------------

    def _write(self, counts: DataFrame, ids: DataFrame) -> tuple[str, str, int]:
        """A segment of counts (token, id, tf, level), and of all its ids with their levels."""
        name = fresh()
        place = f"{self.path}/segment/{name}"
        df = counts.select("token", "id", F.col("tf").cast("int").alias("tf"), F.col("level").cast("int").alias("level"), bucket().alias("bucket"))
        postings = stored(df.hint("rebalance", "bucket"), "postings", place, "bucket")
        every = postings.select("id", "level", "tf").unionByName(ids.select("id", F.col("level").cast("int").alias("level"), F.lit(0).alias("tf")))
        lengths = stored(every.groupBy("id").agg(F.sum("tf").alias("dl"), F.max("level").alias("level")), "lengths", place)
        stored(postings.groupBy("bucket", "token", "level").agg(F.count("*").alias("n")), "vocab", place)
        stored(lengths.groupBy("level").agg(F.count("*").alias("n_docs"), F.sum("dl").alias("dl")), "totals", place)
        return ("segment", name, lengths.count())

    def _take_out(self, entries: list[tuple[str, str, int]], ids: DataFrame) -> list[tuple[str, str, int]]:
        """Writes the living texts among ids as gone; no entry if there is none."""
        if not any(k == "segment" for k, _, _ in entries):
            return []
        name = fresh()
        place = f"{self.path}/gone/{name}"
        hit = stored(self._living(entries).join(ids.select("id").distinct(), "id", "left_semi").select("segment", "id", "dl", "level"), "ids", place)
        n = hit.count()
        if not n:
            return []
        lost = self._read(entries, "segment", "postings", _POSTINGS).select("segment", "bucket", "token", "level", "id").join(hit.select("segment", "id"), ["segment", "id"], "left_semi")
        stored(lost.groupBy("segment", "bucket", "token", "level").agg((-F.count("*")).alias("n")), "vocab", place)
        stored(hit.groupBy("segment", "level").agg((-F.count("*")).alias("n_docs"), (-F.sum("dl")).alias("dl")), "totals", place)
        return [("gone", name, n)]

    def append(self, texts: DataFrame, level: str = "access_level") -> int:
        """A new segment of texts (id, text and their level), which replace those of the same
        ids. Of rows that repeat an id the tokens add up. Returns the version."""
        before = self.version()
        entries = self.manifest(before)
        # The level goes along with the id, so that no join is needed to know it.
        both = texts.select(F.struct(F.col("id").cast("long").alias("id"), F.col(level).alias("level")).alias("id"), "text")
        # Texts are dealt out by id before they are cut, so that their many tokens are counted where they are.
        both = both.repartition("id")
        counts = self.rows(both).groupBy("id", "token").agg(F.count("*").alias("tf")).select("token", "id.id", "tf", "id.level")
        ids = texts.select(F.col("id").cast("long").alias("id"), F.col(level).alias("level"))
        return self._commit([*entries, *self._take_out(entries, ids), self._write(counts, ids)], before)

    def delete(self, ids: DataFrame) -> int:
        """Takes the texts of ids out. Unknown ids change nothing. Returns the version."""
        before = self.version()
        entries = self.manifest(before)
        gone = self._take_out(entries, ids)
        return self._commit([*entries, *gone], before) if gone else before

    def compact(self, least: int = LEAST, most_gone: float = MOST_GONE) -> int:
        """One segment in place of those that are small or thinned out, from their postings.
        Old files stay for readers of older versions; sweep() removes them."""
        before = self.version()
        entries = self.manifest(before)
        lost = {r.segment: r.n for r in self._read(entries, "gone", "totals", _TOTALS).groupBy("segment").agg((-F.sum("n_docs")).alias("n")).collect()}
        old = [e for e in entries if e[0] == "segment" and (e[2] - lost.get(e[1], 0) < least or lost.get(e[1], 0) > most_gone * e[2])]
        if len(old) < 2 and not any(e[1] in lost for e in old):
            return before
        living = self._living([*old, *(e for e in entries if e[0] == "gone")])
        postings = self._read(old, "segment", "postings", _POSTINGS).join(living.select("segment", "id"), ["segment", "id"], "left_semi")
        made = self._write(postings, living)
        rest = [e for e in entries if e not in old]
        named = {r.name for r in self._names(rest).collect()}
        return self._commit([*(e for e in rest if e[0] == "segment" or e[1] in named), made], before)

    def _names(self, entries: list[tuple[str, str, int]]) -> DataFrame:
        """The deletions that still concern a segment."""
        living = [n for k, n, _ in entries if k == "segment"]
        parts = [self.spark.read.schema("segment string, level int").parquet(f"{self.path}/gone/{n}/totals").where(F.col("segment").isin(living)).select(F.lit(n).alias("name")).distinct() for k, n, _ in entries if k == "gone" and living]
        return reduce(DataFrame.unionByName, parts, self.spark.createDataFrame([], "name string"))

    def sweep(self) -> list[str]:
        """Removes the files that the last version doesn't name, and older manifests."""
        at = self.version()
        kept = {(k, n) for k, n, _ in self.manifest(at)}
        old = [f"{k}/{n}" for k in ("segment", "gone") for n in listed(self.spark, f"{self.path}/{k}") if (k, n) not in kept]
        old += [f"manifest/{n}" for n in listed(self.spark, f"{self.path}/manifest") if int(n) < at]
        for place in old:
            removed(self.spark, f"{self.path}/{place}")
        return old

    # -- reading -----------------------------------------------------------------------

    def _index(self, entries: list[tuple[str, str, int]], view: str, level: int) -> Index:
        read = lambda name: self.spark.read.parquet(f"{view}/{name}")
        # Postings above the level have no lengths in the view, so they need not be dealt out.
        postings = self._read(entries, "segment", "postings", _POSTINGS).where(F.col("level") <= level).drop("level")
        return Index(postings, read("tokens"), read("lengths"), read("stats"), ("segment", "id"))

    def view(self, level: int, now: float, ttl: float = TTL, epsilon: float = EPSILON) -> tuple[Index, bool]:
        """The index for readers of a level, and whether its statistics were there already.
        now: seconds, by which ages are told. Views of older versions, or too old, go."""
        at = self.version()
        entries = self.manifest(at)
        place, alive = f"{self.path}/view/{level}", None
        for name in listed(self.spark, place):
            version, made = name.split("-")
            if int(version) == at and 0 <= now - int(made) < ttl and exists(self.spark, f"{place}/{name}/stats/_SUCCESS"):
                alive = name
            elif int(version) < at or now - int(made) >= ttl:
                removed(self.spark, f"{place}/{name}")
        if alive:
            return self._index(entries, f"{place}/{alive}", level), True
        here = f"{place}/{at}-{int(now)}"
        below = F.col("level") <= level
        both = lambda table, schema: self._read(entries, "segment", table, schema).unionByName(self._read(entries, "gone", table, schema)).where(below)
        stored(self._living(entries).where(below).select("segment", "id", "dl"), "lengths", here)
        total = both("totals", _TOTALS).agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.try_divide(F.sum("dl"), F.sum("n_docs")).alias("avgdl"))
        vocab = both("vocab", _VOCAB).groupBy("bucket", "token").agg(F.sum("n").alias("n_docs_with")).where("n_docs_with > 0")
        tokens, stats = rated_tokens(vocab, total, here, epsilon)
        stored(tokens, "tokens", here)
        stored(stats, "stats", here)  # the last one, by which a view is known to be whole
        return self._index(entries, here, level), False
