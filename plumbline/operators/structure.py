"""Document structure and chunks.

Types, metadata, line classes and sections are expressions over a document's own row.
Only the splitting of a long section is sequential, as each piece begins where the
last one ended; that runs in Arrow batches, section by section.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.batches import parts as small_parts
from plumbline.functions.text import bound, running
from plumbline.operators.context import with_titles

#: Document types by their patterns, in order, on upper-cased text.
TYPES = [
    ("ORDER", [r"ПРИКАЗ", r"П\s*Р\s*И\s*К\s*А\s*З", r"№\s*\d+[-\p{L}\p{N}_]*\s*ОТ", r"ПРИКАЗЫВАЮ"]),
    ("INSTRUCTION", [r"ИНСТРУКЦИЯ", r"ДОЛЖНОСТНАЯ\s+ИНСТРУКЦИЯ", r"РЕГЛАМЕНТ"]),
    ("CONTRACT", [r"ДОГОВОР", r"СОГЛАШЕНИЕ", r"КОНТРАКТ"]),
]
#: Metadata fields, the first match of each.
FIELDS = {
    "number": r"№\s*(\d+[-\p{L}\p{N}_]*)",
    "organization": r"(?:ООО|ОАО|ЗАО|ИП)\s*[«\"]?([^«\"»\n]+)[«\"»]?",
    "inn": r"ИНН\s*(\d{10,12})",
    "ogrn": r"ОГРН\s*(\d{13,15})",
    "kpp": r"КПП\s*(\d{9})",
}
#: Dates, who signs, addresses; lines of these words are no titles.
DATE = r"«(\d{1,2})»\s+([\p{L}\p{N}_]+)\s+(\d{4})\s*г?"
SIGNATORY = r"(?:Директор|Генеральный\s+директор|Руководитель)[^\n]*\s+([А-ЯЁ][а-яё]+\s+[А-ЯЁ]\.[А-ЯЁ]\.)"
ADDRESS = r"(?:Юридический\s+адрес|Фактический\s+адрес):\s*([^\n]+)"
#: Kinds of lines, in order of precedence, with the longest line they hold.
LINES = [
    ("numbered_item", r"^(\d+(?:\.\d+)*)\.\s*(.+)", None),
    ("lettered_item", r"^([а-я])\)\s*(.+)", None),
    ("header", r"^([А-ЯЁ\s]{3,}):?\s*$", None),
    ("subheader", r"^([А-ЯЁ][а-яё\s]+):?\s*$", 100),
    ("table", r"^\[Заголовки таблицы:", None),
]
NOT_TITLE = ("ООО", "ИНН", "АДРЕС", "ОГРН")


def document_type(c: Column, types: list = TYPES) -> Column:
    up = F.upper(c)
    out = None
    for name, patterns in types:
        hit = up.rlike("|".join(patterns))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("GENERAL")


def metadata(c: Column, fields: dict[str, str] = FIELDS) -> Column:
    """A struct of the first matches; a field that is not found is null."""
    first = lambda p, g=1: F.nullif(F.regexp_extract(c, p, g), F.lit(""))
    date = F.when(c.rlike(DATE), F.concat_ws(" ", first(DATE, 1), first(DATE, 2), first(DATE, 3)))
    every = lambda p: F.regexp_extract_all(c, F.lit(p), F.lit(1))
    return F.struct(*(F.trim(first(p)).alias(k) for k, p in fields.items()), date.alias("date"), every(SIGNATORY).alias("signatories"), every(ADDRESS).alias("addresses"))


def title(c: Column) -> Column:
    """The first line that is long enough, begins with no digit and is no legal detail."""
    good = lambda x: (F.length(x) > 10) & ~x.rlike("^[0-9]") & ~F.upper(x).rlike("|".join(NOT_TITLE))
    return F.get(F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), good), 0)


def _classified(line: Column, kind: Column, rules: list) -> tuple[Column, Column]:
    """The type and the level of a line."""
    c, out = F.trim(line), None
    for name, pattern, longest in rules:
        hit = c.rlike(pattern) if longest is None else c.rlike(pattern) & (F.length(c) < longest)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    order = kind == "ORDER"
    out = out.when(order & F.contains(F.upper(c), F.lit("ПРИКАЗЫВАЮ")), "order_directive")
    out = out.when(order & c.rlike("^(Директор|Генеральный директор)"), "signatures").otherwise("paragraph")
    number = F.regexp_extract(c, r"^(\d+(?:\.\d+)*)\.", 1)
    level = F.when(out == "numbered_item", F.size(F.split(number, r"\."))).when(out == "lettered_item", 3).when(out == "subheader", 2).otherwise(1)
    return out, level


def _placed(docs: DataFrame, kind: Column | None, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns named in carry, _kind and _lines, an array of line and start: a document
    stays one row, so that offsets and sections need no shuffle."""
    df = docs.select("id", *carry, (kind if kind is not None else F.lit("GENERAL")).alias("_kind"), F.split(F.coalesce("text", F.lit("")), "\n").alias("_l"))
    placed = lambda ls: F.zip_with(ls, running(F.transform(ls, lambda x: F.length(x) + 1)), lambda x, at: F.struct(x.alias("line"), at.alias("start")))
    return df.select("id", *carry, "_kind", bound(F.col("_l"), placed).alias("_lines"))


def lines(docs: DataFrame, kind: Column | None = None, rules: list = LINES) -> DataFrame:
    """id, line_no, line, start, type and level of each line. kind: the document's type."""
    df = _placed(docs, kind).select("id", "_kind", F.posexplode("_lines").alias("line_no", "_x"))
    kind_of, level = _classified(F.col("_x.line"), F.col("_kind"), rules)
    return df.select("id", "line_no", "_x.line", "_x.start", kind_of.alias("type"), level.alias("level"))


def sections(docs: DataFrame, kind: Column | None = None, rules: list = LINES, carry: tuple[str, ...] = ()) -> DataFrame:
    """A header line opens a section that goes to the next one; what stands before the
    first is a preamble. id, section_no, title, type, level, start, end, content, and the
    document's columns that are named in carry."""
    df = _placed(docs, kind, carry)
    heads = F.filter(F.transform("_lines", lambda x, i: F.when(_classified(x["line"], F.col("_kind"), rules)[0] != "paragraph", i)), lambda i: i.isNotNull())
    df = df.withColumn("_heads", heads)
    # The preamble begins at the first line, if that is no header; it is number 0.
    df = df.withColumn("_from", F.when(F.get("_heads", 0) == 0, F.col("_heads")).otherwise(F.concat(F.array(F.lit(0)), "_heads")))
    first = F.when(F.get("_heads", 0) == 0, 1).otherwise(0)
    to = lambda i: F.coalesce(F.get(F.col("_from"), i + 1), F.size("_lines"))
    cut = F.transform("_from", lambda at, i: F.struct((i + first).cast("long").alias("section_no"), F.slice("_lines", at + 1, to(i) - at).alias("ls")))
    df = df.select("id", *carry, "_kind", F.inline(cut))
    head, last = F.element_at("ls", 1), F.element_at("ls", -1)
    kind_of, level = _classified(head["line"], F.col("_kind"), rules)
    content = F.trim(F.array_join(F.transform("ls", lambda x: F.trim(x["line"])), "\n"))
    title = F.when(F.col("section_no") == 0, "Документ").otherwise(F.trim(head["line"]))
    out = df.select("id", "section_no", title.alias("title"), kind_of.alias("type"), level.alias("level"), head["start"].alias("start"), (last["start"] + F.length(last["line"])).alias("end"), content.alias("content"), *carry)
    return out.where(F.col("content") != "")


def optimal_size(kind: Column, n: Column) -> Column:
    return (
        F.when(kind == "header", F.least(F.lit(500), n + 100))
        .when((kind == "numbered_item") & (n < 300), n + 50).when((kind == "numbered_item") & (n < 800), 600)
        .when(kind == "signatures", F.least(F.lit(300), n + 50)).when(kind == "table", F.least(F.lit(1500), n + 200)).otherwise(1000)
    )


def keep_together(kind: Column, n: Column) -> Column:
    return (kind != "table") & ((n < 200) | kind.isin("header", "signatures", "lettered_item") | ((kind == "numbered_item") & (n < 500)))


@dataclass(frozen=True)
class Sizes:
    size: int = 1000
    overlap: int = 100
    least: int = 200


#: Abbreviations that end no sentence, sought from 5 characters before the mark to 2 after.
ABBREVIATIONS = ("т.д", "т.п", "и.о", "г.", "см.", "стр.", "п.", "пп.")
_SENTENCE = re.compile(r"[.!?](?=\s)|\n(?=[^\W_])")
_ITEM_END = re.compile(r"\.\n(?=\s*\d+\.)")


def boundary(text: str, at: int, items: bool = False) -> int:
    """Where a piece that should end at `at` ends: after the last item, sentence or
    paragraph in reach, else at the last white space, else there."""
    if items:
        ends = [m.end() for m in _ITEM_END.finditer(text, max(0, at - 150)) if m.start() < at]
        if ends:
            return ends[-1]
    low = max(0, at - 100)
    for m in reversed([m for m in _SENTENCE.finditer(text, low + 1, min(len(text), at + 2)) if m.start() <= at]):
        i = m.start()
        if text[i] == "\n":
            if text[i + 1].isupper() or text[i + 1].isdigit():
                return i + 1
        elif i < 2 or not any(a in text[max(0, i - 5) : i + 3].lower() for a in ABBREVIATIONS):
            return i + 1
    for i in range(at, low, -1):
        if text[i].isspace():
            return i
    return at


def pieces(text: str, how: Sizes, size: int | None = None, items: bool = False, keep_first: bool = False) -> list[tuple[int, int, str]]:
    """Overlapping pieces: start, end, stripped text. Short ones are left out."""
    size = size or how.size
    if len(text) <= size:
        return [(0, len(text), text)]
    out, at = [], 0
    while True:
        end = min(at + size, len(text))
        end = boundary(text, end, items) if end < len(text) else end
        body = text[at:end].strip()
        if len(body) >= how.least or (keep_first and not out):
            out.append((at, end, body))
        if end >= len(text):
            return out
        at = max(at + 1, end - how.overlap)


def section_chunks(found: DataFrame, how: Sizes = Sizes(), carry: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of sections: whole where they fit or are kept together, else pieces that
    name their section. The columns named in carry pass."""
    kind, n = F.col("type"), F.length("content")
    df = found.select(F.col("id").cast("string").alias("id"), "section_no", "title", "type", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "content", optimal_size(kind, n).alias("size"), keep_together(kind, n).alias("whole"), *carry)

    fits = F.col("whole") | (F.length("content") <= F.col("size"))
    names = ["id", "section_no", "part", "total_parts", "start", "end", "chunk_type", "title", "type", "text"]
    one = F.lit(1).cast("int")
    complete = df.where(fits).select("id", F.col("section_no").cast("int").alias("section_no"), one.alias("part"), one.alias("total_parts"), "start", "end", F.lit("complete_section").alias("chunk_type"), "title", "type", F.col("content").alias("text"), *carry)
    schema = complete.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_parts(batches, "content"):
            at, rows = [], []
            texts, titles, types, starts, sizes = (b.column(c).to_pylist() for c in ("content", "title", "type", "start", "size"))
            for i, text in enumerate(texts):
                parts = pieces(text, how, sizes[i], types[i] == "numbered_item")
                for k, (a, z, body) in enumerate(parts, 1):
                    head = titles[i] if k == 1 else f"{titles[i]} (продолжение)"
                    at.append(i)
                    rows.append((k, len(parts), starts[i] + a, starts[i] + z, f"[{head}]\n{body}"))
            of = lambda c: b.column(c).take(pa.array(at, pa.int64()))
            made = [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()))]
            kind = pa.array(["section_part"] * len(rows), pa.string())
            yield pa.RecordBatch.from_arrays([of("id"), of("section_no"), *made[:4], kind, of("title"), of("type"), made[4], *map(of, carry)], names=[*names, *carry])

    long = df.where(~fits).withColumn("section_no", F.col("section_no").cast("int"))
    return complete.unionByName(long.mapInArrow(run, schema))


def chunk_records(parts: DataFrame, created: Column) -> DataFrame:
    """The whole record of each chunk: its text and twenty fields. parts: as section_chunks()
    gives them, with level, access_level and document, a struct of type, title, number, date and
    organization, carried along; what a document lacks is an empty string. Chunks are numbered
    in the order of sections and parts, in the one shuffle that there is, by document."""
    by = Window.partitionBy("id")
    order = by.orderBy("section_no", "part")
    before_end, before_start = F.lag("end").over(order), F.lag("start").over(order)
    both = F.greatest(F.lit(0), F.least("end", before_end) - F.greatest("start", before_start))
    said = lambda c: F.coalesce(F.col("document")[c].cast("string"), F.lit(""))
    return parts.select(
        F.col("id").cast("string").alias("doc_id"), (F.row_number().over(order) - 1).alias("chunk_index"), "access_level", F.col("start").alias("char_start"), F.col("end").alias("char_end"), created.alias("created_at"),
        F.length("text").alias("char_count"), F.when(before_end.isNull(), 0).otherwise(both).cast("long").alias("overlap_prev"), F.lit(0).alias("overlap_next"), F.count("*").over(by).alias("total_chunks"),
        F.coalesce("title", F.lit("")).alias("section_title"), F.coalesce("type", F.lit("paragraph")).alias("section_type"), F.coalesce("level", F.lit(1)).alias("section_level"),
        F.coalesce("chunk_type", F.lit("content")).alias("chunk_type"), F.coalesce(F.col("chunk_type") == "complete_section", F.lit(False)).alias("is_complete_section"),
        F.coalesce(F.nullif(said("type"), F.lit("")), F.lit("general")).alias("document_type"), said("title").alias("document_title"), said("number").alias("document_number"), said("date").alias("document_date"),
        said("organization").alias("document_organization"), "text",
    )


def basic_chunks(docs: DataFrame, how: Sizes = Sizes()) -> DataFrame:
    """Chunks of texts without structure; the first is kept even if short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_parts(batches, "text"):
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows += [(d, i, a, z, x) for i, (a, z, x) in enumerate(pieces(t or "", how, keep_first=True))]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], names=["id", "chunk_index", "start", "end", "text"])

    return docs.select(F.col("id").cast("string").alias("id"), "text").mapInArrow(run, "id string, chunk_index int, start long, end long, text string")


def fixed_chunks(docs: DataFrame, size: int = 1000, overlap: int = 100, carry: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of a fixed width: id, chunk_index, start, end, text, and the columns named in carry."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - overlap) / step)).cast("int")
    df = docs.select("id", "text", *carry, F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    start = F.col("chunk_index") * step
    return df.select("id", "chunk_index", start.alias("start"), F.least(start + size, F.length("text")).alias("end"), F.substring(F.col("text"), start + 1, F.lit(size)).alias("text"), *carry)


def with_overlaps(chunks: DataFrame) -> DataFrame:
    """total_chunks, overlap_prev and overlap_next (always 0)."""
    order = Window.partitionBy("id").orderBy("chunk_index")
    prev_end, prev_start = F.lag("end").over(order), F.lag("start").over(order)
    both = F.greatest(F.lit(0), F.least("end", prev_end) - F.greatest("start", prev_start))
    return chunks.withColumn("total_chunks", F.count("*").over(Window.partitionBy("id"))).withColumn("overlap_prev", F.when(prev_end.isNull(), 0).otherwise(both)).withColumn("overlap_next", F.lit(0))


def neighbour_overlap(chunks: DataFrame) -> DataFrame:
    """Whether a chunk's head shares more than two long words with the tail before it."""
    order = Window.partitionBy("id").orderBy("chunk_index")
    long_words = lambda c: F.filter(F.split(F.lower(c), r"[ \n\t]+"), lambda w: F.length(w) > 3)
    tail = long_words(F.lag(F.expr("right(text, 50)")).over(order))
    df = chunks.withColumn("_tail", tail).withColumn("_head", long_words(F.substring("text", 1, 50)))
    shared = F.size(F.filter("_head", lambda w: F.array_contains("_tail", w)))
    return df.withColumn("shared_words", F.when(F.col("_tail").isNull(), 0).otherwise(shared)).withColumn("overlaps", F.col("shared_words") > 2).drop("_tail", "_head")


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    n = F.length("text")
    return chunks.agg(F.count("*").alias("n_chunks"), F.round(F.avg(n), 6).alias("avg_size"), F.min(n).alias("min_size"), F.max(n).alias("max_size"), F.sum(n).alias("total_size"))


# -- tables ------------------------------------------------------------------------


def table_rows(tables: DataFrame) -> DataFrame:
    """tables: id, headers, rows, title, before, after. One chunk for each row that has
    a value: context, title, columns, and the row by its columns where they match."""
    cell = lambda x: F.trim(x)
    pairs = F.transform(F.arrays_zip("headers", "row"), lambda p: F.struct(p["headers"].alias("h"), cell(p["row"]).alias("v")))
    named = F.transform(F.filter(pairs, lambda p: p["v"] != ""), lambda p: F.concat_ws(": ", p["h"], p["v"]))
    plain = F.filter(F.transform("row", cell), lambda v: v != "")
    df = tables.select("*", F.posexplode("rows").alias("_i", "row"))
    said = F.when((F.size("headers") > 0) & (F.size("headers") == F.size("row")), named).otherwise(plain)
    df = df.withColumn("_said", said).where(F.size("_said") > 0)
    some = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    text = F.concat_ws(
        "\n", some("Контекст документа: ", F.col("before")), F.concat(F.lit("Таблица: "), F.col("title")),
        some("Столбцы таблицы: ", F.array_join("headers", " | ")),
        F.concat(F.lit("Строка "), (F.col("_i") + 1).cast("string"), F.lit(": "), F.array_join("_said", " | ")), some("Далее в документе: ", F.col("after")),
    )
    return df.select("id", (F.col("_i") + 1).cast("int").alias("row_index"), text.alias("text"))


def table_context(body: Column, start: Column, end: Column) -> Column:
    """What stands before and after a table, and the title in the last line before it."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    before = strip(F.substring(body, F.greatest(F.lit(1), start - 199), F.least(start, F.lit(200))))
    after = strip(F.substring(body, end + 1, F.lit(100)))
    last = F.trim(F.element_at(F.split(before, "\n"), -1))
    name = F.when(F.length(last).between(4, 149), F.regexp_replace(last, ":$", "")).otherwise("Таблица")
    return F.struct(before.alias("before"), after.alias("after"), name.alias("title"))


def tables_in_sections(tables: DataFrame, found: DataFrame) -> DataFrame:
    """Each table with the section that it begins in. Only sections of its document are compared."""
    t, s = tables.alias("t"), found.alias("s")
    inside = (F.col("t.id") == F.col("s.id")) & F.col("t.position").between(F.col("s.start"), F.col("s.end"))
    return t.join(s, inside).select("t.id", "t.table_no", "t.position", "s.section_no")


def table_text(rows: Column) -> Column:
    """A table as text: its first row that has a value as headers, then the others."""
    cells = F.transform(rows, lambda r: F.transform(r, lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))))
    full = F.filter(cells, lambda r: F.exists(r, lambda c: c != ""))
    head = F.concat(F.lit("[Заголовки таблицы: "), F.array_join(F.get(full, 0), " | "), F.lit("]"))
    body = F.transform(F.slice(full, 2, 1_000_000), lambda r, i: F.concat(F.lit("[Строка "), (i + 1).cast("string"), F.lit(": "), F.array_join(F.filter(r, lambda c: c != ""), " | "), F.lit("]")))
    return F.array_join(F.concat(F.array(head), body), "\n")


def around_tables(found: DataFrame, tables: DataFrame, least: int = 200) -> DataFrame:
    """The text of a section before, between and after its tables, pieces of at least
    `least` characters. found: id, section_no, start, content. tables: id, section_no,
    position (in the document), size."""
    begin = F.col("position") - F.col("start")
    gaps = tables.join(found, ["id", "section_no"]).select("id", "section_no", "content", begin.alias("to"), (begin + F.col("size")).alias("next"))
    order = Window.partitionBy("id", "section_no").orderBy("to")
    before = gaps.select("id", "section_no", "content", F.coalesce(F.lag("next").over(order), F.lit(0)).alias("from"), "to", F.lit("text_before_table").alias("chunk_type"))
    last = gaps.groupBy("id", "section_no").agg(F.first("content").alias("content"), F.max("next").alias("from"))
    after = last.select("id", "section_no", "content", "from", F.length("content").alias("to"), F.lit("text_after_table").alias("chunk_type"))
    cut = before.unionByName(after).where(F.col("to") > F.col("from"))
    body = F.regexp_replace(F.substring(F.col("content"), F.col("from").cast("int") + 1, (F.col("to") - F.col("from")).cast("int")), r"^\s+|\s+$", "")
    return cut.select("id", "section_no", "from", "to", "chunk_type", body.alias("text")).where(F.length("text") >= least)


def grouped_rows(rows: DataFrame, size: int = 8) -> DataFrame:
    """Row chunks of a table in groups: id, group_no, text; all but the first are marked as going on."""
    group = F.floor((F.col("row_index") - 1) / size).cast("int")
    lines = F.array_sort(F.collect_list(F.struct("row_index", "text")))
    out = rows.groupBy("id", group.alias("group_no")).agg(F.array_join(F.transform(lines, lambda r: r["text"]), "\n").alias("text"))
    return out.withColumn("text", F.when(F.col("group_no") > 0, F.concat(F.lit("(продолжение)\n"), "text")).otherwise(F.col("text")))


def fallback_table(body: Column, title_of_section: Column) -> Column:
    return F.concat(F.lit("Таблица в "), title_of_section, F.lit("\n"), body)


def enriched(chunks: DataFrame, titles: DataFrame, parts: DataFrame, keywords: str) -> DataFrame:
    """chunks with what is known of their documents: doc_title and document_title (a default
    where there is none), has_tables, content_parts_count, and the keywords out of the struct
    of that name. titles: id, title; parts: id, n_tables, n_parts."""
    named = with_titles(chunks, titles, "id").join(parts, "id", "left")
    return named.select(
        *(c for c in chunks.columns if c != keywords), F.col("title").alias("doc_title"), F.col("title").alias("document_title"),
        (F.coalesce("n_tables", F.lit(0)) > 0).alias("has_tables"), F.coalesce("n_parts", F.lit(0)).alias("content_parts_count"), f"{keywords}.*",
    )


def chunk_histograms(chunks: DataFrame) -> DataFrame:
    """class, value, n: chunks by chunk_type, by section_type, and complete or partial."""
    done = F.when(F.col("is_complete_section"), "complete").otherwise("partial")
    each = F.array(*(F.struct(F.lit(k).alias("class"), c.alias("value")) for k, c in (("chunk_type", F.col("chunk_type")), ("section_type", F.col("section_type")), ("completeness", done))))
    return chunks.select(F.inline(each)).groupBy("class", "value").agg(F.count("*").alias("n"))


def overlap_summary(chunks: DataFrame) -> DataFrame:
    """How many chunks of a document overlap the one before, and their mean length, rounded."""
    marked = neighbour_overlap(chunks)
    return marked.groupBy("id").agg(F.count_if("overlaps").alias("n_overlapping"), F.round(F.avg(F.length("text"))).cast("long").alias("mean_chars"))
