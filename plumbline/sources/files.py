"""Files to texts. Formats are told by extension; what cannot be read is a row with an error."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import text
from plumbline.functions.batches import parts

#: Formats by extension.
FORMATS = {".docx": "docx", ".csv": "csv", ".json": "json"}
ENCODINGS = ("utf-8", "cp1251", "latin-1")
MOST_ROWS, DEEPEST = 1000, 10


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def processor(path: Column) -> Column:
    out = None
    for ext, name in FORMATS.items():
        hit = extension(path) == ext
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unsupported")


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, format, content, error of each file. Spark gives no row for a file of no bytes."""
    df = spark.read.format("binaryFile").load(path)
    kind = processor(F.col("path"))
    error = F.when(kind == "unsupported", "unsupported")
    return df.select("path", kind.alias("format"), "content", error.alias("error"))


def csv_text(rows: DataFrame, by: str, row_no: str, columns: list[str], most: int = MOST_ROWS, totals: DataFrame | None = None) -> DataFrame:
    """A table as text: its columns, then the values of each row that has any; the
    first `most` of those, and a note if there are more. totals: by and n, where rows are
    the first ones of n. The rows beyond are counted, not sorted: each task passes on `most`."""
    pairs = F.array(*(F.struct(F.lit(c).alias("k"), F.trim(F.col(c).cast("string")).alias("v")) for c in columns))
    full = F.filter(pairs, lambda p: p["v"].isNotNull() & (p["v"] != ""))
    df = rows.select(by, row_no, full.alias("_full")).where(F.size("_full") > 0)
    line = F.concat(F.lit("Строка "), F.col(row_no).cast("string"), F.lit(": "), F.array_join(F.transform("_full", lambda p: F.concat_ws(": ", p["k"], p["v"])), "; "))
    order = Window.partitionBy(by).orderBy(row_no)
    totals = df.groupBy(by).agg(F.count("*").alias("n")) if totals is None else totals
    first = df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    both = first.select(by, F.struct("_n", line.alias("t")).alias("_l"), F.lit(None).cast("long").alias("_all"))
    both = both.unionByName(totals.select(by, F.lit(None).cast(both.schema["_l"].dataType).alias("_l"), F.col("n").alias("_all")))
    lines = F.array_sort(F.collect_list("_l"))
    note = F.when(F.max("_all") > most, F.array(F.lit(f"... (файл содержит больше строк, показаны первые {most})"))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.lit("Заголовки: " + ", ".join(columns)))
    return both.groupBy(by).agg(F.array_join(F.concat(head, F.transform(lines, lambda x: x["t"]), note), "\n").alias("text"), F.count("_l").alias("_k")).where("_k > 0").drop("_k")


def decode(content: bytes) -> str:
    for name in ENCODINGS:
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    return ""


def decoded(files: DataFrame) -> DataFrame:
    """id and text of files: id and content. The first encoding that fits is taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if c is None else decode(c) for c in b.column(1).to_pylist()], pa.string())], names=["id", "text"])

    return files.select("id", "content").mapInArrow(run, "id long, text string")


def verdict(path: Column, length: Column) -> Column:
    """ok, or why a file can't be read. length: its bytes, null if there is no such file."""
    return F.when(length.isNull(), "missing").when(length == 0, "empty").when(processor(path) == "unsupported", "unsupported").otherwise("ok")


def json_lines(data, deepest: int = DEEPEST) -> list[str]:
    """`path: value` of each leaf. A stack, so that no depth of input is a depth of calls."""
    out, todo = [], [("", data, deepest)]
    while todo:
        path, value, left = todo.pop()
        if isinstance(value, (dict, list)):
            if left <= 0:
                out.append(f"{path}: [слишком глубокая вложенность]")
                continue
            if isinstance(value, dict):
                inner = [(f"{path}.{k}" if path else str(k), v) for k, v in value.items()]
            else:
                inner = [(f"{path}[{i}]" if path else f"элемент_{i}", v) for i, v in enumerate(value)]
            todo += [(p, v, left - 1) for p, v in reversed(inner)]
            continue
        said = {True: "да", False: "нет"}[value] if isinstance(value, bool) else "" if value is None else str(value).strip()
        if said:
            out.append(f"{path}: {said}" if path else said)
    return out


def flat_json(c: Column) -> Column:
    """The same for objects of one level, as an expression."""
    pairs = F.map_entries(F.from_json(c, "map<string,string>"))
    full = F.filter(pairs, lambda p: p["value"].isNotNull() & (F.trim(p["value"]) != ""))
    value = lambda v: F.when(v == "true", "да").when(v == "false", "нет").otherwise(F.trim(v))
    return F.array_join(F.transform(full, lambda p: F.concat_ws(": ", p["key"], value(p["value"]))), "\n")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """Paragraphs and tables of a DOCX body, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    said = lambda e: re.sub(r"\s+", " ", "".join(t.text or "" for t in e.iter(f"{_W}t"))).strip()
    out = []
    for e in body:
        if e.tag == f"{_W}p" and said(e):
            out.append(said(e))
        elif e.tag == f"{_W}tbl":
            rows = [[said(c) for c in r.findall(f"{_W}tc")] for r in e.findall(f"{_W}tr")]
            rows = [r for r in rows if any(r)]
            if rows:
                out.append("[Заголовки таблицы: " + " | ".join(rows[0]) + "]")
                out += [f"[Строка {i}: " + " | ".join(c for c in r if c) + "]" for i, r in enumerate(rows[1:], 1)]
    return "\n".join(out)


def docx_paragraphs(content: bytes) -> list[dict]:
    """Text and style of each paragraph of a DOCX body: style_name, is_heading,
    heading_level, is_bold and is_italic (of its first run), alignment."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        styles = ElementTree.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else ()
    value = lambda e, path: None if e is None or e.find(path) is None else e.find(path).get(f"{_W}val")
    named = {s.get(f"{_W}styleId"): value(s, f"{_W}name") for s in styles if s.tag == f"{_W}style"}
    on = lambda e, tag: e is not None and e.find(tag) is not None and value(e, tag) not in ("0", "false")
    out = []
    for p in body.findall(f"{_W}p"):
        how, run = p.find(f"{_W}pPr"), p.find(f"{_W}r")
        look = None if run is None else run.find(f"{_W}rPr")
        style = value(how, f"{_W}pStyle")
        style = named.get(style) or style
        heading = "heading" in (style or "").lower()
        level = re.search(r"\d+", style or "") if heading else None
        said = "".join(t.text or "" for t in p.iter(f"{_W}t"))
        out.append({
            "text": said, "style_name": style, "is_heading": heading, "heading_level": int(level[0]) if level else None,
            "is_bold": on(look, f"{_W}b"), "is_italic": on(look, f"{_W}i"), "alignment": value(how, f"{_W}jc"),
        })
    return out


def docx_tables(content: bytes) -> list[dict]:
    """Each table of a DOCX body: headers, rows, structured_rows (maps by header where the
    widths agree), row_count, col_count, has_merged_cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    cell = lambda c: re.sub(r"\s+", " ", " ".join(x for x in ("".join(t.text or "" for t in p.iter(f"{_W}t")).strip() for p in c.findall(f"{_W}p")) if x)).strip()
    out = []
    for t in body.findall(f"{_W}tbl"):
        rows = [[cell(c) for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")]
        full = [r for r in rows if any(r)]
        head, rest = (full[0], full[1:]) if full else ([], [])
        merged = any(next(t.iter(f"{_W}{k}"), None) is not None for k in ("gridSpan", "vMerge"))
        out.append({
            "headers": head, "rows": rest, "structured_rows": [dict(zip(head, r)) for r in rest if len(r) == len(head)],
            "row_count": len(rows), "col_count": max(map(len, rows), default=0), "has_merged_cells": merged,
        })
    return out


_STYLED = "path string, paragraphs array<struct<text:string,style_name:string,is_heading:boolean,heading_level:int,is_bold:boolean,is_italic:boolean,alignment:string>>"
_TABLES = "array<struct<headers:array<string>,rows:array<array<string>>,structured_rows:array<map<string,string>>,row_count:int,col_count:int,has_merged_cells:boolean>>"


def docx_structure(files: DataFrame) -> DataFrame:
    """path, paragraphs, tables, error of the DOCX files among files made by read()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    rows.append((path, docx_paragraphs(content), docx_tables(content), None))
                except Exception as e:  # a broken file is a row, not a failed job
                    rows.append((path, [], [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "paragraphs", "tables", "error"])

    return files.where("format = 'docx' AND error IS NULL").select("path", "content").mapInPandas(run, f"{_STYLED}, tables {_TABLES}, error string")


def csv_file_text(content: bytes) -> str:
    import csv

    body = decode(content)
    try:
        dialect = csv.Sniffer().sniff(body[:1024])
    except csv.Error:
        dialect = csv.excel
    reader = csv.DictReader(io.StringIO(body, newline=""), dialect=dialect)
    out, n = (["Заголовки: " + ", ".join(reader.fieldnames)] if reader.fieldnames else []), 0
    for i, row in enumerate(reader, 1):
        full = [f"{k}: {v}" for k, v in row.items() if isinstance(v, str) and v.strip()]
        if n >= MOST_ROWS:
            return "\n".join([*out, f"... (файл содержит больше строк, показаны первые {n})"])
        if full:
            out.append(f"Строка {i}: " + "; ".join(full))
            n += 1
    return "\n".join(out)


def extracted(files: DataFrame) -> DataFrame:
    """path, format, text (cleaned), error of files made by read()."""
    tools = {"docx": docx_text, "csv": csv_file_text, "json": lambda b: "\n".join(json_lines(json.loads(decode(b))))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, "content"):
            texts, errors = [], []
            for kind, content, error in zip(*(c.to_pylist() for c in b.columns[1:])):
                body = None
                if error is None:
                    try:
                        body = tools[kind](content)
                        error = None if body.strip() else "no text"
                    except Exception as e:  # a broken file is a row, not a failed job
                        error = f"{type(e).__name__}: {e}"
                texts.append(body), errors.append(error)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "format", "text", "error"])

    out = files.select("path", "format", "content", "error").mapInArrow(run, "path string, format string, text string, error string")
    return out.withColumn("text", text.clean(F.col("text")))
