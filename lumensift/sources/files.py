"""Files to rows of page text. A file that can't be read is a row with an error, never an exception."""

from __future__ import annotations

import collections
import csv
import html
import html.entities
import io
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lumensift.functions import lexicons
from lumensift.functions import text as T

PAGE = "filename string, page int, total_pages int, file_type string, sheet_name string, source string, text string, error string"


def folder(spark: SparkSession, path: str) -> DataFrame:
    """All files below path: path, filename, file_type (suffix with dot), supported, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return typed(files)


def typed(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    ext = T.extension(F.col("filename"))
    return files.withColumn("filename", name).withColumn("file_type", ext).withColumn("supported", ext.isin(lexicons.EXTENSIONS))


def kind_of(extension: Column) -> Column:
    """The file type of an extension with its dot: lexicons.FILE_TYPES, else the extension itself."""
    out = F.regexp_replace(extension, r"^\.", "")
    for name, extensions in lexicons.FILE_TYPES:
        out = F.when(extension.isin(extensions), name).otherwise(out)
    return out


def last_of_name(files: DataFrame) -> DataFrame:
    """One file of each name: the last by path."""
    order = Window.partitionBy("filename").orderBy(F.desc("path"))
    return files.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def strict_text(content: Column) -> Column:
    """UTF-8 with line ends made one newline; null where the bytes aren't UTF-8."""
    return _one_newline(F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")))


def lenient_text(content: Column) -> Column:
    """UTF-8 without the bytes that aren't."""
    return _one_newline(F.regexp_replace(F.make_valid_utf8(content.cast("string")), "�", ""))


def _one_newline(text: Column) -> Column:
    return T.where(text, ["\r"], lambda t: F.regexp_replace(t, r"\r\n?", "\n"))


@F.pandas_udf(StringType())
def _printed_json(batch: pd.Series) -> pd.Series:
    out = []
    for text in batch:
        try:
            out.append(None if text is None else json.dumps(json.loads(text), indent=2, ensure_ascii=False))
        except (ValueError, RecursionError):  # not JSON, or nested too deeply to be printed
            out.append(None)
    return pd.Series(out, dtype=object)


def json_text(text: Column) -> Column:
    """JSON printed anew with indents, then cleaned; null if it can't be parsed."""
    return _cleaned(_printed_json(text))


def _cleaned(text: Column) -> Column:
    return F.when(text.isNotNull(), T.clean_loaded(text))


@F.pandas_udf(StringType())
def _csv_rows(batch: pd.Series) -> pd.Series:
    csv.field_size_limit(2**31 - 1)  # a text is no longer than that
    missing, out = set(lexicons.MISSING), []
    for text in batch:
        try:
            head, *rows = (None,) if text is None else [r for r in csv.reader(io.StringIO(text)) if r] or [[]]
        except csv.Error:
            head, rows = None, []
        if head is None:
            out.append(None)
            continue
        lines, seen = [], collections.Counter()
        for i, name in enumerate(head):
            name = name or f"Unnamed: {i}"
            head[i] = f"{name}.{seen[name]}" if seen[name] else name
            seen[name] += 1
        for i, row in enumerate(rows):
            parts = [f"{h}: {v}" for h, v in zip(head, row, strict=False) if v not in missing and v.strip()]
            if parts:
                lines.append(f"Row {i + 1}: " + " | ".join(parts))
        out.append("\n".join(lines))
    return pd.Series(out, dtype=object)


@F.pandas_udf(StringType())
def _unescaped(batch: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else html.unescape(x) for x in batch], dtype=object)


#: An entity with the semicolon at its end.
ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


@F.pandas_udf(StringType())
def _unescaped_whole(batch: pd.Series) -> pd.Series:
    # of a name that isn't known, html.unescape would decode a known beginning
    one = lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html.entities.html5 else m[0]
    return pd.Series([None if x is None else ENTITY.sub(one, x) for x in batch], dtype=object)


def html_page(text: Column, whole_only: bool = False) -> Column:
    """The visible text of a page, with comments dropped and every named or numeric entity decoded; as in a browser also those of old names that
    lack their semicolon, as where a text was cut inside one, unless whole_only."""
    seen = T.visible(F.regexp_replace(text, r"(?s)<!--.*?-->", ""))
    return _unescaped_whole(seen) if whole_only else _unescaped(seen)


def csv_text(text: Column) -> Column:
    """A file's rows as `Row i: column: value | ...`; each file has its own header. Values stay as written, those of lexicons.MISSING and blank
    ones are left out. Blank lines are no rows. Columns without a name are `Unnamed: n`, those of a name again `name.1` and so on."""
    return _cleaned(_csv_rows(text))


def row_text(columns: list[str], number: Column) -> Column:
    """One row of a table as `Row i: column: value | ...` without nulls and blanks; null for a row with nothing."""
    cells = [F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns]
    body = F.concat_ws(" | ", *cells)
    return F.when(body != "", F.concat(F.lit("Row "), number.cast("string"), F.lit(": "), body))


def sheet_pages(rows: DataFrame, columns: list[str], rows_in_part: int = 500) -> DataFrame:
    """Rows of decoded tables (filename, sheet, sheet_name, row_no, columns) as page rows: a sheet is a page, `sheet` its number in the file.

    The sheet's rows with something in them are its lines, in order of row_no, which may have gaps. A page is cut into parts of
    rows_in_part row numbers, so a sheet of any length is made on many tasks and never one row; `part` counts from 0 and chunks are numbered over it.
    """
    part = F.floor((F.col("row_no") - 1) / rows_in_part).cast("int")
    lines = rows.select("filename", "sheet", "sheet_name", part.alias("part"), "row_no", row_text(columns, F.col("row_no")).alias("line"))
    sheets = rows.groupBy("filename").agg(F.max("sheet").cast("int").alias("total_pages"))
    own = F.transform(F.sort_array(F.collect_list(F.struct("row_no", "line"))), lambda x: x["line"])
    text = lines.filter("line is not null").groupBy("filename", "sheet", "sheet_name", "part").agg(own.alias("lines"))
    text = text.join(sheets, "filename").withColumn("text", T.clean_loaded(F.array_join("lines", "\n"))).filter("text <> ''")
    return text.select("filename", F.col("sheet").cast("int").alias("page"), "total_pages", kind_of(T.extension(F.col("filename"))).alias("file_type"), "sheet_name", "part", F.lit(None).cast("string").alias("source"), "text", F.lit(None).cast("string").alias("error"))


def table_text(table: Column) -> Column:
    """Rows of cells as text: the first row is the header; rows of its width become `header: value` pairs, others their values."""
    trimmed = F.filter(F.transform(table, lambda r: F.transform(r, lambda c: T.strip(F.coalesce(c, F.lit(""))))), lambda r: F.exists(r, lambda c: c != ""))
    head = F.get(trimmed, F.lit(0))
    full = lambda r: F.filter(r, lambda c: c != "")
    pair = lambda r: F.filter(F.zip_with(head, r, lambda h, v: F.when((h != "") & (v != ""), F.concat(h, F.lit(": "), v)).otherwise("")), lambda c: c != "")
    lines = F.transform(trimmed, lambda r, i: F.array_join(F.when((i > 0) & (F.size(r) == F.size(head)), pair(r)).otherwise(full(r)), " | "))
    return F.coalesce(F.array_join(F.filter(lines, lambda x: x != ""), "\n"), F.lit(""))


def page_text(text: Column, tables: Column) -> Column:
    """Prose and tables of an extracted page, blank lines between them, cleaned."""
    parts = F.concat(F.array(F.coalesce(text, F.lit(""))), F.coalesce(F.transform(tables, table_text), F.array().cast("array<string>")))
    return T.clean_loaded(F.array_join(F.filter(parts, lambda x: F.trim(x) != ""), "\n\n"))


def extracted(pages: DataFrame) -> DataFrame:
    """Extracted pages (filename, page, text, tables, sheet_name where there is one) as page rows; empty pages are dropped but count in total_pages."""
    total = Window.partitionBy("filename")
    p = pages.withColumn("total_pages", F.max("page").over(total).cast("int")).withColumn("text", page_text(F.col("text"), F.col("tables")))
    return p.filter("text <> ''").select("filename", "page", "total_pages", kind_of(T.extension(F.col("filename"))).alias("file_type"), (F.col("sheet_name") if "sheet_name" in pages.columns else F.lit(None).cast("string")).alias("sheet_name"), F.lit(None).cast("string").alias("source"), "text", F.lit(None).cast("string").alias("error"))


def pages_text(files: DataFrame) -> DataFrame:
    """Files (path, filename, file_type, supported, content) to page rows. One pass: a file is read once, whatever its kind.

    Kinds that need a decoder (PDF, office files, images) come in by `extracted`; here they are rows with an error.
    """
    ext = F.col("file_type")
    lenient, table, tree, marked = ext.isin(".sql", ".dump"), ext == ".csv", ext == ".json", ext.isin(".html", ".htm")
    plain = ext.isin(".txt", ".md", ".markdown")
    text = F.when(lenient, lenient_text(F.col("content"))).when(plain | table | tree | marked, strict_text(F.col("content")))
    f = files.filter(ext.isNotNull()).select("path", "filename", "file_type", "supported", text.alias("_t"))
    # a reader of another kind gets a null, and all of them share one Python process
    only = lambda kind: F.when(kind, F.col("_t"))
    f = f.withColumns({"_page": html_page(only(marked)), "_table": _csv_rows(only(table)), "_tree": _printed_json(only(tree))})
    raw = F.when(marked, F.col("_page")).when(table, F.col("_table")).when(tree, F.col("_tree")).when(F.col("supported"), F.col("_t"))
    rows = f.withColumn("_raw", raw).withColumn("text", _cleaned(F.col("_raw")))
    error = F.when(~F.col("supported"), "unsupported").when(F.col("text").isNull(), "unreadable").when(F.col("text") == "", "no text")
    return rows.select("filename", F.lit(1).alias("page"), F.lit(1).alias("total_pages"), kind_of(F.col("file_type")).alias("file_type"), F.lit(None).cast("string").alias("sheet_name"), F.col("path").alias("source"), "text", error.alias("error"))


def write_transcripts(texts: DataFrame, path: str) -> None:
    texts.select("text").write.text(path)
