"""Reading and writing tables: delimited text, CSV uploads, workbooks, Parquet."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.functions.numbers import known, to_number

DELIMITERS = (",", "\t", ";")


def detect_delimiter(text: str) -> str:
    """The most frequent of comma, tab and semicolon in the first line that isn't blank; a comma if there is none."""
    line = next((x for x in text.splitlines() if x.strip()), "")
    return max(DELIMITERS, key=line.count)


def normal_headers(raw: list[str]) -> list[str]:
    """Unique names: ``Variable_3`` for a blank third one, ``name_2`` for a second ``name``."""
    out: list[str] = []
    for i, name in enumerate(raw):
        name = (name or "").strip() or f"Variable_{i + 1}"
        new, n = name, 1
        while new in out:
            n += 1
            new = f"{name}_{n}"
        out.append(new)
    return out


def _cleaned(df: DataFrame) -> DataFrame:
    """Trimmed cells, blank ones null; rows without any cell go."""
    names = normal_headers([re.sub(r"^﻿", "", c) for c in df.columns])
    df = df.toDF(*[f"c{i}" for i in range(len(names))])
    blank = F.lit(" \t\n\x0b\x0c\r\xa0\ufeff")
    df = df.select(*[F.nullif(F.btrim(F.col(f"c{i}").cast("string"), blank), F.lit("")).alias(f"c{i}") for i in range(len(names))])
    return df.dropna(how="all").toDF(*names)


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, record): the records of delimited text, each as one text, whatever newlines its quotes hold.

    The file is read as lines, in blocks that Spark splits as it likes.  A line
    begins a record where an even number of quotes lies before it.  Each block
    counts its own in one pass; the blocks' parities, added up in their order (one
    row a block), say how a block begins, and to which earlier record its first
    lines belong.  Only lines of records that span several are shuffled.  ``block``
    and ``n`` order the records of a file.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.option("lineSep", "\n").text(path).select("value", *place, F.monotonically_increasing_id().alias("n"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, odd, last = None, 0, [None, None]  # last: the line that began a record, if the block begins outside quotes, or within
        for batch in batches:
            out = []
            for value, file, at, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (file, at) != block:
                    block, odd, last = (file, at), 0, [None, None]
                last[odd] = n
                quotes = value.count('"') & 1
                out.append((odd, quotes, *last))
                odd ^= quotes
            more = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "odd", "quotes", "last0", "last1"])

    rows = lines.mapInArrow(marked, "value string, file string, block long, n long, odd int, quotes int, last0 long, last1 long")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("file", "block").agg((F.sum("quotes") % 2).alias("ends"), F.max("last0").alias("last0"), F.max("last1").alias("last1"))
    blocks = blocks.withColumn("inside", F.coalesce(F.sum("ends").over(earlier), F.lit(0)) % 2)
    began = F.when(F.col("inside") == 0, F.col("last0")).otherwise(F.col("last1"))
    blocks = blocks.withColumn("began", F.when(began.isNotNull(), F.struct("block", began.alias("n"))))
    blocks = blocks.select("file", "block", "inside", F.last("began", ignorenulls=True).over(earlier).alias("carried"))
    own = F.when(F.col("inside") == 0, F.col("last0")).otherwise(F.col("last1"))
    rows = rows.join(blocks, ["file", "block"]).withColumns({
        "of": F.coalesce(F.when(own.isNotNull(), F.struct("block", own.alias("n"))), F.col("carried")),
        "whole": (F.col("odd") == F.col("inside")) & (F.col("quotes") == 0),
    })
    parts = rows.filter(~F.col("whole")).groupBy("file", "of").agg(F.sort_array(F.collect_list(F.struct("block", "n", "value"))).alias("parts"))
    several = parts.select("file", "of.block", "of.n", F.array_join(F.transform("parts", lambda x: x["value"]), "\n").alias("record"))
    return rows.filter("whole").select("file", "block", "n", F.col("value").alias("record")).unionByName(several)


def _cells(spark: SparkSession, path: str, sep: str, ordered: bool) -> tuple[list[str], DataFrame]:
    """The cells of a file's first record, and a table of all the others' as texts, sorted as in the file if ``ordered``."""
    records = quoted_records(spark, path).filter(F.trim(F.translate("record", "\r\ufeff", "")) != "")
    options = {"sep": sep, "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
    first = records.orderBy("file", "block", "n").limit(1).collect()
    if not first:
        raise ValueError("the file is empty")
    head = first[0]
    wide = ", ".join(f"c{i} string" for i in range(head["record"].count(sep) + 1))
    one = spark.createDataFrame([(head["record"].removeprefix("\ufeff"),)], "record string")
    names = [re.sub(r"^\ufeff", "", c or "") for c in one.select(F.from_csv("record", F.lit(wide), options).alias("r")).select("r.*").first()]
    while len(names) > 1 and not names[-1] and head["record"].count('"'):  # separators within quotes are no cells
        names.pop()
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    # Every file of a folder begins with its header, as with other readers.
    firsts = records.groupBy("file").agg(F.min(F.struct("block", "n")).alias("first"))
    body = records.join(F.broadcast(firsts), "file").filter(F.struct("block", "n") != F.col("first"))
    body = body.orderBy("file", "block", "n") if ordered else body
    return names, body.select(F.from_csv("record", F.lit(schema), options).alias("r")).select("r.*")


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, ordered: bool = True) -> DataFrame:
    """A delimited file as text cells; short rows are filled with nulls, cells beyond the header dropped.

    Rows come in the file's order, by a sort in ranges; ``ordered=False`` spares it.
    """
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    if not first:
        raise ValueError("the file is empty")
    names, body = _cells(spark, path, delimiter or detect_delimiter(first[0][0]), ordered)
    return _cleaned(body.toDF(*normal_headers(names)))


def read_upload(spark: SparkSession, path: str, ordered: bool = True) -> DataFrame:
    """A CSV upload: missing-value texts are nulls, and columns of numbers become doubles."""
    names, raw = _cells(spark, path, ",", ordered)
    raw = raw.toDF(*normal_headers(names))
    rows = raw.select(*[known(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    fine = rows.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & to_number(F.col(f"`{c}`")).isNull()).alias(f"b{i}") for i, c in enumerate(rows.columns)]).first()
    return rows.select(*[(to_number(F.col(f"`{c}`")) if fine[i] == 0 else F.col(f"`{c}`")).alias(c) for i, c in enumerate(rows.columns)])


def from_rows(spark: SparkSession, rows: list[list]) -> DataFrame:
    """A sheet's rows, the first being the header, as text cells."""
    if len(rows) < 2:
        raise ValueError("a header and at least one row are needed")
    names = normal_headers([str(c or "") for c in rows[0]])
    cells = [[None if c is None else str(c).strip() for c in r[: len(names)]] + [None] * (len(names) - len(r)) for r in rows[1:]]
    return _cleaned(spark.createDataFrame([tuple(r) for r in cells], ", ".join(f"`{n}` string" for n in names)))


def from_text(spark: SparkSession, text: str) -> DataFrame:
    """Pasted text as a table."""
    import csv

    text = text.removeprefix("﻿")
    return from_rows(spark, [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=detect_delimiter(text)) if any(c.strip() for c in r)])


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def workbook_sheets(data: bytes) -> dict[str, list[list[str]]]:
    """The sheets of an .xlsx workbook as rows of texts, by name in order."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = {}
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).find("m:sheets", _NS):
        target = links[sheet.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")]
        rows: list[list[str]] = []
        for row in ElementTree.fromstring(book.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{{{_NS['m']}}}row"):
            cells: list[str] = []
            for cell in row.findall("m:c", _NS):
                letters = re.match(r"[A-Z]+", cell.get("r") or "")
                at = sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                cells += [""] * (at - len(cells))
                value = cell.find("m:v", _NS)
                text = value.text or "" if value is not None else "".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t"))
                cells.append(shared[int(text)] if cell.get("t") == "s" and text else text)
            rows.append(cells)
        out[sheet.get("name")] = rows
    return out


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """One sheet of an .xlsx file, the first unless named; a workbook is small by its format."""
    sheets = workbook_sheets(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))
    return from_rows(spark, sheets[sheet or next(iter(sheets))])


def with_row_order(df: DataFrame, name: str = "_row_id") -> DataFrame:
    """``df`` with a number that follows the order of its files and rows."""
    return df.withColumn(name, F.monotonically_increasing_id())


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quoteAll=False, escape='"')


#: The sample table.
DEMO = """Source,Group,Score,Age,Pre,Post,Satisfaction
Online,A,72,21,60,66,High
Store,A,81,22,65,68,High
Online,A,77,24,70,74,Medium
Store,A,85,23,68,72,High
Online,B,79,25,72,75,Medium
Store,B,88,20,75,80,High
Online,B,88,20,64,68,High
Store,B,91,22,69,72,High
Online,C,79,25,71,75,Medium
Store,C,94,24,73,76,High
Online,C,86,23,76,80,High
Store,C,90,26,78,82,Medium
"""


def demo(spark: SparkSession) -> DataFrame:
    return from_text(spark, DEMO)
