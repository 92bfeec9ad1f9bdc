"""Readers and writers of the file forms in use: CSV, JSON lines, text, workbooks, SQLite, snapshots."""

from __future__ import annotations

import sqlite3
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from rankweave.session import exists


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, squash: tuple[str, ...] = ()) -> DataFrame:
    """SRC1 to SRC4: all columns as text, missing ones as '', headers trimmed, a byte order mark ignored.

    Quoted fields may span lines and be of any length; ``squash`` names columns whose line breaks become spaces.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("maxCharsPerColumn", -1).option("mode", "PERMISSIVE")
    if columns:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    df = reader.csv(path)
    df = df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])
    return df.select(*[(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " ") if c in squash else F.coalesce(c, F.lit(""))).alias(c) for c in df.columns])


def read_first_comma(spark: SparkSession, path: str, names: tuple[str, str] = ("prompt_id", "query")) -> DataFrame:
    """SRC5, SRC6: two columns, cut at the first comma only; a header line is left out."""
    part = F.split("value", ",", 2)
    t = spark.read.text(path).filter(F.trim("value") != "")
    df = t.select(F.trim(part[0]).alias(names[0]), F.regexp_replace(F.trim(F.coalesce(F.get(part, F.lit(1)), F.lit(""))), '^"|"$', "").alias(names[1]))
    return df.filter(F.lower(names[0]) != names[0].lower())


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC10: JSON lines; unreadable lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_matching(spark: SparkSession, paths: list[str], needed: list[str]) -> DataFrame:
    """SRC11: the CSV files that have all ``needed`` columns, united by name, with the ordinal of each file."""
    parts = []
    for i, p in enumerate(sorted(paths)):
        df = read_csv(spark, p)
        if set(needed) <= set(df.columns):
            parts.append(df.withColumn("file_no", F.lit(i)))
    if not parts:
        return spark.createDataFrame([], ", ".join([*(f"`{c}` string" for c in needed), "file_no int"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """SRC12: whole text files with their paths."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", F.decode("content", "UTF-8").alias("text"), "length")


class _Part(InputPartition):
    pass


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.path, self.sheet = schema.names, options["path"], options.get("sheet")

    def partitions(self):
        return [_Part(0)]

    def read(self, partition) -> Iterator[tuple]:
        head = None
        for cells in sheet_rows(self.path, self.sheet):
            if head is None:
                head = [str(c).strip() if c is not None else "" for c in cells]
                continue
            row = dict(zip(head, cells))
            if any(v not in (None, "") for v in cells):
                yield tuple(row.get(n) for n in self.names)


class WorkbookSource(DataSource):
    """SRC7, SRC8: ``format("workbook")`` reads one sheet (by name, else the first) as text columns, found by header."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        head = next(iter(sheet_rows(self.options["path"], self.options.get("sheet"))), [])
        return ", ".join(f"`{str(c).strip()}` string" for c in head if c not in (None, ""))

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader(schema, dict(self.options))


_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_rows(path: str, sheet: str | None) -> Iterator[list]:
    """Rows of cells (text or None) of a workbook's sheet, read as a stream."""
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_M}t")) for si in ElementTree.parse(z.open("xl/sharedStrings.xml")).getroot()]
        sheets = {s.get("name"): s.get(_R) for s in ElementTree.parse(z.open("xl/workbook.xml")).getroot().iter(f"{_M}sheet")}
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()}
        target = targets[sheets[sheet] if sheet else next(iter(sheets.values()))].lstrip("/")
        with z.open(target if target.startswith("xl/") else f"xl/{target}") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_M}row":
                    continue
                cells: list = []
                for c in row.iter(f"{_M}c"):
                    letters = "".join(x for x in c.get("r", "") if x.isalpha())
                    at = 0
                    for x in letters:
                        at = at * 26 + ord(x) - 64
                    cells += [None] * (max(at, len(cells) + 1) - len(cells) - 1)
                    v, inline = c.find(f"{_M}v"), c.find(f"{_M}is")
                    if inline is not None:
                        cells.append("".join(t.text or "" for t in inline.iter(f"{_M}t")))
                    elif v is None:
                        cells.append(None)
                    else:
                        cells.append(shared[int(v.text)] if c.get("t") == "s" else v.text)
                row.clear()
                yield cells


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.path, self.query, self.n = options["path"], options["query"], len(schema.names)

    def partitions(self):
        return [_Part(0)]

    def read(self, partition) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            for row in db.execute(self.query):
                yield tuple(None if v is None else str(v) for v in row)


class SqliteSource(DataSource):
    """SRC9: ``format("sqlite")`` reads a query of a database file as text columns."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            return ", ".join(f"`{d[0]}` string" for d in db.execute(self.options["query"]).description)

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)
    spark.dataSource.register(SqliteSource)


def write_csv(df: DataFrame, path: str, preferred: list[str] | None = None, quote_all: bool = False, one_line: bool = False) -> None:
    """SNK1, SNK2, SNK2b: preferred columns first, then the others; quotes doubled; line breaks kept or made spaces."""
    order = [c for c in preferred or [] if c in df.columns]
    df = df.select(*order, *[c for c in df.columns if c not in order])
    if one_line:
        df = df.select(*[F.regexp_replace(c, r"[\r\n]+", " ").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", quote_all).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_version(df: DataFrame, folder: str) -> str:
    """SNK3: a table is replaced by writing it beside the old one; returns the new version's path."""
    path = f"{folder.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def append_jsonl(df: DataFrame, path: str) -> None:
    """SNK4."""
    df.write.mode("append").json(path)


def write_snapshots(df: DataFrame, key_hash: str, text: str, order: str, path: str) -> None:
    """SNK5: each content once, under its hash; contents already there are not written again."""
    from rankweave.operators.setops import first_wins

    spark = df.sparkSession
    fresh = first_wins(df.filter(F.trim(F.coalesce(text, F.lit(""))) != ""), [key_hash], [order]).select(F.col(key_hash).alias("hash"), F.col(text).alias("text"))
    if exists(spark, path):
        fresh = fresh.join(spark.read.schema("hash string, text string").parquet(path).select("hash"), "hash", "left_anti")
    fresh.write.mode("append").parquet(path)
