"""Files as tables of (source, pos, text): plain text, CSV, spreadsheets and PDF, chosen by suffix."""

from __future__ import annotations

import csv
import io
import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import resources as R
from ..functions import text as X
from ..functions.regex import SPACE

SCHEMA = "source string, pos int, text string"


class UnsupportedFormat(ValueError):
    """No reader for a file's suffix."""


class MissingColumn(ValueError):
    """A named column that a sheet doesn't have."""


def text_column(names: list[str]) -> str | None:
    """The likeliest text column: by the order of the known names, not of the header; case and outer spaces don't count."""
    by = {n.lower().strip(): n for n in names if n}
    return next((by[c] for c in R.TEXT_COLUMNS if c in by), None)


def paragraphs(c: Column) -> Column:
    """Parts of a text between blank lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, rf"(?U)\n{SPACE}*\n"), X.strip), lambda p: p != "")


def lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\r?\n"), X.strip), lambda p: p != "")


#: Bytes of a table, by Catalyst's estimate, that a task should have; estimates of more than KNOWN_BYTES are none.
PIECE_BYTES, KNOWN_BYTES = 4 << 20, 1 << 50


def pieces(df: DataFrame) -> int | None:
    """Into how many tasks a table should be dealt: two a core at least, and no more than PIECE_BYTES each; None if its size isn't known."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // PIECE_BYTES)) if size < KNOWN_BYTES else None


def spread(df: DataFrame) -> DataFrame:
    """A table dealt to tasks of a size that doesn't grow with it: the files' row groups can be few and large. One of unknown size as it is."""
    n = pieces(df)
    return df.repartition(n) if n else df


def dealt(df: DataFrame, key: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """The same with all rows of a key in one task, so that grouping by it, or by it and more, shuffles nothing else; of the
    columns named, if any are: the estimate for few columns takes no account of texts being the largest."""
    n = pieces(df)
    d = df.select(*columns) if columns else df
    return d.repartition(n, key) if n else d.repartition(key)


def read_txt(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """Paragraphs of each file."""
    if encoding.lower().replace("-", "") == "utf8":
        raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("t"))
    else:
        raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), F.decode("content", encoding).alias("t"))
    return raw.select("source", F.posexplode(paragraphs(F.col("t"))).alias("pos", "text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("t"))
    return raw.select("source", F.posexplode(lines(F.col("t"))).alias("pos", "text"))


CHARSETS = ("utf-8", "cp1251", "latin-1")


def decoded(raw: bytes, preferred: str = "utf-8") -> str:
    """Text of bytes in the first charset that takes them; latin-1 takes any."""
    for name in (preferred, *CHARSETS):
        try:
            return raw.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    raise AssertionError("latin-1 takes all bytes")


def _csv_cells(column: str | None, encoding: str):
    def run(batches):
        for pdf in batches:
            out = []
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                rows = csv.reader(io.StringIO(decoded(bytes(raw), encoding), newline=""))
                header = next(rows, [])
                name = column or text_column(header) or (header[0] if header else None)
                if name in header:
                    at = header.index(name)
                    cells = (r[at].strip() for r in rows if at < len(r))
                    out += [(path, i, t) for i, t in enumerate(c for c in cells if c)]
            yield pd.DataFrame(out, columns=["source", "pos", "text"]).astype({"pos": "int32"})

    return run


def read_csv(spark: SparkSession, path: str, column: str | None = None, encoding: str = "utf-8") -> DataFrame:
    """The text column's cells, stripped, without empty ones; a column that isn't there gives nothing.

    Files of valid UTF-8 are read by the native reader. If any isn't, each is decoded by the first charset that takes it,
    a file a task.
    """
    raw = spark.read.format("binaryFile").load(path)
    plain = encoding.lower().replace("-", "") == "utf8" and raw.filter(~F.is_valid_utf8(F.col("content").cast("string"))).limit(1).count() == 0
    if not plain:
        return raw.select("path", "content").mapInPandas(_csv_cells(column, encoding), SCHEMA)
    d = spark.read.csv(path, header=True, multiLine=True, escape='"')
    name = column or text_column(d.columns) or (d.columns[0] if d.columns else None)
    if name not in d.columns:
        return spark.createDataFrame([], SCHEMA)
    cells = d.select(F.input_file_name().alias("source"), F.monotonically_increasing_id().alias("_i"), X.strip(F.col(f"`{name}`")).alias("text")).filter("text <> ''")
    return cells.select("source", (F.row_number().over(Window.partitionBy("source").orderBy("_i")) - 1).alias("pos"), "text")


class _Paths(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _FileReader(DataSourceReader):
    def __init__(self, options, load: Callable):
        self.options, self.load = options, load

    def partitions(self):
        base = self.options["path"].removeprefix("file://")
        found = [base] if os.path.isfile(base) else sorted(os.path.join(base, f) for f in os.listdir(base) if f.lower().endswith(self.options.get("suffix", "")))
        return [_Paths(p) for p in found]

    def read(self, partition):
        yield from ((partition.path, i, t) for i, t in enumerate(self.load(partition.path, self.options)))


def _sheet_cells(path: str, options) -> list[str]:
    from openpyxl import load_workbook

    book = load_workbook(path, read_only=True, data_only=True)
    sheet = book[options["sheet"]] if options.get("sheet") else book.active
    rows = sheet.iter_rows(values_only=True)
    header = ["" if x is None else str(x) for x in next(rows, ())]
    column = options.get("column") or text_column(header) or (header[0] if header else None)
    if column not in header:
        raise MissingColumn(f"no column {column!r} among {', '.join(header)}")
    at = header.index(column)
    return [t for r in rows if at < len(r) and r[at] and (t := str(r[at]).strip())]


def _pdf_pages(path: str, options) -> list[str]:
    import pymupdf

    with pymupdf.open(path) as doc:
        return [t for page in doc if (t := page.get_text().strip())]


class SheetSource(DataSource):
    """spark.read.format("sheet").option("column", ...).load(path), over openpyxl."""

    @classmethod
    def name(cls):
        return "sheet"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _FileReader(self.options, _sheet_cells)


class PdfSource(DataSource):
    """spark.read.format("pdfpages").load(path), one row a page with text, over pymupdf."""

    @classmethod
    def name(cls):
        return "pdfpages"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _FileReader(self.options, _pdf_pages)


def _from_source(source: type[DataSource]) -> Callable[..., DataFrame]:
    def read(spark: SparkSession, path: str, **options) -> DataFrame:
        spark.dataSource.register(source)
        return spark.read.format(source.name()).options(**{k: v for k, v in options.items() if v is not None}).load(path)

    return read


READERS: dict[str, Callable[..., DataFrame]] = {".txt": read_txt, ".csv": read_csv, ".xlsx": _from_source(SheetSource), ".pdf": _from_source(PdfSource)}


def read_file(spark: SparkSession, path: str, **options) -> DataFrame:
    """source, pos, text of a file, by its suffix in any case."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in READERS:
        raise UnsupportedFormat(f"no reader for {suffix or 'a file without suffix'!r}; there are {', '.join(READERS)}")
    return READERS[suffix](spark, path, **options)


def resolve(spark: SparkSession, source: DataFrame | list[str] | str, **options) -> DataFrame:
    """A table as it is; texts of a list; a path's texts."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, list):
        return spark.createDataFrame([("", i, t) for i, t in enumerate(source)], SCHEMA)
    return read_file(spark, str(source), **options)


def write_lines(df: DataFrame, path: str, text: str = "text") -> None:
    df.select(text).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def asset(name: str, folder: str | None = None) -> str:
    """Path of a resource file: in the folder given, or that of WORDKILN_ASSETS, or among the packaged ones. None is downloaded."""
    for base in (folder, os.environ.get("WORDKILN_ASSETS"), os.path.dirname(os.path.dirname(__file__))):
        for sub in ("", "lexicon", "db"):
            if base and os.path.isfile(p := os.path.join(base, sub, name)):
                return p
    raise FileNotFoundError(f"no asset {name!r}; set WORDKILN_ASSETS to the folder that holds it")
