"""CSV ingest with delimiter choice, bad-line policy and row gates."""

from __future__ import annotations

import csv
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtab.constants import MIN_ROWS, NA_TOKENS

DELIMITERS = [",", ";", "\t"]
OVERFLOW = "_overflow"


def _header(spark: SparkSession, path: str) -> str:
    lines = spark.read.option("pathGlobFilter", "*.csv").text(path)
    first = lines.where(F.trim("value") != "").limit(1).collect()
    if not first:
        raise ValueError("Could not parse CSV file: no rows")
    return first[0][0].lstrip("﻿")


def sniff_delimiter(header: str) -> str:
    """Comma unless it leaves a single column that another delimiter splits."""
    for sep in DELIMITERS:
        if len(next(csv.reader([header], delimiter=sep))) > 1:
            return sep
    return DELIMITERS[0]


def column_names(header: str, sep: str) -> list[str]:
    """Header cells with blanks named and repeats numbered."""
    names: list[str] = []
    for i, cell in enumerate(next(csv.reader([header], delimiter=sep))):
        base = cell if cell != "" else f"Unnamed: {i}"
        name, n = base, 0
        while name in names:
            n += 1
            name = f"{base}.{n}"
        names.append(name)
    return names


def check_rows(df: DataFrame, min_rows: int = MIN_ROWS, max_rows: int | None = None) -> None:
    """Row gates that never count more rows than they must."""
    seen = df.limit(min_rows).count()
    if seen < min_rows:
        raise ValueError(f"DataFrame has only {seen} rows (minimum: {min_rows})")
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"DataFrame has more than {max_rows} rows (maximum: {max_rows})")


def check_column(df: DataFrame, text_col: str) -> None:
    if text_col not in df.columns:
        raise ValueError(f"Column '{text_col}' not found in DataFrame")


def read_feedback_csv(spark: SparkSession, path: str, sep: str | None = None,
                      min_rows: int | None = MIN_ROWS, max_rows: int | None = None,
                      multi_line: bool = True, id_col: str = "row_id") -> DataFrame:
    """All-string table from the ``*.csv`` files under a path, with a row id.

    Short rows are padded with NULL, rows with too many cells are skipped, and the
    usual missing-value tokens become NULL. ``multi_line`` keeps line breaks inside
    quotes; a file is then read by one task, so turn it off for large files without
    such cells. The id follows file order within a file; write the table down
    before anything shuffles it.
    """
    if path.rsplit("/", 1)[-1].count(".") and not path.endswith((".csv", "*")):
        raise ValueError("Only CSV files are supported")
    header = _header(spark, path)
    sep = sep or sniff_delimiter(header)
    names = column_names(header, sep)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, OVERFLOW]])
    raw = (
        spark.read.schema(schema)
        .options(sep=sep, header=True, quote='"', escape='"', multiLine=multi_line,
                 enforceSchema=True, pathGlobFilter="*.csv", nullValue="\u0000",
                 maxCharsPerColumn=-1)
        .csv(path)
    )
    cells = [F.when(~F.col(f"`{n}`").isin(*NA_TOKENS), F.col(f"`{n}`")).alias(n) for n in names]
    df = raw.where(F.col(OVERFLOW).isNull()).select(
        F.monotonically_increasing_id().alias(id_col), *cells)
    if min_rows is not None:
        check_rows(df, min_rows, max_rows)
    return df


def file_heads(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and ``header``: the first line with content of each ``*.csv`` file under a path.

    One pass over the lines; each file sends one line from each task that reads its beginning.
    """
    lines = spark.read.option("pathGlobFilter", "*.csv").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), "value")
    first = lines.where((F.col("start") == 0) & (F.trim("value") != ""))
    return first.groupBy("file").agg(F.min_by("value", "at").alias("header"))


def dialects(spark: SparkSession, path: str) -> dict[tuple[str, tuple[str, ...]], list[str]]:
    """The files of a folder by delimiter and column names. The driver gets the name and header of each file."""
    groups: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    for r in sorted(file_heads(spark, path).collect()):
        header = r.header.lstrip("\ufeff")
        sep = sniff_delimiter(header)
        groups.setdefault((sep, tuple(column_names(header, sep))), []).append(unquote(r.file))
    if not groups:
        raise ValueError("Could not parse CSV file: no rows")
    return groups


def read_csv_folder(spark: SparkSession, path: str, multi_line: bool = True, id_col: str = "row_id",
                    file_col: str = "file") -> tuple[DataFrame, DataFrame]:
    """All-string table of ``*.csv`` files that may differ in delimiter and columns, and the lines skipped in each.

    Each file is read by its own header: files alike in delimiter and columns are one
    scan, and scans are united by column name; a column that a file lacks is NULL.
    Rows, their missing values and ids are as ``read_feedback_csv`` has them;
    ``file_col`` names a row's file. The second table has ``file_col``, ``rows`` and
    ``skipped`` (rows with more cells than the header) of every file with rows. Files
    of blanks alone have neither rows nor header.
    """
    parts, counts = [], []
    for (sep, names), files in dialects(spark, path).items():
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, OVERFLOW]])
        raw = spark.read.schema(schema).options(
            sep=sep, header=True, quote='"', escape='"', multiLine=multi_line, enforceSchema=True,
            nullValue="\u0000", maxCharsPerColumn=-1).csv(files).withColumn(file_col, F.col("_metadata.file_path"))
        counts.append(raw.groupBy(file_col).agg(
            F.count_if(F.col(OVERFLOW).isNull()).alias("rows"), F.count(OVERFLOW).alias("skipped")))
        cells = [F.when(~F.col(f"`{n}`").isin(*NA_TOKENS), F.col(f"`{n}`")).alias(n) for n in names]
        parts.append(raw.where(F.col(OVERFLOW).isNull()).select(file_col, *cells))
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return (table.withColumn(id_col, F.monotonically_increasing_id()),
            reduce(lambda a, b: a.unionByName(b), counts))
