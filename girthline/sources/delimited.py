"""Delimited vendor files and canonical tables."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Byte order marks, longest first.
BYTE_ORDER_MARKS = (
    ("FFFE0000", "UTF-32LE"), ("0000FEFF", "UTF-32BE"), ("EFBBBF", "UTF-8"), ("FFFE", "UTF-16LE"), ("FEFF", "UTF-16BE"),
)


def file_encodings(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """(path, encoding) of every file: its byte order mark, else UTF-8 where valid, else Latin-1, which always is."""
    files = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    head = F.hex(F.substring("content", 1, 4))
    marked = F.lit(None).cast("string")
    for mark, encoding in reversed(BYTE_ORDER_MARKS):
        marked = F.when(head.startswith(mark), encoding).otherwise(marked)
    plain = F.when(F.is_valid_utf8(F.col("content").cast("string")), "UTF-8").otherwise("ISO-8859-1")
    return files.select("path", F.coalesce(marked, plain).alias("encoding"))


def read_rows(spark: SparkSession, paths: Sequence[str] | str, columns: int) -> DataFrame:
    """Rows of delimited files as (file, row_idx, values), each file decoded by its own encoding.

    A file is the tally of one run and is read whole by one task, which keeps its row order. Files are grouped
    by encoding, one scan per encoding.
    """
    by_encoding = defaultdict(list)
    for path, encoding in file_encodings(spark, paths).collect():  # one short row per file
        by_encoding[encoding].append(path)
    schema = ", ".join(f"_c{i} string" for i in range(columns))
    parts = []
    for encoding, files in sorted(by_encoding.items()):
        rows = spark.read.schema(schema).option("encoding", encoding).option("multiLine", True).csv(files)
        parts.append(rows.select(
            F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_id"),
            F.array(*[F.regexp_replace(f"_c{i}", "^﻿", "") for i in range(columns)]).alias("values"),
        ))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    first = rows.groupBy("file").agg(F.min("_id").alias("_first"))
    return rows.join(first, "file").select("file", (F.col("_id") - F.col("_first")).alias("row_idx"), "values")


def to_cells(rows: DataFrame, sheet: str = "csv") -> DataFrame:
    return rows.select("file", F.lit(sheet).alias("sheet"), F.col("row_idx").cast("int").alias("row_idx"), F.posexplode("values").alias("col_idx", "value"))


def is_empty_row(columns: Sequence[str]) -> Column:
    return F.concat_ws("", *columns) == ""


def drop_empty(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drops rows without any value, and columns that are empty throughout."""
    rows = df.where(~is_empty_row(columns))
    filled = rows.agg(*[F.count(F.nullif(F.col(c), F.lit(""))).alias(c) for c in columns]).first()
    return rows.drop(*[c for c in columns if not filled[c]])


def write_canonical(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Canonical tables, one folder per line and run so that later reads prune; each folder's rows come from one task or, where a
    line is large, from the few that adaptive execution splits it into."""
    df.hint("rebalance", "line_id", "run_id").write.mode("errorifexists").partitionBy("line_id", "run_id").format(form).option("header", True).save(path)
