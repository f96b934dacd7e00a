"""Record files: strict all-text CSV, the ordinal of each record, and their union by year."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.session import checkpointed, small_side

SOURCE_ROW = "source_row"
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")

#: Fixed dialect: comma, doubled quotes, header, UTF-8; a malformed record stops the read.
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "mode": "FAILFAST",
    "enforceSchema": "false",
    "encoding": "UTF-8",
    "nullValue": "",
    "emptyValue": "",
}

#: The same dialect for writing; by default the writer would trim the blanks of a cell.
CSV_WRITE = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "lineSep": "\n",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


class SourceRefused(ValueError):
    """A source file that cannot be staged as it is."""


def staged_columns(header: Sequence[str]) -> list[str]:
    """The staging name of each source column: its lower case.

    Refuses, all faults at once, a header that is empty or holds names that are no bare identifiers,
    reserved, or alike but for case.
    """
    lower = [name.lower() for name in header]
    faults = {
        "no columns": not lower,
        "no bare identifier": sorted(n for n in header if not _IDENTIFIER.match(n)),
        "reserved": sorted({SOURCE_ROW} & set(lower)),
        "repeated": sorted(n for n, times in Counter(lower).items() if times > 1),
    }
    if any(faults.values()):
        raise SourceRefused("; ".join(f"{k}: {v}" for k, v in faults.items() if v))
    return lower


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_records(
    spark: SparkSession, path: str | list[str], columns: Sequence[str], multiline: bool = True
) -> DataFrame:
    """A record file as text, every column NULL where the cell is empty.

    ``multiline`` reads each file in one task, as a quoted line break requires. A source without any (see
    ``broken_lines``) can be read without it, split across tasks. Spark reads any line break inside a cell
    as a line feed.
    """
    return (
        spark.read.schema(text_schema(columns))
        .options(**CSV_OPTIONS, multiLine=str(multiline).lower())
        .csv(path)
    )


def broken_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``source_file`` and ``broken``, its lines with an odd number of quotes, of every file.

    Doubled quotes count twice, so a line is odd only where a quoted cell goes on past its end. Files without such a
    line can be read in blocks. The pass is split across tasks whatever the files hold.
    """
    quotes = "length(value) - length(replace(value, '\"', ''))"
    return (
        spark.read.text(path)
        .select(F.col("_metadata.file_path").alias("source_file"), F.expr(f"({quotes}) % 2 = 1").alias("odd"))
        .groupBy("source_file")
        .agg(F.expr("count_if(odd) AS broken"))
    )


def stage_file(
    spark: SparkSession,
    path: str | list[str],
    columns: Sequence[str],
    target: str,
    multiline: bool | None = None,
    group: str = "",
) -> DataFrame:
    """The typed-as-text copy of record files, with the position of each record in its file or group of files.

    By default a first pass tells which files have line breaks in quoted cells; those are read whole, a task each,
    and all others in blocks. ``group`` is a pattern whose first match part in a file's path names its group (a year
    cut into several files, in the order of their names); without it each file is its own.

    The scan writes, next to each record, its file, the block it was read from and a number that
    rises inside a block. The ordinal is then the rows of the earlier files and blocks of the group plus the
    position in the block: one aggregation of a row per block, and no sort of the records. It is
    computed from the written copy, so the split of the scan cannot change between reads. A copy whose columns are
    not the expected text is refused.
    """
    names = staged_columns(columns)
    if multiline is None:
        found = broken_lines(spark, path).collect()  # a row for each file of the listing
        reads = {
            whole: [unquote(r.source_file) for r in found if (r.broken > 0) is whole] for whole in (True, False)
        }
    else:
        reads = {multiline: path}
    parts = [
        read_records(spark, files, columns, whole).select(
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_id"),
            *[F.col(c).alias(n) for c, n in zip(columns, names)],
        )
        for whole, files in reads.items()
        if files
    ]
    if not parts:
        raise SourceRefused(f"no records in {path}")
    for number, part in enumerate(parts):
        part.write.mode("append" if number else "error").parquet(target)
    copy = spark.read.parquet(target)
    problems = schema_problems(copy.drop("_file", "_block", "_id"), names)
    if problems:
        raise SourceRefused("; ".join(problems))
    return with_ordinals(copy, group).select(F.col("_file").alias("source_file"), SOURCE_ROW, *names)


def _group_of(group: str, file: str = "_file") -> F.Column:
    return F.regexp_extract(file, group, 1) if group else F.col(file)


def with_ordinals(copy: DataFrame, group: str = "") -> DataFrame:
    """The 1-based position of each record in its file or group, from its block and its number in it.

    The blocks are one row per block read; few enough are broadcast, so the records do not move.
    """
    before = (
        Window.partitionBy(_group_of(group))
        .orderBy("_file", "_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    blocks = checkpointed(
        copy.groupBy("_file", "_block")
        .agg(F.expr("count(*) AS _rows"), F.expr("min(_id) AS _first"))
        .withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    return copy.join(small_side(blocks), ["_file", "_block"]).withColumn(
        SOURCE_ROW, F.expr("_start + _id - _first + 1")
    )


def parquet_ordinals(spark: SparkSession, path: str, group: str = "") -> DataFrame:
    """A parquet copy with the position of each row in its file or group of files, straight from the scan.

    The rows of the earlier files of a group are counted from the files' footers.
    """
    rows = spark.read.parquet(path)
    if not group:
        return rows.withColumn(SOURCE_ROW, F.col("_metadata.row_index") + F.lit(1))
    before = (
        Window.partitionBy(_group_of(group)).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    )
    files = checkpointed(
        rows.groupBy(F.col("_metadata.file_path").alias("_file"))
        .agg(F.expr("count(*) AS _rows"))
        .withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    return (
        placed.join(small_side(files), "_file")
        .withColumn(SOURCE_ROW, F.expr("_start + _at + 1"))
        .drop("_file", "_at", "_start")
    )


def schema_problems(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Differences from the expected columns, all text, in order."""
    found = [(f.name, f.dataType.simpleString()) for f in df.schema]
    return [
        f"expected {want} as text, found {got}"
        for want, got in zip([(c, "string") for c in columns], found)
        if want != got
    ] + ([] if len(found) == len(columns) else [f"{len(found)} columns, not {len(columns)}"])


def union_years(years: Mapping[int, DataFrame], columns: Sequence[str]) -> DataFrame:
    """The staged years as one table with a year literal, only the columns needed."""
    parts = [
        df.select(F.lit(year).alias("source_year"), SOURCE_ROW, *columns)
        for year, df in sorted(years.items())
    ]
    return reduce(DataFrame.unionByName, parts)


def replace_years(df: DataFrame, path: str) -> None:
    """Replace the partitions of the years in ``df``, and leave every other year as it is."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "source_year"
    ).parquet(path)
