"""Folders of delimited files whose headers differ: one scan per kind of header, whatever the number of files."""

from __future__ import annotations

import csv
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallybook.sources.parse import read_csv

#: What counts as an export, hidden files aside.
NAMES = r"(?i)^[^._].*\.(csv|txt|tsv)$"


@dataclass(frozen=True)
class Kind:
    """Files that share a header line."""

    delimiter: str
    columns: list[str]
    files: list[str]


def first_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, header of every export below a folder: the first line, without a byte order mark; null for a blank one.  A file of no bytes isn't listed.

    The files are read as lines once, and of those each task keeps one line per file; only lines of a file's first block are compared.
    """
    scan = spark.read.option("recursiveFileLookup", True)
    names = scan.format("binaryFile").load(path).select(F.col("path").alias("file")).filter(F.regexp_like(F.element_at(F.split("file", "/"), -1), F.lit(NAMES)))
    lines = scan.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"), "value")
    firsts = lines.filter(F.col("at.file_block_start") == 0).groupBy("file").agg(F.min_by("value", "at").alias("line"))
    here, there = F.regexp_replace("file", "^file:/+", "/"), F.regexp_replace(F.url_decode(F.regexp_replace("f", r"\+", "%2B")), "^file:/+", "/")
    firsts = firsts.withColumnRenamed("file", "f").select(there.alias("key"), "line")
    return names.withColumn("key", here).join(firsts, "key", "left").select(
        "file", F.nullif(F.trim(F.regexp_replace("line", "^\ufeff", "")), F.lit("")).alias("header"))


def by_header(spark: SparkSession, path: str, sniff: Callable[[str], str]) -> tuple[list[Kind], DataFrame]:
    """(kinds, files) of a folder; files: file, header, delimiter, columns.

    Files are listed on the driver, one row each; files without a header belong to no kind.
    """
    found = [(r["file"], r["header"]) for r in first_lines(spark, path).orderBy("file").collect()]
    rows, kinds = [], {}
    for file, header in found:
        delimiter = sniff(header) if header else None
        columns = next(csv.reader([header], delimiter=delimiter)) if header else []
        rows.append((file, header, delimiter, columns))
        if header:
            kinds.setdefault(header, Kind(delimiter, columns, [])).files.append(file)
    return list(kinds.values()), spark.createDataFrame(rows, "file string, header string, delimiter string, columns array<string>")


def read(spark: SparkSession, kind: Kind) -> DataFrame:
    """The rows of all files of a kind in one scan, every field as text, with their position (file and row)."""
    # The reader takes names as globs.
    schema = StructType()
    for n, column in enumerate(kind.columns):
        schema.add(column if column not in kind.columns[:n] else f"{column} {n}", "string")
    return read_csv(spark, [re.sub(r"([][{}*?\\])", r"\\\1", f) for f in kind.files], kind.delimiter, schema=schema)
