"""Reading landed files, and lenient scalar parsing of their text fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MONEY = "decimal(18,2)"


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON-lines documents under an explicit schema: no inference pass."""
    return spark.read.schema(schema).json(path)


def from_text(raw: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Documents held as JSON text in one column; other columns are kept.

    A text is parsed once: filters on fields stay behind the generator, where they would take the parse with them into scans and joins.
    """
    others = [c for c in raw.columns if c != column]
    return raw.select(*others, F.inline(F.array(F.from_json(column, schema))))


def read_csv(spark: SparkSession, path: str | list[str], sep: str = ",", encoding: str = "utf-8", schema: StructType | None = None) -> DataFrame:
    """Delimited text with quoted newlines, every field as text, plus its position.

    A file with quoted newlines is read by one task, in order, so file path and
    row id give the position rows had.  With a schema of text columns no file is opened for its header.
    """
    reader = (
        spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
        .option("multiLine", True).option("escape", '"').option("inferSchema", False)
    )
    rows = (reader.schema(schema) if schema else reader).csv(path)
    return rows.withColumn("position", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row")))


def read_report(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """Tab-separated report, every field as text: a quote is a plain character and a line break ends a row."""
    return (
        spark.read.option("header", True).option("sep", "\t").option("encoding", encoding)
        .option("quote", "").option("inferSchema", False).csv(path)
    )


def blank_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def whole(text: Column) -> Column:
    """Leading integer of a text ('3.7' is 3), 0 when there is none.

    Clean numbers are cast; only the rest pay for a regular expression.
    """
    lead = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("long")
    return F.coalesce(text.try_cast("double").try_cast("long"), lead, F.lit(0).cast("long"))


def number(text: Column, kind: str = MONEY) -> Column:
    """Leading decimal number of a text, 0 when there is none."""
    lead = F.regexp_extract(text, r"^\s*([+-]?\d*\.?\d+(?:[eE][+-]?\d+)?)", 1).try_cast(kind)
    return F.coalesce(text.try_cast(kind), lead, F.lit(0).cast(kind))


_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def strict(text: Column, kind: str = MONEY) -> Column:
    """The number a text is as a whole; 0 for any other text ('1,234.50', '12abc')."""
    return F.coalesce(F.when(text.rlike(_NUMBER), F.coalesce(text.try_cast(kind), text.try_cast("double").try_cast(kind))), F.lit(0).cast(kind))


def strict_whole(text: Column) -> Column:
    """The same without what stands behind the point."""
    return F.coalesce(F.when(text.rlike(_NUMBER), text.try_cast("double").try_cast("long")), F.lit(0).cast("long"))


def with_rejects(raw: DataFrame, schema: str, key: str = "id", column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of JSON texts in one column; other columns are kept in both.

    A text that isn't a document of the schema is rejected as 'broken', one without a key as 'no key'; rejects hold the
    reason and the raw text, so they can be counted, mended and sent again.
    """
    others = [c for c in raw.columns if c != column]
    document = F.from_json(column, f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    # As in from_text, behind a generator: parsed once.
    parsed = raw.select("*", F.explode(F.array(document)).alias("_d"))
    broken = F.col("_d").isNull() | F.col("_d._broken").isNotNull()
    reason = F.when(broken, "broken").when(F.col(f"_d.{key}").isNull(), "no key")
    tagged = parsed.withColumn("_reason", reason)
    good = tagged.filter(F.col("_reason").isNull()).select(*others, "_d.*").drop("_broken")
    return good, tagged.filter(F.col("_reason").isNotNull()).select(*others, F.col("_reason").alias("reason"), F.col(column).alias("raw"))


def any_time(text: Column, formats: tuple[str, ...]) -> Column:
    """Timestamp by the first format that fits the whole text."""
    s = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats])
