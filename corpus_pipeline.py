"""A corpus in five stages: quality, repeated lines, near duplicates, benchmark leaks, token ids.

Each stage takes what the one before kept, and its decision takes effect: the rows it rejects
go, the lines it rejects are cut.  Stages hand documents on as Parquet in the shared folder.  A stage begins by freeing the
broadcasts of those before it.  Columns of any name but doc_id and text are carried along; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import byte_bpe, decontaminate, jaccard_join, line_dedup, quality
from tallybook.llm.common import release, stored, table

#: Documents with a lower quality score go.
KEEP_FROM = 0.3
VOCABULARY = "byte_bpe_50k.tiktoken"


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all other columns in one struct, whatever their names."""
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[c for c in docs.columns if c not in ("doc_id", "text")]).alias("others"))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col("others").getField(c).alias(c) for c in docs.columns])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is scored KEEP_FROM or higher; null and empty texts are scored like others, and rows that repeat stay or go together."""
    release(spark)
    scored = quality.score(_packed(docs), table(spark, sf_dir, "labels"))
    return _unpacked(scored.where(F.col("score") >= KEEP_FROM), docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay, also those that have no line left; n_chars, where there is one, follows the text."""
    release(spark)
    cut = line_dedup.drop_repeated_lines(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id stays of each class; repeated rows of it stay too, and rows without an id."""
    release(spark)
    classes = jaccard_join.near_duplicates(docs)
    kept = classes.where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; null and empty texts hold none."""
    release(spark)
    found = decontaminate.find_items(_packed(docs), table(spark, sf_dir, "benchmark"))
    return _unpacked(found.where(F.size("items") == 0), docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to, for every row."""
    import public_tokenizers

    release(spark)
    return byte_bpe.digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_each_class),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", token_ids),
]

#: The quality classifier is not a query, so SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stored(docs, f"stage-{n}")
    return docs
