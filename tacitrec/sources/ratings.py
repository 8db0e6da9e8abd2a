"""Ratings files without a header line: user, item, rating, time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATINGS_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("timestamp", T.LongType()),
])
# The fields are read as text, and what does not split into four is kept aside.
MALFORMED = "_malformed"
TEXT_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in (*RATINGS_SCHEMA.names, MALFORMED)])

# The spellings of a missing value.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
WHOLE_NUMBER = r"^\s*[+-]?\d+\s*$"


def read_ratings(
    spark: SparkSession, path: str | list[str], null_tokens: tuple[str, ...] = NULL_TOKENS
) -> DataFrame:
    """Scan ratings files with the declared schema.

    A field may be quoted, and a doubled quote in it stands for one. An id or rating spelled
    like a missing value becomes null. A line without exactly four fields, a rating that is
    no number and a time that is no whole number fail the job, whatever is selected later.
    """
    raw = spark.read.csv(
        path, schema=TEXT_SCHEMA, header=False, mode="PERMISSIVE", columnNameOfCorruptRecord=MALFORMED, quote='"', escape='"'
    )

    def value(name: str) -> Column:
        return F.when(~F.col(name).isin(*null_tokens), F.col(name))

    def fails(condition: Column, what: str) -> Column:
        message = F.concat(F.lit(what + ": "), *[
            F.concat(F.coalesce(F.col(name), F.lit("")), F.lit(",")) for name in RATINGS_SCHEMA.names
        ])
        return F.when(condition, F.raise_error(message).cast("boolean"))

    checked = F.coalesce(
        fails(F.col(MALFORMED).isNotNull(), "not four fields"),
        fails(value("rating").isNotNull() & ~F.col("rating").rlike(NUMBER), "the rating is no number"),
        fails(~F.coalesce(F.col("timestamp").rlike(WHOLE_NUMBER), F.lit(False)), "the time is no whole number"),
        F.lit(True),
    )
    # The check is a filter over all fields, so column pruning cannot skip it.
    return raw.filter(checked).select(
        value("user_id").alias("user_id"), value("item_id").alias("item_id"),
        F.trim(value("rating")).cast("double").alias("rating"), F.trim(F.col("timestamp")).cast("bigint").alias("timestamp"),
    )


def write_ratings(df: DataFrame, path: str) -> None:
    """Write ratings in the same form `read_ratings` reads."""
    df.select(*RATINGS_SCHEMA.names).write.csv(path, header=False, quote='"', escape='"')
