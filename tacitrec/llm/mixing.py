"""Mix sources to target weights by repeating whole documents.

Tokens are added up per source. Targets share the total by weight; a source is capped at
`most` times its own size and its excess goes to the others by weight. The repetition rate of
a source is target / size, and each document is emitted floor(rate) times plus once more if a
number hashed from seed and document id falls below the fraction. Reruns agree, and no
document is emitted more than ceil(rate) <= `most` times.

Sources are numbered in code point order, null last, and weighted by `weights`, repeating.
Only sums over capped and uncapped sources reach the driver. Rows of a hot source meet the
source table in a join whose other side has one row per source. Empty and null texts have
size 0 and follow their source's rate like any other. If all sizes are 0, all targets are 0
and so are the rates. Repeated rows draw the same number. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tacitrec.llm.common import replaced, uniform
from tacitrec.operators.encode import id_dictionary
from tacitrec.tables import drop_table, write_table


def source_targets(
    df: DataFrame, source: str, size: Column, weights: Sequence[float] = (5, 2, 1), most: int = 3
) -> DataFrame:
    """`(source, source_size, target, rate)`, one row per source, null being one."""
    sizes = write_table(df.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum(size).alias("source_size")), "source-sizes")
    numbers, n_named = id_dictionary(sizes.filter(F.col("source").isNotNull()), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = sizes.join(numbers.withColumnRenamed("id", "source"), "source", "left").select(
        "source", "source_size",
        F.get(cycle, (F.coalesce("idx", F.lit(n_named)) % len(weights)).cast("int")).alias("weight"),
    )
    weighted = write_table(table, "source-weights")
    limit = (most * F.col("source_size")).cast("double")
    # The water level rises: each pass caps the sources that the level of the last one overfills.
    level, n_capped = 0.0, -1
    while True:
        capped = F.lit(level) * F.col("weight") >= limit
        sums = weighted.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(capped, most * F.col("source_size"))).alias("held"),
            F.sum(F.when(~capped, F.col("weight"))).alias("open"),
            F.count(F.when(capped, True)).alias("n"),
        ).first()
        if sums["n"] == n_capped or not sums["open"]:
            break
        n_capped, level = sums["n"], (sums["all"] - (sums["held"] or 0)) / sums["open"]
    target = F.least(F.lit(level) * F.col("weight"), limit)
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    drop_table(sizes)
    return weighted.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def copies_of(rate: Column, key: Column, seed: int) -> Column:
    """floor(rate) plus a draw with the fraction as its probability."""
    whole = F.floor(rate)
    return (whole + F.when(uniform(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))) <= rate - whole, 1).otherwise(0)).cast("bigint")


def mix(
    df: DataFrame, key: str, source: str, size: Column,
    weights: Sequence[float] = (5, 2, 1), most: int = 3, seed: int = 42,
) -> DataFrame:
    """`df` with `size`, `source_size`, `target` and `copies`, columns of these names replaced."""
    targets = source_targets(df, source, size, weights, most).select(
        F.col("source").alias("__source"), F.col("source_size").alias("__source_size"),
        F.col("target").alias("__target"), F.col("rate").alias("__rate"),
    )
    joined = df.join(targets, F.col(f"`{source}`").eqNullSafe(F.col("__source")))
    return replaced(
        joined,
        size=size, source_size=F.col("__source_size"), target=F.col("__target"),
        copies=copies_of(F.col("__rate"), F.col(f"`{key}`"), seed),
    ).drop("__source", "__source_size", "__target", "__rate")


def emit(mixed: DataFrame, copies: str = "copies") -> DataFrame:
    """Every row as often as `copies` says, without that column."""
    return mixed.withColumn("__copy", F.explode(F.array_repeat(F.lit(True), F.col(copies).cast("int")))).drop("__copy", copies)
