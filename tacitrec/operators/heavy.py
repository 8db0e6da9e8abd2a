"""Joins in which a few keys hold a large part of the rows.

A frequent-items sketch finds the keys that hold more than a small share of the rows; at most
`MOST` keys can. Only their rows are salted, and only their partners are repeated, so a join costs
what a plain one costs where no key is heavy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys that a sketch may return, and items it tracks: a key with over 1/1,000 of the rows is among
# them, as the sketch is wrong by less than 1/4,000 of the rows.
MOST, TRACKED = 1_000, 10_000
SALTS = 32
LEAST = 4096  # rows of a key that one task handles anyway


def heavy_keys(df: DataFrame, *keys: str, least: int = LEAST) -> list[list]:
    """Per column of `keys`, the values that hold over 1/1,000 of the rows and `least` rows or more.

    One pass; its result is at most `MOST` values a column.
    """
    found = df.agg(*[sketch(key).alias(f"top{i}") for i, key in enumerate(keys)], F.count("*").alias("rows")).first()
    return [found_heavy(found[f"top{i}"], found["rows"], least) for i in range(len(keys))]


def sketch(key: str) -> Column:
    """The frequent items of a column, to be added up by any aggregate or observation."""
    return F.expr(f"approx_top_k(`{key}`, {MOST}, {TRACKED})")


def found_heavy(entries: Sequence | None, rows: int, least: int = LEAST) -> list:
    """The heavy ones among the items of a sketch over so many rows."""
    floor = max(least, rows // MOST)
    return [entry["item"] for entry in entries or [] if entry["item"] is not None and entry["count"] >= floor]


def join_salted(
    left: DataFrame, right: DataFrame, key: str, heavy: Sequence, spread: Column | None = None, how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """`left` joined to `right` by `key`; rows of `left` with a heavy key spread over `salts` tasks.

    `spread` tells the rows of a key apart (default: all columns of the row). `how` is inner or
    left. Columns of the result are those of a join on the name `key`.
    """
    if not heavy:
        return left.join(right, key, how)
    if spread is None:
        spread = F.xxhash64(*[F.col(f"`{name}`") for name in left.columns])
    is_heavy = F.coalesce(F.col(key).isin(list(heavy)), F.lit(False))
    salt = F.when(is_heavy, F.pmod(spread, F.lit(salts)).cast("int")).otherwise(0)
    copies = F.when(is_heavy, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return (
        left.withColumn("_salt", salt)
        .join(right.withColumn("_salt", F.explode(copies)), [key, "_salt"], how)
        .drop("_salt")
    )
