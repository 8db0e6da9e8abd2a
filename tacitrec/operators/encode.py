"""Dense integer ids for users and items, numbered in string order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tacitrec.operators.heavy import found_heavy, heavy_keys, join_salted, sketch
from tacitrec.tables import together, write_table

# monotonically_increasing_id keeps the row number within a partition in its low bits.
ROW_BITS = 33


@dataclass(frozen=True)
class Encoded:
    """Encoded rows, the two dictionaries `(id, idx)` and their sizes."""

    rows: DataFrame
    users: DataFrame
    items: DataFrame
    n_users: int
    n_items: int
    staged: DataFrame | None = None  # the table that `rows` reads, if one was written
    heavy_users: Sequence = ()  # ids that a sketch finds very frequent


def id_dictionary(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """Number the distinct values of `column` from 0 in code point order."""
    return _dictionary(df, column)[:2]


def _dictionary(df: DataFrame, column: str) -> tuple[DataFrame, int, list]:
    """The numbered values of `column`, how many there are, and the very frequent ones.

    The values are range-partitioned and sorted; the number is the place in the partition
    plus the sizes of the partitions before it. The sorted values are written first, as
    range bounds may differ between two runs of the same plan. The frequent values are sketched in
    the same scan.
    """
    spark, seen = df.sparkSession, Observation()
    observed = df.select(F.col(column).alias("id")).observe(seen, sketch("id").alias("top"), F.count("*").alias("rows"))
    placed = write_table(
        observed.distinct()
        .repartitionByRange("id").sortWithinPartitions("id")
        .select(
            "id",
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("place"),
        ),
        f"dictionary-{column}",
    )
    sizes = placed.groupBy("part").count().orderBy("part").collect()  # one row per partition
    starts, total = [], 0
    for size in sizes:
        starts.append((size["part"], total))
        total += size["count"]
    offsets = spark.createDataFrame(starts, "part int, start bigint")
    numbered = placed.join(F.broadcast(offsets), "part").select(
        "id", (F.col("start") + F.col("place")).alias("idx")
    )
    # Of a scan without rows nothing is observed.
    return numbered, total, found_heavy(seen.get["top"], seen.get["rows"]) if total else []


def encode_ids(df: DataFrame, users: DataFrame | None = None, items: DataFrame | None = None) -> Encoded:
    """Add `user_idx` and `item_idx` to every row.

    `users` and `items` may hold the ids that occur in `df`, where they are known already;
    otherwise `df` is written first, as it is read once for each dictionary and once for the rows, and
    searched for them. Rows of ids that a sketch finds very frequent are spread. Users are joined last, so
    that rows of a user who is not very frequent lie in one partition, unless the users are broadcast.
    """
    staged = write_table(df, "rows") if users is None or items is None else None
    df = df if staged is None else staged
    given = [key for key, ids in (("user_id", users), ("item_id", items)) if ids is not None]
    frequent, (users, n_users, heavy_users), (items, n_items, heavy_items) = together(
        df.sparkSession,
        lambda: dict(zip(given, heavy_keys(df, *given))) if given else {},
        lambda: _dictionary(df if users is None else users, "user_id"),
        lambda: _dictionary(df if items is None else items, "item_id"),
    )
    heavy_users, heavy_items = frequent.get("user_id", heavy_users), frequent.get("item_id", heavy_items)
    rows = df
    for key, idx, dictionary, heavy in (
        ("item_id", "item_idx", items, heavy_items), ("user_id", "user_idx", users, heavy_users)
    ):
        names = dictionary.select(F.col("id").alias(key), F.col("idx").alias(idx))
        rows = join_salted(rows, names, key, heavy)
    rows = rows.select(*df.columns, "user_idx", "item_idx")
    return Encoded(rows, users, items, n_users, n_items, staged, heavy_users)


def decode(df: DataFrame, users: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """Add the original ids back to rows that carry `user_idx` or `item_idx`."""
    for name, dictionary in (("user", users), ("item", items)):
        if dictionary is not None:
            df = df.join(
                dictionary.select(F.col("id").alias(f"{name}_id"), F.col("idx").alias(f"{name}_idx")),
                f"{name}_idx",
            )
    return df
