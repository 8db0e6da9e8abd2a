"""Leave-one-out split: each user's last interaction is held out."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from tacitrec.tables import hand_over, write_table

PART, LAST, FINAL = "_part", "_last", "_final"


def leave_one_out(
    df: DataFrame, order: Sequence[str] = ("timestamp",), user: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Return `(train, test)`, with one test row per user.

    The last row is the greatest by `order`; the remaining columns break ties, so only exact
    copies can tie, and of those one is held out. The rows are range-partitioned and sorted by user
    and order, so a user with very many rows is spread, and written once. A task marks the rows after
    which another user follows; whether the user of a partition's final row goes on in the next one
    is known from one row per partition. Both results read the one table, without a join.

    `user` may name a column that tells users apart as `user_idx` does and that the results do not need.
    Each user's rows are then sorted in one task, where they are, if `df` is partitioned by that column,
    and spilled if need be; for users who are not very frequent.
    """
    columns = [name for name in df.columns if name != user]
    ranked = ["user_idx", *order, *[name for name in columns if name not in order and name != "user_idx"]]
    if user is not None:
        newest = Window.partitionBy(user).orderBy(*[F.desc(f"`{name}`") for name in ranked[1:]])
        marked_rows = df.withColumn(LAST, F.row_number().over(newest) == 1).select(*columns, LAST)
        return _parts(write_table(marked_rows, "split"), F.col(LAST), columns)
    extra = [StructField(PART, IntegerType()), StructField(LAST, BooleanType()), StructField(FINAL, BooleanType())]
    schema = StructType([*df.schema.fields, *extra])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Mark each user's last row; a batch waits until the next one shows how its users go on."""
        held: pa.RecordBatch | None = None
        for batch in batches:
            if batch.num_rows:
                if held is not None:
                    yield marked(held, batch.column(users)[0])
                held = batch
        if held is not None:
            yield marked(held, None)

    users = columns.index("user_idx")

    def marked(batch: pa.RecordBatch, following: pa.Scalar | None) -> pa.RecordBatch:
        user = batch.column(users).to_pandas().to_numpy()
        last, final = np.ones(len(user), bool), np.zeros(len(user), bool)
        last[:-1] = user[:-1] != user[1:]
        if following is not None:
            last[-1] = user[-1] != following.as_py()
        else:
            final[-1] = True
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(last), pa.array(final)], schema.names)

    placed = write_table(
        df.repartitionByRange(*ranked).sortWithinPartitions(*ranked)
        .withColumn(PART, F.spark_partition_id()).mapInArrow(mark, schema),
        "split",
    )
    ends = placed.groupBy(PART).agg(
        F.min("user_idx").alias("first"), F.max("user_idx").alias("last")
    ).orderBy(PART).collect()  # one row per partition
    going_on = [here[PART] for here, following in zip(ends, ends[1:]) if here["last"] == following["first"]]
    is_test = F.col(LAST) & ~(F.col(FINAL) & F.col(PART).isin(going_on))
    return _parts(placed, is_test, columns)


def _parts(placed: DataFrame, is_test: Column, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of a written table."""
    train, test = placed.filter(~is_test).select(*columns), placed.filter(is_test).select(*columns)
    hand_over(placed, test)  # dropping the test rows drops the table of both
    return train, test
