"""What the corpus operators share: text expressions, running totals, widened rows."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tacitrec.tables import new_path, write_table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    """Number of runs of characters that are not blank; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1] drawn from the digest of the parts, the same on every run."""
    digest = F.md5(F.concat_ws("/", *[part.cast("string") for part in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / float(1 << 52)


def delete_path(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def bucketed_table(df: DataFrame, key: str, name: str) -> DataFrame:
    """Write `df` bucketed by `key`, so that joins by it do not move it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = os.path.basename(path).replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).format("parquet").option("path", path).saveAsTable(table)
    return spark.table(table)


def partitioned_table(df: DataFrame, column: str, name: str) -> tuple[DataFrame, str]:
    """Write `df` in one folder per value of `column`, its last; return the table and its path."""
    path = new_path(df.sparkSession, name)
    df.write.partitionBy(column).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def replaced(df: DataFrame, **columns: Column) -> DataFrame:
    """The columns of `df` without those named, then the named ones: ours win on a clash of names."""
    taken = {name.lower() for name in columns}
    old = [name for name in df.columns if name.lower() not in taken]
    return df.select(*[df[f"`{name}`"] for name in old], *[c.alias(n) for n, c in columns.items()])


def running_starts(df: DataFrame, order: Sequence[str], value: str, start: str, name: str) -> tuple[DataFrame, int]:
    """Add `start`, the sum of `value` over all rows before this one, and return the total too.

    The rows are range-partitioned and sorted by `order`; a task adds up its partition, and the
    sums of the partitions, one number each, go through the driver. `order` should tell rows
    apart, so that a hot key spreads over partitions; rows equal in all of it keep some order,
    which the written table fixes.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType())])
    kept = df.columns

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            sizes = batch.column(kept.index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = total + np.cumsum(sizes)
            if len(sizes):
                total = int(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], batch.column(len(kept)), pa.array(ends - sizes)], [*kept, "part", "local"]
            )

    placed = write_table(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id()).mapInArrow(add_up, schema),
        name,
    )
    ends = placed.groupBy("part").agg(F.max(F.col("local") + F.col(value)).alias("sum")).orderBy("part").collect()
    bases, total = [], 0
    for row in ends:
        bases.append((row["part"], total))
        total += row["sum"]
    offsets = df.sparkSession.createDataFrame(bases, "part int, base bigint")
    # one row per partition, so the size of what is broadcast is known
    return placed.join(F.broadcast(offsets), "part").select(*kept, (F.col("base") + F.col("local")).alias(start)), total


def numbered(df: DataFrame, group: str, order: Sequence[str], place: str, name: str) -> DataFrame:
    """Add `place`, the number from 0 of each row within its `group` by `order`.

    One range partitioning by group and order serves all groups, so a group may be of any size.
    Per partition and group one count goes through the driver: at most partitions plus groups.
    """
    low = F.lit((1 << 33) - 1)  # monotonically_increasing_id has the row of the partition there
    placed = write_table(
        df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
        .select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(low).alias("row")),
        name,
    )
    spans = placed.groupBy(group, "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    bases, before = [], {}
    for row in sorted(spans.collect(), key=lambda r: r["part"]):
        bases.append((row[group], row["part"], before.get(row[group], 0) - row["first"]))
        before[row[group]] = before.get(row[group], 0) + row["n"]
    schema = T.StructType([df.schema[group], T.StructField("part", T.IntegerType()), T.StructField("base", T.LongType())])
    offsets = df.sparkSession.createDataFrame(bases, schema)
    return placed.join(F.broadcast(offsets), [group, "part"]).select(
        *df.columns, (F.col("base") + F.col("row")).alias(place)
    )
