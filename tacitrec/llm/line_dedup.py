"""Line dedup with levelled sorted runs of line hashes.

A line's key is the line without blanks at both ends, A-Z in lower case. A run is a table of
`(line, n_docs)`, bucketed and sorted by the 128-bit hash of the key. Every batch of documents
counts its lines, merge-anti-joins the runs for lines that already reached the limit (they need
no more counting) and adds its own run at level 0; `fanout` runs of a level are merged into one
of the next. Runs are bucketed alike, so joins and merges move no rows. At the end the merged
runs tell the lines that stand in at least `min_docs` documents; all of them go everywhere.

A document's own repeated line counts once. Null and empty texts are one empty line, which has
no key and stays; null text stays null. Repeated rows count as documents of their own; they are
added up before they are shuffled. Lines to drop are found per distinct text and joined back by
the text's digest, so nothing depends on ids. Columns `n_lines` and `n_dropped` are replaced.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tacitrec.llm.common import BLANKS, UPPER, delete_path, lower_ascii, partitioned_table, replaced
from tacitrec.tables import new_path, write_table


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def text_digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


class LineRuns:
    """The levels of runs; `close` drops their tables."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 4, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = new_path(self.spark, name)
        (
            run.write.bucketBy(self.buckets, "line").sortBy("line").format("parquet")
            .option("path", self.paths[name]).saveAsTable(name)
        )
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"drop table if exists {name}")
            delete_path(self.spark, self.paths.pop(name))

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """Add a batch of `(line, n_docs)`, lines occurring any number of times."""
        batch = lines.groupBy("line").agg(F.sum("n_docs").alias("n_docs"))
        for run in self.runs():
            batch = batch.join(run.filter(F.col("n_docs") >= self.min_docs), "line", "left_anti")
        self.levels[0].append(self._write(batch))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            names = self.levels[level]
            merged = self._write(self._merged([self.spark.table(name) for name in names]))
            self.levels[level] = []
            self._drop(names)
            level += 1
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(merged)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        def merge(left: DataFrame, right: DataFrame) -> DataFrame:
            both = left.join(right.withColumnRenamed("n_docs", "more"), "line", "full_outer")
            total = F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))
            return both.select("line", total.alias("n_docs"))

        return reduce(merge, runs)

    def frequent(self) -> DataFrame:
        """The lines that reached the limit."""
        return self._merged(self.runs()).filter(F.col("n_docs") >= self.min_docs).select("line")

    def close(self) -> None:
        for level in self.levels:
            self._drop(level)
        self.levels = [[]]


def lines_of(df: DataFrame, text: str, min_chars: int = 1) -> DataFrame:
    """`(text_digest, line, n_docs)`: the distinct keys of every distinct text and its documents."""
    keys = F.transform(F.split(F.col(f"`{text}`"), "\n", -1), line_key)
    keys = F.array_distinct(F.filter(keys, lambda key: F.length(key) >= min_chars))
    hashed = F.transform(keys, lambda key: F.unhex(F.md5(key)))
    per_doc = df.select(text_digest(F.col(f"`{text}`")).alias("text_digest"), F.explode(hashed).alias("line"))
    return per_doc.groupBy("text_digest", "line").agg(F.count("*").alias("n_docs"))


def _rebuild(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
    lower = str.maketrans(UPPER, UPPER.lower())
    rows = []
    for text, drop in zip(texts, drops):
        lines = (text or "").split("\n")
        if drop is None or not len(drop):
            rows.append((text, len(lines), 0))
            continue
        gone = {bytes(d) for d in drop}
        kept = [
            line for line in lines
            if hashlib.md5(line.strip(BLANKS).translate(lower).encode()).digest() not in gone
        ]
        rows.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])


def drop_frequent_lines(
    df: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 6, fanout: int = 4
) -> DataFrame:
    """`df` without the lines that stand in `min_docs` documents, with `n_lines` and `n_dropped`."""
    spark = df.sparkSession
    # A folder per batch, so that a batch reads its own lines only.
    batch = F.pmod(F.xxhash64("text_digest"), F.lit(batches)).cast("int")
    lines, path = partitioned_table(lines_of(df, text, min_chars).withColumn("batch", batch), "batch", "document-lines")
    runs = LineRuns(spark, min_docs, fanout)
    for number in range(batches):
        runs.add(lines.filter(F.col("batch") == number))
    drops = write_table(
        lines.join(runs.frequent(), "line").groupBy("text_digest").agg(F.collect_list("line").alias("__drops"))
        .withColumnRenamed("text_digest", "__digest"),
        "dropped-lines",
    )
    runs.close()
    delete_path(spark, path)
    joined = df.join(drops, text_digest(F.col(f"`{text}`")) == F.col("__digest"), "left")
    rebuild = F.pandas_udf(_rebuild, "text string, n_lines bigint, n_dropped bigint")
    result = joined.withColumn("__new", rebuild(F.col(f"`{text}`"), F.col("__drops")))
    return replaced(
        result, n_lines=F.col("__new.n_lines"), n_dropped=F.col("__new.n_dropped")
    ).withColumn(text, F.col("__new.text")).drop("__new", "__drops", "__digest")
