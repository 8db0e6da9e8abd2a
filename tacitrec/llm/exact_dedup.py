"""Exact dedup as a stream over files with keyed state that never expires.

A streaming aggregation keeps, per digest of the normalised text, the row that stays (most code
points in the original text, then smallest id), where its content lies (file and row) and how
many rows have come. The state lives in RocksDB on the executors' disks and is committed to
`state_dir` with every micro-batch, so a lost executor costs a reload, and `advance` on files
that came later goes on where the last call ended, however old their times are. Only DataFrame
expressions run.

`verdicts` looks every row up in the state. Where a digest has several rows, their whole
normalised texts are compared, and a digest that stands for different texts is split by the
texts themselves. Copies collapse per task before texts are shuffled, and the rows of digests that
hold over a thousandth of all rows are spread in the lookup, so a group may hold any share of the rows.

Null text counts as empty, and all blank texts are equal. A null id comes after all others. Of
rows equal in length and id the one in the first file and row stays. An empty table gives no
rows; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tacitrec.llm.common import path_exists
from tacitrec.operators.heavy import join_salted
from tacitrec.tables import write_table

# Preallocation would take megabytes of disk for every partition, however small its state. The stores of
# an executor share one bound on native memory; those of ended streams stay loaded for a while.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
}
HOT_ROWS = 4096
SALTS = 16
# Files much older than the newest one seen would be skipped; copies and backups keep old times.
MAX_FILE_AGE = "36500d"


def without_blanks(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


class StreamingDedup:
    """Dedup state over the files of `path`, and the verdicts it gives."""

    def __init__(
        self, spark: SparkSession, path: str, state_dir: str, schema: StructType | None = None,
        id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256_hex,
        files_per_batch: int = 10_000,
    ):
        self.spark, self.path, self.state_dir = spark, path.rstrip("/"), state_dir
        self.schema = schema or spark.read.parquet(path).schema
        self.id, self.text, self.digest, self.files_per_batch = id, text, digest, files_per_batch

    def _rows(self, source: DataFrame) -> DataFrame:
        text = F.col(f"`{self.text}`")
        return source.select(
            F.col(f"`{self.id}`").alias("id"),
            without_blanks(text).alias("normal"),
            F.length(F.coalesce(text, F.lit(""))).alias("chars"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.row_index").alias("row"),
        ).withColumn("digest", self.digest(F.col("normal")))

    @staticmethod
    def _rank() -> Column:
        """Smaller is better; holds the identifier and the place of the content."""
        return F.struct((-F.col("chars")).alias("chars"), F.col("id").isNull().alias("no_id"), "id", "file", "row")

    def advance(self) -> None:
        """Take in the files that came since the last call, in micro-batches."""
        # A file source wants a folder or a pattern, and the table may be one file.
        pattern = f"{self.path[:-1]}[{self.path[-1]}]"
        reader = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files_per_batch)
        source = reader.option("maxFileAge", MAX_FILE_AGE).parquet(pattern)
        groups = self._rows(source).groupBy("digest").agg(F.min(self._rank()).alias("keep"), F.count("*").alias("n"))
        with self._settings():  # the query copies the settings when it starts
            running = (
                groups.writeStream.format("noop").outputMode("update")
                .option("checkpointLocation", self.state_dir).trigger(availableNow=True).start()
            )
        running.awaitTermination()

    @contextmanager
    def _settings(self) -> Iterator[None]:
        """State on disk, for as long as the session's own settings are not needed."""
        before = {key: self.spark.conf.get(key, None) for key in SETTINGS}
        for key, value in SETTINGS.items():
            self.spark.conf.set(key, value)
        try:
            yield
        finally:
            for key, value in before.items():
                if value is None:
                    self.spark.conf.unset(key)
                else:
                    self.spark.conf.set(key, value)

    def groups(self) -> DataFrame:
        """The state as a table: `(digest, keep, n)`."""
        if not path_exists(self.spark, f"{self.state_dir}/commits/0"):
            empty = self._rows(self._documents()).limit(0)
            return empty.groupBy("digest").agg(F.min(self._rank()).alias("keep"), F.count("*").alias("n"))
        state = self.spark.read.format("statestore").option("path", self.state_dir).load()
        named = state.select(
            F.col("key.digest").alias("digest"), F.col("value.min").alias("keep"), F.col("value.count").alias("n")
        )
        with self._settings():
            return write_table(named, "dedup-groups")

    def _documents(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def colliding(self, groups: DataFrame) -> DataFrame:
        """The digests whose rows differ in their whole normalised texts."""
        salt = F.pmod(F.xxhash64("file", "row"), F.lit(SALTS))
        several = groups.filter(F.col("n") > 1).select(
            "digest", F.explode(F.array(*[F.lit(salt).cast("bigint") for salt in range(SALTS)])).alias("salt")
        )
        hits = self._rows(self._documents()).withColumn("salt", salt).join(several, ["digest", "salt"], "left_semi")
        contents = hits.groupBy("digest", "normal").agg(F.count("*").alias("rows"))
        return contents.groupBy("digest").agg(F.count("*").alias("texts")).filter(F.col("texts") > 1).select("digest")

    def verdicts(self) -> DataFrame:
        """`(id, keep_id, group_size, kept, digest)` for every row.

        Fails if the files hold other rows than the state has taken in.
        """
        rows, groups = self._rows(self._documents()), self.groups()
        there, taken = self._documents().count(), groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if there != taken:
            raise ValueError(f"{self.path} has {there} rows, and the state has taken in {taken}: call advance(), or start a new state")
        colliding = write_table(self.colliding(groups), "dedup-collisions")
        # At most a thousand digests can have a thousandth of the rows.
        hot = [r["digest"] for r in groups.filter(F.col("n") >= max(HOT_ROWS, taken // 1000)).select("digest").collect()]
        found = join_salted(rows.drop("normal"), groups, "digest", hot, F.xxhash64("file", "row"), "left")
        missing = F.raise_error(F.concat(F.lit("no state for digest "), "digest"))
        looked_up = self._judged(found.withColumn("n", F.when(F.col("n").isNull(), missing).otherwise(F.col("n"))))
        if colliding.isEmpty():
            return looked_up
        mixed = rows.join(colliding, "digest", "left_semi")
        split = mixed.groupBy("digest", "normal").agg(F.min(self._rank()).alias("keep"), F.count("*").alias("n"))
        exact = self._judged(mixed.join(split, ["digest", "normal"]))
        return looked_up.join(colliding, "digest", "left_anti").select(*exact.columns).unionByName(exact)

    @staticmethod
    def _judged(rows: DataFrame) -> DataFrame:
        kept = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
        return rows.select("id", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), "digest")
