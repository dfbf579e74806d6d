"""Which keys a growing table already has, without reading the table for keys that are new.

A key's hash names its bucket, a partition of the table, and one 64-bit word of the bucket's Bloom
filter with four bits set in it. Filters are tables of words: adding keys is a ``bit_or`` per word, and
looking keys up is a join on bucket and word. Each batch writes the words of its keys; after ``FOLD``
batches all words are folded into one table, which is published by a row in a small list of folds, so
that a failed fold leaves the former state in force. Nothing is deleted.

Beside the table: ``_words/epoch=<n>/batch=<tag>``, ``_folded/epoch=<n>`` and ``_folds``, which readers of the
table do not see.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

#: Partitions of a target, and filter words of each: 268 million bits in all.
BUCKETS, WORDS = 64, 1 << 16
#: Batches whose words are read one by one before they are folded.
FOLD = 32
_FILTER = "bucket int, word int, bits bigint"


def stored(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame | None:
    """A table that may not have been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


class KnownKeys:
    def __init__(self, out: str, key: str, buckets: int = BUCKETS, words: int = WORDS) -> None:
        self.out, self.key, self.buckets, self.words = out, key, buckets, words

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", self.bucket())

    def marked(self, rows: DataFrame) -> DataFrame:
        """The rows with bucket, word, and the four bits of their keys."""
        word = F.pmod(F.xxhash64(self.key, F.lit(1)), F.lit(self.words)).cast("int")
        bits = "|".join(f"shiftleft(1L, cast(shiftright(__h, {6 * i}) & 63 as int))" for i in range(4))
        return self.placed(rows).withColumn("word", word).withColumn("__h", F.xxhash64(self.key, F.lit(2))).withColumn(
            "bits", F.expr(bits)).drop("__h")

    def epoch(self, spark: SparkSession) -> int:
        """The number of published folds."""
        folds = stored(spark, f"{self.out}/_folds", "epoch int")
        return 0 if folds is None else folds.agg(F.coalesce(F.max("epoch"), F.lit(0))).first()[0]

    def filters(self, spark: SparkSession, tag: str | None = None, touched: list[int] | None = None) -> DataFrame | None:
        """``bucket, word, bits`` of the keys of all batches but ``tag``, for the buckets that matter."""
        epoch, parts = self.epoch(spark), []
        recent = stored(spark, f"{self.out}/_words/epoch={epoch}", _FILTER + ", batch string")
        if recent is not None:
            parts.append((recent.where(F.col("batch") != tag) if tag else recent).drop("batch"))
        if epoch:
            parts.append(stored(spark, f"{self.out}/_folded/epoch={epoch}", _FILTER))
        if not parts:
            return None
        if touched is not None:
            parts = [p.where(F.col("bucket").isin(touched)) for p in parts]
        words = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return words.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))

    def in_buckets(self, spark: SparkSession, schema: StructType, wanted: list[int], tag: str) -> DataFrame | None:
        """The keys of the table in some buckets, without those of the batch ``tag``."""
        whole = StructType([f for f in schema if f.name == self.key]).add("bucket", IntegerType()).add("batch", StringType())
        table = stored(spark, self.out, whole)
        return None if table is None else table.where(F.col("bucket").isin(wanted) & (F.col("batch") != tag)).select(self.key)

    def without_known(self, fresh: DataFrame, tag: str) -> DataFrame:
        """The rows whose key the table lacks. ``fresh`` has one row per key and is read several times."""
        spark = fresh.sparkSession
        marked = self.marked(fresh.select(self.key))
        # At most as many numbers as there are buckets.
        touched = [r.bucket for r in marked.select("bucket").distinct().collect()]
        filters = self.filters(spark, tag, touched) if touched else None
        if filters is None:
            return fresh
        has_all = filters["bits"].bitwiseAND(marked["bits"]) == marked["bits"]
        maybe = marked.join(filters, ["bucket", "word"]).where(has_all).select(self.key, "bucket")
        wanted = [r.bucket for r in maybe.select("bucket").distinct().collect()]
        known = self.in_buckets(spark, fresh.schema, wanted, tag) if wanted else None
        if known is None:
            return fresh
        repeated = maybe.select(self.key).join(known, self.key, "left_semi")
        return fresh.join(repeated, self.key, "left_anti")

    def remember(self, new: DataFrame, tag: str) -> None:
        """Write the words of a batch's keys, and fold all words if there are many batches."""
        spark = new.sparkSession
        epoch = self.epoch(spark)
        path = f"{self.out}/_words/epoch={epoch}"
        words = self.marked(new.select(self.key)).groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
        words.withColumn("batch", F.lit(tag)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        batches = stored(spark, path, _FILTER + ", batch string").select("batch").distinct().count()
        if batches >= FOLD:
            folded = self.filters(spark)
            folded.repartition("bucket").sortWithinPartitions("bucket", "word").write.mode("overwrite").partitionBy("bucket").parquet(
                f"{self.out}/_folded/epoch={epoch + 1}")
            spark.range(1).select(F.lit(epoch + 1).alias("epoch")).coalesce(1).write.mode("append").parquet(f"{self.out}/_folds")
