"""Append-and-resume ingest of responses as Structured Streaming jobs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.types import StructType

from voteframe.operators.scoring import score_responses
from voteframe.session import cut_lineage
from voteframe.streaming.known_keys import BUCKETS, WORDS, KnownKeys, stored


def response_stream(
    spark: SparkSession, folder: str, schema: StructType, kind: str = "json",
    glob: str | None = None, files_per_batch: int = 1000,
) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.format(kind).load(folder)


def append_stream(
    rows: DataFrame, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None
) -> StreamingQuery:
    """Append all available rows to a Parquet table; a restart resumes from the checkpoint."""
    shaped = transform(rows) if transform else rows
    return (
        shaped.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .outputMode("append").start()
    )


def scored(group: int = 10) -> Callable[[DataFrame], DataFrame]:
    """Transformation that scores responses and drops their log-probabilities."""
    return lambda df: score_responses(df, group).drop("logprobs")


def stream_ingest_responses(
    spark: SparkSession, folder: str, schema: StructType, out: str, checkpoint: str, group: int = 10,
    kind: str = "json", glob: str | None = None,
) -> StreamingQuery:
    """Score arriving responses and append them without their log-probabilities."""
    rows = response_stream(spark, folder, schema, kind, glob)
    return append_stream(rows, out, checkpoint, scored(group))


def ingest_new(
    rows: DataFrame, out: str, checkpoint: str, key: str = "response_id",
    on_batch: Callable[[int, int, int], None] | None = None, buckets: int = BUCKETS, words: int = WORDS,
) -> StreamingQuery:
    """Append only rows whose key the target table does not have yet; one stream at a time.

    The known keys live in the target table, not in stream state, so state does not grow with the
    stream. The target is partitioned by ``bucket``, a hash of the key, and each bucket has a Bloom filter
    beside the table (``known_keys``). A batch looks its keys up in the filters of the buckets that it touches;
    only for keys that may be known the target is read, and of it only their buckets. ``buckets`` and ``words``
    belong to a target and must stay the same; more keys than about ten bits of filter each
    (``buckets * words * 64`` bits in all) make the filters less selective, never wrong.

    Each batch writes its own ``batch`` partitions (named after the checkpoint and the batch
    number) and replaces them on a retry, so a batch that is run again neither loses nor repeats rows.
    ``on_batch`` gets (batch number, appended, skipped).
    """
    source = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    keys = KnownKeys(out, key, buckets, words)

    def write(batch: DataFrame, batch_id: int) -> None:
        tag = f"{source}-{batch_id}"
        row = F.struct("*")
        # Of several rows with one key, the same one on every attempt.
        fresh = batch.groupBy(key).agg(F.min_by(row, F.md5(F.to_json(row))).alias("__row")).select("__row.*")
        fresh = cut_lineage(fresh, "fresh")
        new = keys.without_known(fresh, tag)
        (
            keys.placed(new).withColumn("batch", F.lit(tag)).repartition("bucket").write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(out)
        )
        keys.remember(new, tag)
        if on_batch:
            received, appended = batch.count(), new.count()
            on_batch(batch_id, appended, received - appended)

    return (
        rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def dedupe_stateful(rows: DataFrame, key: str = "response_id") -> DataFrame:
    """Drop repeated keys with stream state; for runs whose number of keys is bounded."""
    return rows.dropDuplicates([key])


PROGRESS = "worker_replica string, finished bigint, batch bigint"


def stream_progress(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Running number of finished responses per replica.

    A batch hands over only the counts that it changes; they are merged with the table of the batch
    before. There are two tables, written in turn, so a batch that fails while it writes leaves the
    other one whole, and the number of files does not grow with the batches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        merged = batch.withColumn("batch", F.lit(batch_id).cast("bigint"))
        before = stored(batch.sparkSession, f"{out}/slot={(batch_id - 1) % 2}", PROGRESS) if batch_id else None
        if before is not None:
            merged = merged.unionByName(before)
        # Counts only grow, so the larger one is the later one.
        table = merged.groupBy("worker_replica").agg(F.max("finished").alias("finished"))
        table = table.withColumn("batch", F.lit(batch_id).cast("bigint")).coalesce(1)
        table.write.mode("overwrite").parquet(f"{out}/slot={batch_id % 2}")

    counts = rows.groupBy("worker_replica").agg(F.count(F.lit(1)).alias("finished"))
    return (
        counts.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_progress(spark: SparkSession, out: str) -> DataFrame:
    """The counts of the last batch."""
    df = spark.read.schema(PROGRESS).parquet(f"{out}/slot=*")
    last = df.agg(F.max("batch")).scalar()
    return df.where(F.col("batch") == last).drop("batch")


class IngestListener(StreamingQueryListener):
    """What each batch of the session's streams received, by query and batch, and how much of it was appended.

    Received rows come from Spark's progress events; ``ingest_new`` tells the rest, batch by batch, to what
    ``noted`` returns. Add it with ``spark.streams.addListener``; ``report`` is called with every
    progress event's query name, batch number and received rows.
    """

    def __init__(self, report: Callable[[str | None, int, int], None] | None = None) -> None:
        self.report = report
        self.received: dict[tuple[str | None, int], int] = {}
        self.written: dict[int, tuple[int, int]] = {}

    def noted(self, batch_id: int, appended: int, skipped: int) -> None:
        """For ``on_batch`` of ``ingest_new``."""
        self.written[batch_id] = (appended, skipped)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        # A batch may report again when it has nothing to read; its rows are those of its run.
        key = (progress.name, progress.batchId)
        self.received[key] = max(progress.numInputRows, self.received.get(key, 0))
        if self.report:
            self.report(progress.name, progress.batchId, progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
