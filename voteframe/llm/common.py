"""Shared pieces: table access, Arrow batch sizes, held-out keys, bounded labelled samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows per Arrow batch: texts may be long, and a worker holds a few batches at a time.
BATCH_ROWS = 256
#: Bytes of text worked on at once inside a batch (a longer single text is taken whole).
SLICE_BYTES = 4_000_000
#: Most labelled rows that a classifier is fitted on; the rows with the smallest key hash.
SAMPLE_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size where it is above ``BATCH_ROWS``."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with small batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def slices(batches: Iterator[pa.RecordBatch], *columns: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds about ``most`` bytes of the columns, and at least a row."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in columns:
            sizes += pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def key_crc(key: Column | str) -> Column:
    """crc32 of a key's text; a null key counts as empty text."""
    col = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def key_hash(key: str) -> Column:
    return F.xxhash64(F.col(key).cast("string"))


def among_smallest(key: str, rows: Column, limit: int) -> Column:
    """Whether a key's hash is so small that about four times ``limit`` of ``rows`` keys have one.
    It holds for all keys of a small table; of a large one it leaves little to sort, and hashes are
    so even that the smallest ``limit`` are among them."""
    return (key_hash(key).cast("double") / F.lit(2.0**64) + 0.5) * rows <= F.lit(4.0 * limit)


def smallest_hashes(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The ``limit`` rows with the smallest key hash: a repeatable sample of bounded size. Runs a
    count, so that no more than a few times ``limit`` rows are sorted."""
    few = rows.where(among_smallest(key, F.lit(float(rows.count())), limit))
    return few.orderBy(key_hash(key), key).limit(limit)
