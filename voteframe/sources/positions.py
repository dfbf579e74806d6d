"""Numbers of rows by their position in files.

A line's position is the number of lines before it, but a file is read in splits that know nothing of
each other. Rows are written once with the file and the split they came from and a number that grows
within the split; one row per split then carries the count of rows, and a prefix sum over the splits
of each file, and over the files in order of path, gives what lies before a split. The rows
themselves are neither sorted nor shuffled by position, and a split's rows never meet in one task
but the one that read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from voteframe.operators.ordering import running_totals
from voteframe.session import cut_lineage

FILE, SPLIT, GROWING = "__file", "__split", "__growing"


def offsets(marked: DataFrame) -> DataFrame:
    """``__file, __split, __first, __before``: of each split its smallest growing number and the rows
    of all earlier splits and files. One row per split; counted on the map side."""
    splits = marked.groupBy(FILE, SPLIT).agg(
        F.count(F.lit(1)).alias("__rows"), F.min(GROWING).alias("__first")
    )
    splits = cut_lineage(splits, "splits")
    inside = running_totals(splits, [FILE], SPLIT, {"__inside": F.col("__rows")})
    files = splits.groupBy(FILE).agg(F.sum("__rows").alias("__rows"))
    ahead = running_totals(files, [], FILE, {"__ahead": F.col("__rows")}).select(FILE, "__ahead")
    placed = inside.join(ahead, FILE)
    return placed.select(FILE, SPLIT, "__first", (F.col("__inside") + F.col("__ahead")).alias("__before"))


def numbered(rows: DataFrame, name: str = "position") -> DataFrame:
    """Add the zero-based position of each row of a file source (JSON lines, text, CSV, Parquet, ...),
    files in order of path. ``rows`` must be as they were read: a filter before would leave rows out
    of the count."""
    marked = rows.withColumns(
        {FILE: F.col("_metadata.file_path"), SPLIT: F.col("_metadata.file_block_start"), GROWING: F.monotonically_increasing_id()}
    )
    # The marks are those of one reading: how files are split may differ at the next one.
    marked = cut_lineage(marked, "positions")
    joined = marked.join(offsets(marked), [FILE, SPLIT])
    position = F.col("__before") + F.col(GROWING) - F.col("__first")
    return joined.select(*rows.columns, position.cast("bigint").alias(name))


def read_numbered(
    spark: SparkSession, path: str, schema: StructType | str | None = None, kind: str = "json", name: str = "position", **options: str
) -> DataFrame:
    """Read files of a kind and number their rows."""
    reader = spark.read.options(**options)
    return numbered((reader.schema(schema) if schema is not None else reader).format(kind).load(path), name)
