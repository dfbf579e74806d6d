"""Writers and the summary upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

SUMMARY_KEYS = ("dataset", "group_size", "aggregator")


def write_table(
    df: DataFrame, path: str, kind: str = "parquet", partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
) -> None:
    """zstd Parquet, JSON lines, or CSV with a header."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "parquet":
        writer.option("compression", "zstd").parquet(path)
    elif kind == "json":
        writer.json(path)
    elif kind == "csv":
        writer.option("header", True).csv(path)
    else:
        raise ValueError(f"unsupported table kind: {kind}")


def jsonl_to_parquet(
    spark: SparkSession, paths: Sequence[str], out: str, schema, warn=print
) -> DataFrame:
    """Concatenate JSON-lines files into one Parquet table. Missing files are warned about; if all
    are missing it is an error."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(hadoop).exists(p):
            found.append(path)
        else:
            warn(f"missing input: {path}")
    if not found:
        raise FileNotFoundError("no input file exists")
    df = spark.read.schema(schema).json(found)
    df.write.option("compression", "zstd").mode("errorifexists").parquet(out)
    return spark.read.schema(schema).parquet(out)


def upsert_summary(df: DataFrame, path: str) -> None:
    """Replace the partitions of the aggregators present in ``df``; all others stay."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*SUMMARY_KEYS).parquet(path)
    )
