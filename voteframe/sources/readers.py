"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from voteframe import schemas
from voteframe.functions.text import strip
from voteframe.sources.positions import numbered

# Fixed value: answers of one benchmark come wrapped in a box without nested braces.
BOXED_DATASET = "aime24"
UNNESTED_BOX = r"\\boxed\{([^{}]+)\}"


def _suffix(path: str) -> str:
    return path.rstrip("/").rsplit(".", 1)[-1].lower()


def read_problems(spark: SparkSession, path: str, default_ids: bool = True) -> DataFrame:
    """JSON lines or Parquet by suffix; anything else is refused.

    A missing id becomes ``problem_<position in the file>`` (several files in order of path), which
    takes two more passes, made only if an id is missing; ``default_ids=False`` leaves nulls.
    """
    kind = _suffix(path)
    if kind == "jsonl":
        rows = spark.read.schema(schemas.PROBLEMS).json(path)
    elif kind == "parquet":
        rows = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported problem file: {path}")
    if not default_ids:
        return rows
    if "id" not in rows.columns:
        rows = rows.withColumn("id", F.lit(None).cast("string"))
    elif rows.where(F.col("id").isNull()).isEmpty():
        return rows
    return fill_ids(numbered(rows, "__pos"), "__pos").select(*rows.columns)


def fill_ids(df: DataFrame, position: str, prefix: str = "problem_") -> DataFrame:
    """Fill missing ids with the prefix and the position."""
    default = F.concat(F.lit(prefix), F.col(position).cast("string"))
    return df.withColumn("id", F.coalesce(F.col("id").cast("string"), default))


def canonical_problems(df: DataFrame) -> DataFrame:
    """Rename to problem_id, problem_text, ground_truth; missing texts become ''."""
    return df.select(
        F.col("id").cast("string").alias("problem_id"),
        F.coalesce("problem", F.lit("")).alias("problem_text"),
        F.coalesce("answer", F.lit("")).alias("ground_truth"),
    )


def with_default_ids(df: DataFrame, order: str, prefix: str = "problem_") -> DataFrame:
    """Fill missing ids with ``problem_<position in order>``."""
    from voteframe.operators.ordering import row_numbers

    return fill_ids(row_numbers(df, [], order, "__pos"), "__pos", prefix).drop("__pos")


def read_responses(spark: SparkSession, path: str, problem_id: str | None = None) -> DataFrame:
    """Response table; a lookup by problem is pushed down to the Parquet scan."""
    df = spark.read.schema(schemas.RESPONSES).parquet(path)
    return df if problem_id is None else df.where(F.col("problem_id") == problem_id)


def response_index(response_id: Column) -> Column:
    """Position of a response, from the number that ends its id."""
    return F.regexp_extract(response_id, r"_resp_(\d+)$", 1).cast("int")


def parse_text_list(text: Column) -> Column:
    """A list of strings saved as text; text that is not a list becomes a list of that text."""
    parsed = F.from_json(
        text, "array<string>", {"allowSingleQuotes": "true", "mode": "PERMISSIVE"}
    )
    looks = F.regexp_like(F.trim(text), F.lit(r"^\[(?s:.*)\]$"))
    return F.when(looks & parsed.isNotNull(), parsed).otherwise(F.array(text))


def parse_score_lists(text: Column) -> Column:
    """Score arrays by name saved as text; unreadable text becomes an empty entry."""
    parsed = F.from_json(text, "map<string,array<double>>", {"allowSingleQuotes": "true"})
    return F.coalesce(parsed, F.create_map().cast("map<string,array<double>>"))


def read_curated(spark: SparkSession, path: str) -> DataFrame:
    """Curated sets; list columns that were saved as text are parsed."""
    df = spark.read.parquet(path)
    kinds = dict(df.dtypes)
    if kinds.get("responses") == "string":
        df = df.withColumn("responses", parse_text_list(F.col("responses")))
    if kinds.get("confidence_scores") == "string":
        df = df.withColumn("confidence_scores", parse_score_lists(F.col("confidence_scores")))
    return df


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with problem/question and answer/solution."""
    return spark.read.schema(schemas.BENCHMARK).json(path)


def normalize_benchmark(df: DataFrame, dataset: str, order: str) -> DataFrame:
    """Ordinal problem_id, problem_text, ground_truth from whichever columns the table has. The
    second name is used only where the first column does not exist."""
    from voteframe.operators.ordering import row_numbers

    pick = lambda a, b: F.col(a) if a in df.columns else (F.col(b) if b in df.columns else F.lit(""))
    truth = pick("answer", "solution")
    if BOXED_DATASET in dataset.lower():
        boxed = strip(F.regexp_extract(truth, UNNESTED_BOX, 1))
        truth = F.when(F.regexp_like(truth, F.lit(UNNESTED_BOX)), boxed).otherwise(truth)
    placed = row_numbers(df, [], order, "problem_id")
    return placed.select(
        "problem_id", pick("problem", "question").alias("problem_text"), truth.alias("ground_truth")
    )


def read_solution_results(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Nested result files, one row per solution with its position; the ``start`` of a problem that
    was written in several parts is added.

    A multi-line file is one JSON document and is read by one task; ``multi_line=False`` reads the
    same structure as one document per line, which Spark can split.
    """
    df = spark.read.schema(schemas.SOLUTION_RESULTS).option("multiLine", multi_line).json(path)
    problems = df.select("dataset_name", F.explode("generated_solutions").alias("p"))
    rows = problems.select(
        "dataset_name", "p.problem_id", "p.problem_text", "p.ground_truth",
        F.coalesce("p.start", F.lit(0).cast("bigint")).alias("start"), F.posexplode("p.solutions").alias("place", "s"),
    )
    place = (F.col("start") + F.col("place")).cast("int").alias("response_idx")
    return rows.select(*rows.columns[:-3], place, "s.*")


def numeric_answer(answer: Column) -> Column:
    """Token after '####', else the last run of digits, else '0'."""
    marked = F.regexp_extract(answer, r"####\s*(\S+)", 1)
    digits = F.try_element_at(F.regexp_extract_all(answer, F.lit(r"(\d+)")), F.lit(-1))
    return F.coalesce(F.nullif(marked, F.lit("")), digits, F.lit("0"))


def convert_gsm8k(df: DataFrame, order: str) -> DataFrame:
    """question/answer rows to id, problem, answer, full_answer."""
    from voteframe.operators.ordering import row_numbers

    placed = row_numbers(df, [], order, "__pos")
    return placed.select(
        F.concat(F.lit("gsm8k_"), F.col("__pos").cast("string")).alias("id"),
        F.col("question").alias("problem"),
        numeric_answer(F.col("answer")).alias("answer"),
        F.col("answer").alias("full_answer"),
    )


def string_schema(*names: str) -> T.StructType:
    """All-string schema, for line-oriented inputs."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])
