"""Inputs derived from the given tables.

Each derived table is a chain of projections whose expressions are valid in Spark SQL and in DuckDB
alike, so both engines see the same rows. All projections are row-local: deriving an input grows
with its table and needs no grouping. As response tables are stored in practice, a derived table is
written once per session to the shared folder and scanned from there by every query.

``responses``: 60 consecutive events make five problems of 1, 2, 5, 16 and 36 responses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from voteframe.session import new_folder, spread

BOX = "concat(chr(92), 'boxed{')"
FRAC = "concat(chr(92), 'frac{')"

RESPONSES: list[dict[str, str]] = [
    {
        "pos": "cast(event_id % 60 as int)",
        "blk": "cast((event_id - event_id % 60) / 60 as bigint)",
    },
    {
        "slot": "case when pos < 1 then 0 when pos < 3 then 1 when pos < 8 then 2 "
        "when pos < 24 then 3 else 4 end",
    },
    {
        "response_idx": "cast(pos - case slot when 0 then 0 when 1 then 1 when 2 then 3 "
        "when 3 then 8 else 24 end as int)",
        "problem_no": "blk * 5 + slot",
    },
    {
        "problem_id": "concat('p', cast(problem_no as string))",
        "problem_text": "concat('Problem ', cast(problem_no as string), ': ', "
        "repeat('x ', cast(problem_no % 17 as int)))",
        "ground_truth": "case problem_no % 5 when 0 then 'click' when 1 then 'error' "
        "when 2 then 'purchase' when 3 then 'signup' else 'view' end",
    },
    {"answer": "case when event_id % 3 = 0 then ground_truth else event_type end"},
    {
        "response_id": "concat(problem_id, '_resp_', cast(response_idx as string))",
        "final_answer": "case when event_id % 11 = 0 then '' when event_id % 13 = 0 "
        "then concat(' ', upper(answer)) else answer end",
        "output_token_count": "case when event_id % 101 = 0 then 4900 "
        "else cast(floor(value * 10) as int) end",
        "prompt_token_count": "case when event_id % 97 = 0 then null "
        "else cast(50 + problem_no % 7 as int) end",
        "worker_replica": "concat('shard_', cast(event_id % 4 as string))",
        "worker_gpu": "concat('gpu_', cast(event_id % 2 as string))",
        "dataset": "concat('d', cast(problem_no % 3 as string))",
        "model": "case when blk % 2 = 0 then 'baseline' else 'tuned' end",
        "missing": "event_id % 89 = 0",
    },
    {
        "mean_group_confidence": "case when missing then null else value * 0.04e0 end",
        "bottom_10_percent_confidence": "case when missing then null "
        "else value * 0.02e0 + (event_id % 10) * 0.125e0 end",
        "tail_confidence": "case when missing then null else (event_id * 37 % 101) * 0.0625e0 end",
        "head_confidence": "case when missing then null else (event_id * 53 % 103) * 0.0625e0 end",
        "lowest_group_confidence": "case when missing then null "
        "else value * 0.01e0 + (event_id % 7) * 0.0625e0 end",
        "top_10_percent_confidence": "case when missing then null else value * 0.06e0 end",
        "highest_group_confidence": "case when missing then null "
        "else value * 0.08e0 + (event_id % 5) * 0.25e0 end",
        "content": "case when event_id % 31 = 0 then '' else concat('Solution ', "
        "cast(response_idx as string), ' ', repeat('word ', cast(event_id % 40 as int))) end",
        "text_kind": "case when event_id % 103 = 0 then 7 else cast(event_id % 7 as int) end",
        "boxed": "concat(<BOX>, final_answer, '}')",
    },
    {
        "generated_text": "case text_kind "
        "when 0 then concat('<think>reason ', cast(pos as string), '</think> Answer: ', boxed) "
        "when 1 then concat('  Answer ', boxed) "
        "when 2 then concat('<think> a </think>', <BOX>, 'wrong} then ', boxed, ' ok ') "
        "when 3 then concat('<think>b</think>So ', <BOX>, <FRAC>, cast(response_idx as string), "
        "'}{7}} done') "
        "when 4 then concat('<think>c</think>', <BOX>, 'a', chr(92), '}b}') "
        "when 5 then concat('<think>open ', cast(pos as string), ' ', <BOX>, 'x') "
        "when 6 then concat('text ends with number 12', chr(10), 'last line ', "
        "cast(pos as string), '.5') "
        "else null end",
        # What a reader of the text above expects, written down independently of any parser.
        "expected_reasoning": "case text_kind when 0 then concat('reason ', cast(pos as string)) "
        "when 2 then 'a' when 3 then 'b' when 4 then 'c' else '' end",
        "expected_strict": "case text_kind when 0 then concat('Answer: ', boxed) "
        "when 2 then concat(<BOX>, 'wrong} then ', boxed, ' ok') "
        "when 3 then concat('So ', <BOX>, <FRAC>, cast(response_idx as string), '}{7}} done') "
        "when 4 then concat(<BOX>, 'a', chr(92), '}b}') else '' end",
        "expected_answer": "case when text_kind <= 2 then trim(final_answer) "
        "when text_kind = 3 then concat(<FRAC>, cast(response_idx as string), '}{7}') "
        "when text_kind = 4 then concat('a', chr(92), '}b') else '' end",
    },
    {
        "expected_lenient": "case when text_kind in (0, 2, 3, 4) then expected_strict "
        "when text_kind = 7 then '' else trim(generated_text) end",
        "is_correct": "lower(trim(final_answer)) = lower(ground_truth) and final_answer <> ''",
        "split": "case when problem_no % 10 < 8 then 'train' else 'validation' end",
    },
]

def expand(expr: str) -> str:
    """Fill in the two markup snippets, which contain a backslash."""
    return expr.replace("<BOX>", BOX).replace("<FRAC>", FRAC)


def project(df: DataFrame, layers: list[dict[str, str]]) -> DataFrame:
    """Apply the projections in Spark."""
    for layer in layers:
        df = df.selectExpr("*", *[f"{expand(expr)} as {name}" for name, expr in layer.items()])
    return df


def render(base: str, layers: list[dict[str, str]]) -> str:
    """The same projections as SQL text."""
    sql = f"select * from {base}"
    for layer in layers:
        columns = ", ".join(f"{expand(expr)} as {name}" for name, expr in layer.items())
        sql = f"select *, {columns} from ({sql})"
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_stored: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def stored(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """The derived table ``name``, written on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        df, path = build(), new_folder(spark, name)
        df.write.option("compression", "zstd").parquet(path)
        _stored[key] = (path, df.schema)
    path, schema = _stored[key]
    return spark.read.schema(schema).parquet(path)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived responses, without the columns that only the SQL twins need."""

    def build() -> DataFrame:
        df = project(spread(table(spark, sf_dir, "events"), "event_id"), RESPONSES)
        return df.drop("ts", "props", *[c for c in df.columns if c.startswith("expected_")])

    return stored(spark, sf_dir, "responses", build)


RESPONSES_SQL = render("events", RESPONSES)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities from embeddings: five per token, one token for each value and up to 15 more
    for the first values again, with an empty first token (vec_id % 13 = 0), a short last one (vec_id % 7 = 0), no tokens (vec_id % 50 = 0) or null
    (vec_id % 61 = 0)."""
    df = table(spark, sf_dir, "embeddings")
    count = F.when(F.col("vec_id") % 50 == 0, F.lit(0)).otherwise(F.size("embedding") + F.col("vec_id") % 16).cast("int")
    steps = (0.0, 0.1, 0.2, 0.3, 0.4)
    around = lambda x, n: F.array(*[x.cast("double") - F.lit(d) for d in steps[:n]])
    nested = F.transform(
        F.slice(F.concat("embedding", "embedding"), F.lit(1), count),
        lambda x, i: F.when((F.col("vec_id") % 13 == 0) & (i == 0), F.array().cast("array<double>"))
        .when((F.col("vec_id") % 7 == 0) & (i == count - 1), around(x, 4))
        .otherwise(around(x, 5)),
    )
    return df.select(
        F.col("vec_id").alias("response_no"),
        F.concat(F.lit("r"), F.col("vec_id").cast("string")).alias("response_id"),
        F.concat(F.lit("q"), (F.col("vec_id") % 37).cast("string")).alias("problem_id"),
        F.when(F.col("vec_id") % 61 != 0, nested).alias("logprobs"),
    )


TOKENS_SQL = """
select vec_id as response_no, concat('r', cast(vec_id as string)) as response_id,
  concat('q', cast(vec_id % 37 as string)) as problem_id,
  case when vec_id % 61 = 0 then null else
  list_transform(list_zip(list_concat(embedding, embedding)[1:cnt], range(0, cnt)), lambda z:
    case when vec_id % 13 = 0 and z[2] = 0 then cast([] as double[])
    when vec_id % 7 = 0 and z[2] = cnt - 1 then
      list_transform([0.0, 0.1, 0.2, 0.3], lambda d: cast(z[1] as double) - cast(d as double))
    else list_transform([0.0, 0.1, 0.2, 0.3, 0.4], lambda d: cast(z[1] as double) - cast(d as double)) end)
  end as logprobs
from (select *, case when vec_id % 50 = 0 then 0 else len(embedding) + vec_id % 16 end as cnt from embeddings)
"""

QUALITY_LAYERS = [
    {"is_correct": "quality = 1", "score": "cast(n_chars as double)", "toxic_flag": "toxic = 1"},
]


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with quality labels: skewed lengths as score, word count as tokens."""
    from voteframe.functions.text import word_count


    def build() -> DataFrame:
        docs = spread(table(spark, sf_dir, "documents"), "doc_id").withColumn("words", word_count(F.col("text")))
        joined = docs.join(table(spark, sf_dir, "labels"), "doc_id")
        return project(joined.drop("text"), QUALITY_LAYERS)

    return stored(spark, sf_dir, "quality", build)


WORDS_SQL = "len(list_filter(string_split_regex({0}, '[\\s\\x0b]+'), lambda w: w <> ''))"
QUALITY_SQL = (
    f"select *, cast({WORDS_SQL.format('text')} as int) as words from ("
    + render("(select d.*, l.quality, l.toxic from documents d join labels l using (doc_id))", QUALITY_LAYERS)
    + ")"
)
