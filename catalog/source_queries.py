"""Sources, sinks, row selection and streams. Files are written under the shared work folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as fx
from catalog.registry import WITH_R, query, rounded
from voteframe import schemas
from voteframe.functions.text import word_count
from voteframe.operators import overlap, selection as sel
from voteframe.session import new_folder
from voteframe.sources import positions, readers, shards, writers
from voteframe.streaming import ingest

PROBLEMS_SQL = "(select distinct problem_id, problem_text, ground_truth from r)"


def problems(spark, sf):
    return fx.responses(spark, sf).select("problem_id", "problem_text", "ground_truth").distinct()


@query("s1_read_problems", WITH_R + f"select * from {PROBLEMS_SQL}")
def s1(spark, sf):
    path = new_folder(spark, "problems") + ".jsonl"
    rows = problems(spark, sf).select(
        F.col("problem_id").alias("id"), F.col("problem_text").alias("problem"), F.col("ground_truth").alias("answer")
    )
    writers.write_table(rows, path, "json")
    return readers.canonical_problems(readers.read_problems(spark, path))


@query(
    "s1_default_ids",
    "select item_id, concat('problem_', cast(item_id as string)) as id from benchmark",
)
def s1_ids(spark, sf):
    df = fx.table(spark, sf, "benchmark").select("item_id", F.lit(None).cast("string").alias("id"))
    return readers.with_default_ids(df, "item_id")


def ordered_files(spark, rows, order, kind, suffix=""):
    """A folder of files that hold the rows in order, without the column of the order."""
    path = new_folder(spark, "ordered") + suffix
    ranges = rows.repartitionByRange(4, order).sortWithinPartitions(order).drop(order)
    writers.write_table(ranges, path, kind)
    return path


@query(
    "s1_ids_by_position",
    "select concat('problem_', cast(row_number() over (order by o_orderkey) - 1 as string)) as problem_id, "
    "concat(o_orderpriority, ' ', cast(o_orderkey as string)) as problem_text, cast(o_custkey as string) as ground_truth from orders",
)
def s1_positions(spark, sf):
    rows = fx.table(spark, sf, "orders").select(
        "o_orderkey", F.concat("o_orderpriority", F.lit(" "), F.col("o_orderkey").cast("string")).alias("problem"),
        F.col("o_custkey").cast("string").alias("answer"),
    )
    path = ordered_files(spark, rows, "o_orderkey", "json", ".jsonl")
    return readers.canonical_problems(readers.read_problems(spark, path))


@query(
    "s13_convert_by_position",
    "select concat('gsm8k_', cast(row_number() over (order by o_orderkey) - 1 as string)) as id, "
    "o_orderpriority as problem, cast(o_custkey as string) as answer from orders",
)
def s13_positions(spark, sf):
    rows = fx.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("question"), F.concat(F.lit("so #### "), F.col("o_custkey").cast("string")).alias("answer")
    )
    path = ordered_files(spark, rows, "o_orderkey", "json")
    lines = positions.read_numbered(spark, path, readers.string_schema("question", "answer"))
    return readers.convert_gsm8k(lines, "position").drop("full_answer")


@query(
    "p3_shard_by_position",
    "select o_orderkey, cast((row_number() over (order by o_orderkey) - 1) % 7 as int) as shard from orders",
)
def p3_positions(spark, sf):
    rows = fx.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").alias("place"))
    table = positions.read_numbered(spark, ordered_files(spark, rows, "place", "parquet"), kind="parquet")
    return sel.shard(table, 7, "position").select("o_orderkey", "shard")


def response_table(spark, sf):
    df = fx.responses(spark, sf)
    given = {f.name: F.col(f.name) for f in schemas.RESPONSES if f.name != "logprobs"}
    given["logprobs"] = F.array(F.array(F.col("value").cast("float")))
    return df.select(*[given[f.name].alias(f.name) for f in schemas.RESPONSES])


@query(
    "s2_read_responses",
    WITH_R + "select response_id, problem_id, response_idx, output_token_count, round(tail_confidence, 6) as tail_confidence, "
    "round(cast(cast(value as float) as double), 4) as first_logprob from r",
)
def s2(spark, sf):
    path = new_folder(spark, "responses")
    writers.write_table(response_table(spark, sf), path)
    df = readers.read_responses(spark, path)
    return df.select(
        "response_id", "problem_id", readers.response_index(F.col("response_id")).alias("response_idx"),
        "output_token_count", F.round("tail_confidence", 6).alias("tail_confidence"),
        F.round(F.col("logprobs")[0][0].cast("double"), 4).alias("first_logprob"),
    )


@query(
    "s3_read_curated",
    WITH_R + "select event_id, cast(case when event_id % 3 = 0 then 1 else 2 end as int) as n, "
    "case when event_id % 3 = 0 then answer else response_id end as first_response, "
    "case when event_id % 5 = 0 then null else round(value, 2) end as first_score from r",
)
def s3(spark, sf):
    path = new_folder(spark, "curated")
    lists = F.when(F.col("event_id") % 3 == 0, F.col("answer")).otherwise(
        F.concat(F.lit("['"), F.col("response_id"), F.lit("', '"), F.col("answer"), F.lit("']"))
    )
    scores = F.when(F.col("event_id") % 5 == 0, F.lit("not a list")).otherwise(
        F.concat(F.lit("{'tail_confidence': ["), F.round("value", 2).cast("string"), F.lit(", 1.0]}"))
    )
    rows = fx.responses(spark, sf).select(
        "event_id", lists.alias("responses"), scores.alias("confidence_scores")
    )
    writers.write_table(rows, path)
    df = readers.read_curated(spark, path)
    return df.select(
        "event_id", F.size("responses").alias("n"), F.col("responses")[0].alias("first_response"),
        F.try_element_at("confidence_scores", F.lit("tail_confidence"))[0].alias("first_score"),
    )


@query(
    "s4_read_benchmark",
    "select text as problem, concat('answer ', cast(item_id as string)) as answer from benchmark",
)
def s4(spark, sf):
    path = new_folder(spark, "benchmark")
    rows = fx.table(spark, sf, "benchmark").select(
        F.col("text").alias("problem"), F.concat(F.lit("answer "), F.col("item_id").cast("string")).alias("answer")
    )
    writers.write_table(rows, path, "json")
    return readers.read_benchmark(spark, path).select("problem", "answer")


@query(
    "s5_normalize_benchmark",
    "select row_number() over (order by item_id) - 1 as problem_id, text as problem_text, "
    "case when item_id % 2 = 0 then cast(item_id as string) else concat('plain ', cast(item_id as string)) end "
    "as ground_truth from benchmark",
)
def s5(spark, sf):
    number = F.col("item_id").cast("string")
    df = fx.table(spark, sf, "benchmark").select(
        "item_id", F.col("text").alias("question"),
        F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("so \\boxed{ "), number, F.lit(" } holds")))
        .otherwise(F.concat(F.lit("plain "), number)).alias("solution"),
    )
    return readers.normalize_benchmark(df, "AIME24 test", "item_id")


@query(
    "s6_read_solution_results",
    WITH_R + "select dataset as dataset_name, problem_id, response_idx, final_answer, content, "
    "tail_confidence from r",
)
def s6(spark, sf):
    path = new_folder(spark, "results")
    df = fx.responses(spark, sf).withColumns(
        {
            "reasoning_content": F.lit(""),
            "confidence_scores": F.create_map(F.lit("tail_confidence"), F.col("tail_confidence")),
        }
    )
    fields = ["generated_text", "reasoning_content", "content", "final_answer", "confidence_scores"]
    # Maps cannot be compared, so the scores are packed after the positions are in order.
    packed = df.withColumn("scores", F.col("tail_confidence")).drop("confidence_scores")
    nested = sel.nest_by_problem(
        packed, ["generated_text", "reasoning_content", "content", "final_answer", "scores"],
        ["dataset", "problem_id", "problem_text", "ground_truth"],
    )
    solutions = F.transform(
        "solutions",
        lambda s: F.struct(
            *[s[f].alias(f) for f in fields[:-1]],
            F.create_map(F.lit("tail_confidence"), s["scores"]).alias("confidence_scores"),
        ),
    )
    lines = nested.select(
        F.col("dataset").alias("dataset_name"), F.lit(1).cast("bigint").alias("total_problems"),
        F.array(F.struct("problem_id", "problem_text", "ground_truth", "start", solutions.alias("solutions"))).alias("generated_solutions"),
    )
    writers.write_table(lines, path, "json")
    out = readers.read_solution_results(spark, path, multi_line=False)
    return out.select(
        "dataset_name", "problem_id", "response_idx", "final_answer", "content",
        F.try_element_at("confidence_scores", F.lit("tail_confidence")).alias("tail_confidence"),
    )


REPLICAS = ("shard_0", "shard_1", "shard_2", "shard_3")


def shard_folder(spark, sf) -> str:
    """Four shards in one folder; the first lacks two columns."""
    folder = new_folder(spark, "shards")
    df = fx.responses(spark, sf).select(
        "problem_id", "response_id", "generated_text", "worker_gpu", "worker_replica", "output_token_count",
        F.array(F.array(F.col("value"))).alias("logprobs"),
    )
    for name in REPLICAS:
        part = df.where(F.col("worker_replica") == name)
        part = part.drop("worker_gpu", "output_token_count") if name == REPLICAS[0] else part
        writers.write_table(part, f"{folder}/{name}.parquet")
    return folder


@query(
    "s7_merge_shards",
    WITH_R + "select response_id, worker_replica, case when worker_replica = 'shard_0' then null else worker_gpu end as worker_gpu, "
    "case when worker_replica = 'shard_0' then null else output_token_count end as output_token_count from r where worker_replica <> 'shard_3'",
)
def s7(spark, sf):
    merged = shards.merge_shards(spark, shard_folder(spark, sf), exclude="shard_3.parquet")
    return merged.select("response_id", "worker_replica", "worker_gpu", "output_token_count")


@query(
    "s7_merge_report",
    WITH_R + "select worker_replica, count(*) as responses, count(distinct problem_id) as problems, "
    "round(count(*) / count(distinct problem_id), 6) as mean_responses from r group by 1 union all "
    "select null, count(*), count(distinct problem_id), round(count(*) / count(distinct problem_id), 6) from r",
)
def s7_report(spark, sf):
    return rounded(shards.merge_report(fx.responses(spark, sf)))


@query("s8_merge_shards_slim", WITH_R + "select response_id, problem_id, worker_replica from r")
def s8(spark, sf):
    out = new_folder(spark, "slim")
    shards.merge_shards_slim(spark, shard_folder(spark, sf), out)
    slim = spark.read.parquet(out)
    return slim.select(*[c for c in slim.columns if c not in ("worker_gpu", "output_token_count")])


@query(
    "s9_jsonl_to_parquet",
    WITH_R + "select event_id, response_id, final_answer from r union all select event_id, response_id, final_answer from r",
)
def s9(spark, sf):
    rows = fx.responses(spark, sf).select("event_id", "response_id", "final_answer")
    paths = [new_folder(spark, "lines"), new_folder(spark, "lines")]
    for path in paths:
        writers.write_table(rows, path, "json")
    missing = new_folder(spark, "absent")
    return writers.jsonl_to_parquet(
        spark, [*paths, missing], new_folder(spark, "table"), rows.schema, warn=lambda text: None
    )


def two_tables(spark, sf):
    """Responses split by worker; the second lacks the problems of one response."""
    df = fx.responses(spark, sf)
    return df.where("worker_gpu = 'gpu_0'"), df.where("worker_gpu = 'gpu_1'")


TWO = WITH_R + ", a as (select * from r where worker_gpu = 'gpu_0'), b as (select * from r where worker_gpu = 'gpu_1') "


@query(
    "s10_merge_if_same_keys",
    TWO + "select event_id, 'same' as attempt from r where problem_id in (select problem_id from a) "
    "and problem_id in (select problem_id from b)",
)
def s10(spark, sf):
    a, b = two_tables(spark, sf)
    columns = ["problem_id", "event_id"]
    common_a = overlap.restrict_to_common(a, b).select(*columns)
    common_b = overlap.restrict_to_common(b, a).select(*columns)
    # Common problems merge; the tables as they are differ in their keys and give nothing.
    same = shards.merge_if_same_keys(common_a, common_b).withColumn("attempt", F.lit("same"))
    different = shards.merge_if_same_keys(a.select(*columns), b.select(*columns)).withColumn("attempt", F.lit("different"))
    return same.unionByName(different).select("event_id", "attempt")


@query("s11_drop_logprobs", WITH_R + "select response_id, problem_id, output_token_count from r")
def s11(spark, sf):
    df = fx.responses(spark, sf).select(
        "response_id", "problem_id", "output_token_count",
        F.array(F.array("value")).alias("logprobs"), F.col("value").alias("Token_Log_Probs"),
        F.col("value").alias("old_LOGPROBS"),
    )
    return shards.drop_logprobs(df, cleaning=True)


@query(
    "s12_write_table",
    WITH_R + "select event_id, response_id, cast(3 as bigint) as copies from r",
)
def s12(spark, sf):
    rows = fx.responses(spark, sf).select("event_id", "response_id")
    parts = []
    for kind in ("parquet", "json", "csv"):
        path = new_folder(spark, kind)
        writers.write_table(rows, path, kind)
        reader = spark.read.schema(rows.schema)
        parts.append({"parquet": reader.parquet, "json": reader.json, "csv": reader.option("header", True).csv}[kind](path))
    return shards.union_all(parts).groupBy("event_id", "response_id").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "s13_convert_gsm8k",
    "select concat('gsm8k_', cast(row_number() over (order by o_orderkey) - 1 as string)) as id, "
    "o_orderpriority as problem, case o_orderkey % 3 when 0 then cast(o_custkey as string) "
    "when 1 then cast(o_custkey as string) else '0' end as answer from orders",
)
def s13(spark, sf):
    number = F.col("o_custkey").cast("string")
    form = F.col("o_orderkey") % 3
    answer = (
        F.when(form == 0, F.concat(F.lit("adds 1 and 2 ####  "), number, F.lit(" units")))
        .when(form == 1, F.concat(F.lit("adds 7 to get "), number, F.lit(" units"))).otherwise("no digits")
    )
    df = fx.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("question"), answer.alias("answer")
    )
    return readers.convert_gsm8k(df, "o_orderkey").drop("full_answer")


@query(
    "s14_upsert_summary",
    WITH_R + "select dataset, group_size, aggregator, variant_id, correct + case when aggregator = 'agg_1' then 1000 else 0 end as correct from ("
    "select dataset, cast(4 as int) as group_size, concat('agg_', cast(blk % 2 as string)) as aggregator, "
    "concat('variant_', cast(slot as string)) as variant_id, count(*) filter (where is_correct) as correct from r group by 1, 2, 3, 4)",
)
def s14(spark, sf):
    path = new_folder(spark, "summary")
    summary = fx.responses(spark, sf).groupBy(
        "dataset", F.lit(4).alias("group_size"), F.concat(F.lit("agg_"), F.expr("blk % 2").cast("string")).alias("aggregator"),
        F.concat(F.lit("variant_"), F.col("slot").cast("string")).alias("variant_id"),
    ).agg(F.count_if("is_correct").alias("correct"))
    writers.upsert_summary(summary, path)
    again = summary.where("aggregator = 'agg_1'").withColumn("correct", F.col("correct") + 1000)
    writers.upsert_summary(again, path)
    return spark.read.schema(summary.schema).parquet(path).select(*summary.columns)


@query(
    "p1_build_prompt",
    WITH_R + "select problem_id, concat(problem_text, chr(10), chr(10), 'Please reason step by step, and put your final answer within ', "
    f"chr(92), 'boxed{{}}.') as prompt from {PROBLEMS_SQL}",
)
def p1(spark, sf):
    return problems(spark, sf).select("problem_id", sel.build_prompt(F.col("problem_text")).alias("prompt"))


@query(
    "p2_sample_problems",
    WITH_R + f"select problem_id from {PROBLEMS_SQL} order by md5(concat(problem_id, '|42')), problem_id limit 20",
)
def p2(spark, sf):
    return sel.sample_problems(problems(spark, sf), 20).select("problem_id")


@query("p3_shard", "select event_id, cast((row_number() over (order by event_id) - 1) % 7 as int) as shard from events")
def p3(spark, sf):
    return sel.shard(fx.table(spark, sf, "events").select("event_id"), 7, "event_id")


@query(
    "p4_pending",
    TWO + f"select problem_id from {PROBLEMS_SQL} where problem_id not in (select problem_id from a where is_correct)",
)
def p4(spark, sf):
    a, _ = two_tables(spark, sf)
    return sel.pending(problems(spark, sf), a.where("is_correct")).select("problem_id")


@query("p4_pending_responses", TWO + "select response_id from r where response_id not in (select response_id from a)")
def p4_responses(spark, sf):
    a, _ = two_tables(spark, sf)
    return sel.pending(fx.responses(spark, sf).select("response_id"), a, "response_id")


@query(
    "p5_explode_completions",
    "select concat('c', cast(conv_id as string)) as problem_id, cast(i as int) as response_idx, "
    "concat('c', cast(conv_id as string), '_resp_', cast(i as string)) as response_id, "
    "string_split(text, '.')[i + 1] as generated_text from (select conv_id, turn, text, "
    "unnest(range(0, len(string_split(text, '.')))) as i from conversations)",
)
def p5(spark, sf):
    chats = fx.table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("problem_id"),
        F.split("text", r"\.").alias("completions"),
    )
    return sel.explode_completions(chats)


@query(
    "p7_total_tokens",
    WITH_R + "select event_id, coalesce(output_token_count, 0) + coalesce(prompt_token_count, 0) as filled, "
    "output_token_count + prompt_token_count as plain, output_token_count as output_only from r",
)
def p7(spark, sf):
    df = fx.responses(spark, sf)
    return df.select(
        "event_id", sel.total_tokens(df).alias("filled"), sel.total_tokens(df, False).alias("plain"),
        sel.total_tokens(df.drop("prompt_token_count")).alias("output_only"),
    )


@query(
    "p8_nest_by_problem",
    WITH_R + "select problem_id, cast(response_idx // 4096 * 4096 as bigint) as start, cast(count(*) as int) as responses, "
    "string_agg(final_answer, '|' order by response_idx) as answers from r group by 1, 2",
)
def p8(spark, sf):
    nested = sel.nest_by_problem(fx.responses(spark, sf), ["response_id", "final_answer"])
    answers = F.array_join(F.transform("solutions", lambda s: s["final_answer"]), "|")
    return nested.select("problem_id", "start", F.size("solutions").alias("responses"), answers.alias("answers"))


@query("p10_cap_prompt_length", WITH_R + "select event_id from r where prompt_token_count <= 53")
def p10(spark, sf):
    return sel.cap_prompt_length(fx.responses(spark, sf), 53).select("event_id")


@query(
    "p10_capped_prompt_report",
    WITH_R + "select split, count(*) as before, count(*) filter (where prompt_token_count <= 53) as kept, "
    "count(*) - count(*) filter (where prompt_token_count <= 53) as removed from r group by 1",
)
def p10_report(spark, sf):
    return sel.capped_prompt_report(fx.responses(spark, sf), 53)


@query(
    "p11_filter_by_token_length",
    WITH_R + "select event_id, cast(2 + event_id % 40 as int) as token_count from r where content <> '' and 2 + event_id % 40 < 25",
)
def p11(spark, sf):
    kept = sel.filter_by_token_length(fx.responses(spark, sf), 25, word_count)
    return kept.select("event_id", "token_count")


# Streams read the given events table itself (one file or a folder of them), so that their work
# grows with it.
def event_stream(spark, sf):
    schema = fx.table(spark, sf, "events").schema
    return fx.project(ingest.response_stream(spark, f"{sf}/events.parquet*", schema, "parquet"), fx.RESPONSES)


@query(
    "r1_stream_ingest_responses",
    WITH_R + "select response_id, worker_replica, round(-value, 4) as mean_group_confidence from r",
)
def r1(spark, sf):
    out, mark = new_folder(spark, "ingest"), new_folder(spark, "mark")
    rows = event_stream(spark, sf).select(
        "response_id", "worker_replica", F.array(F.array("value")).alias("logprobs")
    )
    ingest.append_stream(rows, out, mark, ingest.scored(1)).awaitTermination()
    df = spark.read.parquet(out)
    return df.select("response_id", "worker_replica", F.round("mean_group_confidence", 4).alias("mean_group_confidence"))


@query("r2_resume", WITH_R + "select response_id, cast(1 as bigint) as copies from r")
def r2(spark, sf):
    out, mark = new_folder(spark, "resume"), new_folder(spark, "mark")
    for _ in range(2):  # the second run resumes from the checkpoint and finds nothing new
        rows = event_stream(spark, sf).select("response_id")
        ingest.append_stream(rows, out, mark).awaitTermination()
    return spark.read.parquet(out).groupBy("response_id").agg(F.count(F.lit(1)).alias("copies"))


@query("r3_dedupe_by_response_id", WITH_R + "select response_id, cast(1 as bigint) as copies from r")
def r3(spark, sf):
    out = new_folder(spark, "unique")
    for _ in range(2):  # a second stream brings the same responses again
        rows = event_stream(spark, sf).select("response_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"))
        ingest.ingest_new(rows, out, new_folder(spark, "mark"), buckets=16).awaitTermination()
    return spark.read.parquet(out).groupBy("response_id").agg(F.count(F.lit(1)).alias("copies"))


@query("r3_dedupe_stateful", WITH_R + "select response_id, cast(1 as bigint) as copies from r")
def r3_state(spark, sf):
    out, mark = new_folder(spark, "unique"), new_folder(spark, "mark")
    rows = event_stream(spark, sf).select("response_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"))
    ingest.append_stream(ingest.dedupe_stateful(rows), out, mark).awaitTermination()
    return spark.read.parquet(out).groupBy("response_id").agg(F.count(F.lit(1)).alias("copies"))


@query("r4_stream_progress", WITH_R + "select worker_replica, count(*) as finished from r group by 1")
def r4(spark, sf):
    out, mark = new_folder(spark, "progress"), new_folder(spark, "mark")
    ingest.stream_progress(event_stream(spark, sf), out, mark).awaitTermination()
    return ingest.latest_progress(spark, out)
