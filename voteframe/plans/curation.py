"""From responses to training and validation sets."""

from __future__ import annotations

from pyspark.sql import DataFrame

from voteframe.functions import grading as g
from voteframe.functions.grading import Grader
from voteframe.operators.curation import clean_responses, curate
from voteframe.sources.shards import drop_logprobs
from voteframe.sources.writers import write_table


def curate_to(
    df: DataFrame, out: str, strategy: str = "naive", size: int = 4, num: int = 4,
    percent: float = 50, fraction: float = 0.8, fill: bool = False, clean: bool = False,
    token_threshold: int = 2000, seed: int = 42, confidence_key: str = "tail_confidence",
    grader: Grader = g.equivalent,
) -> None:
    """Clean (optionally), build, mix and split sets, and write them by set size and split.

    ``curriculum`` and ``multitask`` use every halved size; one folder per size and split serves
    the first, the whole table with its ``set_size`` column the second.
    """
    rows = drop_logprobs(df, cleaning=True)
    if clean:
        rows = clean_responses(rows, token_threshold)
    sets = curate(
        rows, size, num, strategy, percent, fraction, fill, seed, confidence_key, grader=grader
    )
    write_table(sets.drop("accuracy", "set_no", "difficulty"), out, partition_by=("set_size", "split"))
