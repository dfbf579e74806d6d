"""Confidence scores of a response from its per-token confidences.

The sliding scores are row-local: one Arrow-batched function receives the log-probabilities of many
responses as one flat array and returns all seven scores of each, so nothing is exploded and nothing
is shuffled. The tumbling scores need only built-in array functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from voteframe.functions.text import let
from voteframe.schemas import SCORE_NAMES, SCORES

DEFAULT_GROUP = 10
EDGE_SCORES = ("tail_confidence", "head_confidence")


def sliding_means(values: np.ndarray, group: int, short: str = "spread") -> np.ndarray:
    """Means of all stride-1 windows of ``group`` values.

    With fewer values than ``group``: ``spread`` gives ``group - n + 1`` equal values
    ``sum / group`` (what a 'valid' convolution yields once it swaps its operands), ``mean`` gives
    the plain mean once. A NaN or an infinity only affects the windows that contain it.
    """
    n = len(values)
    if n == 0:
        return values
    if n < group:
        if short == "mean":
            return np.array([values.mean()])
        return np.full(group - n + 1, values.sum() / group)
    bad = ~np.isfinite(values)
    sums = np.concatenate(([0.0], np.cumsum(np.where(bad, 0.0, values))))
    out = (sums[group:] - sums[:-group]) / group
    if bad.any():
        held = []
        for marks in (np.isnan(values), values == np.inf, values == -np.inf):
            count = np.concatenate(([0], np.cumsum(marks)))
            held.append(count[group:] > count[:-group])
        out[held[1]], out[held[2]] = np.inf, -np.inf
        out[held[0] | (held[1] & held[2])] = np.nan
    return out


def response_scores(values: np.ndarray, group: int, short: str) -> tuple:
    """The seven scores of a non-empty array of token confidences, in canonical order."""
    groups = sliding_means(values, group, short)
    m = len(groups)
    k = max(1, int(np.ceil(m * 0.1)))
    low = np.partition(groups, k - 1)[:k]
    high = np.partition(groups, m - k)[m - k:]
    tail, head = values[-group:], values[:group]
    return (
        groups.mean(), low.mean(), tail.mean(), head.mean(), groups.min(), high.mean(), groups.max(),
    )


def token_means(tokens: pa.Array) -> np.ndarray:
    """Negative mean of every inner list; NaN for an empty or null one."""
    offsets = tokens.offsets.to_numpy()
    flat = tokens.values.to_numpy(zero_copy_only=False).astype("float64")[:offsets[-1]]
    sizes = np.diff(offsets)
    out = np.full(len(sizes), np.nan)
    filled = (sizes > 0) & tokens.is_valid().to_numpy(zero_copy_only=False)
    if filled.any():
        sums = np.add.reduceat(flat, offsets[:-1][sizes > 0])
        means = np.full(len(sizes), np.nan)
        means[sizes > 0] = -sums / sizes[sizes > 0]
        out[filled] = means[filled]
    return out


def token_arrays(batch: pa.Array) -> Iterator[np.ndarray | None]:
    """Token confidences per row of an Arrow batch, as views of one flat array. The batch holds
    either nested log-probabilities or token confidences."""
    values, offsets = batch.values, batch.offsets.to_numpy()
    if pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        flat = token_means(values)
    else:
        flat = values.to_numpy(zero_copy_only=False).astype("float64")
    for i, ok in enumerate(batch.is_valid().to_numpy(zero_copy_only=False)):
        yield flat[offsets[i]:offsets[i + 1]] if ok else None


def all_confidence(
    logprobs: Column, group: int = DEFAULT_GROUP, empty: str = "zero", short: str = "spread"
) -> Column:
    """Struct of the seven scores, from nested log-probabilities or token confidences.

    ``empty='zero'``: no log-probabilities give 0.0, except tail and head, which are NaN (the mean
    of nothing). ``empty='nan'``: all NaN, as in batch recalculation.
    """
    if empty not in ("zero", "nan"):
        raise ValueError(f"unknown empty policy: {empty}")
    nan = float("nan")
    missing = 0.0 if empty == "zero" else nan
    blank = tuple(nan if n in EDGE_SCORES else missing for n in SCORE_NAMES)

    @F.arrow_udf(SCORES)
    def score(batch: pa.Array) -> pa.Array:
        table = np.empty((len(batch), len(SCORE_NAMES)))
        for i, values in enumerate(token_arrays(batch)):
            filled = values is not None and len(values) > 0
            table[i] = response_scores(values, group, short) if filled else blank
        columns = [pa.array(table[:, j]) for j in range(len(SCORE_NAMES))]
        return pa.StructArray.from_arrays(columns, names=list(SCORE_NAMES))

    # Marked nondeterministic so that the optimizer never evaluates it twice or moves it into a filter.
    return score.asNondeterministic()(logprobs)


TUMBLING_NAMES = (
    "mean_group_confidence", "bottom_10_percent_confidence", "tail_confidence", "lowest_group_confidence",
    "top_10_percent_confidence", "highest_group_confidence",
)


def group_confidence(logprobs: Column, group: int = DEFAULT_GROUP, short: str = "spread") -> Column:
    """Array of sliding group means, from nested log-probabilities or token confidences."""

    @F.arrow_udf("array<double>")
    def slide(batch: pa.Array) -> pa.Array:
        out = [None if v is None else sliding_means(v, group, short) for v in token_arrays(batch)]
        sizes = [0 if v is None else len(v) for v in out]
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype("int32")
        parts = [v for v in out if v is not None]
        flat = np.concatenate(parts) if parts else np.empty(0)
        gone = pa.array([v is None for v in out])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.float64()), mask=gone)

    return slide.asNondeterministic()(logprobs)


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(values) > 0, total / F.size(values))


def edge_confidence(token_conf: Column, group: int = DEFAULT_GROUP, side: str = "tail") -> Column:
    """Mean of the last (``tail``) or first (``head``) ``group`` tokens, or of all of them if there
    are fewer; null without tokens."""
    size = F.least(F.size(token_conf), F.lit(group))
    start = F.when(F.lit(side == "tail"), F.size(token_conf) - size + 1).otherwise(F.lit(1))
    piece = F.when(F.size(token_conf) > 0, F.slice(token_conf, start, size))
    return let(piece, _mean)


def tumbling_scores(values: np.ndarray, group: int) -> np.ndarray:
    """The six scores of one response with tokens, in the order of ``TUMBLING_NAMES``."""
    starts = np.arange(0, len(values), group)
    sizes = np.diff(np.append(starts, len(values)))
    groups = np.add.reduceat(values, starts) / sizes
    ordered = np.sort(groups)
    k = max(1, int(len(groups) * 0.1))
    return np.array(
        [groups.mean(), ordered[:k].mean(), values[-group:].mean(), ordered[0], ordered[-k:].mean(), ordered[-1]]
    )


def tumbling_confidence(token_conf: Column, group: int = DEFAULT_GROUP) -> Column:
    """Struct of six scores over non-overlapping groups, from nested log-probabilities or token
    confidences; the decile size is truncated, not rounded up, and missing log-probabilities give zeros
    throughout. A null token makes the scores that it takes part in NaN."""

    @F.arrow_udf(", ".join(f"{n} double" for n in TUMBLING_NAMES))
    def score(batch: pa.Array) -> pa.Array:
        table = np.zeros((len(batch), len(TUMBLING_NAMES)))
        for i, values in enumerate(token_arrays(batch)):
            if values is not None and len(values):
                table[i] = tumbling_scores(values, group)
        columns = [pa.array(table[:, j]) for j in range(len(TUMBLING_NAMES))]
        return pa.StructArray.from_arrays(columns, names=list(TUMBLING_NAMES))

    # Marked nondeterministic for the same reason as the sliding scores.
    return score.asNondeterministic()(token_conf)
