"""Log-probability arrays: shaping them and turning them into per-token confidence."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LOGPROBS_JSON = "array<array<float>>"


def token_confidence(logprobs: Column) -> Column:
    """Negative mean log-probability of each token; a token without values gives NaN."""

    def one(token: Column) -> Column:
        total = F.aggregate(token, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
        return F.when(F.size(token) > 0, -(total / F.size(token))).otherwise(F.lit(float("nan")))

    return F.transform(logprobs, one)


def normalize_json(logprobs: Column) -> Column:
    """Parse a JSON string of nested log-probabilities."""
    return F.from_json(logprobs, LOGPROBS_JSON)


def normalize_flat(logprobs: Column) -> Column:
    """Turn one log-probability per token into the nested form."""
    return F.transform(logprobs, lambda x: F.array(x))


def topk_from_records(tokens: Column, k: int) -> Column:
    """First ``k`` log-probabilities per token, from arrays of records with a ``logprob`` field."""
    return F.transform(
        tokens,
        lambda t: F.coalesce(F.slice(F.transform(t, lambda e: e["logprob"]), 1, k), F.array()),
    )


def topk_from_maps(tokens: Column, k: int) -> Column:
    """First ``k`` log-probabilities per token, from maps of token to log-probability."""
    return F.transform(tokens, lambda t: F.coalesce(F.slice(F.map_values(t), 1, k), F.array()))
