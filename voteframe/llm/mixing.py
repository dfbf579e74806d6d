"""Mixing to target weights by soft domain membership.

A naive Bayes classifier over hashed words, fitted on a bounded sample of labelled rows, gives every
document posteriors over the domains. Non-negative rates are fitted to the documents by projected
gradient descent on a least-squares objective: the expected tokens of each domain, counted by rate
and posterior, should be its share of the corpus, and rates should stay near one. Posteriors are
rounded, so documents of equal posteriors are counted together, and a step of the descent is one
aggregation of these counts; what the driver holds is one number per domain and step.

Everything is DataFrame operations; texts are read where they lie, and nothing of a document moves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from voteframe.llm.common import SAMPLE_ROWS, smallest_hashes
from voteframe.session import cut_lineage

BUCKETS = 4096
SOFT_WORDS = 40
DOMAINS = 50
STEPS = 60
PULL = 1e-3
TOLERANCE = 1e-4
PARTS = 100  # posteriors are rounded to hundredths


def words(text: Column) -> Column:
    """Lower-case runs of anything but white space."""
    split = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"\s+")
    return F.filter(split, lambda w: w != "")


def word_buckets(text: Column, n: int) -> Column:
    return F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(n)).cast("int"))


def constants(values: list[float]) -> Column:
    """An array literal of numbers, folded by the optimiser."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


@dataclass
class Classifier:
    """Log-probabilities of buckets and priors per domain."""

    domains: list[str]
    priors: list[float]
    weights: list[list[float]]

    def posteriors(self, buckets: Column, soft_words: int = SOFT_WORDS) -> Column:
        """Posteriors in whole parts (``PARTS`` is one), an array in order of ``domains``. Evidence
        counts as that of ``soft_words`` words at most, so long texts keep soft memberships."""
        tables = [constants(w) for w in self.weights]

        def logs(b: Column) -> Column:
            scale = F.least(F.lit(1.0), F.lit(float(soft_words)) / F.greatest(F.size(b), F.lit(1)))
            sums = [evidence(b, t) * scale + F.lit(p) for t, p in zip(tables, self.priors)]
            return F.array(*sums)

        return bound(buckets, lambda b: bound(logs(b), softmax))


def evidence(buckets: Column, table: Column) -> Column:
    return F.aggregate(buckets, F.lit(0.0), lambda acc, x: acc + table[x])


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def softmax(logs: Column) -> Column:
    """Shares of the exponentials in whole parts."""
    parts = lambda s: bound(F.aggregate(s, F.lit(0.0), lambda a, x: a + x), lambda t: F.transform(s, lambda x: F.round(x / t * PARTS).cast("int")))
    return bound(F.array_max(logs), lambda peak: bound(F.transform(logs, lambda x: F.exp(x - peak)), parts))


def fit_classifier(
    docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    domain_col: str = "domain", buckets: int = BUCKETS, sample_rows: int = SAMPLE_ROWS, domains: int = DOMAINS,
) -> Classifier:
    """Naive Bayes from at most ``sample_rows`` rows of ``labelled`` (id, domain), those with the
    smallest key hashes. More than ``domains`` domains in them are an error: the model is an
    expression of as many sums, and no domain is left out without a word."""
    import math

    rows = labelled.where(F.col(domain_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.groupBy(F.col(id_col).alias("__id")).agg(F.min(F.col(domain_col).cast("string")).alias("domain"))
    sample = F.broadcast(smallest_hashes(rows, "__id", sample_rows))  # at most sample_rows ids
    texts = docs.join(sample, F.col(id_col) == F.col("__id"))
    counted = texts.select("domain", F.explode(word_buckets(F.col(text_col), buckets)).alias("bucket"))
    cells = counted.groupBy("domain", "bucket").count()
    shares = {r.domain: r["count"] for r in sample.groupBy("domain").count().limit(domains + 1).collect()}
    if len(shares) > domains:
        raise ValueError(f"more than {domains} domains; pass a larger bound as domains=")
    names = sorted(shares)
    at = {name: i for i, name in enumerate(names)}
    counts = [[0] * buckets for _ in names]
    for r in cells.collect():  # at most buckets * domains cells
        counts[at[r.domain]][r.bucket] = r["count"]
    weights = []
    for row in counts:
        total = sum(row) + buckets
        weights.append([math.log((c + 1) / total) for c in row])
    everything = sum(shares.values())
    return Classifier(names, [math.log(shares[d] / everything) for d in names], weights)


def rate_of(parts: Column, history: list[list[float]], pull: float) -> Column:
    """The rate after all steps, from a document's posteriors and the gradients of the steps."""
    if not history:
        return F.lit(1.0)
    steps = F.array(*[constants(g) for g in history])
    slope = lambda g: F.aggregate(F.zip_with(g, parts, lambda a, p: a * p), F.lit(0.0), lambda s, x: s + x) / PARTS
    step = 1.0 / (1.0 + pull)
    return F.aggregate(steps, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - step * (slope(g) + pull * (r - 1.0))))


def fit_rates(
    cells: DataFrame, domains: list[str], targets: dict[str, float], steps: int = STEPS, pull: float = PULL,
    tolerance: float = TOLERANCE,
) -> list[list[float]]:
    """Gradients, step by step, of the least-squares fit. ``cells``: ``parts, tokens``.

    Each domain's squared error weighs by one over the domain's share, which makes the steps
    independent of how unequal the domains are. Targets are scaled to sum to one; a domain without a
    target gets none of the weight, a target without a domain cannot be met and is left out.
    """
    wanted = [max(0.0, targets.get(d, 0.0)) for d in domains]
    total = sum(wanted)
    if not total:
        raise ValueError("no target weight for any domain")
    wanted = [w / total for w in wanted]
    sums = lambda rate: [F.sum(F.col("tokens") * rate * F.col("parts")[k] / PARTS).alias(f"d{k}") for k in range(len(domains))]
    start = cells.agg(*sums(F.lit(1.0)), F.sum("tokens").alias("all")).first()
    if not start["all"]:
        return []
    shares = [start[f"d{k}"] / start["all"] for k in range(len(domains))]
    history: list[list[float]] = []
    now = shares
    for _ in range(steps):
        errors = [a - w for a, w in zip(now, wanted)]
        if max(abs(e) for e in errors) <= tolerance:
            break
        history.append([e / s if s > 0 else 0.0 for e, s in zip(errors, shares)])
        row = cells.agg(*sums(rate_of(F.col("parts"), history, pull))).first()
        now = [row[f"d{k}"] / start["all"] for k in range(len(domains))]
    return history


def mix(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
    domain_col: str = "domain", seed: int = 42, **options,
) -> tuple[DataFrame, list[str]]:
    """The documents, all columns, with ``__tokens`` (words), ``__parts`` (posteriors in hundredths),
    ``__rate`` and ``__copies``, and the domains in order of the posteriors.

    ``__copies`` is the rate rounded down or up by a hash of the id, so that its expectation is the
    rate. Null and empty texts have no tokens and the priors as posteriors. Without labelled rows
    or without tokens all rates are 1. Repeated rows are treated alike; a null id hashes like a value.
    """
    fit = {k: v for k, v in options.items() if k in ("buckets", "sample_rows", "domains")}
    model = fit_classifier(docs, labelled, id_col, text_col, domain_col, **fit)
    buckets = word_buckets(F.col(text_col), options.get("buckets", BUCKETS))
    scored = docs.withColumn("__b", buckets)
    scored = scored.withColumn("__tokens", F.size("__b").cast("long"))
    parts = model.posteriors(F.col("__b")) if model.domains else F.array().cast("array<int>")
    scored = scored.withColumn("__parts", parts).drop("__b")
    history = []
    if model.domains:
        cells = scored.groupBy(F.col("__parts").alias("parts")).agg(F.sum("__tokens").alias("tokens"))
        history = fit_rates(cut_lineage(cells, "cells"), model.domains, targets, **{k: v for k, v in options.items() if k in ("steps", "pull", "tolerance")})
    rate = rate_of(F.col("__parts"), history, options.get("pull", PULL))
    chance = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    scored = scored.withColumn("__rate", rate)
    return scored.withColumn("__copies", F.floor(F.col("__rate") + chance).cast("int")), model.domains
