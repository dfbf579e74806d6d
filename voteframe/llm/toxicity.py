"""Toxicity by a lexicon, misspellings included, read in context.

The lexicon holds stems learned from labelled documents: beginnings of words that are frequent in
toxic documents and all but absent from the others. A word hits a stem if it begins with it, or if
it lies within one edit of it, or, for stems whose edited forms are as rare in the other documents as
the stems, if it begins with an edited form. The tests of edits are the intersection of the
Levenshtein automata of all stems with their trie: a set of (trie node, edits) pairs walked one
character at a time, whose subsets become states of one automaton when they are first met.

A hit's context tells quoting from abusing: quotation marks and words of reporting near it on the
one hand, words of address on the other. A logistic regression on the counts of hits by kind gives
the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from voteframe.llm.common import SAMPLE_ROWS, map_arrow, slices, smallest_hashes
from voteframe.llm.neardup import SHINGLE, shingles
from voteframe.llm.words import Words
from voteframe.session import cut_lineage

STEM_CHARS = (4, 12)
LEXICON = 400
FUZZY_CHARS = 5
#: Stems of which one may be all toxic by chance: sets the least number of documents of a stem.
CANDIDATES = 10_000
CONTEXT = 6
THRESHOLD = 0.3
#: Signs and words that mark the context of a hit.
QUOTES = frozenset("\"'`«»‘’“”„")
REPORTING = frozenset(
    "said says say called calls quote quoted wrote writes word term means told dit appelle mot sagte nannte wort dijo llama palabra".split()
)
ADDRESS = frozenset("you your youre yourself u tu te vous toi du dich dir ihr usted eres ustedes".split())
WORD = re.compile(r"[^\W_](?:[^\W_]|['@$!*](?=[^\W_]))*")
SWAPS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "'": None, "*": None})


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Lexicon:
    """Stems in a trie; ``kind`` tells how a word hits one. States are sets of (node, edits)."""

    def __init__(self, stems: list[str], fuzzy_chars: int = FUZZY_CHARS, open_stems: tuple[str, ...] = ()) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.stem_at: list[str | None] = [None]
        for stem in sorted(stems):
            node = 0
            for c in stem:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.stem_at.append(None)
                node = self.children[node][c]
            self.stem_at[node] = stem
        self.fuzzy_chars = fuzzy_chars
        self.open = frozenset(open_stems)
        self.moves: dict[tuple[frozenset, str], frozenset] = {}
        self.ends: dict[tuple[frozenset, str], list[str]] = {}
        self.start = self.closed({(0, 0)})

    def closed(self, pairs: set[tuple[int, int]]) -> frozenset:
        """Adds the pairs reached by leaving out one character of a stem."""
        return frozenset(pairs | {(n, 1) for node, edits in pairs if edits == 0 for n in self.children[node].values()})

    def step(self, state: frozenset, c: str) -> frozenset:
        found = self.moves.get((state, c))
        if found is None:
            pairs = set()
            for node, edits in state:
                if c in self.children[node]:
                    pairs.add((self.children[node][c], edits))
                if edits == 0:
                    pairs.add((node, 1))
                    pairs.update((n, 1) for n in self.children[node].values())
            found = self.closed(pairs)
            if len(self.moves) < 200_000:
                self.moves[state, c] = found
        return found

    def begins(self, word: str) -> bool:
        """Whether the word begins with a stem."""
        node = 0
        for c in word:
            node = self.children[node].get(c, -1)
            if node < 0:
                return False
            if self.stem_at[node] is not None:
                return True
        return False

    def near(self, word: str) -> bool:
        """Whether the word is one edit or none away from a stem of at least ``fuzzy_chars``."""
        state = self.start
        for c in word:
            state = self.step(state, c)
            if not state:
                return False
        return any(s is not None and len(s) >= self.fuzzy_chars for s in (self.stem_at[n] for n, _ in state))

    def beginnings(self, word: str) -> set[str]:
        """Stems of which the word begins with a form of at most one edit. The form ends with the
        stem's last character (else all words with the stem's beginning would count), and one of a
        stem below ``fuzzy_chars`` leaves no character out."""
        state, found = self.start, set()
        for i, c in enumerate(word):
            ends = self.ends.get((state, c))
            if ends is None:
                nodes = {self.children[n][c] for n, _ in state if c in self.children[n]}
                ends = [s for n in nodes if (s := self.stem_at[n]) is not None]
                if len(self.ends) < 200_000:
                    self.ends[state, c] = ends
            found.update(s for s in ends if len(s) >= self.fuzzy_chars or i + 1 >= len(s))
            state = self.step(state, c)
            if not state:
                break
        return found

    @lru_cache(maxsize=1 << 17)
    def kind(self, word: str) -> int:
        """2: begins with a stem, 1: a misspelling, 0: neither."""
        if self.begins(word):
            return 2
        plain = word.translate(SWAPS)
        if plain != word and self.begins(plain):
            return 1
        return int(self.near(word) or (bool(self.open) and not self.open.isdisjoint(self.beginnings(word))))


FEATURES = ("stem_hits", "misspelt_hits", "quoted_hits", "addressed_hits", "hits_per_100_words")


def features(text: str | None, lexicon: Lexicon, context: int = CONTEXT) -> list[float]:
    """Counts of hits: by stem, misspelt, in quoting context, next to words of address, and all per
    hundred words. The whole text is read; a context is ``context`` words on either side."""
    text = text or ""
    low = text.lower()
    words = WORD.findall(low)
    kinds = {w: k for w in set(words) if (k := lexicon.kind(w))}
    if not kinds:
        return [0.0] * len(FEATURES)
    spans = [(m.group(), m.start(), m.end()) for m in WORD.finditer(low)]
    exact = misspelt = quoted = addressed = 0
    for i, (word, begin, end) in enumerate(spans):
        if word not in kinds:
            continue
        near = {w for w, _, _ in spans[max(0, i - context) : i + context + 1]}
        left = low[spans[max(0, i - context)][1] : begin]
        right = low[end : spans[min(len(spans) - 1, i + context)][2] + 1]
        if (QUOTES & set(left) and QUOTES & set(right)) or near & REPORTING:
            quoted += 1
        elif kinds[word] == 2:
            exact += 1
        else:
            misspelt += 1
        addressed += bool(near & ADDRESS)
    return [exact, misspelt, quoted, addressed, 100.0 * (exact + misspelt) / len(words)]


def one_of_copies(labelled: DataFrame) -> DataFrame:
    """``text, label, copies`` of the sample without most near copies, whose rare words would look
    frequent: of texts of one label that share the smallest shingle hash, the one of the smallest id
    and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, doc, _ = shingles(Words(batch.column(0)), SHINGLE)
            least = np.zeros(batch.num_rows, np.uint64)
            if len(doc):
                heads = np.flatnonzero(np.diff(doc, prepend=-1))
                least[doc[heads]] = np.minimum.reduceat(hashes, heads)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least.view(np.int64))], ["text", "label", "__id", "sketch"])

    key = dict(labelled.dtypes)["__id"]
    sketched = map_arrow(labelled, run, f"text string, label int, __id {key}, sketch long")
    kept = sketched.groupBy("sketch", "label").agg(F.min_by("text", "__id").alias("text"), F.count(F.lit(1)).alias("copies"))
    return kept.select("text", "label", "copies")


def stem_counts(labelled: DataFrame) -> DataFrame:
    """``stem, toxic, clean``: labelled documents that hold a word beginning with the stem."""
    low, high = STEM_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts = Counter(), Counter()
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[int(bool(label))].update({w[:n] for w in set(tokens(text)) for n in range(low, min(high, len(w)) + 1)})
            for label, counted in enumerate(counts):
                if counted:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(counted), pa.string()), pa.array([label] * len(counted)), pa.array(list(counted.values()))],
                        ["stem", "label", "n"],
                    )

    counted = map_arrow(labelled, run, "stem string, label long, n long")
    of = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0))
    return counted.groupBy("stem").agg(of(1).alias("toxic"), of(0).alias("clean"))


def choose_stems(counts: DataFrame, toxic: int, clean: int, size: int) -> list[str]:
    """Stems in at least 0.3 % of toxic documents, too many to be by chance (or a quarter of them,
    where there are few), three at least, and at most a hundredth as often in others: of a stem and its beginnings the longest that loses no more than a twentieth
    of the documents."""
    chance = math.log(CANDIDATES / 0.05) / math.log((toxic + clean + 1) / (toxic + 0.5))
    least = max(3, min(math.ceil(chance), toxic // 4), toxic * 3 // 1000)
    good = cut_lineage(
        counts.where((F.col("toxic") >= least) & (F.col("clean") * max(toxic, 1) * 100 <= F.col("toxic") * max(clean, 1))), "stems"
    )
    # A stem is closed if no longer one keeps nearly all of its documents; of closed stems of which
    # one begins with the other, the shorter stays.
    shorter = lambda n: F.expr(f"substring(stem, 1, {n})")
    longer = good.groupBy(shorter("length(stem) - 1").alias("stem")).agg(F.max("toxic").alias("longest"))
    closed = good.join(longer, "stem", "left").where("coalesce(longest, 0) * 20 < toxic * 19").select("stem", "toxic")
    inside = F.explode(F.expr("transform(sequence(0, length(stem) - 1), n -> substring(stem, 1, n))")).alias("start")
    extended = closed.select("stem", inside).join(closed.select(F.col("stem").alias("start")), "start").select("stem").distinct()
    best = closed.join(extended, "stem", "left_anti").orderBy(F.desc("toxic"), "stem").limit(size)
    return sorted(r.stem for r in best.collect())  # at most the lexicon's size


def choose_open_stems(labelled: DataFrame, stems: list[str], toxic: int, clean: int) -> list[str]:
    """Stems that, with the edited forms that words begin with, still are at most a hundredth as
    often in other documents as in toxic ones."""
    chosen = tuple(stems)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lru_cache(maxsize=1 << 17)(_lexicon(chosen).beginnings)
        counts = Counter(), Counter()
        for batch in slices(batches, "text"):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[int(bool(label))].update({s for w in set(tokens(text)) for s in of(w)})
        for label, counted in enumerate(counts):
            if counted:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(counted), pa.string()), pa.array([label] * len(counted)), pa.array(list(counted.values()))],
                    ["stem", "label", "n"],
                )

    counted = map_arrow(labelled, run, "stem string, label long, n long").groupBy("stem", "label").agg(F.sum("n").alias("n"))
    found = {(r.stem, r.label): r.n for r in counted.collect()}  # two rows per stem at most
    return [s for s in stems if found.get((s, 0), 0) * max(toxic, 1) * 100 <= found.get((s, 1), 0) * max(clean, 1)]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of log1p counts and a constant, by Newton's method with a ridge; both classes weigh
    as they occur in the rows (``class_shift`` corrects that)."""
    z = np.column_stack([np.log1p(x), np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + penalty
        step = np.linalg.solve(h, z.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def class_shift(labels: dict[int, int], drawn: int, rows: dict[int, int], texts: dict[int, int]) -> float:
    """What to add to the constant of a fit so that the classes weigh as in all usable documents:
    ``labels`` usable ones of each class, at most ``drawn`` of them sampled, found in ``rows``
    documents, of which the fit saw ``texts`` after copies were removed."""
    if not (texts.get(0) and texts.get(1)):
        return 0.0
    whole = {v: rows[v] * labels[v] / min(labels[v], drawn) for v in (0, 1)}
    return math.log(whole[1] / whole[0]) - math.log(texts[1] / texts[0])


class Model:
    """A lexicon and the weights of the hit counts."""

    def __init__(self, stems: list[str], weights: np.ndarray | None, open_stems: list[str] | None = None) -> None:
        self.stems, self.weights, self.open_stems = stems, weights, open_stems or []

    def lexicon(self) -> Lexicon:
        return _lexicon(tuple(self.stems), tuple(self.open_stems))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(rows))
        z = np.log1p(rows) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@lru_cache(maxsize=2)
def _lexicon(stems: tuple[str, ...], open_stems: tuple[str, ...] = ()) -> Lexicon:
    return Lexicon(list(stems), open_stems=open_stems)


def learn(
    docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, lexicon: int = LEXICON,
) -> Model:
    """A model from at most ``sample_rows`` labelled documents, half of each class if there are as
    many; ``use`` selects the labels that may be learned from. Scores are corrected to the classes'
    shares of all usable documents, so they do not depend on the sample's. No labels: a model that
    scores 0."""
    usable = labels.where(use & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    usable = usable.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("label"))
    halves = [smallest_hashes(usable.where(F.col("label") == v), "__id", sample_rows // 2) for v in (0, 1)]
    sample = F.broadcast(halves[0].unionByName(halves[1]))  # at most sample_rows ids and labels
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    labelled = rows.join(sample, rows[id_col] == F.col("__id")).select("text", "label", "__id")
    labelled = cut_lineage(one_of_copies(labelled), "labelled")
    counted = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("rows")).collect()
    numbers, rows_of = ({r.label: r[c] for r in counted} for c in ("texts", "rows"))
    if not numbers.get(1):
        return Model([], None)
    all_labels = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    stems = choose_stems(stem_counts(labelled), numbers[1], numbers.get(0, 0), lexicon)
    open_stems = choose_open_stems(labelled, stems, numbers[1], numbers.get(0, 0))
    model = Model(stems, None, open_stems)
    data = hit_counts(labelled.withColumnRenamed("label", "doc_id"), model, "doc_id", "text").collect()
    x = np.array([r[1] for r in data], float).reshape(len(data), len(FEATURES))
    weights = fit_logistic(x, np.array([r[0] for r in data], float))
    weights[-1] += class_shift(all_labels, sample_rows // 2, rows_of, numbers)
    return Model(stems, weights, open_stems)


def hit_counts(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    key = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = model.lexicon()
        for batch in batches:
            rows = [features(t, lexicon) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "hits"])

    wanted = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return map_arrow(wanted, run, f"doc_id {key}, hits array<double>")


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
    keep_columns: bool = False,
) -> DataFrame:
    """``doc_id, score, predicted`` for the whole text of every document, or with ``keep_columns``
    the documents themselves with ``__toxic_score`` added.

    Null and empty texts have no hits and get the score of such a text. Repeated rows are scored
    alike; a null id stays null, and ids may be of any type; an empty table gives no rows. A column
    of the documents named ``__toxic_score`` is replaced. Map-only.
    """
    if keep_columns:
        docs = docs.drop("__toxic_score")
        position = docs.columns.index(text_col)
        schema = StructType([*docs.schema, StructField("__toxic_score", DoubleType())])
    else:
        key = dict(docs.dtypes)[id_col]
        docs = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
        position, schema = 1, f"doc_id {key}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = model.lexicon()
        for batch in batches:
            rows = np.array([features(t, lexicon) for t in batch.column(position).to_pylist()], float)
            scored = pa.array(model.scores(rows.reshape(-1, len(FEATURES))))
            columns = batch.columns if keep_columns else [batch.column(0)]
            names = batch.schema.names if keep_columns else ["doc_id"]
            yield pa.RecordBatch.from_arrays([*columns, scored], [*names, "__toxic_score" if keep_columns else "score"])

    out = map_arrow(docs, run, schema)
    return out if keep_columns else out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
