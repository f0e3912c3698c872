"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(base + sum of term weights + sum over term pairs of the inner product of their factors).
The pair part catches combinations, such as an insult beside a mention of a group, that no sum of
weights can. It is learned here on a bounded sample of labelled rows.
"""

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import fold, sample

BUCKETS = 1 << 20
FACTORS = 6
LEAST_DOCUMENTS = 3
MOST_TERMS = 1024
LEAST_Z = 4.0
STEM = 4
SAMPLE_ROWS = 6000
STEPS = 150
THRESHOLD = 0.3
CACHED_TERMS = 500_000

_TERM = re.compile(r"[^\W\d_]+|\d+")


@dataclass
class Machine:
    terms: np.ndarray  # sorted hashes of the terms that have weights
    weight: np.ndarray
    factors: np.ndarray
    base: float


def term_hashes(text: str | None, cache: dict[str, tuple[int, int]]) -> list[int]:
    """Hashes of the different terms of a whole text.

    Words are runs of letters or digits, in lower case. A word is a term, and so is its beginning of
    STEM letters, which words share that a small sample has not seen.
    """
    if len(cache) > CACHED_TERMS:
        cache.clear()
    words = set(_TERM.findall((text or "").lower()))
    for word in words:
        if word not in cache:
            stem = b"^" + word[:STEM].encode()
            cache[word] = zlib.crc32(word.encode()) % BUCKETS, zlib.crc32(stem) % BUCKETS
    found: set[int] = set()
    found.update(*[cache[word] for word in words])
    return list(found)


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of consecutive runs; an empty run gives 0."""
    ends = np.cumsum(lengths)
    running = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, 0, dtype=np.float64)])
    return running[ends] - running[ends - lengths]


def probabilities(machine: Machine, terms: list[list[int]]) -> np.ndarray:
    lengths = np.fromiter(map(len, terms), np.int64, len(terms))
    flat = np.fromiter((term for row in terms for term in row), np.int64, lengths.sum())
    owner = np.arange(len(terms)).repeat(lengths)
    if len(machine.terms):
        at = np.minimum(np.searchsorted(machine.terms, flat), len(machine.terms) - 1)
        known = machine.terms[at] == flat
        at, owner = at[known], owner[known]
    else:
        at, owner = flat[:0], owner[:0]
    return 1 / (1 + np.exp(-np.clip(_value(machine, at, np.bincount(owner, minlength=len(terms)))[0], -30, 30)))


def _value(machine: Machine, at: np.ndarray, lengths: np.ndarray):
    together = _sums(machine.factors[at], lengths)
    alone = _sums((machine.factors[at] ** 2).sum(1), lengths)
    pairs = 0.5 * ((together**2).sum(1) - alone)
    return machine.base + _sums(machine.weight[at], lengths) + pairs, together


def train(texts: list[str | None], labels: list[int], seed: int = 11) -> Machine:
    cache: dict[str, tuple[int, int]] = {}
    return train_on_terms([term_hashes(text, cache) for text in texts], labels, seed)


def train_on_terms(rows: list[list[int]], labels: list[int], seed: int = 11) -> Machine:
    """Learn by full-batch Adam on the log loss, label 1 weighing twice.

    Weights go to the MOST_TERMS terms whose presence tells most about the label (two-sample z of the
    shares, LEAST_Z at least), among those of at least LEAST_DOCUMENTS texts. Without both labels the machine gives the
    share of label 1 (0 without rows counts as one half).
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    empty = Machine(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)), float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return empty
    owner = np.arange(len(rows)).repeat([len(row) for row in rows])
    flat = np.fromiter((t for row in rows for t in row), np.int64)
    terms, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
    ones = np.bincount(at, y[owner], len(terms))
    chance = (counts + 1) / (len(y) + 2)
    gap = ones / y.sum() - (counts - ones) / (len(y) - y.sum())
    tells = np.abs(gap) / np.sqrt(chance * (1 - chance) * (1 / y.sum() + 1 / (len(y) - y.sum())))
    tells[(counts < LEAST_DOCUMENTS) | (tells < LEAST_Z)] = 0
    best = np.argsort(-tells, kind="stable")[:MOST_TERMS]
    terms = np.sort(terms[best[tells[best] > 0]])
    if not len(terms):
        return empty
    at = np.minimum(np.searchsorted(terms, flat), len(terms) - 1)
    known = terms[at] == flat
    at, owner = at[known], owner[known]
    lengths = np.bincount(owner, minlength=len(rows))
    by_term = np.argsort(at, kind="stable")
    term_lengths = np.bincount(at, minlength=len(terms))
    machine = Machine(terms, np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), FACTORS)), 0.0)
    weights = np.where(y == 1, 2, 1) / (len(y) + y.sum())
    parameters = [machine.weight, machine.factors, np.zeros(1)]
    first, second = [np.zeros(p.shape) for p in parameters], [np.zeros(p.shape) for p in parameters]
    for step in range(1, STEPS + 1):
        machine.base = float(parameters[2][0])
        value, together = _value(machine, at, lengths)
        error = weights * (1 / (1 + np.exp(-np.clip(value, -30, 30))) - y)
        each = error[owner]
        pair = each[:, None] * (together[owner] - machine.factors[at])
        slopes = [
            _sums(each[by_term], term_lengths) + 2e-4 * machine.weight,
            _sums(pair[by_term], term_lengths) + 1e-3 * machine.factors,
            np.array([error.sum()]),
        ]
        for p, slope, a, b in zip(parameters, slopes, first, second):
            a += 0.1 * (slope - a)
            b += 0.01 * (slope**2 - b)
            p -= 0.05 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-4)
    machine.base = float(parameters[2][0])
    return machine


def fit(documents: DataFrame, labels: DataFrame, learn_from: Column, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Machine:
    """Train on at most `rows` labelled documents; the hashes of all terms of their whole texts are made in tasks."""

    @F.pandas_udf("array<int>")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, tuple[int, int]] = {}
        for texts in batches:
            yield pd.Series([term_hashes(text, cache) for text in texts], dtype="object")

    table = sample(documents, labels, label, learn_from, rows, made_of=hashes)
    return train_on_terms([sorted(map(int, row)) for row in table["text"]], table["label"].tolist())


def score(documents: DataFrame, machine: Machine, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """`documents` with the probability of label 1, from the whole text and nothing else.

    NULL counts as empty; an empty text has the base score. All columns stay; one named like the score
    is replaced. An empty table gives no rows.
    """

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, tuple[int, int]] = {}
        for texts in batches:
            parts = [
                probabilities(machine, [term_hashes(text, cache) for text in texts.iloc[at : at + 256]])
                for at in range(0, len(texts), 256)
            ]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return documents.withColumn(score_column, run(F.col(text_column)))


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; learns from three of four folds."""
    machine = fit(documents, labels, fold("doc_id", 4) != 2)
    rows = score(documents.select("doc_id", "text"), machine)
    return rows.select(
        "doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
