"""Quality classifier: a small convolutional network over bytes, in numpy.

Learned filters slide over all bytes of a text. Their outputs are max-pooled within overlapping chunks
that cover the whole text; the largest and the mean of the pooled values over all chunks are combined
into one probability. It is trained here on a bounded sample of labelled rows and run as Arrow batches.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import fold, sample

FILTERS = 12
WIDTH = 5
HALF = 256  # a chunk is two halves; the next one starts half a chunk later
SAMPLE_ROWS = 1500
THRESHOLD = 0.3
STEPS = 600
BATCH = 32


@dataclass
class Network:
    table: np.ndarray  # (WIDTH, 256, FILTERS): what a byte adds to a filter at each place
    bias: np.ndarray
    weight: np.ndarray  # (2 * FILTERS,): of the largest and of the mean chunk value
    base: float


def _padded(text: str | None) -> np.ndarray:
    """The bytes of a text, zeros after it up to a whole number of halves; an empty text is one half of zeros."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    return np.pad(data, (0, max(1, -(-len(data) // HALF)) * HALF - len(data)))


def _half_maxima(table: np.ndarray, data: np.ndarray, each: int = 32) -> np.ndarray:
    """Largest filter output over the positions of each half; a window may reach into the next half."""
    data = np.pad(data, (0, WIDTH - 1))
    out = np.empty(((len(data) - WIDTH + 1) // HALF, table.shape[2]), np.float32)
    buffers = np.empty((2, min(each, len(out)) * HALF, table.shape[2]), np.float32)
    for at in range(0, len(out), each):
        n = min(each, len(out) - at)
        seen = data[at * HALF : (at + n) * HALF + WIDTH - 1]
        value, part = buffers[0][: n * HALF], buffers[1][: n * HALF]
        table[0].take(seen[: n * HALF], axis=0, out=value, mode="clip")
        for place in range(1, WIDTH):
            table[place].take(seen[place : place + n * HALF], axis=0, out=part, mode="clip")
            value += part
        out[at : at + n] = value.reshape(n, HALF, -1).max(1)
    return out


def probability(network: Network, text: str | None) -> float:
    """Probability of label 1 for one whole text."""
    halves = _half_maxima(network.table, _padded(text))
    chunks = np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves
    pooled = np.maximum(chunks + network.bias, 0)
    value = np.concatenate([pooled.max(0), pooled.mean(0, dtype=np.float64)]) @ network.weight + network.base
    return float(1 / (1 + np.exp(-np.clip(value, -30, 30))))


def train(texts: list[str | None], labels: list[int], seed: int = 7) -> Network:
    """Learn by Adam on the log loss. Without both labels the network gives the share of label 1 (0.5 without rows)."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    network = Network(
        rng.normal(0, 0.05, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.3, 2 * FILTERS), float(np.log(share / (1 - share))),
    )
    if not 0 < y.sum() < len(y):
        network.weight[:] = 0
        return network
    padded = [_padded(text) for text in texts]
    parameters = [network.table, network.bias, network.weight, np.array([network.base])]
    first, second = [np.zeros(p.shape) for p in parameters], [np.zeros(p.shape) for p in parameters]
    kinds = [np.flatnonzero(y == kind) for kind in (0, 1)]
    for step in range(1, STEPS + 1):  # half of each batch has either label, so a score of 0.5 tips neither way
        rows = np.concatenate([rng.choice(kind, BATCH // 2) for kind in kinds])
        slopes = _slopes(parameters, [padded[row] for row in rows], y[rows])
        rate = 0.02 * (1 - step / STEPS) + 0.001
        for p, slope, a, b in zip(parameters, slopes, first, second):
            a += 0.1 * (slope - a)
            b += 0.01 * (slope**2 - b)
            p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)).astype(p.dtype)
    network.base = float(parameters[3][0])
    return network


def _slopes(parameters: list[np.ndarray], texts: list[np.ndarray], y: np.ndarray) -> list[np.ndarray]:
    """Gradient of the mean log loss; only the windows that won their pools get one."""
    table, bias, weight, base = parameters
    counts = np.array([len(text) // HALF for text in texts])
    data = np.concatenate([np.pad(text, (0, 0)) for text in texts])
    data = np.pad(data, (0, WIDTH - 1))
    total = counts.sum()
    value = table[0].take(data[: total * HALF], axis=0)
    for place in range(1, WIDTH):
        value += table[place].take(data[place : place + total * HALF], axis=0)
    value = value.reshape(total, HALF, -1)
    where = value.argmax(1)  # (halves, filters)
    top = np.take_along_axis(value, where[:, None], 1)[:, 0]
    where += np.arange(total)[:, None] * HALF
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    last = np.zeros(total, bool)
    last[starts + counts - 1] = True
    after = np.minimum(np.arange(total) + 1, total - 1)
    other = np.where((last | (counts == 1).repeat(counts))[:, None], -np.inf, top[after])
    take_next = other > top
    chunk, place = np.where(take_next, other, top), np.where(take_next, where[after], where)
    valid = ~last | (counts == 1).repeat(counts)
    owner = np.arange(len(y)).repeat(counts)[valid]
    chunk, place = chunk[valid] + bias, place[valid]
    pooled = np.maximum(chunk, 0)
    begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    number = np.diff(np.r_[begin, len(owner)])
    largest = np.maximum.reduceat(pooled, begin)
    mean = np.add.reduceat(pooled, begin) / number[:, None]
    both = np.concatenate([largest, mean], 1)
    chance = 1 / (1 + np.exp(-np.clip(both @ weight + base[0], -30, 30)))
    error = (chance - y) / len(y)
    filters = table.shape[2]
    down = (error[:, None] * weight[filters:] / number[:, None])[owner]
    is_top = pooled == largest[owner]
    down = (down + is_top * (error[:, None] * weight[:filters])[owner]) * (chunk > 0)
    slope = np.zeros(table.shape)
    filter_of = np.broadcast_to(np.arange(filters), place.shape)
    for at in range(WIDTH):
        np.add.at(slope[at], (data[place + at], filter_of), down)
    return [slope, down.sum(0), both.T @ error + 1e-4 * weight, np.array([error.sum()])]


def fit(documents: DataFrame, labels: DataFrame, learn_from: Column, label: str = "quality", rows: int = SAMPLE_ROWS) -> Network:
    """Train on the whole texts of at most `rows` labelled documents."""
    table = sample(documents, labels, label, learn_from, rows)
    return train(table["text"].tolist(), table["label"].tolist())


def score(documents: DataFrame, network: Network, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """`documents` with the probability of label 1, from the whole text and nothing else.

    NULL counts as empty, and an empty text is scored like any other. All columns of `documents` stay;
    one named like the score is replaced. An empty table gives no rows.
    """

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([probability(network, text) for text in texts], dtype="float64")

    return documents.withColumn(score_column, run(F.col(text_column)))


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; learns from four of five folds."""
    network = fit(documents, labels, fold("doc_id", 5) != 0)
    rows = score(documents.select("doc_id", "text"), network)
    return rows.select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
