"""The classifiers against plain spellings of their formulas, and on labels whose evidence is deep inside long texts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwright.llm import quality_classifier, toxicity


def _plain_convolution(network, text):
    data = list((text or "").encode())
    half = quality_classifier.HALF
    data += [0] * (max(1, -(-len(data) // half)) * half - len(data))
    reach = data + [0] * (quality_classifier.WIDTH - 1)
    filters = network.table.shape[2]
    outputs = [
        [sum(float(network.table[w, reach[at + w], f]) for w in range(quality_classifier.WIDTH)) for f in range(filters)] for at in range(len(data))
    ]
    halves = len(data) // half
    chunks = [(0, half)] if halves == 1 else [(h * half, (h + 2) * half) for h in range(halves - 1)]
    pooled = [[max(0.0, max(outputs[at][f] for at in range(a, b)) + float(network.bias[f])) for f in range(filters)] for a, b in chunks]
    both = [max(row[f] for row in pooled) for f in range(filters)] + [sum(row[f] for row in pooled) / len(pooled) for f in range(filters)]
    value = sum(w * v for w, v in zip(network.weight.tolist(), both)) + network.base
    return 1 / (1 + math.exp(-min(30, max(-30, value))))


def test_probability_equals_a_plain_convolution():
    texts = ["good prose here " * 9, "buy now!!! " * 30, "", None, "é" * 400, "x" * 256, "y" * 257, "tail" * 300]
    network = quality_classifier.train(texts, [1, 0, 0, 0, 1, 0, 0, 1])
    for text in texts:
        assert quality_classifier.probability(network, text) == pytest.approx(_plain_convolution(network, text), abs=1e-4)


def test_probability_equals_a_double_loop_over_pairs():
    rng = np.random.default_rng(1)
    machine = toxicity.Machine(np.sort(rng.choice(1000, 40, False)), rng.normal(size=40), rng.normal(size=(40, 6)), -0.3)
    rows = [sorted(rng.choice(1000, n, False).tolist()) for n in (0, 1, 30, 200)]
    for row, found in zip(rows, toxicity.probabilities(machine, rows)):
        at = [int(np.searchsorted(machine.terms, t)) for t in row if t in machine.terms]
        value = machine.base + sum(machine.weight[i] for i in at)
        value += sum(float(machine.factors[i] @ machine.factors[j]) for n, i in enumerate(at) for j in at[:n])
        assert found == pytest.approx(1 / (1 + math.exp(-min(30, max(-30, value)))), abs=1e-9)


def test_evidence_in_the_middle_of_long_texts_is_learned(spark):
    filler = " ".join(f"plain{i % 50}" for i in range(3000))
    rows = [(i, f"{filler} {'vile insult' if i % 2 else 'kind remark'} {filler}") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    machine = toxicity.fit(table, labels, F.lit(True))
    found = {r.doc_id: r.score for r in toxicity.score(table, machine).collect()}
    assert min(found[i] for i in range(1, 60, 2)) > 0.5 > max(found[i] for i in range(0, 60, 2))
