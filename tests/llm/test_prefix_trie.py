"""The trie of conversations against a plain one in Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from millwright.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, k1 string"


def _rows(rng, count=400):
    texts = ["", None, "a", "bé", "a longer text of a turn", "x" * 5000]
    ids = [rng.choice([rng.randrange(60), rng.randrange(-7, 9), 2**53 + rng.randrange(4), -(2**63)]) for _ in range(count)]
    rows = [(i, rng.choice([None, *range(12)]), rng.choice(["user", "bot", None]), rng.choice(texts), 1, "k") for i in ids]
    copies = [(10_000 + c, t, "user", "same", 1, "k") for c in range(40) for t in range(3)]
    long = [(77, t, "user", "long", 1, "k") for t in range(300)] + [(79, t, "user", "long", 1, "k") for t in range(300)]
    return rows + copies + long + rows[:20] + [(None, 1, "user", "of no conversation", 1, "k")] * 3


def _tie(role, text):
    digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
    signed = [int(half, 16) - (int(half, 16) >> 63 << 64) for half in (digest[:16], digest[16:])]
    return tuple(signed)


def _rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, _tie(role or "", text or ""), role or "", text or ""))
    turns = {c: [(role, text) for *_, role, text in sorted(list_)] for c, list_ in own.items()}
    out = {}
    for c, mine in turns.items():
        base, h = c - (abs(c) % 5 * (1 if c >= 0 else -1)), zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(base, [])[:h] + mine[h:]
    return out


def _brute(sequences):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, inside in members.items():
        own = (len(inside) - 1) * len(path[-1][1].encode()) if path else 0
        leaf = not any(len(p) == len(path) + 1 and p[:-1] == path for p in ()) and children[path] == 0
        for d in range(len(path) + 1):
            saved[path[:d]] += own
            leaves[path[:d]] += leaf
    return sorted(
        (
            min(inside), len(path), min(members[path[:-1]]) if path else None, len(inside), children[path], leaves[path], saved[path],
            hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest(),
        )
        for path, inside in members.items()
    )


@pytest.mark.parametrize("limits", [{}, {"heavy_nodes": 50, "least_heavy": 3, "queue_entries": 5, "chunk_ids": 4}])
def test_against_a_plain_trie(spark, limits):
    rows = _rows(random.Random(len(limits)))
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    sequences = prefix_trie.with_reused_beginnings(prefix_trie.turns(table))
    found = prefix_trie.nodes(sequences, table, **limits)
    assert sorted(map(tuple, found.collect()), key=lambda r: r[:2]) == _brute(_rebuilt(rows))


def test_empty_tables_and_conversations_without_turns(spark):
    none = spark.createDataFrame([], SCHEMA)
    turns = prefix_trie.turns(none)
    assert prefix_trie.nodes(prefix_trie.with_reused_beginnings(turns), none).count() == 0
    members = spark.createDataFrame([(5,), (3,), (5,), (None,)], "conv_id bigint")
    root = prefix_trie.nodes(turns, members).collect()
    assert list(map(tuple, root)) == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,5").hexdigest())]


def test_a_queue_that_spills_keeps_order_and_entries():
    rng = random.Random(8)
    entries = [(rng.randrange(-5, 0), rng.randrange(-4, 4), 0, 1, i, -i) for i in range(500)]
    queue = prefix_trie.SpillingQueue(20)
    for entry in entries:
        queue.push(entry)
    assert queue.spilled > 3
    found = [e for key in sorted({e[:3] for e in entries}) for e in queue.take(key)]
    assert sorted(found) == sorted(entries) and not queue.heap and not queue.runs
