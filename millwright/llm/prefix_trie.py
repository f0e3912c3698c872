"""Trie of conversations by their first turns, with totals of every subtree.

A node is a distinct sequence of first turns. Its key is the exclusive or of hashes of its turns, each with its
place, so the keys of a conversation's nodes are running totals, whatever its length.

Totals go up by time-forward processing. Nodes are sorted in reverse level order, deepest first; a node takes what its children have
sent from a priority queue ordered likewise, and sends its own totals on to its parent. Queues spill sorted runs. A node
that more than a share of all turns pass through is heavy; the subtrees below the heavy nodes are dealt to shards
whole, each shard has its own queue, and then the totals of shard roots go up through the heavy nodes.
"""

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.operators import segments
from millwright.operators.shared_table import write_shared

HEAVY_NODES = 100_000  # the most nodes that can be heavy
LEAST_HEAVY = 1_000  # fewer conversations never make a node heavy
QUEUE_ENTRIES = 200_000  # entries of a queue in memory
CHUNK_IDS = 10_000  # ids joined to one text before they are hashed
MOST_REUSED = 8

KEY = ["depth", "k1", "k2"]
_PARENT = ["depth", "p1", "p2"]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, t1, t2, n_bytes): turns numbered from 1 by turn, NULL first, with 128 bits of MD5 of role and text.

    NULL role or text counts as empty. Turns of one number are ordered by that hash, so equal rows are all kept.
    Rows without conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(name), F.lit("")) for name in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        digest.alias("digest"), F.octet_length(text).cast("bigint").alias("n_bytes"),
    )
    half = lambda at: F.conv(F.substring("digest", at, 16), 16, -10).cast("bigint")
    rows = rows.select("conv_id", "turn", half(1).alias("t1"), half(17).alias("t2"), "n_bytes")
    order = ["turn", "t1", "t2"]
    cut = segments.cut(rows, ["conv_id"], order)
    numbered = segments.running(cut, ["conv_id"], order, {"place": (F.lit(1).cast("bigint"), segments.SUM)})
    return numbered.select("conv_id", "place", "t1", "t2", "n_bytes")


def with_reused_beginnings(numbered: DataFrame) -> DataFrame:
    """Turns of rebuilt conversations: of c the first h turns of c - c % 5 (all if fewer, none if absent), then c's own after its first h.

    h is the unsigned crc32 of c in decimal, modulo 9. Turns are renumbered; a conversation may be left without any.
    """
    base = F.col("conv_id") - F.col("conv_id") % 5
    rows = numbered.withColumns({"base": base, "reused": _reused("conv_id")})
    first = rows.where(F.col("place") <= MOST_REUSED)
    lengths = first.groupBy(F.col("conv_id").alias("base")).agg(F.max("place").alias("length"))  # up to MOST_REUSED
    own = rows.where((F.col("conv_id") == F.col("base")) | (F.col("place") > F.col("reused"))).join(lengths, "base", "left")
    fewer = F.col("reused") - F.least(F.col("reused"), F.coalesce("length", F.lit(0)))
    moved = F.when(F.col("conv_id") == F.col("base"), F.col("place")).otherwise(F.col("place") - fewer)
    own = own.select("conv_id", moved.alias("place"), "t1", "t2", "n_bytes")

    readers = rows.where(F.col("conv_id") != F.col("base")).select("conv_id", "base", "reused").distinct()
    given = first.where(F.col("conv_id") == F.col("base")).select("base", "place", "t1", "t2", "n_bytes")
    given = readers.join(given, "base").where(F.col("place") <= F.col("reused"))
    return own.unionByName(given.select("conv_id", "place", "t1", "t2", "n_bytes"))


def _reused(name: str) -> Column:
    return F.crc32(F.col(name).cast("string").cast("binary")) % (MOST_REUSED + 1)


class SpillingQueue:
    """Priority queue of (level, k1, k2, children, leaves, saved), smallest first; entries of one key may be added up."""

    ROW = struct.Struct("<6q")

    def __init__(self, most: int) -> None:
        self.most, self.heap = most, []
        self.runs: list[tuple[tuple, int, Iterator[tuple]]] = []
        self.spilled = 0

    def push(self, entry: tuple) -> None:
        heapq.heappush(self.heap, entry)
        if len(self.heap) > self.most:
            self._spill()

    def _spill(self) -> None:
        """A sorted run in a file without a name, which goes with the process, as a task's other spill files do."""
        run = tempfile.TemporaryFile()
        self.heap.sort()
        for at in range(0, len(self.heap), 1000):
            run.write(b"".join(self.ROW.pack(*entry) for entry in self.heap[at : at + 1000]))
        self.heap = []
        run.seek(0)
        self.spilled += 1
        self._next(self.spilled, self._read(run))

    def _read(self, run) -> Iterator[tuple]:
        with run:
            while part := run.read(1000 * self.ROW.size):
                yield from self.ROW.iter_unpack(part)

    def _next(self, number: int, entries: Iterator[tuple]) -> None:
        if (entry := next(entries, None)) is not None:
            heapq.heappush(self.runs, (entry, number, entries))

    def take(self, key: tuple) -> Iterator[tuple]:
        """Remove and return all entries of the smallest key, which is `key` or larger."""
        while self.heap and self.heap[0][:3] == key:
            yield heapq.heappop(self.heap)
        while self.runs and self.runs[0][0][:3] == key:
            entry, number, entries = heapq.heappop(self.runs)
            self._next(number, entries)
            yield entry


_NAMES = ["n_children", "n_leaves", "saved_tokens"]


def _upwards(nodes: DataFrame, queue_entries: int) -> DataFrame:
    """Nodes with totals of their subtrees. Each partition is in reverse level order and holds the parents of its nodes, but of those marked `top`.

    What nodes of elsewhere have sent already stands in the columns of _NAMES.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(queue_entries)
        for batch in batches:
            lists = {name: batch.column(name).to_pylist() for name in [*KEY, "p1", "p2", "n_convs", "n_bytes", "top", *_NAMES]}
            out = []
            for depth, k1, k2, p1, p2, n, size, top, children, leaves, saved in zip(*lists.values()):
                for _, _, _, more, more_leaves, more_saved in queue.take((-depth, k1, k2)):
                    children, leaves, saved = children + more, leaves + more_leaves, saved + more_saved
                leaves = leaves or 1
                saved += (n - 1) * size
                out.append((children, leaves, saved))
                if not top:
                    queue.push((1 - depth, p1, p2, 1, leaves, saved))
            totals = zip(*out) if out else [()] * 3
            columns = [pa.array(total, pa.int64()) for total in totals]
            kept = batch.drop_columns(_NAMES)
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], [*kept.schema.names, *_NAMES])

    names = [name for name in nodes.columns if name not in _NAMES] + _NAMES
    return nodes.select(*names).mapInArrow(run, nodes.select(*names).schema)


def _renamed(rows: DataFrame, to: list[str], *more: Column | str) -> DataFrame:
    return rows.select(*[F.col(name).alias(new) for name, new in zip(KEY, to)], *more)


def nodes(
    sequences: DataFrame, conversations: DataFrame, heavy_nodes: int = HEAVY_NODES, least_heavy: int = LEAST_HEAVY,
    queue_entries: int = QUEUE_ENTRIES, chunk_ids: int = CHUNK_IDS,
) -> DataFrame:
    """One row for each node of the trie of `sequences` (conv_id, place, t1, t2, n_bytes; places from 1 without gaps).

    `conversations` has the conv_id of all members, also of those without turns, which end at the root. Columns: conv_id (the smallest
    member), depth, parent_conv_id (the parent's conv_id), n_convs, n_children, n_leaves, saved_tokens (over the subtree:
    (n_convs - 1) times the bytes of the last text), ends_sha256 (of the ids that end here, in order, joined by commas).
    Without conversations there are no rows.
    """
    spark = sequences.sparkSession
    members = write_shared(conversations.select("conv_id").where("conv_id IS NOT NULL").distinct())
    rows = sequences.select(
        "conv_id", F.col("place").alias("depth"), F.xxhash64("place", "t1", "t2").alias("x1"),
        F.xxhash64("t2", "place", "t1", F.lit(1)).alias("x2"), "n_bytes",
    )
    cut = segments.cut(rows, ["conv_id"], ["depth"])
    totals = {"k1": (F.col("x1"), segments.XOR), "k2": (F.col("x2"), segments.XOR)}
    steps = segments.running(cut, ["conv_id"], ["depth"], totals)
    steps = write_shared(
        steps.select("conv_id", *KEY, F.expr("k1 ^ x1 AS p1"), F.expr("k2 ^ x2 AS p2"), "n_bytes")
    )
    every = write_shared(
        steps.groupBy(*KEY).agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
            *[F.first(name).alias(name) for name in ("p1", "p2", "n_bytes")],
        )
    )

    # every step counts once in n_convs, so at most heavy_nodes nodes have more than this
    most = max(least_heavy, steps.count() // heavy_nodes)
    zero = F.lit(0).cast("bigint")
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.withColumns({name: zero for name in [*KEY, "p1", "p2", "n_bytes"]})
    heavy = write_shared(every.where(F.col("n_convs") > most).unionByName(root))
    heavy_keys = F.broadcast(heavy.select(*KEY))

    light_steps = steps.join(heavy_keys, KEY, "left_anti")
    roots = light_steps.groupBy("conv_id").agg(F.min_by(F.struct(*KEY), "depth").alias("shard"))
    light = every.join(heavy_keys, KEY, "left_anti").join(roots, "conv_id")
    light = light.withColumn("top", F.struct(*KEY) == F.col("shard")).withColumns({name: zero for name in _NAMES})
    dealt = light.repartition("shard").drop("shard").sortWithinPartitions(F.desc("depth"), "k1", "k2")
    below = write_shared(_upwards(dealt, queue_entries))

    parent = (F.col("depth") - 1).alias("depth")
    sent = below.where("top").groupBy(parent, F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    )  # a row for each heavy node at most
    above = heavy.join(sent, KEY, "left").fillna(0, _NAMES).withColumn("top", F.col("depth") == 0)
    above = above.repartition(1).sortWithinPartitions(F.desc("depth"), "k1", "k2")  # heavy_nodes and the root at most
    above = write_shared(_upwards(above, queue_entries))

    up = ["up", "p1", "p2"]
    of_heavy = _renamed(heavy, up, F.col("conv_id").alias("parent_conv_id"))
    of_light = _renamed(every.where(F.col("n_convs") <= most), up, F.col("conv_id").alias("parent_conv_id"))
    below = below.withColumn("up", F.col("depth") - 1)
    under_heavy = below.where("top").unionByName(above.withColumn("up", F.col("depth") - 1)).join(F.broadcast(of_heavy), up, "left")
    under_light = below.where("NOT top").join(of_light, up)  # a light node has no more children than members
    found = under_heavy.unionByName(under_light).join(_ends(steps, members, chunk_ids), KEY, "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )


def _ends(steps: DataFrame, members: DataFrame, chunk_ids: int) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of nodes where conversations end.

    Ids are put in order and joined in chunks first, so that the one task that must hash all ends of a node, one after the
    other, gets few rows of it and holds one.
    """
    last = steps.groupBy("conv_id").agg(F.max_by(F.struct(*KEY), "depth").alias("end"))
    zero = F.lit(0).cast("bigint")
    ends = members.join(last, "conv_id", "left").select(
        "conv_id", *[F.coalesce(F.col(f"end.{name}"), zero).alias(name) for name in KEY]
    )
    numbered = segments.running(
        segments.cut(ends, KEY, ["conv_id"]), KEY, ["conv_id"], {"at": (F.lit(1).cast("bigint"), segments.SUM)}
    )
    chunk = F.floor((F.col("at") - 1) / chunk_ids).alias("chunk")
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda number: number.cast("string"))
    chunks = numbered.groupBy(*KEY, chunk).agg(F.concat_ws(",", ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*[batch.column(name).to_pylist() for name in [*KEY, "ids"]]):
                if key == held:
                    digest.update(b",")
                else:
                    if held is not None:
                        done.append((*held, digest.hexdigest()))
                    held, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            yield batch_of(done)
        if held is not None:
            yield batch_of([(*held, digest.hexdigest())])

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done)) if done else [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*KEY, "ends_sha256"])

    dealt = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "chunk").select(*KEY, "ids")
    return dealt.mapInArrow(run, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")
