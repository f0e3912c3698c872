"""SimHash near-dedup with covering locality-sensitive hashing.

Every text gets a 64-bit fingerprint. Links are pairs of fingerprints that differ in few bits. The
masks below cover the radius: whatever the differing bits, at least one mask leaves all of them out,
so both fingerprints are equal under that mask and meet in one of its buckets. Nothing is missed.

Tables that grow with the corpus are joined by merge, and Spark is told so: it sizes what an explode makes as if each
row gave one, and compressed files as what they take on disk, so it would broadcast them through the driver.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.operators.shared_table import write_shared

from . import whole_ids
from .components import components

BITS = 64
SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
BUCKET = 1 << 14


def fingerprint(text: str | None, words_each: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of a text; 0 of one without words.

    Words are runs of bytes other than space and 09-0D, A-Z in lower case. A bit is set if it is set in
    over half of the XXH64 hashes of all shingles, repeats included.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < words_each:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - words_each + 1].tolist(), ends[words_each - 1 :].tolist())
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64)
    over = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)].astype("<u8"))
        over += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(2 * over > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, id_column: str, text_column: str, words_each: int, others: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) of every row, and its bigint columns `others`; fp is the fingerprint as a signed bigint."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.fromiter((fingerprint(text, words_each) for text in batch["text"]), np.uint64, len(batch))
            kept = {name: batch[name] for name in ("doc_id", whole_ids.NONE, *others)}
            yield pd.DataFrame({**kept, "fp": found.view(np.int64)})

    rows = documents.select(*whole_ids.without_null(id_column), F.col(text_column).alias("text"), *others)
    more = "".join(f", {name} bigint" for name in others)
    found = rows.mapInPandas(run, f"doc_id bigint, {whole_ids.NONE} boolean{more}, fp bigint")
    return found.select(whole_ids.with_null(), "fp", *others)


def covering_masks(radius: int, bits: list[int], base: int = 0) -> list[int]:
    """2^(radius+1) - 1 masks that keep `base` and about half of `bits`.

    Bit i gets a vector m(i) of radius+1 binary digits; mask v keeps the bits with an odd m(i) AND v.
    Any `radius` bits give `radius` linear equations in radius+1 unknowns, so some v other than 0 is
    even for all of them: mask v leaves all these bits out.
    """
    vectors = (1 << (radius + 1)) - 1
    return [
        base | sum(1 << bit for at, bit in enumerate(bits) if ((1 + at % vectors) & v).bit_count() % 2)
        for v in range(1, vectors + 1)
    ]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def forest(values: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join all different fingerprints of a bucket which chains of near ones connect."""
    left = np.unique(values)
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count((left ^ at).view(np.uint64)) <= radius
            if near.any():
                found = left[near]
                yield np.full(len(found), at), found
                queue.extend(found)
                left = left[~near]


def _links_in_buckets(radius: int):
    """Reads rows sorted by (t, key), each bucket as a run; gives a spanning forest of every bucket."""

    def bucket_links(t, key, fp):
        edges = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(fp)]))
        sizes = ends - starts
        pair = starts[sizes == 2]
        near = pair[np.bitwise_count((fp[pair] ^ fp[pair + 1]).view(np.uint64)) <= radius]
        yield fp[near], fp[near + 1]
        for a, b in zip(starts[sizes > 2], ends[sizes > 2]):
            yield from forest(fp[a:b], radius)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[np.ndarray] = []
        for batch in batches:
            rows = batch.to_numpy(np.int64)
            if not len(rows):
                continue
            if rest and (rest[-1][-1, :2] == rows[-1, :2]).all() and (rows[:, :2] == rows[-1, :2]).all():
                rest.append(rows)  # the run goes on
                continue
            rows = np.concatenate([*rest, rows])
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(1))
            cut = last[-1] + 1 if len(last) else 0
            rest = [rows[cut:]]
            if cut:
                yield from frames(rows[:cut])
        if rest:
            yield from frames(np.concatenate(rest))

    def frames(rows):
        found = list(bucket_links(*np.ascontiguousarray(rows.T)))
        yield pd.DataFrame({"a": np.concatenate([a for a, _ in found]), "b": np.concatenate([b for _, b in found])})

    return run


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between the different fingerprints of the stored table `fps` (fp bigint).

    Their connected components are those of all pairs within the radius: a bucket gives a spanning
    forest of its near pairs, never all of them. A bucket of more than `bucket` fingerprints is dealt
    out again by covering masks over the bits its first mask left out, which holds for those pairs in
    the same way. Two masks together leave out 16 bits at most for a radius of 4, so no bucket of the
    second kind holds more than 65,536 different fingerprints, whatever the input.
    """
    first = covering_masks(radius, list(range(BITS)))
    second = [
        mask
        for base in first
        for mask in covering_masks(radius, [bit for bit in range(BITS) if not base >> bit & 1], base)
    ]

    def masks(values: list[int]):
        return F.array(*[F.lit(_signed(value)).cast("bigint") for value in values])

    keyed = fps.select("fp", F.posexplode(masks(first)).alias("t", "mask"))
    keyed = keyed.select(F.col("t").cast("bigint").alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    shared = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = write_shared(keyed.join(shared.hint("merge"), ["t", "key"]))
    few = members.where(F.col("n") <= bucket).select("t", "key", "fp")
    step = len(first)
    many = members.where(F.col("n") > bucket).select("t", "fp", F.explode(F.sequence(F.lit(0), F.lit(step - 1))).alias("u"))
    many = many.select((F.col("t") * step + F.col("u")).alias("t"), "fp")
    many = many.withColumn("mask", F.element_at(masks(second), (F.col("t") + 1).cast("int")))
    many = many.select((F.col("t") + step).alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    dealt = few.unionByName(many).repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    return dealt.mapInPandas(_links_in_buckets(radius), "a bigint, b bigint").distinct()


def near_duplicates(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    words_each: int = SHINGLE_WORDS, radius: int = RADIUS, bucket: int = BUCKET,
) -> DataFrame:
    """One row for each row of `documents`: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links, the row's own included; equal fingerprints
    are linked at distance 0, so copies meet before any link is sought. NULL, empty and blank texts
    have fingerprint zero, linked like any other. Rows with a NULL id are returned and don't count
    for the smallest; repeated rows are returned as often. Other columns are not read. An empty table
    gives no rows.
    """
    docs = write_shared(fingerprints(documents, id_column, text_column, words_each))
    placed = _placed(docs, radius, bucket)
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = placed.join(least.hint("merge"), "component").select("fp", "component_id")
    return _with_class(docs, classes).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _placed(docs: DataFrame, radius: int, bucket: int) -> DataFrame:
    """(fp, least, component) of the different fingerprints of the stored table `docs`; least is the smallest id."""
    fps = write_shared(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    member = components(links(fps, radius, bucket)).withColumnRenamed("node", "fp")
    placed = fps.join(member.hint("merge"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    return write_shared(placed)


def _with_class(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Join by fingerprint; adaptive execution splits the rows of a fingerprint many texts share."""
    return docs.join(write_shared(classes).hint("merge"), "fp")


def one_of_each(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    words_each: int = SHINGLE_WORDS, radius: int = RADIUS, bucket: int = BUCKET,
) -> DataFrame:
    """One row of `documents` for each component: that with the smallest id.

    Rows that repeat this id are told apart by a hash of the text, and of exact repeats any one stays. A row with a
    NULL id stays only if no row with an id is in its component.
    """
    rows = documents.withColumns({"_row": F.monotonically_increasing_id(), "_hash": F.xxhash64(F.col(text_column))})
    rows = write_shared(rows)  # the numbers must be the same when they are read again
    docs = write_shared(fingerprints(rows, id_column, text_column, words_each, ("_row", "_hash")))
    classes = _placed(docs, radius, bucket).select("fp", "component")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_hash", "_row")
    kept = _with_class(docs, classes).groupBy("component").agg(F.min(order).alias("first")).select("first._row")
    return rows.join(write_shared(kept).hint("merge"), "_row", "left_semi").select(*[F.col(f"`{name}`") for name in documents.columns])
