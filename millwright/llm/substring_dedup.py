"""Substring dedup: near-equal paragraphs by MinHash banding, exact Jaccard and components; equal passages by
windows of words at places that the words themselves choose, wherever lines begin and end."""

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.operators.shared_table import write_shared

from . import whole_ids
from .bit_filter import maybe_in
from .components import components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
LEAST_WORDS = 20
BANDS, BAND_ROWS = 16, 4  # a pair of similarity 0.8 meets with chance 1 - (1 - 0.8 ** 4) ** 16 = 0.9998
PASSAGE_WORDS = 26
REACH = 25  # of so many places in a row, one at least starts a passage: any equal run of REACH + PASSAGE_WORDS - 1 = 50 words shares one
PLACE_BYTES = 16  # what chooses a place; no more than eight words
WORDS_AT_ONCE = 1 << 16
HASHES_AT_ONCE = 1 << 15
_PLACE = np.uint64((1 << 17) - 1)
_random = np.random.default_rng(20)
_FACTORS = _random.integers(1, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_BREAK = re.compile("\n")
_SPACES = np.array([chr(code).isspace() for code in range(0x3002)])


def paragraphs(text: str | None, least_words: int = LEAST_WORDS) -> Iterator[tuple[int, int, int, list[str]]]:
    """(number, start, end, words in lower case) of the lines that have enough words."""
    start = 0
    for number, line in enumerate((text or "").split("\n")):
        words = line.lower().split()
        if len(words) >= max(least_words, 1):
            yield number, start, start + len(line), words
        start += len(line) + 1


def shingles(words: list[str]) -> list[int]:
    """Hashes of all runs of five words; fewer words are one run."""
    digest = xxhash.xxh64_intdigest
    runs = max(1, len(words) - SHINGLE_WORDS + 1)
    return [digest(" ".join(words[at : at + SHINGLE_WORDS])) for at in range(runs)]


def band_keys(sets: list[list[int]]) -> np.ndarray:
    """One key for each set and band."""
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.fromiter(chain.from_iterable(sets), np.uint64, lengths.sum())
    ends = np.cumsum(lengths)
    starts = ends - lengths
    keys = np.zeros((len(sets), BANDS), np.uint64)
    first = 0
    while first < len(sets):  # whole sets, few enough to stay in the processor's cache through all bands
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + HASHES_AT_ONCE, "right")))
        part, begins = flat[starts[first] : ends[last - 1]], starts[first:last] - starts[first]
        value, high, found = np.empty_like(part), np.empty_like(part), keys[first:last]
        for at, factor in enumerate(_FACTORS):
            np.multiply(part, factor, out=value)
            np.right_shift(value, np.uint64(32), out=high)
            value ^= high
            least = np.minimum.reduceat(value, begins)
            found[:, at // BAND_ROWS] = (found[:, at // BAND_ROWS] ^ least) * np.uint64(0x9E3779B97F4A7C15)
        first = last
    return keys.view(np.int64)


def _identity(words: list[str]) -> bytes:
    return hashlib.md5(" ".join(words).encode()).digest()


_ROW = ["row", "doc_id", whole_ids.NONE, "content"]  # number of the row, its id, and the hash of its text


def _paragraph_rows(least_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, sets, size = [], [], 0
            for *row, text in zip(*(batch[name].tolist() for name in _ROW), batch["text"]):
                for number, start, end, words in paragraphs(text, least_words):
                    rows.append((*row, number, start, end, len(words), _identity(words)))
                    sets.append(shingles(words))
                    size += len(words)
                    if size > 500_000:
                        yield frame(rows, sets)
                        rows, sets, size = [], [], 0
            if rows:
                yield frame(rows, sets)

    def frame(rows, sets):
        table = pd.DataFrame(rows, columns=[*_ROW, "paragraph", "begin", "end", "n_words", "same"])
        table["bands"] = list(band_keys(sets))
        return table

    return run


def _needed_shingles(least_words: int):
    """Distinct shingle hashes of the paragraphs of a document that are asked for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, same, nodes in zip(batch["text"], batch["same"], batch["nodes"]):
                wanted = dict(zip(map(bytes, same), nodes))
                for _, _, _, words in paragraphs(text, least_words):
                    node = wanted.pop(_identity(words), None)
                    if node is not None:
                        rows.append((node, sorted({value - (1 << 63) for value in shingles(words)})))
            yield pd.DataFrame(rows, columns=["node", "shingles"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose shingle sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("one"))
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("other"))
    common = F.size(F.array_intersect("one", "other"))
    near = common >= F.lit(SIMILARITY) * (F.size("one") + F.size("other") - common)
    return pairs.join(one, "a").join(other, "b").where(near).select("a", "b")


def _with_pivot(met: DataFrame) -> DataFrame:
    """Pairs of the most central node of each bucket with the other nodes."""
    order = F.struct("central", (-F.col("node")).alias("last"))
    pivots = met.groupBy("band", "key").agg(F.max_by("node", order).alias("pivot"))
    pairs = met.join(pivots, ["band", "key"]).where("node <> pivot")
    return pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def _apart(met: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in buckets that hold several components."""
    placed = met.select("band", "key", "node").join(components(links), "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    buckets = placed.groupBy("band", "key").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    buckets = buckets.where("least < most").select("band", "key")
    return write_shared(placed.join(buckets, ["band", "key"], "left_semi").select("node", "component").distinct())


def _rare_shingle_pairs(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of nodes of different components that may be similar enough; no similar pair is missing.

    Similar sets of n shingles share one of the n - ceil(0.8 n) + 1 rarest of each. Shingles that one node
    has alone fill these places first and join nothing, so many unlike variants of one text make few pairs.
    """
    every = sets.join(nodes, "node").select("node", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    count = every.groupBy("s").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    shared = every.join(count, "s").groupBy("node", "component", "n").agg(F.sort_array(F.collect_list(F.struct("count", "s"))).alias("shared"))
    alone = F.col("n") - F.size("shared")
    places = F.col("n") - F.ceil(F.col("n") * F.lit(SIMILARITY) - 1e-9).cast("int") + 1 - alone
    prefix = shared.where(places > 0).select("node", "component", "n", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), places)).alias("at", "rare"))
    prefix = prefix.select("node", "component", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("left"), F.col("rare.s").alias("s"))
    prefix = write_shared(prefix)
    a, b = prefix.alias("a"), prefix.alias("b")
    n, m = F.col("a.n"), F.col("b.n")
    common = F.least("a.left", "b.left") * (1 + SIMILARITY) >= (n + m) * SIMILARITY - 1e-6
    pairs = a.join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.component") != F.col("b.component")) & common)
    return pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def repeated_paragraphs(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = LEAST_WORDS
) -> DataFrame:
    """One row for each paragraph that has a near-equal one.

    doc_id, paragraph (line number), begin, end (characters), n_words, component_size, first_doc_id,
    first_paragraph, kept. Paragraphs are lines of at least `least_words` words. Linked are paragraphs whose
    sets of five-word shingles have a Jaccard similarity of 0.8 or more; the first of each
    component (by id, then row, then line; NULL ids last) is kept, and nothing else of it, also where rows share an id or have none.

    Equal paragraphs count as one node with members, so copies never meet in pairs. In a bucket, every
    node is compared with the most central one. Nodes of buckets that still hold several components are
    joined exactly, by their rarest shingles, so no link that a band shows is lost. NULL and empty texts have no paragraph; repeated rows repeat
    their paragraphs. Other columns are not read. An empty table gives no rows.
    """
    content = F.xxhash64(F.col(text_column)).alias("content")
    docs = documents.select(
        F.monotonically_increasing_id().alias("row"), *whole_ids.without_null(id_column), content, F.col(text_column).alias("text")
    )
    schema = f"row long, doc_id long, {whole_ids.NONE} boolean, content long, paragraph int, begin long, end long, n_words int, same binary, bands array<bigint>"
    found = docs.mapInPandas(_paragraph_rows(least_words), schema)
    found = write_shared(found.withColumn("doc_id", whole_ids.with_null()).drop(whole_ids.NONE))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "paragraph")
    nodes = found.groupBy("same").agg(
        F.count(F.lit(1)).alias("members"), F.min(place).alias("first"), F.min("content").alias("content"), F.first("bands").alias("bands")
    )
    nodes = write_shared(nodes.withColumn("node", F.monotonically_increasing_id()))
    keyed = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = write_shared(keyed.join(shared, ["band", "key"]))
    # the text that others were copied from shares its keys with most of them
    central = met.groupBy("node").agg(F.sum("n").alias("central"))
    met = write_shared(met.drop("n").join(central, "node"))

    wanted = nodes.join(met.select("node").distinct(), "node", "left_semi").select("content", "same", "node")
    # the paragraphs of one text, each but once
    wanted = write_shared(wanted.groupBy("content").agg(F.collect_list("same").alias("same"), F.collect_list("node").alias("nodes")))
    likely = documents.select(content, F.col(text_column).alias("text")).where(maybe_in(wanted.select("content"), F.col("content")))
    sets = likely.join(wanted, "content").mapInPandas(_needed_shingles(least_words), "node bigint, shingles array<bigint>")
    sets = write_shared(sets.dropDuplicates(["node"]))

    links = write_shared(_verified(_with_pivot(met), sets))
    links = links.union(_verified(_rare_shingle_pairs(_apart(met, links), sets), sets))

    member = components(links).withColumnRenamed("node", "n").withColumnRenamed("component", "c")
    classed = nodes.join(member, F.col("node") == F.col("n"), "left").select("same", "members", "first", F.coalesce("c", "node").alias("component"))
    classed = write_shared(classed)
    sizes = classed.groupBy("component").agg(F.sum("members").alias("component_size"), F.min("first").alias("first"))
    classed = write_shared(classed.select("same", "component").join(sizes.where("component_size > 1"), "component"))
    rows = found.drop("bands").join(classed, "same")
    return rows.select(
        "doc_id", "paragraph", "begin", "end", "n_words", "component_size",
        F.col("first.doc_id").alias("first_doc_id"), F.col("first.paragraph").alias("first_paragraph"),
        ((F.col("row") == F.col("first.row")) & (F.col("paragraph") == F.col("first.paragraph"))).alias("kept"),
    )


def _places(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Words that start the passages of a text: of any REACH words in a row that with the smallest hash of PLACE_BYTES bytes.

    A run of words that two texts share chooses the same places in both. The first and the last passage of a
    text are added, so that every word is in one. A text of less than PASSAGE_WORDS words is one passage.
    data: the words, a blank after each, and PLACE_BYTES more bytes.
    """
    last = max(len(starts) - PASSAGE_WORDS, 0)
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    chosen = [np.array([0, last])]
    for at in range(0, last + 1, WORDS_AT_ONCE):
        part = starts[at : at + WORDS_AT_ONCE + REACH]
        if len(part) < REACH:
            break
        value = (eights[part] * _FACTORS[0]) ^ (eights[part + 8] * _FACTORS[1])
        value ^= value >> np.uint64(32)
        value *= _FACTORS[2]
        value = (value & ~_PLACE) | np.arange(len(part), dtype=np.uint64)
        reach = 1
        while reach < REACH:  # the least of so many from each place on
            step = min(reach, REACH - reach)
            value = np.minimum(value[: len(value) - step], value[step:])
            reach += step
        chosen.append(at + (value[np.r_[True, value[1:] != value[:-1]]] & _PLACE).astype(np.int64))
    places = np.unique(np.concatenate(chosen))
    return places[places <= last]


def passages(text: str | None, least_words: int = LEAST_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(first word, words, identity) of the passages of a text; of equal ones that overlap the first only."""
    words = (text or "").lower().split()
    if len(words) < max(least_words, 1):
        return
    words.append(" " * PLACE_BYTES)
    joined = " ".join(words).encode()
    data = np.frombuffer(joined, np.uint8)
    blanks = np.flatnonzero(data[:-PLACE_BYTES] == 32)
    starts = np.concatenate(([0], blanks[:-1] + 1))
    places = _places(data, starts)
    length = min(PASSAGE_WORDS, len(starts))
    ends: dict[bytes, int] = {}
    for at, a, b in zip(places.tolist(), starts[places].tolist(), blanks[places + length - 1].tolist()):
        same = xxhash.xxh3_128_digest(joined[a:b])
        if ends.get(same, 0) <= at:
            ends[same] = at + length
            yield at, length, same


def _word_bounds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """First character of every word, and the one after its last."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    blank = np.concatenate(([True], _SPACES[np.minimum(codes, len(_SPACES) - 1)], [True]))
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[::2], edges[1::2]


def _keys(same: list[bytes]) -> np.ndarray:
    """The first eight bytes of each identity."""
    return np.frombuffer(b"".join(same), "<i8")[::2]


def _passage_keys(least_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            same: list[bytes] = []
            for text in batch["text"]:
                same += [digest for _, _, digest in passages(text, least_words)]
                if len(same) > 100_000:
                    yield pd.DataFrame({"key": _keys(same)})
                    same = []
            yield pd.DataFrame({"key": _keys(same)})

    return run


def _passage_rows(least_words: int):
    columns = ["row", "doc_id", whole_ids.NONE, "paragraph", "begin", "end", "n_words"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts, same = [], []
            for row, doc, none, text in zip(batch["row"].tolist(), batch["doc_id"].tolist(), batch[whole_ids.NONE].tolist(), batch["text"]):
                found = list(passages(text, least_words))
                if not found:
                    continue
                begins, ends = _word_bounds(text)
                length = found[0][1]
                at = np.array([first for first, _, _ in found])
                begin, end = begins[at], ends[at + length - 1]
                breaks = np.array([m.start() for m in _BREAK.finditer(text)], np.int64)
                parts.append(([row] * len(at), [doc] * len(at), [none] * len(at), np.searchsorted(breaks, begin), begin, end, [length] * len(at)))
                same += [digest for _, _, digest in found]
                if len(same) > 50_000:
                    yield frame(parts, same)
                    parts, same = [], []
            if same:
                yield frame(parts, same)

    def frame(parts, same):
        table = pd.DataFrame({name: np.concatenate(values) for name, values in zip(columns, zip(*parts))})
        return table.assign(same=same, key=_keys(same))

    return run


def repeated_passages(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = LEAST_WORDS
) -> DataFrame:
    """One row for each passage of PASSAGE_WORDS words that occurs again, word for word in lower case.

    The columns are those of `repeated_paragraphs`; paragraph is the line in which the passage begins. Passages
    overlap, run over line ends, and cover every word. Any run of 50 words that occurs twice holds
    one that is reported in both places. component_size counts the places; the first (by id, then place;
    NULL ids last, and each row by itself) is kept. NULL texts and those of less than `least_words` words have none.
    An empty table gives no rows.
    """
    texts = documents.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    keys = texts.select("text").mapInPandas(_passage_keys(least_words), "key bigint")
    again = write_shared(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    schema = f"row long, doc_id long, {whole_ids.NONE} boolean, paragraph int, begin long, end long, n_words int, same binary, key long"
    rows = texts.select(F.monotonically_increasing_id().alias("row"), *whole_ids.without_null("doc_id"), "text")
    rows = rows.mapInPandas(_passage_rows(least_words), schema).where(maybe_in(again, F.col("key")))
    rows = rows.withColumn("doc_id", whole_ids.with_null()).drop(whole_ids.NONE)
    rows = write_shared(rows.join(again, "key", "left_semi").drop("key"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "paragraph", "begin")
    sizes = rows.groupBy("same").agg(F.count(F.lit(1)).alias("component_size"), F.min(place).alias("first"))
    found = rows.join(write_shared(sizes.where("component_size > 1")), "same")
    return found.select(
        "doc_id", "paragraph", "begin", "end", "n_words", "component_size",
        F.col("first.doc_id").alias("first_doc_id"), F.col("first.paragraph").alias("first_paragraph"),
        ((F.col("row") == F.col("first.row")) & (F.col("begin") == F.col("first.begin"))).alias("kept"),
    )
