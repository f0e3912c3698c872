"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed (LZ78) into phrases, each the longest known phrase and one more character. Texts that
compress well together share phrases, so the likeness of two texts is the estimated share of common
phrases, from the smallest hashes of either phrase set.
"""

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millwright.operators.shared_table import write_shared

from . import whole_ids

SIZE = 128  # values of a signature, one for each part of the range of hashes
EMPTY = 0xFFFFFFFF
_ODD, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


class Parse:
    """Phrases of a text so far; can go back to a mark, so that a common beginning is parsed once."""

    def __init__(self) -> None:
        self.known: dict[int, int] = {}
        self.hashes: list[int] = [0]
        self.state = 0

    def feed(self, codes: list[int]) -> list[int]:
        """Parse on; returns the keys of new phrases. Key of a phrase: number of the known part and the character."""
        known, hashes, state = self.known, self.hashes, self.state
        new = []
        find, note = known.get, new.append
        for code in codes:
            key = state << 21 | code
            state = find(key)
            if state is None:
                known[key] = len(hashes)
                hashes.append(((hashes[key >> 21] ^ code) * _ODD + 0x7F4A7C15) & _MASK)
                note(key)
                state = 0
        self.state = state
        return new

    def back(self, mark: tuple[int, int], new: list[int]) -> None:
        phrases, self.state = mark
        del self.hashes[phrases:]
        for key in new:
            del self.known[key]

    def mark(self) -> tuple[int, int]:
        return len(self.hashes), self.state

    def signature(self) -> np.ndarray:
        """Smallest hash in each of SIZE parts; EMPTY where no phrase falls. A rest that ends inside a known phrase adds nothing."""
        value = np.array(self.hashes[1:], np.uint64)
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(32)
        out = np.full(SIZE, EMPTY, np.uint32)
        part, low = (value % np.uint64(SIZE)).astype(np.int64), (value >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((low, part))
        part, low = part[order], low[order]
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else part
        out[part[first]] = np.minimum(low[first], EMPTY - 1)
        return out


def _codes(text: str) -> list[int]:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).tolist()


def text_of(signature: np.ndarray) -> str:
    """A signature as hexadecimal digits, 8 for each value."""
    return signature.astype(">u4").tobytes().hex()


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Share of parts with equal values, of those where either has one; 1 if neither has any."""
    used = (one != EMPTY) | (other != EMPTY)
    return float((one == other)[used].mean()) if used.any() else 1.0


def signature(text: str | None) -> np.ndarray:
    parse = Parse()
    parse.feed(_codes(text or ""))
    return parse.signature()


def both_signatures(text: str, other_end: str) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of `text`, and of `text` with its last third exchanged for `other_end`; the beginning is parsed once."""
    keep = len(text) - len(text) // 3
    parse = Parse()
    parse.feed(_codes(text[:keep]))
    mark = parse.mark()
    new = parse.feed(_codes(text[keep:]))
    whole = parse.signature()
    parse.back(mark, new)
    parse.feed(_codes(other_end))
    return whole, parse.signature()


def _in_order(documents: DataFrame, id_column: str, text_column: str, parts: int) -> tuple[DataFrame, int]:
    """Rows (part, id, hash, text, ahead), and the number of parts: each a run of the descending order of ids and hashes, with the row after it.

    Parts are ranges of ids cut at approximate quantiles. Rows without an id, and those of an id that fills a part or more, are cut
    by ranges of the hash of their text, so these are spread, too. The first row of a part is added once more, with `ahead`, to
    the part before it; the first of all to the last part. Parts are numbered in order; each has rows.
    """
    rows = documents.select(F.col(id_column).cast("bigint").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("id", [at / parts for at in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    hot = {cut: times for cut, times in Counter(cuts).items() if times > 1}
    # the order of doubles is that of ids, and ids that share a double share a range
    splits = [float("-inf"), *sorted({float(cut) for cut in cuts} or {0.0}), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="number", outputCol="bucket", handleInvalid="keep")
    rows = ranged.transform(rows.withColumns({"number": F.col("id").cast("double"), "hash": F.sha2("text", 256)}))
    slices = F.when(F.col("id").isNull(), F.lit(parts))
    for cut, times in hot.items():
        slices = slices.when(F.col("id") == cut, F.lit(times + 1))
    rows = rows.withColumn("slices", slices)
    share = F.conv(F.substring("hash", 1, 8), 16, 10).cast("bigint")
    ranks = {  # ascending; a hot id is the smallest of its range
        "r0": F.col("id").isNull(), "r1": -F.coalesce("bucket", F.lit(0.0)), "r2": F.col("slices").isNotNull(),
        "r3": F.when(F.col("slices").isNotNull(), -F.coalesce("id", F.lit(0).cast("bigint")).cast("decimal(20,0)")),
        "r4": F.col("slices") - 1 - F.floor(share * F.col("slices") / (1 << 32)),
    }
    rows = rows.withColumns(ranks).withColumn("place", F.struct(*ranks)).select("id", "text", "hash", "place")
    row = F.struct(F.col("id").isNotNull().alias("some"), "id", "hash")
    heads = rows.groupBy("place").agg(F.max(row).alias("head"))  # one row for each part
    order = Window.orderBy("place")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("place", "head", (F.row_number().over(order) - 1).alias("part"), F.count(F.lit(1)).over(every).alias("all"))
    heads = heads.withColumn("before", F.pmod(F.col("part") - 1, F.col("all")).cast("int"))
    heads = write_shared(heads)
    rows = rows.join(F.broadcast(heads.select("place", "part", "before", "head")), "place")
    first = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("hash") == F.col("head.hash"))
    ahead = rows.where(first).dropDuplicates(["part", "id", "hash"])
    ahead = ahead.select("id", "hash", "text", F.col("before").alias("part"), F.lit(True).alias("ahead"))
    return rows.select("id", "hash", "text", "part", F.lit(False).alias("ahead")).unionByName(ahead), heads.count()


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a part in order; each is finished when the row after it is seen."""
    held: tuple | None = None  # part, id, text
    waiting: list | None = None  # result of the row before `held`, which still lacks the likeness to it

    def results(part, text) -> Iterator[list]:
        nonlocal waiting
        take = len(held[2]) // 3
        whole, edited = both_signatures(held[2], text[:take])
        changed = held[2][: len(held[2]) - take] + text[:take]
        if waiting is not None:
            yield [*waiting[:-1], likeness(waiting[-1], whole)]
        waiting = [
            *held[1], len(held[2]), hashlib.sha256(changed.encode()).hexdigest(), text_of(whole), text_of(edited),
            likeness(whole, edited), whole,
        ]

    for batch in batches:
        out = []
        columns = (batch[name].tolist() for name in ("part", "doc_id", whole_ids.NONE, "text", "ahead"))
        for part, number, none, text, ahead in zip(*columns):
            if held is not None and held[0] == part:
                out += results(part, text)
            held = (part, (number, none), text)
            if ahead:
                out.append([*waiting[:-1], likeness(waiting[-1], signature(text))])
                held = waiting = None
        yield pd.DataFrame(out, columns=NAMES)


NAMES = ["doc_id", whole_ids.NONE, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = (
    f"doc_id bigint, {whole_ids.NONE} boolean, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def with_edited(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, one row for each row of `documents`.

    The edited text has its last floor(n / 3) characters exchanged for the first as many of the next row
    in descending order of id (the first row's after the last). NULL text counts as empty; rows of one id
    follow each other by the hash of their text, NULL ids come last. A single row is its own next. The texts are
    shuffled once, by part; an empty table gives no rows. Other columns are not read.
    """
    spark = documents.sparkSession
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, found = _in_order(documents, id_column, text_column, parts)
    dealt = rows.repartitionById(max(found, 1), F.col("part")).sortWithinPartitions(
        "part", "ahead", F.col("id").desc_nulls_last(), F.desc("hash")
    )
    dealt = dealt.select("part", *whole_ids.without_null("id", "doc_id"), "text", "ahead")
    rows = dealt.mapInPandas(_neighbours, SCHEMA)
    return rows.withColumn("doc_id", whole_ids.with_null()).drop(whole_ids.NONE)


def fingerprints(documents: DataFrame, text_column: str = "text", name: str = "fingerprint") -> DataFrame:
    """`documents` with the fingerprint of their whole texts in one more column; NULL counts as empty."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([text_of(signature(text)) for text in texts], dtype="object")

    return documents.withColumn(name, run(F.col(text_column)))
