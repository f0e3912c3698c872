"""Token ids of whole texts in a file format of blocks, written and read by Spark.

A token table is a folder of Parquet files whose rows are frames. A frame holds up to BLOCK_IDS ids of a
run of documents, coded as `range_coder` says by the JVM (`jvm_coder`), and says which documents they belong to; it can be read alone
and has two checksums, of itself and of the ids in it. Spark's writer commits the files, so a lost executor
leaves no half-written table, and any file system that Spark reaches will do.
"""

import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import jvm_coder, whole_ids

END = 2
BLOCK_IDS = 8192
BLOCKS_AT_ONCE = 64
KNOWN_WORDS = 1_000_000
MAGIC = b"TIB1"
_HEAD = struct.Struct("<4sIIIII")  # magic, ids, pieces, bytes of code (or of plain ids), crc32 of ids, crc32 of all that follows
_PIECE = struct.Struct("<?qQIIQ")
_LAYOUT = _HEAD.size, _PIECE.size, MAGIC
# how byte-level vocabularies of this kind cut a text before merging; a fixed pattern
WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


class Encoder:
    """Ids of texts by the tokenizers library; words met before are looked up.

    The vocabulary merges within the words of WORDS only, so a text's ids are those of its words.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        words = [WORDS.findall(text) for text in texts]
        new = list(set().union(*words) - self.known.keys())
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            found = [one.ids for one in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            ends = (2 * np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))).tolist()
            every = np.fromiter(chain.from_iterable(found), "<u2", ends[-1] // 2).tobytes()
            self.known.update((word, every[a:b]) for word, a, b in zip(some, [0, *ends], ends))
        end, get = struct.pack("<H", END), self.known.__getitem__
        return [np.frombuffer(b"".join([*map(get, found), end]), "<u2") for found in words]


@cache
def encoder(path: str) -> Encoder:
    """One in each Python worker."""
    return Encoder(path)


def checksum(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def _frame(code: bytes, ids: np.ndarray, pieces: list[tuple]) -> bytes:
    """pieces: (id of the document or None, its row in the shard, number of the piece, ids in it, ids of the shard before it)."""
    body = b"".join(_PIECE.pack(doc is None, doc or 0, *rest) for doc, *rest in pieces) + code
    return _HEAD.pack(MAGIC, len(ids), len(pieces), len(code), checksum(ids), zlib.crc32(body)) + body


def _parse(frame: bytes) -> tuple[int, int, bytes, list[tuple]]:
    magic, n_ids, n_pieces, n_code, crc, whole = _HEAD.unpack_from(frame)
    body = frame[_HEAD.size :]
    if magic != MAGIC or zlib.crc32(body) != whole or len(body) != n_pieces * _PIECE.size + n_code:
        raise ValueError("a frame is damaged")
    pieces = [_PIECE.unpack_from(body, at * _PIECE.size) for at in range(n_pieces)]
    return n_ids, crc, body[n_pieces * _PIECE.size :], pieces


class _Shard:
    """Cuts the ids of the documents of one shard into blocks; a document that doesn't fit starts a new one, a longer one fills several."""

    def __init__(self) -> None:
        self.row = self.before = 0
        self.blocks: list[tuple[list[np.ndarray], list[tuple]]] = []
        self.parts: list[np.ndarray] = []
        self.pieces: list[tuple] = []
        self.size = 0

    def close(self) -> None:
        if self.size:
            self.blocks.append((self.parts, self.pieces))
            self.parts, self.pieces, self.size = [], [], 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        if self.size + len(ids) > BLOCK_IDS:
            self.close()
        for number, at in enumerate(range(0, len(ids), BLOCK_IDS)):
            part = ids[at : at + BLOCK_IDS]
            self.parts.append(part)
            self.pieces.append((doc, self.row, number, len(part), self.before))
            self.size += len(part)
            self.before += len(part)
            if self.size >= BLOCK_IDS:
                self.close()
        self.row += 1

    def frames(self, shard: int, least: int) -> Iterator[pd.DataFrame]:
        """Frames of plain ids."""
        while len(self.blocks) >= least:
            now, self.blocks = self.blocks[:BLOCKS_AT_ONCE], self.blocks[BLOCKS_AT_ONCE:]
            ids = [np.concatenate(parts) for parts, _ in now]
            rows = [_frame(part.astype("<u2").tobytes(), part, pieces) for part, (_, pieces) in zip(ids, now)]
            yield pd.DataFrame({"shard": shard, "first": [pieces[0][4] for _, pieces in now], "n_ids": list(map(len, ids)), "frame": rows})


def write(documents: DataFrame, path: str, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", shards: int | None = None) -> None:
    """Write the ids of all texts in ascending order of id; NULL ids come first, a NULL text is empty.

    Every document ends in the id END. A shard is a range of ids, and of hashes of the texts of one id. Rows that repeat an id follow each other,
    ordered by the hash of their text. `tokenizer` names a file that every executor can read; its ids must be below 65,536.
    Other columns are not read. An empty table is written as one without frames.
    """
    shards = shards or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    order = ["doc_id", "hash"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, number, model = _Shard(), TaskContext.get().partitionId(), encoder(tokenizer)
        for batch in batches:
            ids = zip(batch["doc_id"].tolist(), batch[whole_ids.NONE].tolist())
            docs, texts = [None if none else doc for doc, none in ids], batch["text"].tolist()
            for at in range(0, len(texts), 200):
                for doc, ids in zip(docs[at : at + 200], model.encode(texts[at : at + 200])):
                    shard.add(doc, ids)
                yield from shard.frames(number, BLOCKS_AT_ONCE)
        shard.close()
        yield from shard.frames(number, 1)

    dealt = rows.withColumn("hash", F.sha2("text", 256)).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    frames = dealt.select(*whole_ids.without_null("doc_id"), "text").mapInPandas(run, "shard int, first long, n_ids int, frame binary")
    coded = jvm_coder.coded(documents.sparkSession, F.col("frame"), *_LAYOUT).alias("frame")
    frames.select("shard", "first", "n_ids", coded).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, shard, row, piece, n_ids, before, ids_crc32, ids) of all frames; raises if one is damaged."""
    return _decoded(spark, path, True)


def _decoded(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    schema = "doc_id bigint, shard int, row long, piece int, n_ids int, before long, ids_crc32 long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BLOCKS_AT_ONCE):
                yield decoded(batch.iloc[at : at + BLOCKS_AT_ONCE])

    def decoded(batch: pd.DataFrame) -> pd.DataFrame:
        parsed = [_parse(frame) for frame in batch["frame"]]
        rows, lists = [], []
        for shard, (n_ids, crc, plain, pieces) in zip(batch["shard"], parsed):
            ids = np.frombuffer(plain, "<u2")
            if len(ids) != n_ids or checksum(ids) != crc:
                raise ValueError("the ids of a frame are damaged")
            at = 0
            for none, doc, row, piece, n, before in pieces:
                part = ids[at : at + n]
                rows.append((None if none else doc, shard, row, piece, n, before, checksum(part)))
                lists.append(part)
                at += n
        table = pd.DataFrame(rows, columns=["doc_id", "shard", "row", "piece", "n_ids", "before", "ids_crc32"])
        table["doc_id"] = whole_ids.column_of([doc for doc, *_ in rows])
        if with_ids:
            table["ids"] = [part.astype(np.int32) for part in lists]
        return table

    table = spark.read.schema("shard int, first long, n_ids int, frame binary").parquet(path)
    plain = jvm_coder.plain(spark, F.col("frame"), *_LAYOUT).alias("frame")
    return table.select("shard", plain).mapInPandas(run, schema + ", ids array<int>" * with_ids)


@lru_cache(64)
def _advance(length: int) -> list[int]:
    """How `length` zero bytes change a crc32: the images of its 32 bits."""
    square = [0xEDB88320, *(1 << at for at in range(31))]  # one zero bit; the polynomial is fixed
    result = [1 << at for at in range(32)]
    bits = 8 * length
    while bits:
        if bits & 1:
            result = [_times(square, value) for value in result]
        square = [_times(square, value) for value in square]
        bits >>= 1
    return result


def _times(matrix: list[int], value: int) -> int:
    total = 0
    for image in matrix:
        if not value:
            break
        if value & 1:
            total ^= image
        value >>= 1
    return total


def joined_checksum(checksums: list[int], lengths: list[int]) -> int:
    """crc32 of pieces one after the other, from those of the pieces and their lengths in bytes."""
    total = checksums[0] if checksums else 0
    for value, length in zip(checksums[1:], lengths[1:]):
        total = _times(_advance(length), total) ^ value
    return total


@F.pandas_udf(LongType())
def _joined(checksums: pd.Series, lengths: pd.Series) -> pd.Series:
    return pd.Series([joined_checksum(list(map(int, c)), [4 * int(n) for n in k]) for c, k in zip(checksums, lengths)], dtype="int64")


def index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a token table, from its decoded frames.

    start counts the ids of all documents before it. The pieces of a long document are put together
    by their checksums. There is one row for each row written.
    """
    pieces = _decoded(spark, path, False)
    shards = spark.read.schema("shard int, n_ids int").parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # one row a shard
    offsets = shards.select("shard", F.coalesce(before, F.lit(0)).alias("offset"))
    part = F.struct("piece", "n_ids", F.col("ids_crc32").alias("crc"))
    docs = pieces.groupBy("shard", "row").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"), F.min("before").alias("before"),
        F.sum("n_ids").alias("n_tokens"), F.sort_array(F.collect_list(part)).alias("parts"),
    )
    docs = docs.join(F.broadcast(offsets), "shard")
    return docs.select(
        "doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens",
        _joined(F.col("parts.crc"), F.col("parts.n_ids")).alias("ids_crc32"),
    )
