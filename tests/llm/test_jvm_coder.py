"""The coder of the JVM writes what the one in numpy writes, byte for byte, and reads it again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwright.llm import jvm_coder, range_coder, token_files


def _blocks() -> list[np.ndarray]:
    rng = np.random.default_rng(2)
    plain = [rng.integers(0, most, n) for most, n in ((65536, 8192), (50257, 3000), (10_240, 8192), (3, 8192), (300, 1), (1, 5000), (65536, 2))]
    return [ids.astype(np.uint16) for ids in (*plain, rng.zipf(1.3, 8192).clip(0, 65535), np.full(4000, 65535), np.arange(20_000))]


def _frames(spark, frames: list[bytes]):
    return spark.createDataFrame([(at, bytearray(frame)) for at, frame in enumerate(frames)], "at int, frame binary").repartition(2)


def _bytes(frames, way, spark) -> list[bytes]:
    found = frames.select("at", way(spark, F.col("frame"), *token_files._LAYOUT).alias("frame")).orderBy("at").collect()
    return [bytes(row.frame) for row in found]


def test_the_same_bytes(spark):
    blocks = _blocks()
    pieces = [[(None, 0, 0, len(ids), 0), (2**53 + at, 1, 0, 0, 7)] for at, ids in enumerate(blocks)]
    plain = [token_files._frame(ids.astype("<u2").tobytes(), ids, of) for ids, of in zip(blocks, pieces)]
    expected = [token_files._frame(code, ids, of) for code, ids, of in zip(range_coder.encode(blocks), blocks, pieces)]
    coded = _bytes(_frames(spark, plain), jvm_coder.coded, spark)
    assert coded == expected
    assert _bytes(_frames(spark, coded), jvm_coder.plain, spark) == plain
    other = spark.newSession()
    assert _bytes(_frames(other, coded[:3]), jvm_coder.plain, other) == plain[:3]


def test_a_damaged_frame_is_not_read(spark):
    ids = np.arange(300, dtype=np.uint16)
    frame = token_files._frame(range_coder.encode([ids])[0], ids, [(1, 0, 0, 300, 0)])
    for at in (0, 9, 13, len(frame) // 2, len(frame) - 1):  # magic, pieces, size, code
        bad = frame[:at] + bytes([frame[at] ^ 1]) + frame[at + 1 :]
        with pytest.raises(Exception, match="a frame is damaged"):
            _bytes(_frames(spark, [bad]), jvm_coder.plain, spark)
