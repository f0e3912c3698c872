"""Byte-level BPE against the tiktoken library and against plain merges."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from millwright.llm import byte_pairs, registry

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_pairs.read_ranks(RANKS), special_tokens={})


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_every_document_against_the_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = registry.op13_byte_pairs(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for row in found:
        ids = np.array(library.encode_ordinary(texts[row.doc_id]), "<u4")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_odd_rows(spark, library):
    texts = ["", None, " ", "a" * 30_000, "ab" * 9999, " \n\t x  ", "é😀▁ <s> <|endoftext|> \x00", "don't we'LL 1²३", "x " * 20_000, "same", "same"]
    ids = [2**53 + 1, 2**53 + 3, -(2**63), None, None, 5, 5, 6, 7, 8, 8]
    table = spark.createDataFrame([(i, t, b"old", 1) for i, t in zip(ids, texts)], "doc_id bigint, text string, ids binary, block int")
    rows = byte_pairs.decode(byte_pairs.encode(table, RANKS, public_tokenizers.PATTERN), RANKS)
    rows = rows.withColumn("list", byte_pairs.unpacked(rows.ids))
    assert rows.columns == ["doc_id", "text", "ids", "block", "decoded", "list"]
    found = sorted(((r.doc_id, r.text, list(r.list), bytes(r.decoded)) for r in rows.collect()), key=str)
    expected = [(i, t, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in zip(ids, texts)]
    assert found == sorted(expected, key=str)
    assert byte_pairs.encode(table.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_characters_that_unicode_tables_class_differently(library):
    odd = [chr(c) for c in byte_pairs._stand_ins()]
    words = byte_pairs.Words(byte_pairs.vocabulary(RANKS), public_tokenizers.PATTERN)
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(["ab ", "'s", "l", "1", ".", "é", "\n", rng.choice(odd)]) for _ in range(rng.randrange(12)))
        assert ids_of(words.encode(text)) == library.encode_ordinary(text)


def test_small_vocabularies_against_plain_merges():
    rng = random.Random(9)
    for _ in range(200):
        ranks = {bytes([i]): i for i in range(256)}
        while len(ranks) < 280:  # a vocabulary by random merges, so words need going back
            token = rng.choice([t for t in ranks if t.strip(b"abc") == b""]) + rng.choice([t for t in ranks if t.strip(b"abc") == b""])
            whole = byte_pairs.plain_merges(token, ranks)
            if len(whole) == 2:
                ranks[token] = len(ranks)
        model = byte_pairs.Vocabulary(ranks)
        for _ in range(100):
            word = bytes(rng.choices(b"abc", k=rng.randrange(1, 40)))
            assert [model.of[i] for i in model.encode_word(word)] == byte_pairs.plain_merges(word, ranks)


def test_a_token_that_no_merge_makes_stands_for_a_whole_word_only():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 257, b"xyz": 258}
    model = byte_pairs.Vocabulary(ranks)
    assert model.encode_word(b"xyz") == [258]
    assert [model.of[i] for i in model.encode_word(b"xyzabc")] == [b"x", b"y", b"z", b"abc"]


def test_a_vocabulary_out_of_order_is_refused():
    with pytest.raises(ValueError):
        byte_pairs.Vocabulary({bytes([i]): i for i in range(256)} | {b"abc": 256, b"ab": 257})
    with pytest.raises(ValueError):
        byte_pairs.Vocabulary({b"a": 0})


def test_known_words_are_bounded(monkeypatch, library):
    monkeypatch.setattr(byte_pairs, "KNOWN_WORD_BYTES", 2000)
    monkeypatch.setattr(byte_pairs, "KNOWN_PAIRS", 50)
    words = byte_pairs.Words(byte_pairs.vocabulary(RANKS), public_tokenizers.PATTERN)
    text = " ".join(f"word{i} thing{i % 7}" for i in range(500))
    for _ in range(3):
        assert ids_of(words.encode(text)) == library.encode_ordinary(text)
