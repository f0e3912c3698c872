"""Ids of all 64 bits beside NULL come out of every operator as they went in."""

import pytest
from pyspark.sql import functions as F

from millwright.llm import (
    byte_pairs, exact_dedup, line_dedup, lz_fingerprint, mixing, piece_sampling, registry, simhash_dedup, substring_dedup, token_files,
)
from millwright.operators.shared_table import stored_tables, shared_folder

IDS = [2**53 + 1, 2**53 + 3, -(2**63), 2**63 - 1, None, None, 0, 5, 5]
TEXT = " ".join(f"word{i}" for i in range(80))


@pytest.fixture(scope="module")
def table(spark):
    rows = [(doc, TEXT + (f"\nown line {at}" if at % 2 else ""), "en", "s") for at, doc in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(2)


def _ids(rows):
    return sorted((r.doc_id for r in rows.collect()), key=lambda doc: (doc is None, doc or 0))


EVERY = sorted(IDS, key=lambda doc: (doc is None, doc or 0))


def test_ids_of_single_rows(spark, table):
    model = registry.tokenizer_file("piece_bpe_32k.model")
    assert _ids(simhash_dedup.near_duplicates(table)) == EVERY
    assert {r.component_id for r in simhash_dedup.near_duplicates(table).collect()} == {-(2**63)}
    assert [r.doc_id for r in simhash_dedup.one_of_each(table).collect()] == [-(2**63)]
    assert _ids(exact_dedup.duplicates(table)) == EVERY
    assert _ids(piece_sampling.encode(table, model)) == EVERY
    assert set(_ids(mixing.mix(table, {"s": 1.0}))) <= set(IDS)
    assert _ids(byte_pairs.encode(table, registry.tokenizer_file("byte_bpe_multi_50k.tiktoken"), r"\S+|\s+")) == EVERY
    assert set(_ids(line_dedup.repeated_lines(table))) <= set(IDS)


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_ids_of_neighbours_and_files(spark, table, parts):
    assert _ids(lz_fingerprint.with_edited(table, parts=parts)) == EVERY
    with stored_tables():
        path = f"{shared_folder(spark)}/tokens-of-ids-{parts}-{id(table)}"
        token_files.write(table, path, registry.tokenizer_file("byte_bpe_50k.json"), shards=parts)
        found = token_files.index(spark, path).orderBy("start")
        assert [r.doc_id for r in found.collect()] == [None, None, *EVERY[:-2]]
        assert _ids(token_files.read(spark, path).select("doc_id").where("doc_id IS NOT NULL")) == EVERY[:-2]


def test_ids_of_paragraphs_and_passages(table):
    for found in (substring_dedup.repeated_paragraphs(table), substring_dedup.repeated_passages(table)):
        assert set(_ids(found)) == set(IDS)
        assert {r.first_doc_id for r in found.collect()} == {-(2**63)}
        one = found.where("component_size = 9").groupBy("begin", "paragraph").agg(F.count_if("kept").alias("kept")).collect()
        assert one and all(r.kept == 1 for r in one)


def test_one_paragraph_of_rows_that_share_an_id_or_have_none_is_kept(spark):
    other = " ".join(f"other{i}" for i in range(40))
    rows = [(7, TEXT), (7, TEXT), (7, "short\n" + other), (None, other), (None, other), (None, other), (8, other + "\n" + other)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = substring_dedup.repeated_paragraphs(table).collect()
    assert sorted((r.component_size, r.kept, r.first_doc_id) for r in found) == [(2, False, 7), (2, True, 7)] + [(6, False, 7)] * 5 + [(6, True, 7)]


def test_hot_ids_and_rows_without_one_are_spread(spark):
    hot = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id"))
    table = spark.range(6000).select(hot.alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text"))
    rows, found = lz_fingerprint._in_order(table, "doc_id", "text", 12)
    sizes = [r["count"] for r in rows.where("NOT ahead").groupBy("part").count().collect()]
    assert len(sizes) == found and sum(sizes) == 6000 and max(sizes) < 1000
    placed = rows.where("ahead").select("part").collect()
    assert sorted(r.part for r in placed) == list(range(found))
