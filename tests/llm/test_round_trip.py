"""Sampled pieces and their text from one worker equal those of encoding and decoding apart."""

import pyarrow as pa

from millwright.llm import piece_sampling, registry


def test_both_ways_agree(spark, sf_dir):
    model = registry.tokenizer_file("piece_bpe_32k.model")
    rows = [(1, "one two"), (2, None), (None, ""), (3, "é😀 x" * 2000), (3, "é😀 x" * 2000)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    table = table.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    apart = piece_sampling.decode(piece_sampling.encode(table, model), model)
    found = piece_sampling.round_trip(table, model)
    assert found.columns == apart.columns and found.dtypes == apart.dtypes
    assert sorted(map(str, found.collect())) == sorted(map(str, apart.collect()))
    assert piece_sampling.round_trip(table.limit(0), model).count() == 0


def test_all_pieces_that_a_text_ends_in_are_found():
    pieces = piece_sampling.Pieces(registry.tokenizer_file("piece_bpe_32k.model"))
    reach, text = pieces.nothing, " the theory of\tétés and 漢字 unlikelihoods the"
    for end in range(1, len(text) + 1):
        reach = reach[text[end - 1]]
        found = {(back, (edge >> 37) - piece_sampling._CODES) for _, edge, back in reach.found}
        assert found == {(back, pieces.weights[text[end - back : end]][1]) for back in range(1, end + 1) if text[end - back : end] in pieces.weights}
        assert [back for *_, back in reach.found] == sorted(back for back, _ in found)


def test_ids_come_in_batches_of_few_characters(monkeypatch):
    model = piece_sampling.Pieces(registry.tokenizer_file("piece_bpe_32k.model"))
    texts = [None, "", *[f"{at} is one of some words é " * 1000 for at in range(60)], "long " * 100_000, None]
    keys, column = pa.array(map(str, range(len(texts)))), pa.array(texts)
    found = list(piece_sampling._sampled(model, keys, column, 0))
    parts = list(piece_sampling._slices(column))
    assert [len(ids) for ids in found] == [part.stop - part.start for part in parts] and sum(map(len, found)) == len(texts)
    for part in parts:
        held = [text for text in texts[part] if text]
        assert len(held) == 1 or sum(map(len, held)) <= piece_sampling.BATCH_CHARS
    assert [text for ids in found for text in piece_sampling._spelled(model, ids).to_pylist()] == [text or "" for text in texts]
    monkeypatch.setattr(piece_sampling, "BATCH_CHARS", 10**9)
    whole = list(piece_sampling._sampled(model, keys, column, 0))
    assert len(whole) == 1 < len(found) and whole[0].to_pylist() == [ids for one in found for ids in one.to_pylist()]
    assert list(piece_sampling._sampled(model, keys[:0], column[:0], 0)) == []
