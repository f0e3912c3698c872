"""Hashes of shingles and passages are made many at a time."""

import numpy as np

from millwright.llm import substring_dedup


def test_band_keys_of_parts_are_those_of_the_whole(monkeypatch):
    sets = [substring_dedup.shingles([f"é{at * step % 13}" for at in range(size)]) for step, size in enumerate([1, 5, 6, 40, 3, 200, 26], 1)]
    plain = np.zeros((len(sets), substring_dedup.BANDS), np.uint64)
    for row, one in enumerate(sets):
        for at, factor in enumerate(substring_dedup._FACTORS):
            value = np.array(one, np.uint64) * factor
            plain[row, at // substring_dedup.BAND_ROWS] ^= (value ^ (value >> np.uint64(32))).min()
            plain[row, at // substring_dedup.BAND_ROWS] *= np.uint64(0x9E3779B97F4A7C15)
    for most in (1, 30, 70, 1 << 15):
        monkeypatch.setattr(substring_dedup, "HASHES_AT_ONCE", most)
        assert (substring_dedup.band_keys(sets) == plain.view(np.int64)).all()
    assert substring_dedup.band_keys([]).shape == (0, substring_dedup.BANDS)


def test_passages_of_a_frame(spark):
    words = [f"W{at}" for at in range(90)]
    text = " ".join(words[:30]) + "\n\n" + " ".join(words[30:60]) + "\n" + " ".join(words[60:])
    table = spark.createDataFrame([(1, text), (2, None), (None, text), (3, "few words"), (4, "\n" + text)], "doc_id bigint, text string")
    found = substring_dedup.repeated_passages(table, least_words=3).collect()
    assert {row.doc_id for row in found} == {1, None, 4} and len(found) % 3 == 0
    texts = {1: text, None: text, 4: "\n" + text}
    for row in found:
        here, before = texts[row.doc_id][row.begin : row.end], texts[row.doc_id][: row.begin]
        assert len(here.split()) == row.n_words == substring_dedup.PASSAGE_WORDS and row.paragraph == before.count("\n")
        assert row.component_size == 3 and row.first_doc_id == 1 and row.kept == (row.doc_id == 1)
    assert len(substring_dedup._keys([])) == 0 and substring_dedup._keys([b"\xff" * 8 + b"\0" * 8]).tolist() == [-1]
