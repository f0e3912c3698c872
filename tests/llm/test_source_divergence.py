"""Divergence of sources against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from millwright.llm import source_divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, n int, term_id string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def _brute(rows, least, top):
    docs = [(lang or "", source or "", _terms(text or "")) for _, text, lang, source, *_ in rows]
    groups, held = sorted({d[:2] for d in docs}), defaultdict(Counter)
    for lang, _, terms in docs:
        held[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        counts = {g[1]: Counter() for g in groups if g[0] == lang}
        for l, source, terms in docs:
            if l == lang:
                counts[source].update(t for t in terms if t in set(kept))
        counts_of_lang = sum(counts.values(), Counter())
        share = lambda count: [1 + 10**9 * (count[t] + 5) // (sum(count.values()) + 5 * len(kept)) for t in kept]
        p, q = {s: share(c) for s, c in counts.items()}, share(counts_of_lang)
        for source in counts:
            pairs = [(-sum(abs(a - b) for a, b in zip(p[source], p[o])), o.encode(), o) for o in counts if o != source]
            terms = [(b - a, t.encode(), t) for a, b, t in zip(p[source], q, kept) if counts[source][t] and a > b]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, source, part, item, -value, rank) for rank, (value, _, item) in enumerate(items, 1)]
    return sorted(out)


def _rows(rng):
    words = [f"{a}{b}" for a in "abcé" for b in ("", "X", "ß", "Zz", "日本", "İ")] + ["1", "-", "\x00", "a1b", " x"]
    langs, sources = ["en", "en", "de", "", None, "e\0n", "fr"], [*"abcdefg", None, "", "Σ"]
    rows = []
    for i in range(300):
        lang = rng.choice(langs)
        text = rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(40)))]) if lang != "fr" else "rare" + str(i)
        rows.append((rng.choice([None, i, 2**53 + 1]), text, lang, rng.choice(sources), 1, "t"))
    return rows + rows[:30] + [(9, "Long words " * 20_000, "en", "a", 1, "t"), (9, "", "it", "only one", 1, "t")]


@pytest.mark.parametrize("limits", [{}, {"block": 2}, {"most_terms": 7}, {"block": 3, "most_terms": 20}])
def test_against_plain_counting(spark, limits):
    rows = _rows(random.Random(2))
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = source_divergence.audit(table, min_documents=6, top_terms=5, **limits)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == _brute(rows, 6, 5)


def test_no_terms_and_no_rows(spark):
    rows = [(1, "one two", "en", "a", 1, ""), (2, None, "en", "b", 1, ""), (3, "", None, None, 1, "")]
    table = spark.createDataFrame(rows, SCHEMA)
    found = sorted(map(tuple, source_divergence.audit(table).collect()))
    assert found == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert source_divergence.audit(table.limit(0)).count() == 0


def test_large_counts_are_exact(spark):
    rows = spark.createDataFrame([(9 * 10**17, 9 * 10**18, 3)], "n long, total long, terms long")
    found = rows.select(source_divergence._share(rows.n, rows.total, rows.terms).alias("p")).first().p
    assert found == 1 + 10**9 * (9 * 10**17 + 5) // (9 * 10**18 + 15)


def test_terms_of_many_texts_at_once():
    texts = ["Ab cD", "", "é!É", "tail", "tail", " \t", "x" * 9, "日Z本"]
    langs = ["en", "en", "", "fr", "en", "d\0e", "日", "en"]
    table = pa.array(["skip", *texts])[1:]
    found = source_divergence.cut_terms(table, pa.array(langs)).to_pylist()
    assert found == [[f"{lang}\0{term}" for term in _terms(text)] for text, lang in zip(texts, langs)]
    assert source_divergence.cut_terms(pa.array([], pa.string()), pa.array([], pa.string())).to_pylist() == []


def test_terms_of_a_source_come_in_few_lists(spark):
    rows = _rows(random.Random(3)) * 5
    table = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    lists = source_divergence.terms_by_source(table).collect()
    assert len(lists) <= len({source or "" for *_, source, _, _ in rows}) + -(-len(rows) // 500)
    counted, plain = Counter(), Counter()
    for source, terms in lists:
        counted.update((source, term) for term in terms)
    for _, text, lang, source, *_ in rows:
        plain.update((source or "", f"{lang or ''}\0{term}") for term in _terms(text or ""))
    assert counted == plain
    assert source_divergence.terms_by_source(table.limit(0)).count() == 0
