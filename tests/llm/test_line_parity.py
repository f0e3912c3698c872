"""Lines of many words: unlike ones are told apart before their words are fetched, and no similar pair is lost."""

import random

from millwright.llm import line_dedup


def _lines(spark, lines):
    return spark.createDataFrame([(at, " ".join(words)) for at, words in enumerate(lines)], "doc_id bigint, text string").repartition(3)


def _looked_at(monkeypatch, table):
    """What repeated_lines finds, and how many pairs were compared word by word."""
    pairs, similar = [], line_dedup._similar_pairs

    def counted(found, *others):
        pairs.append(found.distinct().count())
        return similar(found, *others)

    monkeypatch.setattr(line_dedup, "_similar_pairs", counted)
    return {row.doc_id for row in line_dedup.repeated_lines(table).collect()}, sum(pairs)


def test_unlike_long_lines_make_no_pairs(spark, monkeypatch):
    draw = random.Random(1)
    lines = [[f"w{i}" for i in draw.sample(range(2000), draw.choice([70, 120, 250]))] for _ in range(120)]
    assert _looked_at(monkeypatch, _lines(spark, lines)) == (set(), 0)


def test_similar_lines_around_the_wide_size_are_found(spark, monkeypatch):
    draw = random.Random(2)
    lines = []
    for size in [10, *range(line_dedup.WIDE - 14, line_dedup.WIDE + 17, 4), *range(line_dedup.WIDER - 20, line_dedup.WIDER + 21, 10), 300]:
        words = draw.sample(range(3000), size)
        lines.append(words)
        for share in (0.06, 0.1, 0.12, 0.2):  # so many words are other ones
            changed = words[: size - int(size * share)] + draw.sample(range(3000, 6000), int(size * share))
            lines += [changed, words[: size - int(size * share)], words + changed[size - int(size * share) :]]
    lines = [[f"w{i}" for i in draw.sample(words, len(words))] for words in lines]
    sets = [set(words) for words in lines]
    brute = {x for x in range(len(sets)) if any(9 * len(sets[x] & sets[y]) >= 4 * (len(sets[x]) + len(sets[y])) for y in range(x))}
    found, pairs = _looked_at(monkeypatch, _lines(spark, lines))
    assert found == brute and pairs


def _second_join(spark, monkeypatch, table, run):
    """What `run` makes of the pairs that the join on prefix codes gives."""
    made, similar = [], line_dedup._similar_pairs

    def looked(found, *others):
        made.append(run(found))
        return similar(found, *others)

    monkeypatch.setattr(line_dedup, "_similar_pairs", looked)
    gone = {row.doc_id for row in line_dedup.repeated_lines(table).collect()}
    return gone, made[1]


def test_both_sides_of_the_join_on_codes_are_one_exchange(spark, monkeypatch):
    draw = random.Random(3)
    table = _lines(spark, [[f"w{i}" for i in draw.sample(range(400), 30)] for _ in range(50)])
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan is known before it runs
    try:
        _, plan = _second_join(spark, monkeypatch, table, lambda found: found._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    dealt = [line for line in plan.splitlines() if "hashpartitioning(code" in line]
    assert len(dealt) == 2 and "ReusedExchange" in dealt[0] + dealt[1]


def test_a_large_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    draw = random.Random(4)
    first = draw.sample(range(1000), 60)
    lines = []
    for _ in range(400):
        lines.append([f"w{i if draw.random() > 0.07 else draw.randrange(1000, 100000)}" for i in first])
    sets = [set(words) for words in lines]
    brute = {x for x in range(len(sets)) if any(9 * len(sets[x] & sets[y]) >= 4 * (len(sets[x]) + len(sets[y])) for y in range(x))}
    found, pairs = _second_join(spark, monkeypatch, _lines(spark, lines), lambda found: found.count())
    assert found == brute and pairs < 20 * len(lines)
