"""Tables that grow with the corpus don't pass the driver, whatever size Spark takes them for."""

from millwright.llm import line_dedup, simhash_dedup
from millwright.operators.shared_table import write_shared

TEXT = " ".join(f"word{i}" for i in range(60))


def _noted(monkeypatch, module) -> list[str]:
    """The plans of what `module` stores from now on."""
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write_shared(df)

    monkeypatch.setattr(module, "write_shared", noted)
    return plans


def _texts(spark):
    near = TEXT.replace("word30", "other")
    rows = [(1, TEXT), (2, TEXT), (3, near), (4, "a b c d e"), (None, TEXT), (5, "a b c d e f\nk l m")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_simhash_buckets_and_classes(spark, monkeypatch):
    plans = _noted(monkeypatch, simhash_dedup)
    found = simhash_dedup.near_duplicates(_texts(spark))
    kept = simhash_dedup.one_of_each(_texts(spark))
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in (found, kept)]
    assert sum("SortMergeJoin" in plan for plan in plans) >= 6
    assert not [plan for plan in plans if "BroadcastHashJoin" in plan]
    assert len(found.collect()) == 6
    assert {row.doc_id for row in kept.collect()} >= {1, 4}


def test_line_sets_and_lines_that_go(spark, monkeypatch):
    plans = _noted(monkeypatch, line_dedup)
    found = line_dedup.without_repeated_lines(_texts(spark))
    gone = line_dedup.repeated_lines(_texts(spark))
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in (found, gone)]
    assert sum("SortMergeJoin" in plan for plan in plans) >= 10
    fixed = [line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line and "word#" not in line]
    assert not fixed  # but for the words of a bit filter, whose number is fixed
    assert {row.doc_id: row.text for row in found.collect()} == {
        1: TEXT, 2: "", 3: "", 4: "a b c d e", None: "", 5: "k l m",
    }
    assert {(row.doc_id, row.line) for row in gone.collect()} == {(2, 0), (3, 0), (None, 0), (5, 0)}
