"""The pipeline leaves its result behind and no other table, and nothing in the scope of a caller."""

import corpus_pipeline
from millwright.operators.shared_table import stored_tables
from tests.test_segments import _folders


def test_only_the_result_is_left(spark, sf_dir):
    before = _folders(spark)
    with stored_tables():
        found = corpus_pipeline.run(spark, sf_dir)
        assert len(_folders(spark) - before) == 1
        assert found.where("lossless").count() == found.count() > 0
    assert _folders(spark) == before
