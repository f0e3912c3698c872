"""A training corpus from `documents`: five stages, each written as Parquet and read by the next."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm import line_dedup, mixing, piece_sampling, quality_classifier, simhash_dedup
from millwright.llm.labelled import fold
from millwright.llm.registry import tokenizer_file
from millwright.operators.shared_table import drop_shared, stored_tables, write_shared

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.3 or more; the classifier learns from the labels of four of five folds."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    network = quality_classifier.fit(docs, labels, fold("doc_id", 5) != 0)
    scored = quality_classifier.score(docs, network, score_column="_score")
    return scored.where(F.col("_score") >= quality_classifier.THRESHOLD).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are near-equal to an earlier one; n_chars counts what is left."""
    left = line_dedup.without_repeated_lines(docs.select(*COLUMNS))
    return left.withColumn("n_chars", F.length("text").cast("bigint"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    return simhash_dedup.one_of_each(docs).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as drawn, in random order, so that a source weighs the square root of its size."""
    return mixing.mix(docs).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_pieces and the sampled piece ids, decoded to see that no text is lost."""
    model = tokenizer_file("piece_bpe_32k.model")
    rows = piece_sampling.round_trip(docs, model)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return rows.select("doc_id", "source", F.size("piece_ids").alias("n_pieces"), "piece_ids", same.alias("lossless"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", pieces),
]

#: A trained classifier and sampled segmentations can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the table `documents`; what each returns is stored before the next reads it.

    What a stage stores on its way is removed when its result is written, and this as soon as the next stage's is.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        with stored_tables() as scope:
            docs = scope.keep(write_shared(stage(spark, docs, sf_dir)))
        if before is not None:
            drop_shared(before)
        before = docs
    return docs
