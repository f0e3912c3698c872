"""Bounded samples of labelled documents to learn from."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_column: str, folds: int):
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds


def sample(
    documents: DataFrame, labels: DataFrame, label: str, learn_from, rows: int, text_chars: int | None = None,
    made_of: Callable[[Column], Column] | None = None,
) -> pd.DataFrame:
    """At most `rows` labelled whole texts (text, label) on the driver, whichever way the ids hash.

    Only rows for which `learn_from` holds and with a label of 0 or 1 are drawn. Ids are drawn first, so
    their texts reach the driver by a join with a list of at most `rows` ids; of rows that repeat one, the smallest text. `made_of` makes
    in tasks what is taken of each text. Only a caller who gives `text_chars` gets that many characters of either end of a longer text.
    """
    ids = (
        labels.where(learn_from).where(F.col(label).isin(0, 1)).where(F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(label).alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    ids = ids.select(F.col("doc_id").alias("_id"), "_label")
    text = F.coalesce(F.col("text"), F.lit(""))
    if text_chars is not None:
        ends = F.concat(F.substring(text, 1, text_chars), F.lit("\n"), F.substring(text, -text_chars, text_chars))
        text = F.when(F.length(text) > 2 * text_chars, ends).otherwise(text)
    found = documents.select(F.col("doc_id").alias("_id"), text.alias("text")).join(F.broadcast(ids), "_id")
    table = found.groupBy("_id").agg(F.min("text").alias("text"), F.first("_label").alias("label"))
    if made_of is not None:
        table = table.withColumn("text", made_of(F.col("text")))
    return table.toPandas().sort_values("_id", ignore_index=True)[["text", "label"]]
