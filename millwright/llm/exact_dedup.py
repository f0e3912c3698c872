"""Exact dedup by deterministic block naming.

A text is cut into blocks of fixed size. Equal blocks get one integer name: the distinct blocks are
sorted and numbered. Then adjacent names are paired, and the distinct pairs are named in the same
way, until one name is left of each text. Together with the length in bytes that name is the identity
of the text: two texts have it in common only if they are equal, whatever any hash says.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.operators.shared_table import write_shared

from .groups import with_group

BLOCK_BYTES = 4096


def _keyed(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One key for each row; rows that agree in id and text share it."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = documents.select(F.col(id_column).alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("text_sha256", F.sha2("text", 256))
    row = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_sha256")
    return rows.withColumn("row", row)


def identities(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One stored row for each different (id, text): row, doc_id, text_sha256, n_bytes, copies, name.

    Two texts are equal if and only if (n_bytes, name) are. NULL text counts as empty, and an empty
    text has one empty block. `copies` counts input rows with this id and text. Each round halves the
    blocks left of a text, so a text of any length takes log2(blocks) rounds; texts with one name left
    take no part in later rounds.
    """
    keyed = _keyed(documents, id_column, text_column)
    texts = write_shared(
        keyed.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"), F.first("text_sha256").alias("text_sha256"),
            F.first(F.octet_length("text")).cast("bigint").alias("n_bytes"), F.count(F.lit(1)).alias("copies"),
        )
    )

    def left_at(level: int):  # names left of a text after so many rounds
        return F.greatest(F.ceil(F.col("n_bytes") / F.lit(block_bytes * 2**level)), F.lit(1))

    total, longest = texts.agg(
        F.coalesce(F.sum(left_at(0) * F.col("copies")), F.lit(0)), F.coalesce(F.max(left_at(0)), F.lit(1))
    ).first()
    blocks = keyed.select("row", F.encode("text", "utf-8").alias("data"), F.octet_length("text").alias("n"))
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("n") / block_bytes), F.lit(1)) - 1)
    blocks = blocks.select("row", (F.ceil(F.col("n") / block_bytes) > 1).alias("more"), F.posexplode(cut_at(starts, block_bytes)).alias("at", "block"))
    names = write_shared(with_group(blocks, ["block"], total, names="name").select("row", "at", "more", "name"))
    done = [names.where(~F.col("more")).select("row", "name")]
    left, level = names.where("more").select("row", F.col("at").cast("bigint").alias("at"), "name"), 0
    while longest > 1:
        level, longest = level + 1, -(-longest // 2)
        odd = F.pmod("at", F.lit(2)) == 1
        pairs = left.groupBy("row", F.floor(F.col("at") / 2).alias("at")).agg(
            F.max(F.when(~odd, F.col("name"))).alias("first"),
            F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(0)).alias("second"),  # no name is 0
        )
        pairs = write_shared(pairs)
        named = with_group(pairs, ["first", "second"], pairs.count(), names="name")
        named = write_shared(named.select("row", "at", "name"))
        finished = named.groupBy("row").agg(F.max("at").alias("last")).where("last = 0").select("row")
        done.append(named.join(finished, "row", "left_semi").select("row", "name"))
        left = named.join(finished, "row", "left_anti")
    whole = done[0]
    for names in done[1:]:
        whole = whole.unionByName(names)
    return write_shared(texts.join(whole.distinct(), "row"))


def cut_at(starts, block_bytes: int):
    """The blocks of the column `data` that start at these block numbers."""
    return F.transform(
        starts, lambda at: F.substring(F.col("data"), (at * block_bytes + 1).cast("int"), F.lit(block_bytes))
    )


def duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of `documents`: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays; NULL ids lose to all others. Rows that repeat
    both id and text count as many times, and one of them stays. Other columns of `documents`, whatever
    their names, are not read. An empty table gives no rows.
    """
    texts = identities(documents, id_column, text_column, block_bytes)
    grouped = with_group(
        texts, ["n_bytes", "name"], texts.count(),
        F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"),
    )
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return grouped.select("doc_id", "keep_id", "group_size", "text_sha256", each).select(
        "doc_id", "keep_id", "group_size", stays.alias("kept"), "text_sha256"
    )
