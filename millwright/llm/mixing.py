"""Mixing sources to target weights by Poisson replication.

The repetition rate of a source is its target share of all characters over its share now. Each document
is repeated as often as a Poisson variable of that mean says, found by inverting the distribution at a
number hashed from the seed and the document id. So the mix has the size of the input and the target
weights on average, and every run draws the same.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.operators.lookup import lookup

MOST_MEAN = 8.0  # larger means are sums of equal parts
TERMS = 72  # a variable of mean 8 exceeds this with a chance below 1e-40, while draws are multiples of 2 ** -52


def uniform(*parts: Column) -> Column:
    """A number from 0 to 1 (exclusive) from the MD5 of the parts."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 52))


def rates(documents: DataFrame, targets: dict[str, float] | None = None, power: float = 0.5, source_column: str = "source", text_column: str = "text") -> DataFrame:
    """(_source_key, rate): mean repetitions of the documents of each source.

    A document counts its characters and one more. `targets` has the weight of each source; a source that
    isn't named gets none. Without `targets` a source's weight is its size to `power`: 1 leaves the mix as it is,
    0 makes all sources equal. NULL is a source of its own, named None in `targets`.
    """
    size = F.sum(F.length(F.coalesce(F.col(text_column), F.lit(""))) + 1)
    sizes = documents.groupBy(_key(F.col(source_column)).alias("_source_key")).agg(size.alias("size"))
    if targets is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(power)))
    else:
        spark = documents.sparkSession
        named = [("null" if name is None else f"s:{name}", float(weight)) for name, weight in targets.items()]
        weighed = sizes.join(F.broadcast(spark.createDataFrame(named, "_source_key string, weight double")), "_source_key")
    total = weighed.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight"))  # one row
    share = F.col("weight") / total.select("weight").scalar()
    return weighed.select("_source_key", (share * total.select("size").scalar() / F.col("size")).alias("rate"))


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s:"), source), F.lit("null"))


def _steps(mean: Column) -> Column:
    """The distribution function of a Poisson variable at 0, 1, 2, ..."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("upto"))

    def more(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(state["upto"], F.array(F.element_at(state["upto"], -1) + p)).alias("upto"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, more, lambda state: state["upto"])


def mix(
    documents: DataFrame, targets: dict[str, float] | None = None, power: float = 0.5, seed: int = 0,
    id_column: str = "doc_id", source_column: str = "source", text_column: str = "text",
) -> DataFrame:
    """The rows of `documents`, each as often as drawn, in random order; adds `copy` (from 1) and `shuffle_key`.

    Rows are ordered by `shuffle_key`, an MD5 of seed, id and copy, over range partitions: the order over
    all of the result. Rows that repeat an id are drawn alike and share their keys, in no fixed order among
    themselves; NULL ids count as one id. Input columns named like
    the two new ones are replaced. An empty table gives no rows.
    """
    marks = ("copy", "shuffle_key", "_source_key", "_parts", "_steps", "_times")
    kept = [name for name in documents.columns if name not in marks]
    found = rates(documents, targets, power, source_column, text_column).where("rate > 0")
    parts = F.greatest(F.ceil(F.col("rate") / MOST_MEAN), F.lit(1)).cast("int")
    found = found.select("_source_key", parts.alias("_parts"), _steps(F.col("rate") / parts).alias("_steps"))
    rows = documents.select(*[F.col(f"`{name}`") for name in kept], _key(F.col(source_column)).alias("_source_key"))
    rows = lookup(rows, found, ["_source_key"], spread=[id_column])
    key = F.coalesce(F.col(id_column).cast("string"), F.lit("null"))

    def drawn(part: Column) -> Column:
        value = uniform(F.lit(str(seed)), key, part.cast("string"))
        return F.size(F.filter("_steps", lambda upto: upto <= value))

    times = F.aggregate(F.sequence(F.lit(1), F.col("_parts")), F.lit(0), lambda total, part: total + drawn(part))
    rows = rows.withColumn("_times", times).where("_times > 0")
    rows = rows.select(*[F.col(f"`{name}`") for name in kept], F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("copy"))
    order = F.md5(F.concat_ws(":", F.lit(f"order {seed}"), key, F.col("copy").cast("string")).cast("binary"))
    rows = rows.withColumn("shuffle_key", order)
    spread = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(spread, "shuffle_key").sortWithinPartitions("shuffle_key")
