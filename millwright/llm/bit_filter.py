"""A filter of fixed size that keeps all rows whose key is in a set, and few others."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 17


def maybe_in(keys: DataFrame, key: Column, words: int = WORDS) -> Column:
    """True wherever `key` equals one of `keys` (one column), and by chance elsewhere.

    The set is hashed into 64 * `words` bits, one megabyte, whatever the number of keys. So it may go to
    all tasks. A join must follow for the exact answer; the filter only spares it the other rows.
    """
    bits = 64 * words
    at = F.pmod(F.xxhash64(F.col(keys.columns[0])), F.lit(bits))
    found = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")
    )
    every = keys.sparkSession.range(words).withColumnRenamed("id", "word").join(found, "word", "left")
    pair = F.struct("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
    table = every.agg(F.sort_array(F.collect_list(pair)).alias("all")).select(F.col("all.bits")).scalar()
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    word = F.get(table, F.floor(place / 64).cast("int"))
    return F.getbit(word, (place % 64).cast("int")) == 1
