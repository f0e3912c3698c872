"""Line dedup by an exact set-similarity join, in DataFrame operations only.

A line is the set of its words in lower case. It goes if an earlier line has a Jaccard similarity of
0.8 or more with it. Words are ordered by rarity; two similar sets share a word among the first
n - ceil(0.8 n) + 1 of each (prefix filter). Length, place of the shared word and a parity bitmap of the
words (64 bits, 256 for many words) bound the overlap, and what is left is verified on the words themselves. The filters know words by
their hash of 64 bits; a shared word is found by 32 of these, so that different words may cost a candidate.
Different lines are numbered in the order of their first places, and only these numbers travel through the joins.
The joins are by merge, and Spark is told so: it sizes a stored table as what it takes on disk, not as what it takes when broadcast.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.operators.shared_table import drop_shared, shuffles_removed, stored_tables, write_shared

from .bit_filter import maybe_in

TALLIES = 1 << 18
NO_ID = 9223372036854775807
PLACE = ["doc", "key", "line"]  # of a line: document, which of the rows with that id, number
PARITY = ["parity", "parity1", "parity2", "parity3"]  # 64 bits each: of all words, of those whose next bit of the hash is set, of those whose next two are 2 and 3
WIDE, WIDER = 40, 100  # words; from so many on 64 and 128 bits don't tell unlike sets apart; smaller sets have 0 for the others, which costs a shuffle little
BACK = 4  # how many sets before it a set may find its partner among in the first pass; the second pass has no limit


def _known(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """`documents` with _doc and _key, which tell unlike rows apart: id and hash of the whole text.

    Rows with a NULL id come after all others; they are stored with a number each, so that every one is itself.
    """
    doc = F.col(id_column).cast("bigint")
    named = documents.where(doc.isNotNull()).withColumns({"_doc": doc, "_key": F.xxhash64(F.col(text_column))})
    others = documents.where(doc.isNull()).withColumns({"_doc": F.lit(NO_ID), "_key": F.monotonically_increasing_id()})
    return named.union(write_shared(others))


def _texts(known: DataFrame, text_column: str) -> DataFrame:
    """(doc, key, line, text): every line."""
    lines = F.posexplode(F.split(F.col(text_column), "\n")).alias("line", "text")
    return known.select(F.col("_doc").alias("doc"), F.col("_key").alias("key"), lines)


def _words() -> Column:
    """The different words of `text` in lower case, cut at ASCII white space."""
    return F.array_remove(F.array_distinct(_cut()), "")


def _cut() -> Column:
    """The words of `text` with repeats; runs of white space leave empty ones."""
    small = F.lower("text")
    other = F.contains("text", F.lit("\t")) | F.contains("text", F.lit("\r")) | F.contains("text", F.lit("\f")) | F.contains("text", F.lit("\x0b"))
    return F.split(F.when(other, F.translate(small, "\t\x0b\f\r", "    ")).otherwise(small), " ")


def _same() -> Column:
    return F.md5(F.col("text").cast("binary"))


def _has_words() -> Column:
    """Said without the words, since a filter below them would cut every text twice."""
    return F.btrim("text", F.lit(" \t\x0b\f\r")) != ""


def _hashes() -> Column:
    """The different words of `text`, hashed, in order of their hashes."""
    every = F.array_distinct(F.transform(_cut(), lambda word: F.xxhash64(word)))
    return F.sort_array(F.array_remove(every, F.xxhash64(F.lit(""))))


def _tally(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(TALLIES - 1)).cast("int")


def _rarity(texts: DataFrame) -> Column:
    """One byte for each of TALLIES classes of words, by hash: how often they occur, in quarters of a power of two.

    Words that occur once mostly have 1. The table has a fixed size for any corpus, so it may pass the
    driver and go to all tasks. It only sets an order of words; a coarse one costs time, never results.
    """
    words = texts.select(F.explode(_cut()).alias("word"))
    counts = words.groupBy(_tally(F.xxhash64("word")).alias("at")).count()
    grade = F.least(F.floor(F.log2(F.col("count") + 0.0) * 4) + 1, F.lit(126)).cast("int")
    with shuffles_removed(texts.sparkSession):
        found = counts.select("at", grade.alias("grade")).toPandas()
    table = bytearray(b"\1" * TALLIES)
    for at, value in zip(found["at"].tolist(), found["grade"].tolist()):
        table[at] = value
    return F.lit(bytes(table))


def _sets(texts: DataFrame) -> DataFrame:
    """One stored row for each different line: set, same, doc, key, line (its first place), n, prefix, PARITY, ends.

    set: its number, larger for a later place. ends: hashes of the two words with the smallest hashes, and of the two with the largest.
    """
    grades = _rarity(texts)
    lines = texts.where(_has_words()).select(F.unhex(_same()).alias("same"), *PLACE, _hashes().alias("hashes"))
    lines = lines.withColumn("n", F.size("hashes"))

    def ranked(hashed: Column) -> Column:  # sorts by rarity, then by the upper bits of the hash
        grade = F.ascii(F.substring(grades, _tally(hashed) + 1, F.lit(1)).cast("string"))
        return F.shiftleft(grade.cast("bigint"), 56).bitwiseOR(F.shiftrightunsigned(hashed, 8))

    rarest = F.slice(F.sort_array(F.transform("hashes", ranked)), F.lit(1), F.col("n") - _least_common(F.col("n"), F.col("n"), 4, 5) + 1)
    prefix = F.transform(rarest, lambda code: (code.bitwiseAND(F.lit((1 << 32) - 1)) - (1 << 31)).cast("int"))
    bit = lambda total, value: total.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), value.bitwiseAND(F.lit(63)).cast("int")))
    parity = [F.aggregate("hashes", F.lit(0).cast("bigint"), bit).alias("parity")]
    for name, least, bits, value in zip(PARITY[1:], (WIDE, WIDER, WIDER), (1, 3, 3), (1, 2, 3)):
        mine = F.filter("hashes", lambda hashed: F.shiftright(hashed, 6).bitwiseAND(F.lit(bits)) == value)  # noqa: B023
        parity.append(F.when(F.col("n") > least, F.aggregate(mine, F.lit(0).cast("bigint"), bit)).otherwise(F.lit(0).cast("bigint")).alias(name))
    ends = [F.hash(*[F.get("hashes", at) for at in pair]) for pair in ((F.lit(0), F.lit(1)), (F.col("n") - 1, F.col("n") - 2))]
    coded = lines.select("same", *PLACE, "n", prefix.alias("prefix"), *parity, F.array(*ends).alias("ends"))
    first = F.min(F.struct(*PLACE)).alias("first")
    sets = coded.groupBy("same").agg(first, *[F.first(name).alias(name) for name in ("n", "prefix", *PARITY, "ends")])
    ordered = sets.select("same", "first.*", "n", "prefix", *PARITY, "ends").repartitionByRange(*PLACE).sortWithinPartitions(*PLACE)
    return write_shared(ordered.withColumn("set", F.monotonically_increasing_id()))


def _least_common(n: Column, m: Column, of: int = 4, among: int = 9) -> Column:
    """Words two sets of n and m words have in common at least if their similarity is 0.8: ceil(4 (n + m) / 9)."""
    total = (n + m) * of if among == 9 else n * of
    return F.floor((total + (among - 1)) / among).cast("int")


def _differ_at_most(n: Column, m: Column) -> Column:
    return n + m - 2 * _least_common(n, m)


def _pair(first: Column, second: Column) -> Column:
    """Two integers, none negative, in one."""
    return F.coalesce(F.shiftleft(first.cast("bigint"), 32).bitwiseOR(second.cast("bigint")), F.lit(0).cast("bigint"))


def _first(name: str) -> Column:
    return F.shiftright(name, 32).cast("int")


def _second(name: str) -> Column:
    return F.col(name).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def _bits_apart(one: str, other: str, n: Column, m: Column) -> Column:
    """Places in which the parities of two sets differ, by the widest parity that both have.

    A word in one set only flips one bit of a parity, so there are no more of these than words in one set only.
    That also holds for the two parts of the words that `parity1` makes, and for the four of all parities, in which fewer words share a bit.
    """
    every, odd, two, three = [F.col(f"{one}.{name}").bitwiseXOR(F.col(f"{other}.{name}")) for name in PARITY]
    halves = [odd, every.bitwiseXOR(odd)]
    quarters = [three, odd.bitwiseXOR(three), two, every.bitwiseXOR(odd).bitwiseXOR(two)]
    size = F.least(n, m)
    apart = [reduce(Column.__add__, map(F.bit_count, parts)) for parts in ([every], halves, quarters)]
    return F.when(size <= WIDE, apart[0]).when(size <= WIDER, apart[1]).otherwise(apart[2])


def _similar_pairs(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (set, to) that hold on the words themselves; fetches only lines that occur in them."""
    pairs = write_shared(pairs.distinct())
    ends = pairs.select("set").union(pairs.select(F.col("to").alias("set"))).distinct()
    places = write_shared(sets.select("set", *PLACE).join(ends.hint("merge"), "set", "left_semi"))
    place = F.struct(*PLACE)
    texts = texts.where(_has_words() & maybe_in(places.select(place.alias("place")), place)).join(places.hint("merge"), PLACE).dropDuplicates(["set"])
    words = write_shared(texts.select("set", F.array_join(_words(), " ").alias("words")))  # one string is smaller than a list
    to = words.select(F.col("set").alias("to"), F.col("words").alias("to_words"))
    one, other = F.split("words", " "), F.split("to_words", " ")
    near = F.size(F.array_intersect(one, other)) * 9 >= (F.size(one) + F.size(other)) * 4
    return pairs.join(words.hint("merge"), "set").join(to.hint("merge"), "to").where(near)


def repeated_sets(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All sets, and the numbers (set) of those that have a similar earlier set.

    First every set is compared with others among sets that share a key: its smallest prefix code by hash,
    and the words at either end of the order of hashes, which rare words seldom move. The
    others are those of the BACK sets before it and the first of all whose parity allows it.
    That settles most of a large group of near copies, each by a few partners. Sets still unsettled
    are then joined with all sets on the codes of the prefix.
    """
    sets = _sets(texts)

    def smallest(seed: int) -> Column:
        return F.array_min(F.transform("prefix", lambda value: F.xxhash64(value, F.lit(seed))))

    keys = F.array(*[smallest(seed) for seed in range(1)], *[F.xxhash64(F.lit(at), F.get("ends", F.lit(at))) for at in range(2)])
    narrow = sets.select("set", "n", *PARITY, F.explode(keys).alias("met"))
    order = Window.partitionBy("met").orderBy("set")
    this = F.struct("set", "n", *PARITY)
    others = {f"other{back}": F.lag(this, back).over(order) for back in range(1, BACK + 1)}
    others["other0"] = F.when(F.row_number().over(order) > 1, F.first(this).over(order))

    def allowed(other: str) -> Column:
        n, m = F.col("n"), F.col(f"{other}.n")
        near = _bits_apart("this", other, n, m) <= _differ_at_most(n, m)
        return F.when((n >= m * 0.8) & (m >= n * 0.8) & near, F.col(f"{other}.set"))

    found = [allowed(other).alias(f"to_{other}") for other in others]
    tried = narrow.withColumns(others).withColumn("this", this).select("set", *found)
    named = [F.col(f"to_{other}") for other in others]
    tried = tried.where(F.coalesce(*named).isNotNull())  # few rows are left to be spread out
    tried = tried.select("set", F.explode(F.array(*named)).alias("to")).where("to is not null")
    with stored_tables() as scope:  # the pairs and words looked at go when this is known
        settled = scope.keep(write_shared(_similar_pairs(tried, sets, texts).select("set").distinct()))

    marked = sets.select("set", "n", "prefix", *PARITY).join(settled.withColumn("settled", F.lit(True)).hint("merge"), "set", "left")
    # A settled set seeks no partner. Numbers of 32 bits share a column, which halves what is shuffled. No column
    # is nullable and no condition is on one side alone, so nothing is pushed below and both sides are one exchange.
    rows = marked.select(
        *[F.coalesce(name, F.lit(0)).alias(name) for name in ("set", *PARITY)], "n",
        F.coalesce("settled", F.lit(False)).cast("int").alias("settled"), F.posexplode("prefix").alias("at", "code"),
    )
    rows = rows.select(
        "set", *PARITY, _pair(F.col("n"), F.col("at") * 2 + F.col("settled")).alias("n_at"), F.coalesce("code", F.lit(0)).alias("code"),
    )
    x, y = rows.alias("x"), rows.alias("y")
    n, at, is_settled = _first("x.n_at"), F.shiftright(_second("x.n_at"), 1), _second("x.n_at") % 2
    m, to_at = _first("y.n_at"), F.shiftright(_second("y.n_at"), 1)
    reach = F.least(n - at, m - to_at)  # common words from this one on
    before = F.when(is_settled == 0, F.col("x.set")).otherwise(F.lit(-1).cast("bigint"))
    found = x.join(
        y.hint("merge"),
        (F.col("x.code") == F.col("y.code")) & (F.col("y.set") < before) & (n >= m * 0.8) & (m >= n * 0.8)
        & (reach >= _least_common(n, m)) & (_bits_apart("x", "y", n, m) <= _differ_at_most(n, m)),
    )
    found = found.select("x.set", F.col("y.set").alias("to"))
    with stored_tables() as scope:
        more = _similar_pairs(found, sets, texts).select("set").distinct()
        return sets, scope.keep(write_shared(settled.union(more)))


def repeated_lines(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, line): every line with a similar earlier one, `line` counting from 0.

    Earlier is by id, then by line; NULL ids come last, each row a document of its own. Any earlier line counts, whether it stays or not.
    Lines without words never go, nor do NULL and empty texts have any. Rows that repeat an id
    are ordered by a hash of their texts; equal ones are one document. Other columns are not read; an empty table gives no rows.
    """
    gone = _gone(_known(documents, id_column, text_column), text_column)
    return gone.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "line").distinct()


def _gone(known: DataFrame, text_column: str) -> DataFrame:
    """Places (doc, key, line) of the lines that go; rows that are equal may repeat one."""
    texts = _texts(known, text_column)
    sets, gone = repeated_sets(texts)
    firsts = sets.select("set", "same", *[F.col(name).alias(f"first_{name}") for name in PLACE])
    firsts = write_shared(firsts.join(gone.withColumn("gone", F.lit(True)).hint("merge"), "set", "left").drop("set"))
    drop_shared(sets)
    again = texts.select(*PLACE, F.unhex(_same()).alias("same")).join(firsts.hint("merge"), "same")
    return again.where("gone or doc <> first_doc or key <> first_key or line <> first_line").select(*PLACE)


def without_repeated_lines(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`documents` without those lines; a text that loses all of them is empty, and every row stays."""
    known = _known(documents, id_column, text_column)
    gone = _gone(known, text_column).groupBy(F.col("doc").alias("_d"), F.col("key").alias("_k")).agg(F.collect_set("line").alias("_gone"))
    gone = write_shared(gone)
    rows = known.join(gone.hint("merge"), (F.col("_doc") == F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    stay = F.filter(F.split(F.col(text_column), "\n"), lambda line, at: ~F.array_contains("_gone", at))
    text = F.when(F.col("_gone").isNull(), F.col(text_column)).otherwise(F.array_join(stay, "\n"))
    return rows.withColumn(text_column, text).select(*[F.col(f"`{name}`") for name in documents.columns])
