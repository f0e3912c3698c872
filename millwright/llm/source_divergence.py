"""How the terms of each source diverge from those of its language and of the language's other sources.

CountVectorizer makes a sparse vector of exact counts of each document. Its terms carry their language, so one fit
keeps for every language the terms in enough of that language's documents. Sums of the vectors by source stay sparse. Sources are
compared in blocks: a task sees all counts of some terms in two blocks of sources, and adds up the differences of all pairs.
"""

import math
import uuid
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.operators.shared_table import shared_folder, write_shared

MIN_DOCUMENTS = 30
ADDED = 5  # to every count
SCALE = 10**9
TOP_TERMS = 50
MOST_TERMS = 2_000_000  # that one model holds, about, on the driver and in every executor
LOOKED_AT = 64
BLOCK = 512  # sources compared at once
_PARTS = 64  # of the terms of a language, in the comparison of two blocks
_CELLS = 1 << 19  # numbers in a dense block
_VOCABULARY_SIZE = 2**31 - 1

_BYTES = np.arange(256, dtype=np.uint8)
_IN_TERM = (_BYTES >= 128) | ((_BYTES | 32) - 97 < 26)  # letters, and all bytes of other characters
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


def cut_terms(texts: pa.StringArray, prefixes: pa.StringArray) -> pa.ListArray:
    """The terms of each text, each behind its row's prefix and a zero byte, which no term has.

    A term is a run of A-Z, a-z and characters beyond ASCII; only A-Z are lower-cased. Works on the bytes of all texts at once.
    """
    texts, prefixes = texts.cast(pa.large_string()), prefixes.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[bounds[0] : bounds[-1]] if buffer else np.empty(0, np.uint8)
    bounds = bounds - bounds[0]
    within = _IN_TERM[data]
    begins = within.copy()
    begins[1:] &= ~within[:-1]
    row_begins = bounds[:-1][bounds[:-1] < len(data)]
    begins[row_begins] = within[row_begins]
    starts = np.flatnonzero(begins)
    order = np.cumsum(within)  # bytes of terms up to and with each byte
    first = order[starts] - 1 if len(starts) else np.empty(0, np.int64)
    body = _LOWER[data[within]]
    sizes = np.diff(np.append(first, len(body)))
    upto = np.searchsorted(starts, bounds)  # terms before each row
    row = np.repeat(np.arange(len(texts)), np.diff(upto))

    kinds, which = np.unique(np.array([f"{p}\0".encode() for p in prefixes.to_pylist()], dtype=object), return_inverse=True)
    lengths = np.array([len(kind) for kind in kinds], np.int64)
    before = lengths[which[row]]
    offsets = np.concatenate(([0], np.cumsum(sizes + before)))
    whole = np.empty(offsets[-1], np.uint8)
    whole[np.arange(len(body)) + np.repeat(np.cumsum(before), sizes)] = body
    for kind, prefix in enumerate(kinds):
        mine = offsets[:-1][which[row] == kind]
        for at, byte in enumerate(prefix):
            whole[mine + at] = byte
    terms = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(whole))
    return pa.LargeListArray.from_arrays(upto.astype(np.int64), terms).cast(pa.list_(pa.string()))


def term_lists(documents: DataFrame) -> DataFrame:
    """(lang, source, terms) of every document; NULL in any column counts as empty."""
    rows = documents.select(*[F.coalesce(F.col(name), F.lit("")).alias(name) for name in ("lang", "source", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                terms = cut_terms(part.column("text"), part.column("lang"))
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("source"), terms], ["lang", "source", "terms"])

    return rows.mapInArrow(run, "lang string, source string, terms array<string>")


def terms_by_source(documents: DataFrame) -> DataFrame:
    """(source, terms) with the same terms, but those of documents of one source next to each other as one list.

    Counts of sources are sums over documents, so a vector of many documents does for them, and there are far fewer cells.
    """
    rows = documents.select(*[F.coalesce(F.col(name), F.lit("")).alias(name) for name in ("lang", "source", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = pc.sort_indices(batch.column("source"))
            for at in range(0, batch.num_rows, 500):
                part = batch.take(order[at : at + 500])
                terms, sources = cut_terms(part.column("text"), part.column("lang")), part.column("source")
                ends = np.flatnonzero(np.append(pc.not_equal(sources[1:], sources[:-1]).to_numpy(zero_copy_only=False), True)) + 1
                bounds = pa.array(np.append(0, ends), pa.int32())
                lists = pa.ListArray.from_arrays(terms.offsets.take(bounds), terms.values)
                yield pa.RecordBatch.from_arrays([sources.take(bounds[:-1]), lists], ["source", "terms"])

    return rows.mapInArrow(run, "source string, terms array<string>")


def _slices(documents: DataFrame, min_documents: int, most_terms: int) -> int:
    """How many models the kept terms need, from every LOOKED_AT-th document; it decides about memory, never about results.

    A term in `min_documents` documents is in one of those with a chance of 1 - (1 - 1 / LOOKED_AT) ** min_documents at least, so
    the different terms found there, over this chance, are about as many as the kept ones, or more.
    """
    some = documents.where(F.pmod(F.monotonically_increasing_id(), F.lit(LOOKED_AT)) == 0)
    found = term_lists(some).select(F.explode("terms").alias("term")).agg(F.approx_count_distinct("term")).first()[0]
    chance = 1 - (1 - 1 / LOOKED_AT) ** min_documents
    return max(1, math.ceil(found / chance / most_terms))


def counts(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, most_terms: int = MOST_TERMS) -> tuple[DataFrame, DataFrame]:
    """The kept terms (term_id, lang, term), and the counts above 0 (source, term_id, n), both stored.

    A language keeps the terms in at least `min_documents` of its documents. The terms are dealt by hash to as many models as
    it takes for none to hold more than about `most_terms`; any number gives the same counts.
    """
    spark = documents.sparkSession
    lists, by_source = term_lists(documents), terms_by_source(documents)
    slices = _slices(documents, min_documents, most_terms)
    kept, summed = [], []
    for number in range(slices):
        mine, of_sources = lists, by_source
        if slices > 1:
            dealt = F.filter("terms", lambda t: F.pmod(F.xxhash64(t), F.lit(slices)) == number)  # noqa: B023
            mine, of_sources = (table.withColumn("terms", dealt) for table in (lists, by_source))
        # as many rows with a term that no text has, so that there is something to keep
        filler = spark.range(min_documents).select(F.array(F.lit("")).alias("terms"))
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_documents), vocabSize=_VOCABULARY_SIZE).fit(
            mine.select("terms").unionByName(filler)
        )
        path = f"{shared_folder(spark).rstrip('/')}/millwright-{uuid.uuid4().hex}"
        model.write().save(path)
        words = spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("at", "word")).where("word <> ''")
        term_id = (F.col("at") + (number << 32)).alias("term_id")
        size = F.length("word") - F.locate("\0", F.reverse("word"))  # a language may hold a zero character, a term can't
        lang, term = F.substring("word", F.lit(1), size), F.substring("word", size + 2, F.length("word"))
        kept.append(words.select(term_id, lang.alias("lang"), term.alias("term")))
        vector = F.unwrap_udt("vector")
        cells = model.transform(of_sources).select("source", vector.alias("v")).select("source", F.inline(F.arrays_zip("v.indices", "v.values")))
        cells = cells.groupBy("source", "indices").agg(F.sum(F.col("values").cast("bigint")).alias("n"))
        summed.append(write_shared(cells.select("source", (F.col("indices") + F.lit(number << 32)).alias("term_id"), "n")))
    return write_shared(reduce(DataFrame.unionByName, kept)), reduce(DataFrame.unionByName, summed)


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + ADDED) / (total + ADDED * terms)), in whole numbers."""
    top = (n + ADDED).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    whole = F.call_function("div", top, (total + ADDED * terms).cast("decimal(20,0)"))
    return whole + 1


def audit(
    documents: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS, most_terms: int = MOST_TERMS, block: int = BLOCK,
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group of lang and source, also of documents without terms.

    Each kept term of a language has in a group, and in the language, the smoothed share of `_share`. Part `pair`: item is each other
    source of the language, value the sum over its kept terms of the differences of both shares (0 without terms). Part `term`: item is
    a term the group has, and more often by share than the language, value the difference; the first `top_terms`. rank counts from 1 by
    value, largest first, then by item. NULL lang, source and text count as empty. An empty table gives no rows.
    """
    terms, cells = counts(documents, min_documents, most_terms)
    names = [F.coalesce(F.col(name), F.lit("")).alias(name) for name in ("lang", "source")]
    found = write_shared(documents.select(*names).distinct())
    sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    cells = write_shared(cells.join(terms.select("term_id", "lang"), "term_id"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("number")
    groups = found.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["terms", "total"])
    group_share = _share(F.col("n"), F.col("total"), F.col("terms"))
    least = F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.col("terms")))
    groups = groups.select("*", number, least.alias("least"))  # the share of terms that the group lacks
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count(F.lit(1)).alias("sources"))
    langs = langs.withColumn("lang_number", F.row_number().over(Window.orderBy("lang")) - 1)
    groups = write_shared(groups.join(langs, "lang"))
    shares = write_shared(cells.join(groups, ["lang", "source"]).select(*cells.columns, "number", "lang_number", "terms", "lang_total", "sources", group_share.alias("p")))
    return _pairs(groups, shares, block).unionByName(_terms(shares, terms, top_terms))


def _terms(shares: DataFrame, terms: DataFrame, top_terms: int) -> DataFrame:
    of_lang = shares.groupBy("term_id").agg(F.sum("n").alias("n"), F.first("lang_total").alias("total"), F.first("terms").alias("terms"))
    of_lang = of_lang.select("term_id", _share(F.col("n"), F.col("total"), F.col("terms")).alias("q"))
    over = shares.join(of_lang, "term_id").where("p > q").select("lang", "source", "term_id", (F.col("p") - F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    first = over.withColumn("at", F.rank().over(by_value)).where(F.col("at") <= top_terms)  # with all that tie for the last place
    named = first.join(terms.select("term_id", F.col("term").alias("item")), "term_id")
    return _ranked(named, "term").where(F.col("rank") <= top_terms)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _pairs(groups: DataFrame, shares: DataFrame, block: int) -> DataFrame:
    """Differences of all pairs of sources of a language.

    A count goes to every pair of blocks that its source's block is in, once if a language has `block` sources or fewer.
    """
    number, blocks = F.col("number"), F.ceil(F.col("sources") / block)
    mine = F.floor(number / block)
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), (blocks - 1).cast("bigint"))).alias("other")
    every = F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))).alias("part")
    least = groups.where("terms > 0").select("lang_number", "number", mine.alias("mine"), other, F.lit(-1).cast("bigint").alias("term_id"), F.col("least").alias("p"))
    least = least.select("*", every)
    part = F.pmod(F.xxhash64("term_id"), F.lit(_PARTS)).cast("int").alias("part")
    seen = shares.select("lang_number", "number", mine.alias("mine"), other, "term_id", "p").select("*", part)
    rows = seen.unionByName(least).select(
        F.col("lang_number").cast("bigint"), F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "part",
        "term_id", F.col("number").cast("bigint"), "p",
    )
    dealt = rows.repartition("lang_number", "low", "high", "part").sortWithinPartitions("lang_number", "low", "high", "part", "term_id")
    sums = dealt.mapInArrow(partial(_differences, block=block), "lang_number bigint, a bigint, b bigint, seen bigint, value bigint")
    sums = sums.groupBy("lang_number", "a", "b").agg(F.sum("seen").alias("seen"), F.sum("value").alias("value"))

    one = groups.select("lang_number", "lang", "terms", F.col("number").alias("a"), "source", F.col("least").alias("least_a"))
    two = groups.select("lang_number", F.col("number").alias("b"), F.col("source").alias("item"), F.col("least").alias("least_b"))
    pairs = one.join(two, "lang_number").where("a < b").join(sums, ["lang_number", "a", "b"], "left")
    rest = (F.col("terms") - F.coalesce("seen", F.lit(0))) * F.abs(F.col("least_a") - F.col("least_b"))
    pairs = pairs.withColumn("value", F.coalesce("value", F.lit(0)) + F.coalesce(rest, F.lit(0)))
    both = F.inline(F.array(
        F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))
    ))
    return _ranked(pairs.select("lang", "value", both), "pair")


def _differences(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Sums over the terms of each run of rows of one (lang_number, low, high, part); the rows of term -1 are shares of terms a source lacks."""
    names = ["lang_number", "low", "high", "part", "term_id", "number", "p"]
    held, sums = np.empty((7, 0), np.int64), None
    for batch in batches:
        rows = np.array([batch.column(name).to_numpy(zero_copy_only=False) for name in names], np.int64).reshape(7, -1)
        rows = np.concatenate((held, rows), 1)
        changes = np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(0)) + 1
        bounds = [0, *changes.tolist(), rows.shape[1]]
        for start, end in zip(bounds, bounds[1:]):
            run = rows[:, start:end]
            if sums is None:
                sums = _Sums(*run[:3, 0])
            if end < rows.shape[1]:
                sums.add(run[4:])
                yield sums.result(block)
                sums, held = None, rows[:, end:]
            else:  # the last term may go on in the next batch
                whole = np.searchsorted(run[4], run[4, -1]) if run.shape[1] else 0
                sums.add(run[4:, :whole])
                held = run[:, whole:]
    if sums is not None:
        sums.add(held[4:])
        yield sums.result(block)


class _Sums:
    """Differences of the sources of two blocks, added up term by term."""

    def __init__(self, lang_number: int, low: int, high: int) -> None:
        self.lang_number, self.same = lang_number, low == high
        self.least: dict[int, int] = {}
        self.total = None
        self.seen = 0

    def _begin(self) -> None:
        self.numbers = np.array(sorted(self.least), np.int64)
        self.start = np.array([self.least[n] for n in self.numbers.tolist()], np.int64)
        self.total = np.zeros((len(self.numbers),) * 2, np.int64)

    def add(self, rows: np.ndarray) -> None:
        terms, numbers, shares = rows
        lacking = int(np.searchsorted(terms, 0))
        self.least.update(zip(numbers[:lacking].tolist(), shares[:lacking].tolist()))
        terms, numbers, shares = terms[lacking:], numbers[lacking:], shares[lacking:]
        if not len(terms):
            return
        if self.total is None:
            self._begin()
        column = np.cumsum(np.append(0, terms[1:] != terms[:-1]))
        row = np.searchsorted(self.numbers, numbers)
        width = max(1, _CELLS // len(self.numbers))
        for at in range(0, int(column[-1]) + 1, width):
            low, high = np.searchsorted(column, (at, at + width))
            count = int(column[high - 1]) + 1 - at
            dense = np.repeat(self.start[:, None], count, 1)
            dense[row[low:high], column[low:high] - at] = shares[low:high]
            for a in range(len(dense) - 1):
                self.total[a, a + 1 :] += np.abs(dense[a + 1 :] - dense[a]).sum(1)
            self.seen += count

    def result(self, block: int) -> pa.RecordBatch:
        if self.total is None:
            self._begin()
        a, b = np.triu_indices(len(self.numbers), 1)
        values = [np.full(len(a), self.lang_number), self.numbers[a], self.numbers[b], np.full(len(a), self.seen), self.total[a, b]]
        if not self.same:  # pairs within a block have a block pair of their own
            keep = self.numbers[a] // block != self.numbers[b] // block
            values = [value[keep] for value in values]
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], ["lang_number", "a", "b", "seen", "value"])
