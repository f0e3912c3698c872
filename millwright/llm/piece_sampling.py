"""SentencePiece encoding by sampling from the lattice of pieces, and decoding.

Forward filtering: for every position of a word, the summed weight of all segmentations up to it.
Backward sampling: from the end, a piece is drawn with its share of that sum, and so on to the start.
Draws come from a hash of the row key and the position, so a row always gets the same segmentation.
No piece spans the start of a run of spaces, so words are lattices of their own, and the lattice of a
word is built once for all of its occurrences; all draws of a batch advance together.
"""

import math
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
MOST_STATES = 500_000
BATCH_CHARS = 250_000  # encoded at once, and in one batch of a result; a longer text is one by itself
_CODES = 1 << 21  # characters spelled in bytes have negative codes
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class _Reach(dict):
    """The longest end of the characters read so far that some piece begins with; the entry of a character is the reach after it.

    `found` are the pieces the text ends in, the shortest first, as (weight, edge without its start, length). Entries are made when first met.
    """

    __slots__ = ("text", "begun", "weights", "found")

    def __init__(self, text: str, begun: "dict[str, _Reach | None]", weights: dict[str, tuple[float, int]]) -> None:
        self.text, self.begun, self.weights = text, begun, weights
        ends = [text[at:] for at in range(len(text) - 1, -1, -1)]
        self.found = [(weights[end][0], (weights[end][1] + _CODES) << 37 | len(end) << 32, len(end)) for end in ends if end in weights]

    def __missing__(self, char: str) -> "_Reach":
        text = self.text + char
        while text not in self.begun:
            text = text[1:]
        reach = self.begun[text]
        if reach is None:
            reach = self.begun[text] = _Reach(text, self.begun, self.weights)
        self[char] = reach
        return reach


class Pieces:
    """A vocabulary with a weight for each piece, and the lattices of words seen so far.

    A piece of a rank-scored vocabulary (score = -rank) weighs (rank + 2) ** -sharpness, like Zipf's law
    for its frequency. A character that is no piece is spelled with byte pieces, at less weight than any.
    """

    def __init__(self, path: str, sharpness: float = 1.0) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        assert len(self.bytes) == 256, "the vocabulary must have all byte pieces"
        texts = {i: model.id_to_piece(i).replace(SPACE, " ") for i in plain}
        self.weights = {text: ((2 - model.get_score(i)) ** -sharpness, i) for i, text in texts.items()}
        self.longest = max(map(len, self.weights))
        assert self.longest < 32, "an edge has five bits for its length"
        begun: dict[str, _Reach | None] = {text[:upto]: None for text in self.weights for upto in range(len(text) + 1)}
        self.nothing = begun[""] = _Reach("", begun, self.weights)
        self.rare = min(weight for weight, _ in self.weights.values()) / math.e
        spelled = [b""] * len(ids)
        for i, text in texts.items():
            spelled[i] = text.encode()
        for byte, i in self.bytes.items():
            spelled[i] = bytes([byte])
        self.spelled_length = np.array([len(text) for text in spelled], np.int64)
        self.spelled_start = np.cumsum(self.spelled_length) - self.spelled_length
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        alone = "" if any("\n" in text for text in self.weights) else "\n"  # in no piece: a word of its own
        self.word = re.compile(f" *[^ {alone}]+| +" + (f"|{alone}" if alone else ""))
        self.clear()

    def clear(self) -> None:
        self.ends: dict[str, int] = {}
        self.states = 0  # number of the last state; 0 is the start of every word
        self.sums, self.parent = array("d", [1.0]), array("q", [0])
        self.last, self.scale = array("q", [-1]), array("d", [0.0])  # of a state: its last edge, and what makes its sum 2 ** 32 - 1
        self.upto, self.edges = array("d"), array("q")

    def build(self, word: str) -> int:
        """The state of the end of a word that is not known yet.

        Words with a common beginning share its states. A beginning too unlikely for a float is continued
        in states of its own, in which only the ratios count.
        """
        known = len(word) - 1
        while known and word[:known] not in self.ends:
            known -= 1
        state = self.ends[word[:known]] if known else 0
        reach = self.nothing
        for char in word[:known]:
            reach = reach[char]
        sums, states = [self.sums[state]], [state]
        for _ in reach.text:  # the way back, as far as a piece can begin
            state = self.parent[state]
            sums.append(self.sums[state])
            states.append(state)
        sums.reverse()
        states.reverse()
        shared = True
        longest, add_sum, add_edge = self.longest, self.upto.append, self.edges.append
        for end in range(known + 1, len(word) + 1):
            reach = reach[word[end - 1]]
            total = 0.0
            found = reach.found
            for weight, edge, back in found:
                total += sums[-back] * weight
                add_sum(total)
                add_edge(edge | states[-back])
            if not found or found[0][2] > 1:  # the last character is no piece
                total += sums[-1] * self.rare ** len(word[end - 1].encode())
                add_sum(total)
                add_edge((_CODES - ord(word[end - 1]) - 1) << 37 | 1 << 32 | states[-1])
            self.states += 1
            state = self.states
            self.last.append(len(self.edges) - 1)
            self.scale.append(4294967295 / total)
            self.parent.append(states[-1])
            if total < 1e-200:
                shared = False
                sums = [value * 1e200 for value in sums[-longest:]]
                total *= 1e200
            sums.append(total)
            states.append(state)
            self.sums.append(total)
            if shared and end < len(word):
                self.ends[word[:end]] = state
        if shared:
            self.ends[word] = state
        return state

    def encode(self, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has."""
        if self.states > MOST_STATES:
            self.clear()
        words, number, size = [], [], []
        for text in texts:
            found = self.word.findall(" " + text)  # every word begins with a space, the first as well
            words += found
            number.append(len(found))
            size.append(len(text) + 1)
        state = list(map(self.ends.get, words))
        if None in state:
            private: dict[str, int] = {}  # words too unlikely to be kept, or known since
            for at, word in enumerate(words):
                if state[at] is None:
                    end = self.ends.get(word) or private.get(word)
                    if end is None:
                        end = private[word] = self.build(word)
                    state[at] = end
        sizes = np.array(size, np.int64)
        starts = np.cumsum(sizes) - sizes
        offset = int(sizes.sum())
        chosen = np.zeros(offset + 1, np.int32)
        taken = np.zeros(offset + 1, bool)
        # these are gone before the next word is built
        edges, last = np.frombuffer(self.edges, np.int64), np.frombuffer(self.last, np.int64)
        upto, scale = np.frombuffer(self.upto), np.frombuffer(self.scale)
        now, position = np.array(state, np.int64), np.fromiter(map(len, words), np.int64, len(words)).cumsum()
        owner = np.arange(len(texts)).repeat(number)
        with np.errstate(over="ignore"):
            while len(now):
                mixed = seeds[owner] + (position - starts[owner]).astype(np.uint64) * _GOLDEN
                mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                draw = (mixed >> np.uint64(32)).astype(np.int64)
                at, top, unit = last[now - 1] + 1, last[now], scale[now]
                under = np.flatnonzero(at < top)
                while len(under):  # a state has few edges
                    under = under[(upto[at[under]] * unit[under]).astype(np.int64) < draw[under]]
                    at[under] += 1
                    under = under[at[under] < top[under]]
                edge = edges[at]
                chosen[position], taken[position] = (edge >> 37) - _CODES, True
                now = edge & 0xFFFFFFFF
                more = now > 0
                position, owner, now = (position - (edge >> 32 & 31))[more], owner[more], now[more]
        where = np.flatnonzero(taken)
        ids = chosen[where]
        counts = np.searchsorted(where, starts + sizes, "right") - np.searchsorted(where, starts, "right")
        if (ids < 0).any():
            spelled = {int(code): [self.bytes[b] for b in chr(-code - 1).encode()] for code in np.unique(ids[ids < 0])}
            rare = np.flatnonzero(ids < 0)
            each = np.ones(len(ids), np.int64)
            each[rare] = [len(spelled[code]) for code in ids[rare].tolist()]
            text_of = np.arange(len(texts)).repeat(counts).repeat(each)
            out = ids.repeat(each)
            begin = np.cumsum(each) - each
            for one, code in zip(begin[rare].tolist(), ids[rare].tolist()):
                out[one : one + len(spelled[code])] = spelled[code]
            ids, counts = out, np.bincount(text_of, minlength=len(texts))
        return ids, counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts again, without the space put before the first word."""
        lengths = self.spelled_length[ids]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + (self.spelled_start[ids] - ends + lengths).repeat(lengths)
        data = self.spelled[at].tobytes()
        upto = np.concatenate(([0], ends))[np.cumsum(counts)]
        return [data[a + 1 : b].decode() for a, b in zip(np.r_[0, upto[:-1]].tolist(), upto.tolist())]


@cache
def pieces(path: str, sharpness: float) -> Pieces:
    """One vocabulary in each Python worker; its word lattices live as long as a task."""
    return Pieces(path, sharpness)


def _slices(column: pa.Array) -> Iterator[slice]:
    begin = size = 0
    for at, length in enumerate(pc.utf8_length(column).fill_null(0).to_pylist()):
        if size and size + length > BATCH_CHARS:
            yield slice(begin, at)
            begin, size = at, 0
        size += length
    if begin < len(column):
        yield slice(begin, len(column))


def _sampled(model: Pieces, keys: pa.Array, column: pa.Array, seed: int) -> Iterator[pa.Array]:
    """The ids of all texts, those of BATCH_CHARS characters at a time: only so much is held besides the column."""
    for part in _slices(column):
        texts = [text or "" for text in column[part].to_pylist()]
        seeds = np.array([xxhash.xxh64_intdigest(str(key), seed) for key in keys[part].to_pylist()], np.uint64)
        ids, counts = model.encode(texts, seeds)
        ends = np.concatenate(([0], counts)).cumsum().astype(np.int32)
        yield pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))


def _spelled(model: Pieces, column: pa.Array) -> pa.Array:
    counts = np.diff(column.offsets.to_numpy()).astype(np.int64)
    ids = column.flatten().to_numpy(zero_copy_only=False)
    found = []
    begin = np.cumsum(counts) - counts
    for at in range(0, len(counts), 512):
        part = counts[at : at + 512]
        found += model.decode(ids[begin[at] : begin[at] + part.sum()], part)
    return pa.array(found, pa.string())


def round_trip(
    documents: DataFrame, path: str, key_column: str = "doc_id", text_column: str = "text",
    ids_column: str = "piece_ids", decoded_column: str = "decoded", sharpness: float = 1.0, seed: int = 0,
) -> DataFrame:
    """`documents` with the columns of `encode` and of `decode` after it, by one Python worker a task in place of two."""

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = pieces(path, sharpness)
        try:
            for keys, column in batches:
                for ids in _sampled(model, keys, column, seed):
                    yield pa.StructArray.from_arrays([ids, _spelled(model, ids)], ["ids", "decoded"])
        finally:
            model.clear()

    both = documents.withColumn(ids_column, run(F.col(key_column).cast("string"), F.col(text_column)))
    both = both.withColumn(decoded_column, F.col(f"`{ids_column}`.decoded"))
    return both.withColumn(ids_column, F.col(f"`{ids_column}`.ids"))


def encode(
    documents: DataFrame, path: str, key_column: str = "doc_id", text_column: str = "text",
    ids_column: str = "piece_ids", sharpness: float = 1.0, seed: int = 0,
) -> DataFrame:
    """`documents` with the sampled ids of every whole text in one more column (array<int>).

    `path` names a SentencePiece model that every executor can read. NULL counts as empty; an empty text
    gets the ids of the space put before every text. Rows of one key and text get equal ids, also
    rows with a NULL key. All columns stay; one named like the ids is replaced. Texts of any length are encoded whole.
    """

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = pieces(path, sharpness)
        try:
            for keys, column in batches:
                yield from _sampled(model, keys, column, seed)
        finally:
            model.clear()  # an idle worker of later stages holds no lattices

    return documents.withColumn(ids_column, run(F.col(key_column).cast("string"), F.col(text_column)))


def decode(rows: DataFrame, path: str, ids_column: str = "piece_ids", text_column: str = "decoded", sharpness: float = 1.0) -> DataFrame:
    """`rows` with the text of their ids in one more column; NULL ids give a NULL text, no ids an empty one."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = pieces(path, sharpness)
        for column in batches:
            yield _spelled(model, column)

    text = F.when(F.col(ids_column).isNotNull(), run(F.coalesce(F.col(ids_column), F.array().cast("array<int>"))))
    return rows.withColumn(text_column, text)
