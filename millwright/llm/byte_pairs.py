"""Byte-level BPE by backtracking over longest matches, in time linear in the text.

A sequence of tokens is what the merges make of its bytes exactly if every two neighbours are what the merges
make of those two (compatible). So a word is encoded from left to right: take the longest token that starts
here and is compatible with the one before; if none is, drop the one before and try its next shorter form. A
place from which no way leads to the end is marked, so none is tried twice. The longest token at a place comes
from a trie of pyahocorasick, whose bytes are read as Latin-1.
"""

import base64
import struct
from array import array
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KNOWN_WORD_BYTES = 64 << 20  # words met before, per task
KNOWN_PAIRS = 1 << 19  # answers of compatible() that are kept
_END = 1 << 32


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """Tokens with ranks in the order of their merges; every byte is one."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if any(bytes([byte]) not in ranks for byte in range(256)) or max(ranks.values()) >= 1 << 24:
            raise ValueError("a vocabulary needs all 256 bytes, and ranks below 2**24")
        self.ranks = ranks
        self.of = {rank: token for token, rank in ranks.items()}
        #: the last merge of a token: its two halves; a byte is its own half
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.known: dict[int, bool] = {}  # answers of compatible()
        for rank in sorted(self.of):
            self._add(rank, self.of[rank])
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for rank in self.halves:
            self.trie.add_word(self.of[rank].decode("latin-1"))
        # compact tables by rank, so that they stay in the processor's cache; size 0: merges never make this token
        self.sizes = array("H", bytes(2 * (max(self.of) + 1)))
        for rank in self.halves:
            self.sizes[rank] = len(self.of[rank])
        self.most = max(self.sizes)
        #: the longest token that a token begins with, other than itself; a byte has none
        self.shorter = array("i", [-1]) * len(self.sizes)
        for rank in self.halves:
            self.shorter[rank] = self._longest(self.of[rank][:-1])

    def _longest(self, start: bytes) -> int:
        """The longest token that merges make and `start` begins with; -1 of nothing."""
        while start and self.ranks.get(start) not in self.halves:
            start = start[:-1]
        return self.ranks[start] if start else -1

    def _add(self, rank: int, token: bytes) -> None:
        if len(token) == 1:
            self.halves[rank] = rank, rank
            return
        for at in range(1, len(token)):
            left, right = self.ranks.get(token[:at], _END), self.ranks.get(token[at:], _END)
            if left < rank and right < rank and left in self.halves and right in self.halves and self._meet(left, right):
                self.halves[rank] = left, right
                self.merged[left, right] = rank
                return
        # merges never make this token, so it only stands for a whole word
        if len(plain_merges(token, {t: r for t, r in self.ranks.items() if t in token})) == 1:
            raise ValueError(f"rank {rank} is lower than that of its halves")

    def _meet(self, left: int, right: int) -> bool:
        """Whether merges leave the two as they are: undo the later merge of both, again and again, and see that no earlier one joins what meets."""
        halves, merged, limit = self.halves, self.merged, _END
        while True:
            if merged.get((left, right), _END) < limit:
                return False
            if left > right:
                limit, left = left, halves[left][1]
                if left == limit:
                    limit, right = right + 1, halves[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, halves[right][0]
                if right + 1 == limit:
                    limit, left = left, halves[left][1]
                    if left == limit:
                        return True

    def compatible(self, left: int, right: int) -> bool:
        if len(self.known) >= KNOWN_PAIRS:
            self.known.clear()
        found = self.known[left << 32 | right] = self._meet(left, right)
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one match of the pattern; a word that is a token itself is that token, however merges go."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        size, most = len(word), self.most
        text, longest_path = word.decode("latin-1"), self.trie.longest_prefix
        known, sizes, shorter, rank_of = self.known.get, self.sizes, self.shorter, self.ranks.get
        ids: list[int] = []
        dead = bytearray(size + 1)  # places from which the end can't be reached
        at, before = 0, -1
        while at < size:
            start = word[at : at + longest_path(text[at : at + most])]
            rank = rank_of(start, -1)
            if rank < 0 or not sizes[rank]:
                rank = self._longest(start)
            while True:
                while rank >= 0:
                    after = at + sizes[rank]
                    if not dead[after]:
                        if before < 0:
                            break
                        fits = known(before << 32 | rank)
                        if fits or fits is None and self.compatible(before, rank):
                            break
                    rank = shorter[rank]
                else:  # nothing fits here: the token before gets shorter
                    dead[at] = 1
                    rank = ids.pop()
                    at -= sizes[rank]
                    before = ids[-1] if ids else -1
                    rank = shorter[rank]
                    continue
                break
            ids.append(rank)
            at, before = after, rank
        return ids


def plain_merges(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Join the neighbours of lowest rank until none is left, in quadratic time: to check a vocabulary, and for tests."""
    parts = [bytes([byte]) for byte in word]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], _END), i) for i in range(len(parts) - 1))
        if rank == _END:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@cache
def vocabulary(path: str) -> Vocabulary:
    """One in each Python worker, of the size of the file."""
    return Vocabulary(read_ranks(path))


@cache
def _stand_ins() -> dict[int, int]:
    """Characters that tiktoken's Unicode tables class unlike those of `regex`, and a like one that both agree on."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    classes = []
    for pattern in (r"\p{L}+", r"\p{N}+", r"\s+"):
        asked = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        theirs = set(asked.decode_bytes(asked.encode_ordinary(every)).decode())
        classes.append((theirs, set("".join(regex.findall(pattern, every)))))
    odd = set().union(*(theirs ^ ours for theirs, ours in classes))
    like = ["א", "١", " "]  # a letter, a number, a space; else a sign
    return {ord(c): ord(next((like[i] for i, (theirs, _) in enumerate(classes) if c in theirs), "§")) for c in odd}


class Words:
    """Cuts texts as tiktoken does, and encodes words, those met before in this task by a look-up."""

    def __init__(self, model: Vocabulary, pattern: str) -> None:
        self.model, self.find = model, regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.size = 0
        self.stand_ins = _stand_ins()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        words = self.find.findall(text)
        new = set(words).difference(self.known)
        odd = not all(map(str.isascii, new)) and any(ord(c) in self.stand_ins for c in set().union(*new))
        if odd:
            like = text.translate(self.stand_ins)  # cut this, one character for one, and the text at the same places
            words = [text[match.start() : match.end()] for match in self.find.finditer(like)]
            new = set(words).difference(self.known)
        if self.size > KNOWN_WORD_BYTES:
            self.known.clear()
            self.size, new = 0, set(words)
        for word in new:
            ids = self.model.encode_word(word.encode())
            self.known[word] = struct.pack(f"<{len(ids)}I", *ids)
            self.size += 200 + 2 * len(word) + 4 * len(ids)
        whole = b"".join(map(self.known.__getitem__, words))
        if odd:  # a word with such a character stays unknown, so that it is seen in every text
            for word in new:
                del self.known[word]
        return whole


def encode(documents: DataFrame, ranks: str, pattern: str, text_column: str = "text", ids_column: str = "ids") -> DataFrame:
    """`documents` with the ids of each whole text, packed as little-endian unsigned 32-bit integers (`unpacked` lists them).

    `ranks` names a file that every executor can read. Each match of `pattern` is merged by itself; there are no
    special tokens. NULL text counts as empty and has no ids. Rows stay as they are, in any number and with any id;
    a column that has the name `ids_column` is replaced. An empty table gives no rows.
    """

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words(vocabulary(ranks), pattern)
        for texts in batches:
            yield pd.Series([words.encode(text or "") for text in texts], dtype="object")

    return documents.withColumn(ids_column, run(F.col(text_column)))


def decode(rows: DataFrame, ranks: str, ids_column: str = "ids", bytes_column: str = "decoded") -> DataFrame:
    """`rows` with the bytes that packed ids stand for; NULL ids count as none. An id that is no rank is an error."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        token = {rank: token for token, rank in read_ranks(ranks).items()}.__getitem__
        for packed in batches:
            whole = [b"".join(map(token, np.frombuffer(ids or b"", "<u4").tolist())) for ids in packed]
            yield pd.Series(whole, dtype="object")

    return rows.withColumn(bytes_column, run(F.col(ids_column)))


def count(ids: Column) -> Column:
    """Number of packed ids."""
    return (F.octet_length(ids) / 4).cast("bigint")


def unpacked(ids: Column) -> Column:
    """Packed ids as an array of longs."""

    def byte(at: Column, number: int) -> Column:
        return F.conv(F.hex(F.substring(ids, at * 4 + number + 1, F.lit(1))), 16, 10).cast("bigint")

    places = F.sequence(F.lit(0), (F.octet_length(ids) / 4 - 1).cast("int"))
    ids_list = F.transform(places, lambda at: byte(at, 0) + byte(at, 1) * 256 + byte(at, 2) * 65536 + byte(at, 3) * 16777216)
    return F.when(F.octet_length(ids) > 0, ids_list).otherwise(F.array().cast("array<bigint>"))
