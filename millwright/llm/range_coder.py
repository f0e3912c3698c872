"""Adaptive context-mixing range coder for blocks of token ids.

A block is coded on its own, from a fresh model, so any block can be read alone. Per id: the orders 2 and 1
each predict one id, from a table by the last two ids or the last one. Whether the prediction of order 2 is
right is coded with a chance mixed from both orders' track records; then likewise that of order 1, if it
differs. An id that neither foretold is coded by order 0: adaptive counts of its high byte, then of its low
byte given the high one. All arithmetic is on integers, so decoding repeats it exactly.

Many blocks are coded in step, as columns of numpy arrays: step t codes id t of all of them.
"""

import numpy as np

TABLE = 4096  # slots of a prediction table
SURE = 15  # largest track record of a prediction
MOST = 1 << 15  # total of the counts of high bytes; the coder needs totals below its least range, 65,536
_ONE = 4096
_squash = np.clip(_ONE / (1 + np.exp(-np.arange(-2047, 2048) / 256.0)), 1, _ONE - 1).astype(np.int64)
_chances = np.clip(np.arange(_ONE), 1, _ONE - 1) / _ONE
_stretch = np.clip(np.rint(256 * np.log(_chances / (1 - _chances))), -2047, 2047).astype(np.int64)
_TOP, _BOTTOM, _MASK = np.uint32(1 << 24), np.uint32(1 << 16), np.uint32(0xFFFF)


class _Writer:
    def __init__(self, lengths: np.ndarray) -> None:
        n = len(lengths)
        self.low, self.range = np.zeros(n, np.uint32), np.full(n, 0xFFFFFFFF, np.uint32)
        self.out = np.zeros((n, 7 * int(lengths.max(initial=0)) + 8), np.uint8)
        self.at = np.zeros(n, np.int64)

    def narrow(self, rows: np.ndarray, below: np.ndarray, width: np.ndarray, total) -> None:
        unit = self.range[rows] // total
        low, span = self.low[rows] + below * unit, width * unit
        where = np.arange(len(rows))
        while True:
            l, s = low[where], span[where]
            same = (l ^ (l + s)) < _TOP
            short = ~same & (s < _BOTTOM)
            need = same | short
            if not need.any():
                break
            where, l, s, short = where[need], l[need], s[need], short[need]
            s = np.where(short, (np.uint32(0) - l) & _MASK, s)
            row = rows[where]
            self.out[row, self.at[row]] = l >> np.uint32(24)
            self.at[row] += 1
            low[where], span[where] = l << np.uint32(8), s << np.uint32(8)
        self.low[rows], self.range[rows] = low, span

    def bit(self, rows: np.ndarray, chance: np.ndarray, hit: np.ndarray) -> np.ndarray:
        chance = chance.astype(np.uint32)
        self.narrow(rows, np.where(hit, np.uint32(0), chance), np.where(hit, chance, np.uint32(_ONE) - chance), np.uint32(_ONE))
        return hit

    def symbol(self, rows: np.ndarray, counts: np.ndarray, value: np.ndarray) -> np.ndarray:
        upto = counts.cumsum(1, dtype=np.uint32)
        each = np.arange(len(rows))
        width = counts[each, value].astype(np.uint32)
        self.narrow(rows, upto[each, value] - width, width, upto[:, -1])
        return value

    def blocks(self) -> list[bytes]:
        rows = np.arange(len(self.at))
        for _ in range(4):
            self.out[rows, self.at] = self.low >> np.uint32(24)
            self.at += 1
            self.low <<= np.uint32(8)
        return [self.out[row, :end].tobytes() for row, end in enumerate(self.at.tolist())]


class _Reader:
    def __init__(self, blocks: list[bytes]) -> None:
        n = len(blocks)
        self.data = np.zeros((n, max(map(len, blocks), default=0) + 8), np.uint8)
        for row, block in enumerate(blocks):
            self.data[row, : len(block)] = np.frombuffer(block, np.uint8)
        self.low, self.range = np.zeros(n, np.uint32), np.full(n, 0xFFFFFFFF, np.uint32)
        self.code = np.ascontiguousarray(self.data[:, :4]).view(">u4")[:, 0].astype(np.uint32)
        self.at = np.full(n, 4, np.int64)

    def narrow(self, rows: np.ndarray, unit: np.ndarray, below: np.ndarray, width: np.ndarray) -> None:
        low, span, code = self.low[rows] + below * unit, width * unit, self.code[rows]
        where = np.arange(len(rows))
        while True:
            l, s = low[where], span[where]
            same = (l ^ (l + s)) < _TOP
            short = ~same & (s < _BOTTOM)
            need = same | short
            if not need.any():
                break
            where, l, s, short = where[need], l[need], s[need], short[need]
            s = np.where(short, (np.uint32(0) - l) & _MASK, s)
            row = rows[where]
            code[where] = code[where] << np.uint32(8) | self.data[row, np.minimum(self.at[row], self.data.shape[1] - 1)]
            self.at[row] += 1
            low[where], span[where] = l << np.uint32(8), s << np.uint32(8)
        self.low[rows], self.range[rows], self.code[rows] = low, span, code

    def bit(self, rows: np.ndarray, chance: np.ndarray, hit: None) -> np.ndarray:
        chance = chance.astype(np.uint32)
        unit = self.range[rows] // np.uint32(_ONE)
        hit = (self.code[rows] - self.low[rows]) // unit < chance
        self.narrow(rows, unit, np.where(hit, np.uint32(0), chance), np.where(hit, chance, np.uint32(_ONE) - chance))
        return hit

    def symbol(self, rows: np.ndarray, counts: np.ndarray, value: None) -> np.ndarray:
        upto = counts.cumsum(1, dtype=np.uint32)
        unit = self.range[rows] // upto[:, -1]
        place = np.minimum((self.code[rows] - self.low[rows]) // unit, upto[:, -1] - np.uint32(1))
        value = (upto > place[:, None]).argmax(1)
        each = np.arange(len(rows))
        width = counts[each, value].astype(np.uint32)
        self.narrow(rows, unit, upto[each, value] - width, width)
        return value


class _Chance:
    """Chance that a prediction is right, mixed from track records by weights that learn as they go."""

    def __init__(self, blocks: int, inputs: int) -> None:
        start = (np.arange(SURE + 1) + 1) * _ONE // (SURE + 3)
        self.records = [np.tile(start, (blocks, 1)) for _ in range(inputs)]
        self.weights = np.full((inputs + 1, blocks), 1 << 15)

    def mixed(self, rows: np.ndarray, states: list[np.ndarray]) -> np.ndarray:
        self.rows, self.states = rows, states
        self.inputs = [_stretch[record[rows, state]] for record, state in zip(self.records, states)]
        self.inputs.append(np.full(len(rows), 64))
        total = sum(self.weights[at, rows] * value for at, value in enumerate(self.inputs))
        self.chance = _squash[np.clip(total >> 16, -2047, 2047) + 2047]
        return self.chance

    def learn(self, hit: np.ndarray) -> None:
        error = hit * _ONE - self.chance
        for at, value in enumerate(self.inputs):
            self.weights[at, self.rows] += (value * error) >> 10
        for record, state in zip(self.records, self.states):
            old = record[self.rows, state]
            record[self.rows, state] = old + ((hit * (_ONE - 1) - old) >> 4)


def _code(lengths: np.ndarray, coder, ids: np.ndarray | None) -> np.ndarray:
    """Code or decode blocks in step; lengths must not increase. ids: (blocks, longest)."""
    blocks, longest = len(lengths), int(lengths.max(initial=0))
    result = np.zeros((blocks, longest), np.uint16) if ids is None else ids
    guess = [np.full((blocks, TABLE), -1, np.int32) for _ in range(2)]
    record = [np.zeros((blocks, TABLE), np.uint8) for _ in range(2)]
    second, first = _Chance(blocks, 2), _Chance(blocks, 2)
    high, totals = np.ones((blocks, 256), np.uint16), np.full(blocks, 256)
    low = np.ones((blocks, 256, 256), np.uint8)
    last, before = np.zeros(blocks, np.int64), np.zeros(blocks, np.int64)
    active = np.searchsorted(-lengths, -np.arange(longest), "left")
    for step in range(longest):
        rows = np.arange(active[step])
        last, before = last[rows], before[rows]
        slots = [(last * 40503 >> 4) % TABLE, ((last * 40503 + before * 30029) >> 3) % TABLE]
        one, two = guess[0][rows, slots[0]], guess[1][rows, slots[1]]
        trust = [record[0][rows, slots[0]], record[1][rows, slots[1]]]
        now = None if ids is None else ids[rows, step].astype(np.int64)
        agree = np.where(one == two, trust[0], 0)
        hit = coder.bit(rows, second.mixed(rows, [trust[1], agree]), None if now is None else two == now)
        second.learn(hit)
        value = np.where(hit, two, 0).astype(np.int64)
        rest = np.flatnonzero(~hit & (one != two))
        if len(rest):
            right = coder.bit(rest, first.mixed(rest, [trust[0][rest], trust[1][rest]]), None if now is None else one[rest] == now[rest])
            first.learn(right)
            value[rest[right]] = one[rest[right]]
            hit[rest[right]] = True
        rest = np.flatnonzero(~hit)
        if len(rest):
            upper = coder.symbol(rest, high[rest], None if now is None else now[rest] >> 8)
            high[rest, upper] += 32
            totals[rest] += 32
            full = rest[totals[rest] > MOST]
            high[full] = (high[full] >> 1) | 1
            totals[full] = high[full].sum(1)
            lower = coder.symbol(rest, low[rest, upper], None if now is None else now[rest] & 255)
            low[rest, upper, lower] += 24
            full = low[rest, upper, lower] > 220
            part = low[rest[full], upper[full]]
            low[rest[full], upper[full]] = (part >> 1) | 1
            value[rest] = upper << 8 | lower
        if ids is None:
            result[rows, step] = value
        for table, sure, slot, old, state in zip(guess, record, slots, (one, two), trust):
            good = old == value
            table[rows, slot] = np.where(good | (state > 0), old, value)
            sure[rows, slot] = np.where(good, np.minimum(state + 1, SURE), state >> 1)
        before, last = last, value
    return result


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids (below 65,536) as bytes of its own."""
    lengths = np.fromiter(map(len, blocks), np.int64, len(blocks))
    order = np.argsort(-lengths, kind="stable")
    table = np.zeros((len(blocks), int(lengths.max(initial=0))), np.uint16)
    for row, at in enumerate(order.tolist()):
        table[row, : lengths[at]] = blocks[at]
    coder = _Writer(lengths)
    _code(lengths[order], coder, table)
    out: list[bytes] = [b""] * len(blocks)
    for at, data in zip(order.tolist(), coder.blocks()):
        out[at] = data
    return out


def decode(blocks: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """The ids of each block again."""
    numbers = np.array(lengths, np.int64)
    order = np.argsort(-numbers, kind="stable")
    table = _code(numbers[order], _Reader([blocks[at] for at in order.tolist()]), None)
    out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(blocks)
    for row, at in enumerate(order.tolist()):
        out[at] = table[row, : lengths[at]]
    return out
