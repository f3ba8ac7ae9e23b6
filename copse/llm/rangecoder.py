"""Adaptive context-mixing range coder for sequences of token ids.

A block is cut into lanes of consecutive ids, which are coded side by side: at each step one id of every lane. All lanes
learn into the same model, which begins anew with each block. For each id the model names two candidates, the id seen last
after the same two ids (order 2) and after the same id (order 1), and mixes what speaks for them: how often their contexts
have been right of late, and the candidates' order-0 shares. Integer logistic mixers give the probability of each; an id
that is neither is coded by its order-0 frequency. All arithmetic is on integers, so every machine decodes alike.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np

LANES, STEPS = 32768, 256
#: Ids in a block at most.
BLOCK = LANES * STEPS
TOP, WORD, WHOLE, NONE = np.uint64(1 << 48), np.uint64(16), np.uint64(1 << 16), np.uint64(0)
#: What an order-0 frequency grows by.
GAIN = 24
MAGIC = b"CXRC"
HASH_BITS = 20
#: States: confidence of order 2 and of order 1, whether they agree, and the order-0 share of the candidate.
GRID = (8, 8, 2, 8)
#: What is summed over, for the frequencies that are mixed.
VIEWS = ((1, 3), (0, 3), (0, 1, 2), (3,))
#: The state of an order-0 share of 2**12: the next begins at 1, 2, 4, 8, 16, 32 and 64.
COMMON = np.searchsorted([1, 2, 4, 8, 16, 32, 64], np.arange(4097), side="right").astype(np.int32)


def logistic_tables() -> tuple[np.ndarray, np.ndarray]:
    """stretch: 8 bits of fraction of ln(p/(1-p)) for 12-bit p; squash: 12-bit p for -2047..2047."""
    p = [max(1, i) / 4096 for i in range(4096)]
    stretch = np.array([round(256 * math.log(x / (1 - x))) for x in p], np.int64).clip(-2047, 2047)
    squash = np.array([min(4094, max(2, round(4096 / (1 + math.exp(-i / 256))))) for i in range(-2047, 2048)], np.int64)
    return stretch, squash


STRETCH, SQUASH = logistic_tables()


class Mixed:
    """The probability that a candidate is right, for every combination of a few small states.

    Each state alone has been right with some frequency; a logistic mixer weighs these frequencies. As states are few, all
    combinations are worked out at once, and lanes look theirs up.
    """

    def __init__(self) -> None:
        self.all, self.hits = np.zeros(GRID, np.int64), np.zeros(GRID, np.int64)
        self.weights = [1 << 15] * len(VIEWS)
        self.work_out()

    def work_out(self) -> None:
        self.inputs = []
        for axes in VIEWS:
            n, h = self.all.sum(axes, keepdims=True), self.hits.sum(axes, keepdims=True)
            self.inputs.append(STRETCH[(((h + 1) << 12) // (n + 3)).clip(2, 4094)])
        dot = sum(w * x for w, x in zip(self.weights, self.inputs, strict=True))
        self.p = SQUASH[(dot >> 16).clip(-2047, 2047) + 2047]

    def learn(self, states: np.ndarray, right: np.ndarray) -> None:
        n, h = (np.bincount(x, minlength=self.all.size).reshape(GRID) for x in (states, states[right]))
        wrong = (h << 12) - n * self.p
        seen = max(1, len(states)) << 7
        for i, x in enumerate(self.inputs):
            self.weights[i] = min(max(self.weights[i] + int((wrong * x).sum()) // seen, -(1 << 18)), 1 << 18)
        self.all += n
        self.hits += h
        self.work_out()


class Model:
    """What all lanes of a block have learned so far."""

    def __init__(self, alphabet: int) -> None:
        self.alphabet = alphabet
        # Tables of the candidates and their confidence: id * 8 + confidence.
        self.two, self.one = np.zeros(1 << HASH_BITS, np.int32), np.zeros(alphabet + 1, np.int32)
        self.first, self.second = Mixed(), Mixed()
        self.freq = np.ones(alphabet, np.uint64)
        self.escaped: list[np.ndarray] = []
        self.steps = 0
        self.order_zero()
        self.shares()

    def order_zero(self) -> None:
        self.cum = np.concatenate([[NONE], np.cumsum(self.freq)])
        self.total = int(self.cum[-1])
        self.common = COMMON.take((self.freq << np.uint64(12)) // np.uint64(self.total))
        # The total is the alphabet and GAIN an id at most, so 32 bits hold it; the table is half as large for it.
        self.ends = self.cum[1:].astype(np.uint32)

    def id_at(self, value: np.ndarray) -> np.ndarray:
        """The ids in whose order-0 range the values lie; ascending values are found several times as fast."""
        value = np.minimum(value, np.uint64(self.total - 1)).astype(np.uint32)
        order = np.argsort(value)
        out = np.empty(len(value), np.int32)
        out[order] = np.searchsorted(self.ends, value[order], side="right")
        return out

    def shares(self) -> None:
        """Of 2**16, for either candidate, by state."""
        self.share_a = (self.first.p << 4).reshape(-1).astype(np.uint64)
        b = np.maximum(1, ((65536 - (self.first.p << 4)) * self.second.p) >> 12)
        b[:, :, 1] = 0
        self.share_b = b.reshape(-1).astype(np.uint64)

    def predict(self, before2: np.ndarray, before1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Two candidates for each lane, and their shares."""
        self.h = (before2.astype(np.uint32) * np.uint32(0x9E3779B1) + before1.astype(np.uint32) * np.uint32(0x85EBCA77)) >> np.uint32(32 - HASH_BITS)
        self.before1 = before1
        self.got2, self.got1 = self.two.take(self.h), self.one.take(before1)
        self.a, self.b = self.got2 >> 3, self.got1 >> 3
        self.state = ((((self.got2 & 7) << 3) | (self.got1 & 7)) << 4) | ((self.a == self.b) * np.int32(8)) | self.common.take(self.a)
        return self.a, self.b, self.share_a.take(self.state), self.share_b.take(self.state)

    @staticmethod
    def moved(got: np.ndarray, ids: np.ndarray, right: np.ndarray) -> np.ndarray:
        """More confidence in a candidate that was right, half of it if wrong; one without gives way to the id seen."""
        sure = got & 7
        wrong = np.where(sure > 1, got - (sure + 1 >> 1), ids << 3)
        return np.where(right, got + (sure < 7), wrong)

    def learn(self, ids: np.ndarray, is_a: np.ndarray, is_b: np.ndarray, escaped: np.ndarray) -> None:
        self.two[self.h] = self.moved(self.got2, ids, is_a)
        self.one[self.before1] = self.moved(self.got1, ids, self.b == ids)
        self.escaped.append(escaped)
        self.steps += 1
        if self.steps < 16 or self.steps % (4 if self.steps < 64 else 8) == 0:
            self.first.learn(self.state, is_a)
            left = np.flatnonzero(~is_a & ((self.state & 8) == 0))
            self.second.learn(self.state[left], is_b[left])
            self.shares()
        if self.steps < 8 or self.steps % 8 == 0:
            self.freq += (GAIN * np.bincount(np.concatenate(self.escaped), minlength=self.alphabet)).astype(np.uint64)
            self.escaped = []
            self.order_zero()


def shape(n: int, steps: int = STEPS, lanes: int = LANES) -> tuple[int, int]:
    """Lanes and the steps of each but the last, which may be shorter."""
    steps = max(min(steps, n), -(-n // lanes), 1)
    return -(-n // steps), steps


class Lanes:
    """The intervals of all lanes: low and width, of 64 bits. A width never stays under 2**48, so that 2**16 shares and then
    an order-0 frequency can be taken from it before the next shift."""

    def __init__(self, lanes: int) -> None:
        self.low, self.width = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)

    def due(self, m: int) -> np.ndarray:
        return np.flatnonzero(self.width[:m] < TOP)

    def shifted(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shifts the leading 16 bits out of lanes; the bits, and the lanes that have to shift again.

        Where these bits could still change, the interval is cut short at the next change: nothing is ever carried.
        """
        lo, wi = self.low[at], self.width[at]
        wi = np.where((lo ^ (lo + wi)) < TOP, wi, (~lo + np.uint64(1)) & (TOP - np.uint64(1)))
        self.low[at], wi = lo << WORD, wi << WORD
        self.width[at] = wi
        return lo >> np.uint64(48), at[wi < TOP]


def encode_block(ids: np.ndarray) -> bytes:
    """One block: its header, the checksum of its ids and of its payload, and the payload."""
    n = len(ids)
    lanes, steps = shape(n)
    alphabet = int(ids.max()) + 1
    model = Model(alphabet)
    state = Lanes(lanes)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    last = n - (lanes - 1) * steps
    came_lane: list[np.ndarray] = []
    came_word: list[np.ndarray] = []
    start = np.full(lanes, alphabet, np.int32)
    b2, b1 = start, start
    every = np.arange(lanes)
    for t in range(steps):
        m = lanes if t < last else lanes - 1
        if not m:
            break
        x = grid[t, :m]
        a, b, fa, fb = model.predict(b2[:m], b1[:m])
        is_a, is_b = x == a, x == b
        neither = ~(is_a | is_b)
        esc = np.flatnonzero(neither)
        ab = fa + fb
        low, width = state.low[:m], state.width[:m]
        part = width >> WORD
        low += part * np.where(is_a, NONE, np.where(is_b, fa, ab))
        part *= np.where(is_a, fa, np.where(is_b, fb, WHOLE - ab))
        width[:] = part
        y = x[esc]
        if len(esc):
            r = width[esc] // np.uint64(model.total)
            low[esc] += r * model.cum[y]
            width[esc] = r * model.freq[y]
        at = state.due(m)
        while len(at):
            came_lane.append(at.astype(np.uint16))
            word, at = state.shifted(at)
            came_word.append(word.astype(np.uint16))
        model.learn(x, is_a, is_b, y)
        b2, b1 = b1, x
    for k in range(4):
        came_lane.append(every.astype(np.uint16))
        came_word.append((state.low >> np.uint64(48 - 16 * k)).astype(np.uint16))
    lane, word = np.concatenate(came_lane), np.concatenate(came_word)
    payload = np.bincount(lane, minlength=lanes).astype("<u4").tobytes() + word[np.argsort(lane, kind="stable")].astype("<u2").tobytes()
    head = np.array([n, alphabet, len(payload), crc32(payload), crc32(np.ascontiguousarray(ids, "<u4"))], "<u4")
    return MAGIC + head.tobytes() + payload


def decode_block(data: memoryview) -> tuple[np.ndarray, int]:
    """The ids of the block that data begins with, and its bytes. Raises ValueError if a checksum fails."""
    if bytes(data[:4]) != MAGIC:
        raise ValueError("not a block")
    n, alphabet, size, check, of_ids = (int(x) for x in np.frombuffer(data[4:24], "<u4"))
    payload = data[24 : 24 + size]
    if len(payload) != size or crc32(payload) != check:
        raise ValueError("a block's checksum fails")
    lanes, steps = shape(n)
    counts = np.frombuffer(payload[: 4 * lanes], "<u4").astype(np.int64)
    words = np.append(np.frombuffer(payload[4 * lanes :], "<u2").astype(np.uint64), np.zeros(1, np.uint64))
    at_word = np.cumsum(counts) - counts
    model = Model(alphabet)
    state, code = Lanes(lanes), np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = (code << WORD) | words[at_word]
        at_word += 1
    last = n - (lanes - 1) * steps
    grid = np.zeros((steps, lanes), np.int32)
    start = np.full(lanes, alphabet, np.int32)
    b2, b1 = start, start
    every = np.arange(lanes)
    for t in range(steps):
        m = lanes if t < last else lanes - 1
        if not m:
            break
        a, b, fa, fb = model.predict(b2[:m], b1[:m])
        low, width, ab = state.low[:m], state.width[:m], fa + fb
        part = width >> WORD
        value = (code[:m] - low) // part
        is_a = value < fa
        neither = value >= ab
        is_b = ~(is_a | neither)
        esc = np.flatnonzero(neither)
        low += part * np.where(is_a, NONE, np.where(is_b, fa, ab))
        part *= np.where(is_a, fa, np.where(is_b, fb, WHOLE - ab))
        width[:] = part
        x = np.where(is_a, a, b)
        y = esc
        if len(esc):
            r = width[esc] // np.uint64(model.total)
            y = model.id_at((code[esc] - low[esc]) // r)
            low[esc] += r * model.cum[y]
            width[esc] = r * model.freq[y]
            x[esc] = y
        at = state.due(m)
        while len(at):
            code[at] = (code[at] << WORD) | words[at_word[at]]
            at_word[at] += 1
            _, at = state.shifted(at)
        model.learn(x, is_a, is_b, y)
        grid[t, :m] = x
        b2, b1 = b1, x
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:n].astype(np.uint32)
    if crc32(ids.astype("<u4")) != of_ids:
        raise ValueError("the ids' checksum fails")
    return ids, 24 + size
