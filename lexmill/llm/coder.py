"""Adaptive context-mixing range coder for token ids, many blocks in step.

Ids are cut into blocks. Each block starts anew: its model is empty, its bytes
stand alone, and it carries the CRC-32 of its ids. Order-2, order-1 and order-0
contexts each predict one id. Which of them holds first, or none, is one coded
outcome; its distribution is a mix of two adaptive ones (by the confidences of the
predictions, by the last two outcomes), weighted by how well each did. What no
context predicts is coded by a fixed distribution that falls with the id, as small
ids of a merge vocabulary are the frequent ones. Blocks do not depend on each
other, so numpy advances all of them by one id at a time; all arithmetic is in
whole numbers.

An adaptive distribution over the four outcomes is one 64-bit word: 16 bits for
the frequencies below each outcome. So it is read, mixed and moved in single steps.
The range has 64 bits and gives out 32 at a time, once an id at most.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

BLOCK = 1024
SLOT_BITS = 10
ONE = 1 << 16
U, V = np.uint64, np.uint32


def _u(x: int) -> np.ndarray:
    """A 64-bit constant; arrays of no dimension spare numpy a conversion a call."""
    return np.array(x, U)


def _v(x: int) -> np.ndarray:
    return np.array(x, V)


U3, U4, U5, U16, U32, U48 = map(_u, (3, 4, 5, 16, 32, 48))
U1, U8, U63 = map(_u, (1, 8, 63))
V1, V2, V16 = map(_v, (1, 2, 16))
WORD, MOST, FIELD, ID = _u(1 << 32), _u((1 << 32) - 1), _u(0xFFFF), _v(0xFFFF)
#: Frequencies below the outcomes 0 to 3 add up to 8,095 at most; eight parts of them and FLOOR stay below 2**16.
EVEN = 2048 << 16 | 4096 << 32 | 6144 << 48
FLOOR = _u(128 << 16 | 256 << 32 | 384 << 48)
FADE5, FADE4 = _u(0x00FF_00FF_00FF_0000), _u(0x01FF_01FF_01FF_0000)
AIM5, AIM4 = (np.array([sum(most << 16 * k for k in range(1, 4) if k > hit) for hit in range(4)], U) for most in (252, 505))
LEVEL, TOP_LEVEL = _u(0x2000_2000_2000_2000), _u(0x2000 << 48)
HASH1, HASH2, HASH_SHIFT = _v(0x9E3779B1), _v(0x85EBCA6B), _v(32 - SLOT_BITS)

#: The fixed distribution: 2**18 parts, one for each id, the others in proportion to 1 / (id + 64).
PART_BITS = 18
PART_SHIFT, LAST_PART = _u(PART_BITS), _u((1 << PART_BITS) - 1)


def _falling() -> tuple[np.ndarray, np.ndarray]:
    """Parts below each id and, in the lowest 10 bits, parts of it; the id of each part."""
    weight = [(1 << 40) // (i + 64) for i in range(ONE)]
    spare, total = (1 << PART_BITS) - ONE, sum(weight)
    parts = np.array([1 + w * spare // total for w in weight], np.int64)
    parts[0] += (1 << PART_BITS) - parts.sum()
    return (np.cumsum(parts) - parts << 10 | parts).astype(V), np.repeat(np.arange(ONE, dtype=np.uint16), parts)


SHARE, ID_AT = _falling()
U10, PARTS = _u(10), _u(1023)


class _Slots:
    """Predicted ids by context: the id that came last and, above its 16 bits, how often running (0 to 3)."""

    def __init__(self, n: int, shift: int):
        self.held = np.zeros(n << SLOT_BITS, V)
        self.most, self.one = _v(2 << shift), _v(1 << shift)

    def look(self, at: np.ndarray) -> np.ndarray:
        self.at, self.found = at, self.held.take(at)
        self.guess = self.found & ID
        return self.guess

    def learn(self, found: np.ndarray) -> None:
        sure = np.minimum(self.found - self.guess, self.most)
        sure += self.one
        sure *= self.guess == found
        sure += found
        self.held[self.at] = sure


class _Model:
    """Predictions and outcome distributions of several blocks, and what they give for the next id."""

    def __init__(self, n: int):
        # bits 3, 4 and 1, 2 of the context of by_sure, once moved down by 16
        self.two, self.one = _Slots(n, 19), _Slots(n, 17)
        # order 0 keeps an id it is sure of until others came in its place twice
        self.zero, self.sure = np.zeros(n, V), np.zeros(n, V)
        self.by_sure, self.by_past = np.full(n * 32, EVEN, U), np.full(n * 16, EVEN, U)
        self.past = np.zeros(n, np.int64)
        self.weight = np.full(n, 32, U)
        self.last, self.before = np.zeros(n, V), np.zeros(n, V)
        self.base = np.arange(n, dtype=np.int64) << SLOT_BITS
        # distributions of one context lie side by side, as few contexts are frequent
        self.n, self.each = np.array(n), np.arange(n, dtype=np.int64)
        self.fifteen, self.two_bits = np.array(15), np.array(2)

    def predict(self, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The predictions of orders 2, 1 and 0 and the mixed distribution of the first m blocks."""
        spread, both = self.last[:m] * HASH1, self.before[:m] * HASH2
        both += spread
        both >>= HASH_SHIFT
        spread >>= HASH_SHIFT
        g1 = self.one.look(spread + self.base[:m])
        g2 = self.two.look(both + self.base[:m])
        context = self.two.found >> V16
        context += self.one.found >> V16
        context += g2 == g1
        self.ia = context.astype(np.int64)
        self.ia *= self.n
        self.ia += self.each[:m]
        self.ib = self.past[:m] * self.n
        self.ib += self.each[:m]
        self.a, self.b = self.by_sure.take(self.ia), self.by_past.take(self.ib)
        w = self.weight[:m] >> U3
        mixed = self.a * w
        mixed += self.b * (U8 - w)
        mixed += FLOOR
        return g2, g1, self.zero[:m].copy(), mixed

    def learn(self, m: int, found: np.ndarray, outcome: np.ndarray, shift: np.ndarray) -> None:
        """Move everything towards the id found."""
        a, b = self.a, self.b
        lead = a + LEVEL
        lead -= b
        above = lead >> U16
        above |= TOP_LEVEL
        above >>= shift
        lead >>= shift
        better = (above & FIELD) > (lead & FIELD)
        w = self.weight[:m]
        w += better
        w += better
        w -= U1
        np.maximum(w, U8, out=w)
        np.minimum(w, U63, out=w)
        self.by_sure[self.ia] = a - (a >> U5 & FADE5) + AIM5.take(outcome)
        self.by_past[self.ib] = b - (b >> U4 & FADE4) + AIM4.take(outcome)
        past = self.past[:m]
        past <<= self.two_bits
        past &= self.fifteen
        past += outcome
        self.two.learn(found)
        self.one.learn(found)
        zero, sure = self.zero[:m], self.sure[:m]
        same = zero == found
        np.putmask(zero, sure < V2, found)
        np.minimum(sure, V2, out=sure)
        sure *= same
        sure += V1
        self.before[:m] = self.last[:m]
        self.last[:m] = found


def _split(mixed: np.ndarray, outcome: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies below an outcome and of it, out of 2**16, and where its bits begin."""
    shift = outcome.astype(U)
    shift <<= U4
    low = mixed >> shift
    low &= FIELD
    # above the last outcome all 2**16 are used up, which 16 bits hold as 0
    freq = mixed >> U16
    freq >>= shift
    freq -= low
    freq &= FIELD
    return low, freq, shift


def _widths(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """(step, blocks that have an id there); lengths do not grow."""
    ends = np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), "left")
    return enumerate(ends.tolist())


def _write(rows: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Code ``rows`` (step, block)."""
    n = rows.shape[1]
    model = _Model(n)
    low, size = np.zeros(n, U), np.full(n, ~U(0), U)
    width = int(lengths.max(initial=0)) + 2
    words = np.zeros(n * width, V)
    start = np.arange(n, dtype=np.int64) * width
    at = start.copy()

    def carry(place: np.ndarray) -> None:
        """Add one to the words given out last."""
        while place.size:
            place = place - 1
            words[place] += V1
            place = place[words[place] == 0]

    for t, m in _widths(lengths):
        found = rows[t, :m]
        g2, g1, g0, mixed = model.predict(m)
        miss = found != g2
        outcome = miss.astype(np.int64)
        miss &= found != g1
        outcome += miss
        miss &= found != g0
        outcome += miss
        below, freq, shift = _split(mixed, outcome)
        part = size[:m] >> U16
        below *= part
        lows = low[:m]
        lows += below
        over = (lows < below).nonzero()[0]
        if over.size:
            carry(at[over])
        np.multiply(part, freq, out=size[:m])
        x = miss.nonzero()[0]
        if x.size:
            ids, part = found.take(x), size.take(x)
            part >>= PART_SHIFT
            share = SHARE.take(ids).astype(U)
            more = share >> U10
            more *= part
            share &= PARTS
            lows = low.take(x)
            lows += more
            low[x] = lows
            over = x[lows < more]
            if over.size:
                carry(at[over])
            part *= share
            size[x] = part
        model.learn(m, found, outcome, shift)
        x = (size[:m] < WORD).nonzero()[0]
        if x.size:
            settled, place = low.take(x), at.take(x)
            words[place] = settled >> U32
            place += 1
            at[x] = place
            settled <<= U32
            low[x] = settled
            size[x] = size.take(x) << U32
    # one word more lies within every range that is left
    low += MOST
    carry(at[low < MOST])
    words[at] = low >> U32
    return [words[a : b + 1].astype("<u4").tobytes() for a, b in zip(start, at, strict=True)]


def _read(blobs: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """Ids (step, block) of coded blocks."""
    n, steps = len(blobs), int(lengths.max(initial=0))
    model = _Model(n)
    width = steps + 4
    words = np.zeros((n, width), V)
    for i, b in enumerate(blobs):
        if len(b) % 4 or len(b) > 4 * (steps + 2):
            raise ValueError(f"block {i} is damaged")
        words[i, : len(b) // 4] = np.frombuffer(b, "<u4")
    words = words.ravel()
    at = np.arange(n, dtype=np.int64) * width
    code = words[at].astype(U) << U32 | words[at + 1]
    at += 2
    size = np.full(n, ~U(0), U)
    out = np.zeros((steps, n), V)
    for t, m in _widths(lengths):
        g2, g1, g0, mixed = model.predict(m)
        part = size[:m] >> U16
        value = code[:m] // part
        np.minimum(value, FIELD, out=value)
        # at least 1, 2 or 3
        one = value >= (mixed >> U16 & FIELD)
        two = value >= (mixed >> U32 & FIELD)
        miss = value >= mixed >> U48
        outcome = one.astype(np.int64)
        outcome += two
        outcome += miss
        below, freq, shift = _split(mixed, outcome)
        below *= part
        codes = code[:m]
        codes -= below
        np.multiply(part, freq, out=size[:m])
        found = out[t, :m]
        found[:] = g2
        np.putmask(found, one, g1)
        np.putmask(found, two, g0)
        x = miss.nonzero()[0]
        if x.size:
            part, held = size.take(x), code.take(x)
            part >>= PART_SHIFT
            value = held // part
            np.minimum(value, LAST_PART, out=value)
            ids = ID_AT.take(value.view(np.int64))
            found[x] = ids
            share = SHARE.take(ids).astype(U)
            held -= (share >> U10) * part
            share &= PARTS
            code[x] = held
            part *= share
            size[x] = part
        model.learn(m, found, outcome, shift)
        x = (size[:m] < WORD).nonzero()[0]
        if x.size:
            place, held = at.take(x), code.take(x)
            held <<= U32
            held |= words.take(place)
            code[x] = held
            place += 1
            at[x] = place
            size[x] = size.take(x) << U32
    return out


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """Blocks of ids (0 to 65535) as bytes: count, then (length, bytes, crc) of each block, then their bodies."""
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < ONE:
        raise ValueError("ids take 16 bits")
    n = -(-len(ids) // block)
    lengths = np.full(n, block, np.int64)
    if n:
        lengths[-1] = len(ids) - block * (n - 1)
    rows = np.zeros((n, block), "<u4")
    rows.ravel()[: len(ids)] = ids
    bodies = _write(np.ascontiguousarray(rows.T), lengths) if n else []
    head = [struct.pack("<I", n)]
    for i, body in enumerate(bodies):
        head.append(struct.pack("<III", int(lengths[i]), len(body), zlib.crc32(rows[i, : lengths[i]])))
    return b"".join(head + bodies)


def decode(data: bytes) -> np.ndarray:
    """Ids of ``encode``; a block that does not match its checksum is an error."""
    (n,) = struct.unpack_from("<I", data)
    heads = [struct.unpack_from("<III", data, 4 + 12 * i) for i in range(n)]
    if not n:
        return np.zeros(0, "<u4")
    at, bodies = 4 + 12 * n, []
    for _, size, _ in heads:
        bodies.append(data[at : at + size])
        at += size
    lengths = np.array([h[0] for h in heads], np.int64)
    rows = np.ascontiguousarray(_read(bodies, lengths).T).astype("<u4", copy=False)
    for i, (length, _, crc) in enumerate(heads):
        if zlib.crc32(rows[i, :length]) != crc:
            raise ValueError(f"block {i} is damaged")
    whole = np.arange(rows.shape[1]) < lengths[:, None]
    return rows.ravel() if whole.all() else rows[whole]
