"""Token-ID files: adaptive context-mixing range coder over blocks of ids.

The ids of documents in ascending order form one sequence.  It is written as
frames of whole documents; a frame's ids are cut into blocks of at most
``BLOCK`` ids, and every block is coded on its own, from a model that begins anew,
and carries a CRC-32 of its ids.  A frame's header has the frequencies of its ids
(to an eighth of a power of two), from which every block begins; inside of the
coder an id is its place in order of frequency.

A block is coded id by id.  Predictions compete: the id that followed the last
two ids before (order 2), the one that followed the last id (order 1), and for
ids that are rare in the frame the latest such one of the block that these have
missed, with the same low byte (order 0).  Which of them is right, if any, is a symbol of four; its cumulative
frequencies mix those of two adaptive models (by the confidence of the orders 2
and 1, and without context), weighted by how well each has done in the block.
Where none is right the id is coded by the frame's order-0 frequencies.  A range
coder with carries codes all of it.  All arithmetic is on integers, so that any machine decodes what another has
coded.  Ids have up to 32 bits.

Blocks don't depend on each other, so many are coded and decoded in step: lane
k of the arrays is block k.  The coder knows all ids, so it makes the guesses of
whole blocks at once and goes in step for the mixing alone.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.textbytes import PIECE_BYTES, hash_spans, pieces, utf8_views

#: Ids of a block, of a frame (at least, unless it is the last), and lanes coded at a time (about).
BLOCK, FRAME, LANES = 2048, 1 << 19, 4096
MAGIC = b"BTF3"
#: Pieces of text whose ids a worker keeps; beyond, it begins anew.
CACHE_PIECES = 2_000_000
#: Pieces that go to the library as one text.
LINES = 256

#: A word leaves the coder as soon as the span is below the first of these, a second one below the other.
_LEAST, _LESS = np.uint64(1 << 48), np.uint64(1 << 32)
#: A model's frequencies add up to 2 ** _TOTAL and are _GAP at least; the weights of the two add up to 2 ** _WEIGHT.
_TOTAL, _GAP, _WEIGHT = 15, 48, 6
#: Where learning of each symbol moves the lower bounds of the four.
_LOWER = np.array([[_GAP * k if k <= s else (1 << _TOTAL) - _GAP * (4 - k) for k in range(4)] for s in range(4)], np.int32)
_GOALS = _LOWER.view(np.complex128).ravel()
_UNIT, _WHOLE = np.uint64(_TOTAL + _WEIGHT), np.int32((1 << (_TOTAL + _WEIGHT)) - 1)
_SLOTS_BITS = 8
#: Blocks whose guesses are made, and whose words are added up, at a time.
_ROWS = 32
#: Bits of what follows each symbol: order 2, order 1, order 0 (a low byte), none (by frequency).
_TAIL = np.array([0, 0, 8, 16], np.uint64)
#: Groups of ids with a frequency of their own, at most; more ids share groups of like frequency.
MOST_GROUPS = 1 << 15
#: Ids of at least this frequency (of 65,536) cost less by frequency than by a low byte.
_FREQUENT = 128


class Prior:
    """Frequencies of the ids of a frame.

    ids: in ascending order; classes: their counts as floats of five and three
    bits.  Places go by falling class, then id.  Frequencies are of groups of
    2 ** bits places, in 65,536ths.
    """

    def __init__(self, ids: np.ndarray, classes: np.ndarray):
        self.ids, self.classes = ids, classes
        self.known: np.ndarray | None = None  # place by id, made when it is asked for
        order = np.argsort(-classes.astype(np.int64), kind="stable")
        self.order = ids[order]
        self.place = np.empty(len(ids), np.uint32)
        self.place[order] = np.arange(len(ids), dtype=np.uint32)
        self.bits = max(0, int(-(-len(ids) // MOST_GROUPS) - 1).bit_length())
        kind = classes[order].astype(np.int64)
        count = ((8 + (kind & 7)) << (kind >> 3)) >> 3
        group = np.add.reduceat(count, np.arange(0, len(ids), 1 << self.bits)) if len(ids) else np.ones(1, np.int64)
        width = group * (65536 - len(group)) // group.sum() + 1
        width[0] += 65536 - width.sum()
        self.width = width.astype(np.uint64)
        self.start = np.cumsum(self.width) - self.width

    @classmethod
    def of(cls, stream: np.ndarray) -> Prior:
        """That of a frame's ids."""
        if len(stream) and int(stream.max()) < 1 << 22:
            count = np.bincount(stream)
            ids = np.flatnonzero(count)
            count = count[ids]
        else:
            ids, count = np.unique(stream, return_counts=True)
        power = np.zeros(len(count), np.int64)
        for k in range(1, 40):
            power += count >= 1 << k
        return cls(ids.astype(np.uint32), ((power << 3) | (((count << 3) >> power) & 7)).astype(np.uint16))

    def places(self, ids: np.ndarray) -> np.ndarray:
        """The places of ids of the frame."""
        if not len(self.ids) or self.ids[-1] >= 1 << 22:
            return self.place[np.searchsorted(self.ids, ids)]
        if self.known is None:
            self.known = np.zeros(int(self.ids[-1]) + 1, np.uint32)
            self.known[self.ids] = self.place
        return self.known.take(ids)

    def slots(self) -> np.ndarray:
        """The group of each of the 65,536 parts."""
        return np.repeat(np.arange(len(self.width), dtype=np.uint16), self.width.astype(np.int64))

    def pack(self) -> bytes:
        step = np.diff(self.ids, prepend=np.uint32(0)).astype("<u4")
        planes = step.view(np.uint8).reshape(-1, 4).T.tobytes() + self.classes.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()
        return struct.pack("<I", len(self.ids)) + zlib.compress(planes)

    @classmethod
    def unpack(cls, data: bytes) -> Prior:
        n = struct.unpack_from("<I", data)[0]
        planes = np.frombuffer(zlib.decompress(data[4:]), np.uint8).reshape(6, n)
        step = np.ascontiguousarray(planes[:4].T).view("<u4").ravel()
        return cls(np.cumsum(step, dtype=np.uint64).astype(np.uint32), np.ascontiguousarray(planes[4:].T).view("<u2").ravel().astype(np.uint16))


def _tables(priors: list[Prior], decode: bool):
    """Of the different priors of lanes: (number of each lane's table, its first group, first rare place and bits; starts << 16 | widths less 1; slots)."""
    number: dict[int, int] = {}
    some: list[Prior] = []
    of = np.array([number.setdefault(id(p), len(number)) for p in priors], np.int64)
    for p in priors:
        if number[id(p)] == len(some):
            some.append(p)
    sizes = [len(p.width) for p in some]
    first = np.cumsum([0, *sizes[:-1]])
    rare = [int((p.width >= _FREQUENT).sum()) << p.bits for p in some]
    both = np.concatenate([p.start << np.uint64(16) | (p.width - np.uint64(1)) for p in some]).astype(np.uint32)
    slots = np.concatenate([p.slots() for p in some]) if decode else np.zeros(0, np.uint16)
    return of, first[of], np.array(rare, np.uint32)[of], np.array([p.bits for p in some], np.uint64)[of], both, slots


class _Mixture:
    """The two adaptive models of the symbols of all lanes, mixed in step: row k is lane k.

    Models are rows of four lower bounds, the first always 0.  Whole rows are put
    back through a view of 16-byte items.
    """

    def __init__(self, n: int):
        even = np.arange(4, dtype=np.int32) << (_TOTAL - 2)
        # the model without context, and the one that the lane's context picks of its 16
        self.both, self.goal = np.tile(even, (2, n, 1)), np.zeros((n, 4), np.int32)
        self.rows = np.tile(even, (n * 16, 1)).view(np.complex128).ravel()
        self.good = np.full((2, n), 1 << (_TOTAL - 2), np.int32)
        # their weights, once for each of the four symbols: products of equal shape are fast
        self.weights = np.full((2, n, 4), 1 << (_WEIGHT - 1), np.int32)
        # mixed lower bounds, and a 0 behind them: where the next row begins, the whole ends
        self.bounds = np.zeros(4 * n + 1, np.int32)
        self.upper = self.bounds[1:]
        self.lane_context, self.lane_row = np.arange(n) * 16, np.arange(n) * 4
        self.cut(n)

    def cut(self, a: int) -> None:
        """Go on with the first ``a`` lanes."""
        self.both, self.good, self.weights = (np.ascontiguousarray(x[:, :a]) for x in (self.both, self.good, self.weights))
        self.lane_context, self.lane_row, self.goal = self.lane_context[:a], self.lane_row[:a], self.goal[:a]
        self.mixed = self.bounds[: 4 * a].reshape(a, 4)
        self.products, self.steps = np.empty_like(self.both), np.empty_like(self.both)
        self.picked, self.aim = self.both[1].view(np.complex128).ravel(), self.goal.view(np.complex128).ravel()
        self.flat = self.both.reshape(2, -1)

    def mix(self, context: np.ndarray) -> None:
        """The mixed bounds, given each lane's context."""
        self.context = self.lane_context + context
        self.rows.take(self.context, out=self.picked, mode="clip")
        np.multiply(self.both, self.weights, out=self.products)
        np.add(self.products[0], self.products[1], out=self.mixed)

    def parts(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower bound, width) of a symbol of each lane."""
        self.symbol, self.pick = s, self.lane_row + s
        below = self.bounds.take(self.pick)
        return below.astype(np.uint64), ((self.upper.take(self.pick) - below) & _WHOLE).astype(np.uint64)

    def learn(self, weigh: bool) -> None:
        """Move to the symbols that ``parts`` was asked for; set the weights if asked."""
        if weigh:
            for good, m in zip(self.good, self.flat):
                got = (m.take(self.pick + 1, mode="wrap") - m.take(self.pick)) & ((1 << _TOTAL) - 1)
                good += (got - good) >> 3
            first = self.good[0] * ((1 << _WEIGHT) - 2) // (self.good[0] + self.good[1]) + 1
            self.weights[0] = first[:, None]
            np.subtract(1 << _WEIGHT, self.weights[0], out=self.weights[1])
        _GOALS.take(self.symbol, out=self.aim, mode="clip")
        np.subtract(self.goal, self.both, out=self.steps)
        self.steps >>= 5
        self.both += self.steps
        self.rows[self.context] = self.picked


def _spreads(last: np.ndarray, turned: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Hashes of orders 1 and 2, given the last id and how order 2 takes the one before."""
    np.multiply(last, np.uint32(0x9E3779B1), out=out[0])
    np.bitwise_xor(out[0], turned, out=out[1])
    out >>= np.uint32(32 - _SLOTS_BITS)
    return out


def _turned(last: np.ndarray) -> np.ndarray:
    """An id as the hash of order 2 takes it two ids later."""
    return (last * np.uint32(0x85EBCA6B)) ^ (last >> np.uint32(3))


def _guesses(ids: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of whole blocks, one a row: (symbols | contexts << 2; which are right by order 0).

    What the decoder finds in its tables: the latest id behind the same hash, and
    how often in a row (to 3) such ids were right.  Here the places of a row are
    sorted by hash, so that the one before is the neighbour.
    """
    rows, steps = ids.shape
    bits, flat = np.uint32(max(1, (steps - 1).bit_length())), ids.reshape(-1)
    begin, within = np.arange(rows)[:, None] * steps, np.arange(steps, dtype=np.uint32)
    last, turned = np.zeros((2, rows, steps), np.uint32)
    last[:, 1:] = ids[:, :-1]
    turned[:, 1:] = _turned(last[:, :-1])
    hits, sure = np.empty((2, 2, rows * steps), np.uint8)
    for k, h in enumerate(_spreads(last, turned, np.empty((2, rows, steps), np.uint32))):
        h <<= bits
        h |= within
        h.sort(axis=1)
        place = ((h & ((np.uint32(1) << bits) - np.uint32(1))) + begin).ravel()
        h >>= bits
        once = np.zeros((rows, steps), bool)  # right once at least, then twice, three times
        np.equal(h[:, 1:], h[:, :-1], out=once[:, 1:])
        once = once.ravel()
        x = flat.take(place)
        before = np.zeros_like(x)
        np.multiply(x[:-1], once[1:], out=before[1:])
        right = x == before
        once[1:] &= right[:-1]
        twice = once.copy()
        twice[1:] &= once[:-1]
        often = twice.copy()
        often[1:] &= twice[:-1]
        hits[k][place] = right
        sure[k][place] = once.view(np.uint8) + twice.view(np.uint8) + often.view(np.uint8)
    # the first prediction that is right: 0 (order 2), 1 (order 1) or 2 (order 0); else 3
    notes = (np.uint8(1) - hits[1]) * (np.uint8(3) - (hits[0] << np.uint8(1)))
    some = np.flatnonzero(((notes == 3).reshape(rows, steps) & (ids >= rare[:, None])).ravel())
    x = flat.take(some).astype(np.uint64)
    # by lane, low byte and place; what lies behind the last 32 bits tells the same slot
    keys = (some // steps).astype(np.uint64) << np.uint64(40) | (x & np.uint64(255)) << np.uint64(32) | some.astype(np.uint64)
    keys.sort()
    some = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    keys >>= np.uint64(32)
    x = flat.take(some)
    before = np.zeros_like(x)
    np.multiply(x[:-1], keys[1:] == keys[:-1], out=before[1:])
    some = some[x == before]
    notes[some] = 2
    notes |= (sure[1] << np.uint8(4)) | (sure[0] << np.uint8(2))
    return notes.reshape(rows, steps), some


def _shrink(span: np.ndarray) -> np.ndarray:
    """Bits that leave the coder: the highest words of small spans (never more than two); spans are widened."""
    bits = ((span < _LEAST).view(np.uint8) + (span < _LESS).view(np.uint8)) << np.uint8(4)
    span <<= bits
    return bits


def _encoded(blocks: list[np.ndarray], priors: list[Prior]) -> list[bytes]:
    """Code lanes in step; their lengths must not increase.

    The range coder's number is the sum of the lower ends of all steps, each
    shifted by the bits that had left before: they are kept and added at the end.
    """
    n = len(blocks)
    lengths = np.array([len(b) for b in blocks], np.int64)
    steps = int(lengths[0])
    of, row_group, rare, shared, both, _ = _tables(priors, False)
    turns = 2 if shared.any() else 1  # some groups have several ids, told apart by a second part
    notes, tails = np.zeros((steps, n), np.uint8), np.zeros((steps, n), np.uint32)
    rests = np.zeros((steps, n), np.uint32) if turns > 1 else None
    for a in range(0, n, _ROWS):
        b, m = min(n, a + _ROWS), int(lengths[a])
        ids = np.zeros((b - a, m), np.uint32)
        for r in range(a, b):
            ids[r - a, : lengths[r]] = priors[r].places(blocks[r])
        note, some = _guesses(ids, rare[a:b])
        more = shared[a:b, None].astype(np.uint32)
        none = (note & np.uint8(3)) == 3
        # start << 16 | width less 1 of what follows each symbol
        held = both.take(row_group[a:b, None] + (ids >> more), mode="clip") * none
        held.reshape(-1)[some] = (ids.reshape(-1).take(some) & np.uint32(255)) << np.uint32(16)
        notes[:m, a:b], tails[:m, a:b] = note.T, held.T
        if turns > 1:
            rests[:m, a:b] = (ids & ((np.uint32(1) << more) - np.uint32(1)) * none).T
    lows, left = np.zeros((steps * turns, n), np.uint64), np.zeros((steps * turns, n), np.uint8)
    span, mixture, active = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF)), _Mixture(n), n
    ends = np.searchsorted(-lengths, -np.arange(steps), "left").tolist()  # lanes longer than t
    for t, a in enumerate(ends):
        if a != active:
            active = a
            mixture.cut(a)
            span, shared = span[:a], shared[:a]
        note, held = notes[t, :a], tails[t, :a]
        s = (note & np.uint8(3)).astype(np.intp)
        mixture.mix(note >> np.uint8(2))
        below, part = mixture.parts(s)
        unit = span >> _UNIT
        part *= unit
        part >>= _TAIL.take(s)
        below *= unit
        below += part * (held >> np.uint32(16))
        lows[t * turns, :a] = below
        span = part * ((held & np.uint32(65535)) + np.uint32(1))
        left[t * turns, :a] = _shrink(span)
        if turns > 1:
            span >>= shared * (s == 3)
            lows[2 * t + 1, :a] = span * rests[t, :a]
            left[2 * t + 1, :a] = _shrink(span)
        mixture.learn(not t & 7)
    return [w for a in range(0, n, _ROWS) for w in _sums(lows[:, a : a + _ROWS], left[:, a : a + _ROWS])]


def _sums(lows: np.ndarray, left: np.ndarray) -> list[bytes]:
    """The words of lanes (columns), of the lower ends and the bits that left behind each."""
    lanes, steps = lows.shape[1], len(lows)
    gone = np.cumsum(left.T >> np.uint8(4), axis=1, dtype=np.int64)
    used = gone[:, -1] + 4
    width = int(used.max())
    at = np.zeros((lanes, steps), np.int64)
    at[:, 1:] = gone[:, :-1]
    at += np.arange(lanes)[:, None] * width
    at = at.ravel()
    # ends that begin at the same word add up within 64 bits; then words of 16 bits, and their carries
    new = np.flatnonzero(np.diff(at, prepend=-1))
    total, at = np.add.reduceat(np.ascontiguousarray(lows.T).ravel(), new), at[new]
    words = np.zeros(lanes * width, np.uint32)
    for k in range(4):  # the places of one k all differ
        words[at + k] += ((total >> np.uint64(48 - 16 * k)) & np.uint64(65535)).astype(np.uint32)
    over = np.flatnonzero(words >> np.uint32(16))
    while len(over):
        carried = words[over] >> np.uint32(16)
        words[over] &= np.uint32(65535)
        words[over - 1] += carried
        over = over - 1
        over = over[words[over] > 65535]
    rows = words.reshape(lanes, width).astype("<u2")
    return [row[:k].tobytes() for row, k in zip(rows, used.tolist())]


def _decoded(lengths: np.ndarray, words: np.ndarray, priors: list[Prior]) -> np.ndarray:
    """Decode lanes in step: (lanes, any) words of uint16 to (lanes, longest) places.  ``lengths`` must not increase."""
    n, steps = len(lengths), int(lengths[0])
    table, row_group, rare, shared, both, slot_of = _tables(priors, True)
    row_part, wide_ids = table << 16, bool(shared.any())
    lane = np.arange(n)
    # the next two words at each place
    stream = words.reshape(-1).astype(np.uint32)
    stream <<= np.uint32(16)
    stream[:-1] |= words.reshape(-1)[1:]
    at = lane * words.shape[1]
    # how far the code lies above the lower end of the span
    low = stream.take(at).astype(np.uint64) << np.uint64(32) | stream.take(at + 2)
    at += 4
    span, mixture, active = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF)), _Mixture(n), n
    out = np.zeros((steps, n), np.uint32)
    # predicted id << 2 | confidence, of orders 1 and 2, as a flat table of (order, lane, hash)
    slots = 1 << _SLOTS_BITS
    entries, row_slots = np.zeros(2 * n * slots, np.uint32), np.arange(2 * n).reshape(2, n) * slots
    zeroth, row_bytes = np.zeros(n * 256, np.uint32), lane * 256
    # the last id, and the one before it as the hash of order 2 takes it
    last, turned = np.zeros((2, n), np.uint32)
    spreads = np.empty((2, n), np.uint32)
    one, two, three, half, lower_half = np.uint32(1), np.uint32(2), np.uint32(3), np.uint32(16), np.uint32(65535)
    ends = np.searchsorted(-lengths, -np.arange(steps), "left").tolist()  # lanes longer than t
    for t, a in enumerate(ends):
        if a != active:
            active = a
            mixture.cut(a)
            row_slots, spreads = np.ascontiguousarray(row_slots[:, :a]), np.empty((2, a), np.uint32)
            row_bytes, row_group, row_part, rare, shared, low, span, at, last, turned = (x[:a] for x in (row_bytes, row_group, row_part, rare, shared, low, span, at, last, turned))
        slot = row_slots + _spreads(last, turned, spreads)
        entry = entries.take(slot)
        guess, sure = entry >> two, entry & three
        mixture.mix((sure[1] << two) | sure[0])
        unit, mixed = span >> _UNIT, mixture.mixed
        value = (low // unit).astype(np.int32)
        s = (value >= mixed[:, 1]).view(np.int8) + (value >= mixed[:, 2]).view(np.int8)
        s += value >= mixed[:, 3]
        long_s = s.astype(np.intp)
        below, part = mixture.parts(long_s)
        below *= unit
        low -= below
        part *= unit
        part >>= _TAIL.take(long_s)
        span = part
        # by order 2 or 1, without a branch
        x = (guess[0] ^ guess[1]) * (s == 0)
        x ^= guess[0]
        some = (s == 2).nonzero()[0]
        wide, lo = span.take(some), low.take(some)
        tail = np.minimum(lo // wide, np.uint64(255))
        low[some] = lo - wide * tail
        x[some] = zeroth.take(row_bytes.take(some) + tail.view(np.int64))
        none = (s == 3).nonzero()[0]
        wide, lo = span.take(none), low.take(none)
        found = slot_of.take(row_part.take(none) + np.minimum(lo // wide, np.uint64(65535)).view(np.int64))
        held = both.take(row_group.take(none) + found)
        low[none] = lo - wide * (held >> half)
        span[none] = wide * ((held & lower_half) + one)
        if wide_ids:
            bits = _shrink(span)
            low <<= bits
            low |= stream.take(at, mode="clip") >> (np.uint8(32) - bits)
            at += bits >> np.uint8(4)
            more = shared.take(none)
            wide, lo = span.take(none) >> more, low.take(none)
            span[none] = wide
            rest = np.minimum(lo // wide, (np.uint64(1) << more) - np.uint64(1))
            low[none] = lo - wide * rest
            found = (found.astype(np.uint32) << more.astype(np.uint32)) | rest.astype(np.uint32)
        x[none] = found
        out[t, :a] = x
        far = (found >= rare.take(none)).nonzero()[0]
        found = found.take(far)
        zeroth[row_bytes.take(none.take(far)) + (found & 255)] = found
        # of a damaged block anything may be read: its checksum tells
        bits = _shrink(span)
        low <<= bits
        low |= stream.take(at, mode="clip") >> (np.uint8(32) - bits)
        at += bits >> np.uint8(4)
        mixture.learn(not t & 7)
        sure += one
        np.minimum(sure, three, out=sure)
        sure *= guess == x
        sure |= x << two
        entries[slot.reshape(-1)] = sure.reshape(-1)
        turned, last = _turned(last), x
    return np.ascontiguousarray(out.T)


def _parts(order: list[int]) -> list[list[int]]:
    """About LANES at a time, evenly: a few lanes take as many steps as many."""
    count = max(1, (len(order) + LANES // 2) // LANES)
    cuts = [len(order) * k // count for k in range(count + 1)]
    return [order[a:b] for a, b in zip(cuts, cuts[1:]) if a < b]


def encode_blocks(blocks: list[np.ndarray], priors: list[Prior]) -> list[bytes]:
    """The coded words of each block of ids (at most BLOCK, not empty), by the prior of its frame."""
    out: list[bytes] = [b""] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
    for part in _parts(order):
        for k, words in zip(part, _encoded([blocks[k] for k in part], [priors[k] for k in part])):
            out[k] = words
    return out


def decode_blocks(blocks: list[tuple[int, bytes]], priors: list[Prior]) -> list[np.ndarray]:
    """The ids of blocks given as (number of ids, coded words)."""
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda k: -blocks[k][0])
    for part in _parts(order):
        lengths = np.array([blocks[k][0] for k in part], np.int64)
        words = np.zeros((len(part), max(len(blocks[k][1]) // 2 for k in part) + 8), np.uint16)
        for r, k in enumerate(part):
            w = np.frombuffer(blocks[k][1], "<u2")
            words[r, : len(w)] = w
        ids = _decoded(lengths, words, [priors[k] for k in part])
        for r, k in enumerate(part):
            out[k] = priors[k].order.take(ids[r, : lengths[r]], mode="clip")
    return out


def pack_frame(doc_ids: np.ndarray, sizes: np.ndarray, prior: Prior, blocks: list[tuple[int, int, bytes]]) -> bytes:
    """A frame: header, document ids (int64) and sizes, frequencies, then the blocks with number of ids and CRC-32."""
    held = prior.pack()
    head = MAGIC + struct.pack("<III", len(doc_ids), len(blocks), len(held))
    table = b"".join(struct.pack("<III", n, crc, len(data)) for n, crc, data in blocks)
    body = head + doc_ids.astype("<i8").tobytes() + sizes.astype("<u4").tobytes() + held + table
    return body + struct.pack("<I", zlib.crc32(body)) + b"".join(data for *_, data in blocks)


def unpack_frame(frame: bytes) -> tuple[np.ndarray, np.ndarray, Prior, list[tuple[int, int, bytes]]]:
    """(document ids, sizes, frequencies, blocks); raises ValueError if the header is damaged."""
    if frame[:4] != MAGIC:
        raise ValueError("not a token frame")
    docs, count, held = struct.unpack_from("<III", frame, 4)
    at = 16 + 12 * docs + held
    if at + 12 * count + 4 > len(frame) or zlib.crc32(frame[: at + 12 * count]) != struct.unpack_from("<I", frame, at + 12 * count)[0]:
        raise ValueError("damaged frame header")
    ids, sizes = np.frombuffer(frame, "<i8", docs, 16), np.frombuffer(frame, "<u4", docs, 16 + 8 * docs)
    table = [struct.unpack_from("<III", frame, at + 12 * k) for k in range(count)]
    prior = Prior.unpack(frame[at - held : at])
    at += 12 * count + 4
    blocks = []
    for n, crc, size in table:
        blocks.append((n, crc, frame[at : at + size]))
        at += size
    return ids, sizes, prior, blocks


class HashIndex:
    """64-bit hash -> number, for arrays: open addressing, linear probing, growing."""

    def __init__(self, bits: int = 16):
        self.bits, self.count = bits, 0
        self.keys, self.numbers = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Numbers, -1 for unknown hashes."""
        slot, mask = self._slot(keys), len(self.keys) - 1
        out = self.numbers.take(slot)
        open_ = np.flatnonzero((out >= 0) & (self.keys.take(slot) != keys))
        while len(open_):
            slot[open_] = place = (slot[open_] + 1) & mask
            found = self.numbers.take(place)
            out[open_] = found
            open_ = open_[(found >= 0) & (self.keys.take(place) != keys[open_])]
        return out

    def put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Add distinct hashes that aren't there."""
        if 2 * (self.count + len(keys)) > len(self.keys):
            held = self.numbers >= 0
            old = self.keys[held], self.numbers[held]
            while 2 * (len(old[0]) + len(keys)) > 1 << self.bits:
                self.bits += 1
            self.keys, self.numbers, self.count = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32), 0
            self.put(*old)
        self.count += len(keys)
        slot, mask = self._slot(keys), len(self.keys) - 1
        while len(keys):
            free = np.flatnonzero(self.numbers.take(slot) < 0)
            _, one = np.unique(slot[free], return_index=True)
            now = free[one]
            self.keys[slot[now]], self.numbers[slot[now]] = keys[now], numbers[now]
            rest = np.ones(len(keys), bool)
            rest[now] = False
            keys, numbers, slot = keys[rest], numbers[rest], (slot[rest] + 1) & mask


# Classes of bytes for the split: what isn't listed makes a text go to the library whole.
_OTHER, _LETTER, _DIGIT, _MARK, _WHITE, _EDGE = 0, 1, 2, 3, 4, 5
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = _MARK
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[[0x09, 0x0A, 0x0D, 0x20]] = _WHITE
#: The second byte of characters U+00A1 to U+00BF and U+00C0 to U+00FF.
_AFTER_C2, _AFTER_C3 = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
_AFTER_C2[0xA1:0xC0] = _MARK
_AFTER_C2[[0xAA, 0xB5, 0xBA]] = _LETTER
_AFTER_C2[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _DIGIT
_AFTER_C3[0x80:0xC0] = _LETTER
_AFTER_C3[[0x97, 0xB7]] = _MARK


def split_bytes(buffer: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first bytes, ends, texts to leave alone) of the pieces of a piece's texts.

    The pieces are those of the byte-level split: contractions, then runs of
    letters, digits or other marks with a space before them, then white space;
    a run of white space leaves its last character to what follows.
    """
    n = len(buffer)
    kind = _CLASS.take(buffer)
    for lead, after in ((0xC2, _AFTER_C2), (0xC3, _AFTER_C3)):
        at = np.flatnonzero(buffer[:-1] == lead)
        kind[at] = kind[at + 1] = after.take(buffer[at + 1])
    gaps = starts - 1  # the byte before each text, and the one behind the last
    kind[gaps] = _EDGE
    odd = (kind == _OTHER).astype(np.int32)
    mark = np.flatnonzero((buffer[:-1] == 0x3C) & (buffer[1:] == 0x7C))  # "<|" may begin an added token
    odd[mark] = 1
    bad = np.add.reduceat(odd, gaps[:-1]) > 0
    begin = np.r_[0, np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == _EDGE)) + 1]
    end = np.r_[begin[1:], n]
    kinds = kind[begin]
    follows = np.r_[kinds[1:], _EDGE]
    first = np.zeros(n, bool)
    first[begin] = True
    # the last character of white space that something follows: alone, or a space that joins it
    white = np.flatnonzero((kinds == _WHITE) & (follows != _EDGE))
    tail = end[white] - 1
    first[tail] = True
    first[end[white][buffer[tail] == 0x20]] = False
    # contractions: a lone apostrophe that no space has joined, and the letters behind it
    alone = np.flatnonzero((kinds == _MARK) & (follows == _LETTER) & (end - begin == 1) & (buffer[begin] == 0x27))
    alone = alone[first[begin[alone]]]
    if len(alone):
        a = end[alone]
        size = end[alone + 1] - a
        x, y = buffer[a], buffer[np.minimum(a + 1, n - 1)]
        single = np.isin(x, np.frombuffer(b"stmd", np.uint8))
        double = (size >= 2) & (((x == 0x72) & (y == 0x65)) | ((x == 0x76) & (y == 0x65)) | ((x == 0x6C) & (y == 0x6C)))
        took = np.where(single, 1, np.where(double, 2, 0))
        hit = took > 0
        first[a[hit]] = False
        rest = hit & (size > took)
        first[a[rest] + took[rest]] = True
    where = np.flatnonzero(first)
    ends = np.r_[where[1:], n]
    real = kind[where] != _EDGE
    return where[real], ends[real], bad


class PieceIds:
    """Ids by the tokenizers library, each distinct piece of a split text encoded once."""

    def __init__(self, path: str):
        # a task has one core; the library's threads would only get in each other's way
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # the split of ``split_bytes``; texts of other vocabularies go to the library whole
        split = spec["pre_tokenizer"] or {}
        self.splits = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and all(t["content"].startswith("<|") for t in spec["added_tokens"])
        line = self.library.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.forget()

    def forget(self) -> None:
        self.index = HashIndex()
        self.first, self.size, self.held, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0

    def _encoded(self, data: bytes, first: list[int], end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the pieces ``data[first:end]``, number of each).

        The library is slow at very many short texts.  Pieces that aren't white
        space go to it in lines: the split cuts at a line's end, which is one id,
        and leaves the piece before and behind it as it was.
        """
        parts = [data[a:b] for a, b in zip(first, end)]
        if self.line is not None and not any(p.isspace() for p in parts):
            texts = [(b"\n".join(parts[k : k + LINES]) + b"\n").decode() for k in range(0, len(parts), LINES)]
            flat = np.concatenate([_narrow(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)])
            mark = flat == self.line
            ends = np.flatnonzero(mark)
            if len(ends) == len(parts):
                return flat[~mark], np.diff(ends, prepend=-1) - 1
        found = [e.ids for e in self.library.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]
        return _narrow([k for f in found for k in f]), np.array([len(f) for f in found], np.int64)

    def _append(self, flat: np.ndarray, size: np.ndarray) -> None:
        base = self.index.count
        while len(self.held) < self.used + len(flat):
            self.held = np.r_[self.held, np.zeros_like(self.held)]
        while len(self.first) < base + len(size):
            self.first, self.size = np.r_[self.first, self.first], np.r_[self.size, self.size]
        self.held[self.used : self.used + len(flat)] = flat
        self.first[base : base + len(size)] = self.used + np.cumsum(size) - size
        self.size[base : base + len(size)] = size
        self.used += len(flat)

    def numbers(self, buffer: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each piece; new pieces are encoded."""
        hashes = hash_spans(buffer, first, end)
        out = self.index.get(hashes)
        new = np.flatnonzero(out < 0)
        if len(new):
            if self.index.count + len(new) > CACHE_PIECES and self.index.count:
                self.forget()
                return self.numbers(buffer, first, end)
            once, at = np.unique(hashes[new], return_index=True)
            at = new[at]
            # white space by itself
            white = _CLASS.take(buffer.take(end[at] - 1)) == _WHITE
            data = buffer.tobytes()
            for some in (np.flatnonzero(~white), np.flatnonzero(white)):
                if len(some):
                    base, place = self.index.count, at[some]
                    self._append(*self._encoded(data, first[place].tolist(), end[place].tolist()))
                    self.index.put(once[some], np.arange(base, base + len(some), dtype=np.int32))
            out[new] = self.index.get(hashes[new])
        return out

    def encode(self, raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a column, as ``encode(text, add_special_tokens=False)`` gives them."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * (len(at) - 1)
        if not self.splits:
            data = raw.tobytes()
            return [_narrow(self.library.encode(data[a:b].decode(), add_special_tokens=False).ids) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        whole = np.flatnonzero(np.diff(at) > PIECE_BYTES).tolist()
        long = set(whole)
        for rows, starts, buffer in pieces(raw, at):
            first, end, bad = split_bytes(buffer, starts)
            if bad.any():
                whole += rows[bad].tolist()
                text = np.searchsorted(starts, first, "right") - 1
                good = ~bad[text]
                first, end = first[good], end[good]
            if len(first):
                k = self.numbers(buffer, first, end)
                size = self.size.take(k)
                ends = np.cumsum(size)
                ids = self.held.take(np.arange(ends[-1]) + np.repeat(self.first.take(k) - (ends - size), size))
                bounds = np.r_[0, ends].take(np.searchsorted(first, starts))
                for r, a, b in zip(rows.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    out[r] = ids[a:b]
        data = raw.tobytes() if whole else b""
        for r in set(whole) | long:
            out[r] = _narrow(self.library.encode(data[at[r] : at[r + 1]].decode(), add_special_tokens=False).ids)
        return out


def _narrow(ids: list[int]) -> np.ndarray:
    """Ids as uint32."""
    return np.array(ids, np.uint32)


@lru_cache(maxsize=2)
def piece_ids(path: str) -> PieceIds:
    """The encoder, read once in each worker."""
    return PieceIds(path)


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int) -> None:
    """Write the ids of all documents, each with ``end_id`` behind, to ``folder``.

    The folder is a Parquet table (so that any file system that Spark writes
    will do) of frames in order: part, seq, before (ids earlier in the part),
    n_docs, n_tokens, frame.  Documents lie in ascending doc_id; rows of the same
    id in the order of their texts; rows without id come first, their id written
    as the smallest long.  Null texts are empty: they have the end id alone.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")

    def run(batches):
        encoder = piece_ids(path)
        part = TaskContext.get().partitionId()
        seq = before = 0
        ready: list[tuple] = []  # frames whose blocks wait for coding
        ids: list[int] = []
        parts: list[np.ndarray] = []
        held = 0

        def close():
            nonlocal ids, parts, held
            if ids:
                ready.append((np.array(ids, np.int64), np.array([len(p) for p in parts], np.int64), np.concatenate(parts)))
            ids, parts, held = [], [], 0

        def coded():
            nonlocal seq, before, ready
            priors = [Prior.of(s) for *_, s in ready]
            blocks = [s[k : k + BLOCK] for *_, s in ready for k in range(0, len(s), BLOCK)]
            words = iter(encode_blocks(blocks, [p for p, (*_, s) in zip(priors, ready) for _ in range(0, len(s), BLOCK)]))
            columns = []
            for prior, (doc_ids, sizes, stream) in zip(priors, ready):
                cut = [stream[k : k + BLOCK] for k in range(0, len(stream), BLOCK)]
                frame = pack_frame(doc_ids, sizes, prior, [(len(c), zlib.crc32(c.astype("<u4").tobytes()), next(words)) for c in cut])
                columns.append((part, seq, before, len(doc_ids), len(stream), frame))
                seq, before = seq + 1, before + len(stream)
            ready = []
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*columns), kinds)], names=["part", "seq", "before", "n_docs", "n_tokens", "frame"])

        end = np.array([end_id], np.uint32)
        for batch in batches:
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), encoder.encode(*utf8_views(batch.column("text")))):
                ids.append(-(1 << 63) if doc_id is None else doc_id)
                parts.append(np.concatenate([found, end]))
                held += len(parts[-1])
                if held >= FRAME:
                    close()
            if sum(-(-len(s) // BLOCK) for *_, s in ready) >= LANES:
                yield coded()
        close()
        if ready:
            yield coded()

    rows.mapInArrow(run, "part int, seq long, before long, n_docs long, n_tokens long, frame binary").write.mode("overwrite").parquet(folder)


def read_tokens(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """Every document of a folder: doc_id, start, n_tokens, ids_crc32 (and ids, if asked).

    Blocks are decoded and held against their checksums; a mismatch raises.
    """
    frames = spark.read.parquet(folder)
    # one row per part: as many as the writing job had tasks
    totals = sorted((r["part"], r["n"]) for r in frames.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    offset, total = {}, 0
    for part, n in totals:
        offset[part], total = total, total + n
    shared = spark.sparkContext.broadcast(offset)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")

    def emit(held):
        blocks = [(n, data) for *_, cut in held for n, _, data in cut]
        decoded = iter(decode_blocks(blocks, [prior for *_, prior, cut in held for _ in cut]))
        for part, before, doc_ids, sizes, _, cut in held:
            streams = [next(decoded) for _ in cut]
            for s, (_, crc, _) in zip(streams, cut):
                if zlib.crc32(s.astype("<u4").tobytes()) != crc:
                    raise ValueError("damaged block of ids")
            stream = np.concatenate(streams).astype("<u4")
            ends = np.cumsum(sizes.astype(np.int64))
            begins = ends - sizes
            crcs = [zlib.crc32(stream[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist())]
            null = doc_ids == -(1 << 63)
            columns = [pa.array(doc_ids, pa.int64(), mask=null), pa.array(begins + before + shared.value[part], pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())]
            if ids:
                columns.append(pa.array([stream[a:b].astype(np.int32) for a, b in zip(begins.tolist(), ends.tolist())], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids])

    def run(batches):
        held, lanes = [], 0
        for batch in batches:
            for part, before, frame in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "frame"))):
                held.append((part, before, *unpack_frame(frame)))
                lanes += len(held[-1][-1])
                if lanes >= LANES:
                    yield from emit(held)
                    held, lanes = [], 0
        if held:
            yield from emit(held)

    return frames.select("part", "before", "frame").mapInArrow(run, schema)
