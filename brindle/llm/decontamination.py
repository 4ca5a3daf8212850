"""Benchmark decontamination by template windows.

Texts are canonicalised to templates: numbers become one placeholder, units
after a number another, and runs of capitalised words inside a sentence a third
(names).  Windows of canonical words are hashed; a document's windows are
hash-joined with those of the benchmark.  Hits of one item that lie on one
diagonal are an alignment; any of them is a leak that covers enough of the item's
windows and whose slots agree: one value of an item's slot stands for one value
of the document's, and the other way round.  A re-parameterised question is
caught that way, and prose that only shares placeholders is not.  Alignments of at
least ``EXACT`` canonical words that lie in the item's order add up.

Beside the templates, windows of ``EXACT`` lower-cased words as they stand are
joined too, so that a verbatim copy is found whatever its case and whatever
its words are made of; one such window is a leak, however long the item.  An item
of at most ``EXACT`` words, or without a window of enough words that are no
numbers, is looked for as a whole.  Items made mostly of numbers and names have
longer windows with fewer other words (``widths``), and short ones are one window.

The benchmark's windows are sent to all tasks as one block of at most
``BLOCK_WINDOWS``.  A larger benchmark is cut into such blocks.  A bit map of all
windows (``MAP_BITS``) then picks the documents that can have a leak; these are
stored, and the blocks pass over them one after the other, so that no task holds
two.

Null and empty texts have no leaks; null items and items of fewer than
``LEAST_WORDS`` words are skipped; items of numbers alone are found verbatim only;
repeated items and repeated documents give repeated rows; empty tables give
empty results.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.scratch import Scratch
from brindle.llm.textbytes import class_table, hash_spans, pieces, splitmix, utf8_views

#: Canonical words of a window, and how many of them must be no placeholders.
WINDOW, LEAST_PLAIN = 5, 3
#: Words of an exact window.
EXACT = 8
#: Windows of items without any of those: canonical words, and plain ones among them.
SPARSE, LEAST_SPARSE = 8, 2
#: Bits of the map of all windows of a large benchmark.
MAP_BITS = 27
#: Items with fewer words can't be told from chance.
LEAST_WORDS = 3
#: Share of an item's windows that an alignment covers, and of its slots that agree.
LEAST_COVER, LEAST_AGREE = 0.5, 0.75
#: Places by which an alignment may shift (words added or left out).
BAND = 3
#: Windows of the benchmark that tasks hold at a time.
BLOCK_WINDOWS = 1_000_000

#: Units that may follow a number.
UNITS = "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg lb lbs oz ounce ounces ton tons tonne tonnes ml l litre litres liter liters gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents pound pounds degree degrees hz khz mhz ghz kb mb gb tb watt watts kw volt volts".split()

PLAIN, NUMBER, NAME, UNIT = 0, 1, 2, 3
_SLOT = splitmix(np.array([11, 22, 33, 44], np.uint64))
_FACTORS = splitmix(np.arange(201, 233, dtype=np.uint64)) | np.uint64(1)
_WORDS = class_table("word", False)
_STOP = np.zeros(256, np.int64)
_STOP[list(b".!?:;\n\"")] = 1


def _hashes(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    size = np.array([len(w.encode()) for w in words])
    first = np.cumsum(size + 1) - size - 1
    return hash_spans(np.frombuffer(data, np.uint8), first, first + size)


_UNIT_HASHES = np.sort(_hashes(UNITS))


@dataclass
class Template:
    """Canonical words of a text: hash, hash of what was there, kind, number of the word.

    words, number: hash of every lower-cased word, and whether it is a number.
    """

    canon: np.ndarray
    raw: np.ndarray
    kind: np.ndarray
    word: np.ndarray
    words: np.ndarray
    number: np.ndarray

    @staticmethod
    def join(parts: list[Template]) -> Template:
        if len(parts) == 1:
            return parts[0]
        shift = np.cumsum([0, *[len(p.words) for p in parts[:-1]]])
        whole = {c: np.concatenate([getattr(p, c) for p in parts]) for c in ("canon", "raw", "kind", "words", "number")}
        return Template(word=np.concatenate([p.word + k for p, k in zip(parts, shift)]), **whole)


def canonical(buffer: np.ndarray, starts: np.ndarray) -> tuple[Template, np.ndarray, np.ndarray]:
    """(template of all texts of a piece, bounds of each text in its canonical words, and in its words)."""
    mapped = _WORDS[buffer]
    # lower case: A-Z, and the capitals of U+00C0 to U+00DE
    after_c3 = np.r_[False, buffer[:-1] == 0xC3]
    high = after_c3 & (buffer >= 0x80) & (buffer <= 0x9E) & (buffer != 0x97)
    ascii_capital = (buffer >= 0x41) & (buffer <= 0x5A)
    low = np.where(ascii_capital | high, mapped + 32, mapped).astype(np.uint8)
    black = mapped != 32
    edge = np.flatnonzero(black[1:] != black[:-1]) + 1
    first, last = edge[0::2], edge[1::2]
    bounds = np.searchsorted(first, starts)
    if not len(first):
        none = np.zeros(0, np.uint64)
        return Template(none, none, np.zeros(0, np.int8), np.zeros(0, np.int64), none, np.zeros(0, bool)), bounds, bounds
    raw = hash_spans(low, first, last)
    text = np.searchsorted(starts, first, "right") - 1
    lead = np.r_[True, text[1:] != text[:-1]]
    digit = np.r_[0, np.cumsum((buffer >= 0x30) & (buffer <= 0x39))]
    number = digit[last] - digit[first] == last - first
    stops = np.r_[0, np.cumsum(_STOP[buffer])]
    opens = lead.copy()
    opens[1:] |= stops[first[1:]] > stops[last[:-1]]
    two = (buffer[first] == 0xC3) & (last - first > 1)
    second = np.minimum(first + 1 + two, len(buffer) - 1)
    capital = ascii_capital[first] | (two & high[np.minimum(first + 1, len(buffer) - 1)])
    shouted = ascii_capital[second] | ((buffer[second] == 0xC3) & high[np.minimum(second + 1, len(buffer) - 1)])
    name = capital & ~shouted & ~opens & ~number & (last - first > 1 + two)
    kind = np.zeros(len(first), np.int8)
    kind[number], kind[name] = NUMBER, NAME
    unit = np.zeros(len(first), bool)
    place = np.minimum(np.searchsorted(_UNIT_HASHES, raw), len(_UNIT_HASHES) - 1)
    unit[1:] = number[:-1] & ~lead[1:] & ~number[1:] & (_UNIT_HASHES[place] == raw)[1:]
    kind[unit] = UNIT
    keep = np.ones(len(first), bool)
    point = (buffer[last[:-1]] == 0x2E) | (buffer[last[:-1]] == 0x2C)
    keep[1:] &= ~(number[1:] & number[:-1] & ~lead[1:] & (first[1:] - last[:-1] == 1) & point)
    keep[1:] &= ~(name[1:] & name[:-1] & ~lead[1:])
    canon = np.where(kind == PLAIN, raw, _SLOT[kind])
    word = np.arange(len(first)) - bounds[:-1][text]
    kept_before = np.r_[0, np.cumsum(keep)]
    return Template(canon[keep], raw[keep], kind[keep], word[keep], raw, number), kept_before[bounds], bounds


def templates(raw: np.ndarray, at: np.ndarray):
    """Yield (row, template) of every text."""
    held: list[Template] = []
    holder = -1
    for rows, starts, buffer in pieces(raw, at):
        whole, bounds, word_bounds = canonical(buffer, starts)
        for k, row in enumerate(rows.tolist()):
            a, b = bounds[k], bounds[k + 1]
            u, v = word_bounds[k], word_bounds[k + 1]
            if row != holder:
                if holder >= 0:
                    yield holder, Template.join(held)
                held, holder = [], row
            held.append(Template(whole.canon[a:b], whole.raw[a:b], whole.kind[a:b], whole.word[a:b], whole.words[u:v], whole.number[u:v]))
    if holder >= 0:
        yield holder, Template.join(held)


def widths(t: Template) -> tuple[int, int]:
    """(canonical words of an item's windows, plain words that each of them has at least); (0, 0) for none."""
    n, plain = len(t.canon), t.kind == PLAIN
    size = min(WINDOW, n)
    tries = [(size, min(LEAST_PLAIN, size))]
    tries += [(SPARSE, LEAST_SPARSE), (SPARSE, 1)] if n > SPARSE else [(n, LEAST_SPARSE), *[(n, 1)] * (n >= WINDOW)]
    for size, least in tries:
        if n >= LEAST_WORDS and len(_plain_places(plain, size, least)):
            return size, least
    return 0, 0


def windows(t: Template, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first place, hash) of the windows with enough plain words."""
    if len(t.canon) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    good = _plain_places(t.kind == PLAIN, size, least)
    return good, _window_hashes(t.canon, size)[good]


def _window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    n = max(0, len(words) - size + 1)
    value = np.zeros(n, np.uint64)
    for k in range(size):
        value += words[k : n + k] * _FACTORS[k]
    return splitmix(value + np.uint64(size))


def _plain_places(plain: np.ndarray, size: int, least: int) -> np.ndarray:
    """First places of the windows with enough plain words."""
    before = np.r_[0, np.cumsum(plain)]
    return np.flatnonzero(before[size:] - before[:-size] >= least)


def _lookup(parts: list[tuple[int, np.ndarray, np.ndarray]]):
    """(hash, item, place, map of leading bits) of windows in order of hash."""
    item = np.concatenate([np.full(len(p), k) for k, p, _ in parts])
    place, value = (np.concatenate([x[c] for x in parts]) for c in (1, 2))
    order = np.argsort(value, kind="stable")
    maybe = np.zeros(1 << 20, bool)
    maybe[(value >> np.uint64(44)).astype(np.int64)] = True
    return value[order], item[order], place[order], maybe


def _equal(held, here: np.ndarray, hashed: np.ndarray, least: np.ndarray | None = None):
    """(item, place in the text, place in the item) of equal windows.

    With ``least`` (per item) only of items of which so many windows are there:
    counted first, on each different window of the text once, so that a window
    that very many items share costs no more than its items.
    """
    value, item, place, maybe = held
    some = np.flatnonzero(maybe[(hashed >> np.uint64(44)).astype(np.int64)])
    here, hashed = here[some], hashed[some]
    if least is not None and len(some):
        at, _ = _ranges(value, np.unique(hashed))
        found, count = np.unique(item[at], return_counts=True)
        found = found[count >= least[found]]
        at = np.sort(at[np.isin(item[at], found)])
        value, item, place = value[at], item[at], place[at]
    at, count = _ranges(value, hashed)
    return item[at], np.repeat(here, count), place[at]


def _ranges(value: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of equal values in the sorted ``value``, their number) for each hash."""
    a = np.searchsorted(value, hashed, "left")
    count = np.searchsorted(value, hashed, "right") - a
    return np.repeat(a - np.cumsum(count) + count, count) + np.arange(count.sum()), count


class BenchmarkIndex:
    """Windows of benchmark items, for lookups by hash."""

    def __init__(self, items: list[tuple[int, Template]]):
        self.ids = [i for i, _ in items]
        self.templates = [t for _, t in items]
        self.width: list[int] = []
        self.whole: list[bool] = []
        total = np.zeros(len(items), np.int64)
        found, exact = defaultdict(list), defaultdict(list)
        for k, t in enumerate(self.templates):
            size, least = widths(t)
            self.width.append(size)
            if size:
                place, value = windows(t, size, least)
                total[k] = len(place)
                found[size, least].append((k, place, value))
            size = min(EXACT, len(t.words))
            place = _plain_places(~t.number, size, LEAST_PLAIN) if len(t.words) > EXACT else np.zeros(0, np.int64)
            self.whole.append(not len(place))
            if len(t.words) >= LEAST_WORDS:
                place = place if len(place) else np.zeros(1, np.int64)
                exact[size].append((k, place, _window_hashes(t.words, size)[place]))
        self.total, self.least = total, LEAST_COVER * total
        self.sizes = {size: _lookup(parts) for size, parts in found.items()}
        self.exact = {size: _lookup(parts) for size, parts in exact.items()}

    def hits(self, t: Template) -> dict[int, np.ndarray]:
        """Per item number: (place in the text, place in the item) of equal template windows, if they may be enough."""
        out: dict[int, np.ndarray] = {}
        for (size, least), held in self.sizes.items():
            item, d, p = _equal(held, *windows(t, size, least), self.least)
            if not len(item):
                continue
            order = np.argsort(item, kind="stable")
            pairs = np.stack([d, p], 1)[order]
            first = np.flatnonzero(np.r_[True, np.diff(item[order]) != 0])
            out |= zip(item[order[first]].tolist(), np.split(pairs, first[1:]))
        return out

    def verbatim(self, t: Template) -> dict[int, dict]:
        """Per item number: the leak that equal words show by themselves."""
        pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for size, held in self.exact.items():
            hashed = _window_hashes(t.words, size)
            for k, d, p in zip(*(x.tolist() for x in _equal(held, np.arange(len(hashed)), hashed))):
                pairs[k].append((d, p))
        out = {}
        for k, found in pairs.items():
            words = self.templates[k].words
            if self.whole[k]:
                first = next((d for d, _ in found if np.array_equal(t.words[d : d + len(words)], words)), None)
                if first is not None:
                    out[k] = {"cover": 1.0, "agree": 1.0, "first_word": first}
                continue
            covered = {q for _, p in found for q in range(p, p + EXACT)}
            out[k] = {"cover": len(covered) / len(words), "agree": 1.0, "first_word": min(d for d, _ in found)}
        return out

    def leaks(self, t: Template) -> list[dict]:
        """Alignments of a text that are leaks, by item: of templates, or else of equal words."""
        out = self.verbatim(t)
        for k, pairs in self.hits(t).items():
            if found := self.aligned(t, k, pairs):
                out[k] = found
        return [{"item_id": self.ids[k], **found} for k, found in sorted(out.items())]

    def aligned(self, t: Template, k: int, pairs: np.ndarray) -> dict | None:
        """The first leak among the diagonal bands of an item's hits, those of most hits first; else of those in order."""
        pairs = pairs[np.argsort(pairs[:, 0] - pairs[:, 1], kind="stable")]
        diagonal = pairs[:, 0] - pairs[:, 1]
        middle = np.unique(diagonal)
        a, b = np.searchsorted(diagonal, middle - BAND, "left"), np.searchsorted(diagonal, middle + BAND, "right")
        for x in np.argsort(a - b, kind="stable").tolist():
            if b[x] - a[x] < LEAST_COVER * self.total[k]:
                break
            near = pairs[a[x] : b[x]]
            if found := self.judged(t, k, near):
                return found
        chain = self.in_order(pairs)
        return self.judged(t, k, chain) if len(chain) else None

    @staticmethod
    def in_order(pairs: np.ndarray) -> np.ndarray:
        """The hits of those long runs, one behind the other in text and item, that have most of them; given by diagonal."""
        step = np.diff(pairs, axis=0)
        edge = np.flatnonzero((step[:, 0] != step[:, 1]) | (step[:, 1] > WINDOW)) + 1
        first, last = np.r_[0, edge], np.r_[edge, len(pairs)] - 1
        long = pairs[last, 1] - pairs[first, 1] + WINDOW >= EXACT
        first, last = first[long], last[long]
        # the best chain that ends at or before each place of the item, as a Fenwick tree of (hits, run)
        best = [(0, -1)] * (int(pairs[:, 1].max()) + 2)
        score, before = [0] * len(first), [-1] * len(first)
        events = sorted([(int(pairs[x, 0]), 0, j) for j, x in enumerate(first)] + [(int(pairs[x, 0]), 1, j) for j, x in enumerate(last)])
        for _, ends, j in events:
            if ends:
                at, new = int(pairs[last[j], 1]) + 1, (score[j], j)
                while at < len(best):
                    if new[0] > best[at][0]:
                        best[at] = new
                    at += at & -at
            else:
                at, top = int(pairs[first[j], 1]), (0, -1)
                while at > 0:
                    top = max(top, best[at], key=lambda x: x[0])
                    at -= at & -at
                score[j], before[j] = top[0] + int(last[j] - first[j]) + 1, top[1]
        j = max(range(len(first)), key=score.__getitem__, default=-1)
        chain = []
        while j >= 0:
            chain.append(pairs[first[j] : last[j] + 1])
            j = before[j]
        return np.concatenate(chain[::-1]) if chain else pairs[:0]

    def judged(self, t: Template, k: int, near: np.ndarray) -> dict | None:
        """The leak that hits of one alignment are, if they cover enough and their slots agree."""
        cover = len(np.unique(near[:, 1])) / self.total[k]
        if cover < LEAST_COVER:
            return None
        agree = self.agreement(t, self.templates[k], near.tolist(), self.width[k])
        if agree < LEAST_AGREE:
            return None
        return {"cover": cover, "agree": agree, "first_word": int(t.word[near[:, 0].min()])}

    @staticmethod
    def agreement(t: Template, item: Template, near: list[tuple[int, int]], size: int) -> float:
        """Share of the aligned slots whose values map one to one; 1 without slots."""
        slots = {(p + s, d + s) for d, p in near for s in range(size) if item.kind[p + s] != PLAIN and item.kind[p + s] == t.kind[d + s]}
        if not slots:
            return 1.0
        values = [(int(item.kind[p]), int(item.raw[p]), int(t.raw[d])) for p, d in sorted(slots)]
        there, back = defaultdict(Counter), defaultdict(Counter)
        for kind, a, b in values:
            there[kind, a][b] += 1
            back[kind, b][a] += 1
        # each value stands for its commonest partner, the smaller of equals
        mode = lambda counts: {k: min(c, key=lambda v: (-c[v], v)) for k, c in counts.items()}
        to, fro = mode(there), mode(back)
        return sum(to[k, a] == b and fro[k, b] == a for k, a, b in values) / len(values)


def benchmark_blocks(benchmark: DataFrame, most: int = BLOCK_WINDOWS):
    """Yield indexes over the items, in blocks of at most ``most`` words and canonical words (one item at least)."""
    items, held = [], 0
    rows = benchmark.select("item_id", "text").where("item_id is not null and text is not null").orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        data = r["text"].encode()
        found = list(templates(np.frombuffer(data, np.uint8), np.array([0, len(data)])))
        t = found[0][1]
        if items and held + len(t.canon) + len(t.words) > most:
            yield BenchmarkIndex(items)
            items, held = [], 0
        items.append((int(r["item_id"]), t))
        held += len(t.canon) + len(t.words)
    if items:
        yield BenchmarkIndex(items)


_LEAK = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("cover", T.DoubleType()), T.StructField("agree", T.DoubleType()), T.StructField("first_word", T.LongType())]))
_LEAK_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("cover", pa.float64()), ("agree", pa.float64()), ("first_word", pa.int64())]))


def with_leaks(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] | None = None, column: str = "leaks") -> DataFrame:
    """``docs`` (or its columns ``keep``) with the array of leaks of each row.

    Without benchmark items every array is empty.
    """
    base = [c for c in (keep or docs.columns) if c != column]
    blocks = benchmark_blocks(benchmark)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs.select(*base, F.array().cast(_LEAK).alias(column))
    if second is not None:
        del first, second
        return _block_by_block(docs, benchmark, base, column)
    shared = docs.sparkSession.sparkContext.broadcast(first)
    # the given columns travel in a struct, so that no name clashes
    rows = docs.select(F.struct(*base).alias("row") if base else F.lit(0).alias("row"), "text")

    def run(batches):
        index = shared.value
        for batch in batches:
            leaks: list[list[dict]] = [[]] * batch.num_rows
            for row, t in templates(*utf8_views(batch.column("text"))):
                if found := index.leaks(t):
                    leaks[row] = found
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(leaks, _LEAK_ARROW)], names=["row", "leaks"])

    found = rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("leaks", _LEAK)]))
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in base], F.col("leaks").alias(column))


class WindowMap:
    """A bit map of the windows of all items, each kind by itself: what a text must hit to have a leak."""

    def __init__(self, bits: int):
        self.shift, self.held = np.uint64(64 - bits), np.zeros(1 << (bits - 3), np.uint8)
        self.sizes: set[tuple[int, int]] = set()
        self.exact: set[int] = set()

    def add(self, index: BenchmarkIndex) -> None:
        self.sizes |= set(index.sizes)
        self.exact |= set(index.exact)
        for value, *_ in [*index.sizes.values(), *index.exact.values()]:
            at = (value >> self.shift).astype(np.int64)
            np.bitwise_or.at(self.held, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))

    def met(self, t: Template) -> bool:
        kinds = [windows(t, *size)[1] for size in self.sizes] + [_window_hashes(t.words, size) for size in self.exact]
        at = (np.concatenate(kinds) >> self.shift).astype(np.int64)
        return bool(((self.held[at >> 3] >> (at & 7).astype(np.uint8)) & 1).any())


def _block_by_block(docs: DataFrame, benchmark: DataFrame, base: list[str], column: str) -> DataFrame:
    """``with_leaks`` for a benchmark of several blocks."""
    context = docs.sparkSession.sparkContext
    scratch = Scratch(docs.sparkSession, "leaks")
    windows_of_all = WindowMap(MAP_BITS)
    for block in benchmark_blocks(benchmark):
        windows_of_all.add(block)
    shared = context.broadcast(windows_of_all)
    rows = docs.select(F.struct(*base).alias("row") if base else F.lit(0).alias("row"), "text")

    def picked(wanted):
        def run(batches):
            every = shared.value
            for batch in batches:
                met = np.zeros(batch.num_rows, bool)
                for row, t in templates(*utf8_views(batch.column("text"))):
                    met[row] = every.met(t)
                yield batch.filter(pa.array(met == wanted))

        return run

    held = rows.mapInArrow(picked(True), rows.schema).withColumn("number", F.monotonically_increasing_id())
    held = scratch.keep(held, "held")
    parts = []
    for k, block in enumerate(benchmark_blocks(benchmark)):
        one = context.broadcast(block)

        def run(batches):
            index = one.value
            for batch in batches:
                number, out = batch.column("number").to_pylist(), []
                for row, t in templates(*utf8_views(batch.column("text"))):
                    if found := index.leaks(t):
                        out.append((number[row], found))
                numbers, leaks = zip(*out) if out else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(leaks, _LEAK_ARROW)], names=["number", "leaks"])

        schema = T.StructType([T.StructField("number", T.LongType()), T.StructField("leaks", _LEAK)])
        parts.append(scratch.keep(held.select("number", "text").mapInArrow(run, schema), f"block{k}").withColumn("block", F.lit(k)))
        one.unpersist()
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.groupBy("number").agg(F.flatten(F.array_sort(F.collect_list(F.struct("block", "leaks"))).getField("leaks")).alias("leaks"))
    none = F.array().cast(_LEAK)
    some = held.join(found, "number", "left").select("row", F.coalesce("leaks", none).alias("leaks"))
    rest = rows.mapInArrow(picked(False), rows.schema).select("row", none.alias("leaks"))
    return some.unionByName(rest).select(*[F.col(f"row.`{c}`").alias(c) for c in base], F.col("leaks").alias(column))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cover, agree, first_word: one row per document and leaked item."""
    found = with_leaks(docs, benchmark, ("doc_id",))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents of ``docs`` that hold no benchmark item."""
    column = "_leaks"
    while column in docs.columns:
        column += "_"
    return with_leaks(docs, benchmark, column=column).where(F.size(column) == 0).drop(column)
