"""Licence scan: matching statistics from a generalised suffix automaton.

The automaton accepts every run of words of every template.  Streaming a text
through it gives, at each word and for each template, the length of the longest
run that ends there and stands in it.  Runs that can't be extended in their template
are the long matches;
chaining those that lie in template order covers spans of the text, and a
template counts when enough of its words are covered.  Where its label names a
version, the version's numbers in the wording must be covered too.

Phrases (short names of licences) are templates of the same automaton; each
place where all words of a phrase stand is reported.

Words are runs of digits, ASCII letters (lower-cased) and bytes from 0x80.
Only words that occur in a template can be in a match, so the vectorised part
finds those first and the automaton reads the runs of two and more of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from brindle.llm.license_texts import PHRASES, TEMPLATES
from brindle.llm.textbytes import class_table, pieces, utf8_views, words_of

#: A long match has at least so many words (or the whole template).
LEAST_RUN = 4
#: Words of the text that may stand between two matches of a chain.
MOST_GAP = 12
#: Share of a template's words that a chain must cover.
LEAST_COVER = 0.6

_WORDS = class_table("word", True)


def word_ids(text: str) -> tuple[np.ndarray, list[bytes]]:
    """(hashes, words) of a text, cut as documents are."""
    raw = text.encode()
    _, _, buffer = next(pieces(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
    mapped = _WORDS[buffer]
    first, last, hashes = words_of(mapped)
    return hashes, [mapped[a:b].tobytes() for a, b in zip(first, last)]


@dataclass
class Span:
    """A chain: words [start, end) of the text that cover a template."""

    label: str
    template: int
    start: int
    end: int
    cover: float


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers, one pass per template."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, words in enumerate(sequences):
            last = 0
            for place, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].add((k, place + 1))
        # a state's words also end wherever those of the states that link to it end
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _clone(self, p: int, q: int, w: int) -> int:
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        self.link[q] = twin
        return twin

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:  # the word run is there from an earlier template
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        return new


def version_places(label: str, words: list[bytes]) -> frozenset[int]:
    """Places of the numbers behind ``version`` or ``v`` in a wording whose label names a version."""
    out: set[int] = set()
    if any(c.isdigit() for c in label):
        for k, w in enumerate(words):
            if w.isdigit() and k and (words[k - 1] in (b"version", b"v") or k - 1 in out):
                out.add(k)
    return frozenset(out)


class LicenseIndex:
    """The automaton over phrases and templates, and the numbers of their words."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.phrases, self.templates = list(phrases), list(templates)
        numbers: dict[int, int] = {}
        self.sequences = []
        for _, text in [*self.phrases, *self.templates]:
            self.sequences.append([numbers.setdefault(int(h), len(numbers)) for h in word_ids(text)[0]])
        self.versions = [version_places(label, word_ids(text)[1]) for label, text in self.templates]
        known = np.array(sorted(numbers), np.uint64)
        self.hashes, self.numbers = known, np.array([numbers[int(h)] for h in known], np.int64)
        self.automaton = SuffixAutomaton(self.sequences)
        a = self.automaton
        self.least = max(2, min([LEAST_RUN, *[len(x) for x in self.sequences[len(self.phrases) :]]]))
        # phrases that end where a state's longest word run ends: those of its link chain
        whole: dict[int, int] = {}
        for k in range(len(self.phrases)):
            s = 0
            for w in self.sequences[k]:
                s = a.next[s][w]
            whole[s] = k
        self.phrase_at: list[tuple[int, ...]] = []
        for s in range(len(a.link)):
            found, t = [], s
            while t > 0:
                if t in whole:
                    found.append(whole[t])
                t = a.link[t]
            self.phrase_at.append(tuple(found))

        # per state and template, the longest of the state's runs and their suffixes that stands in it: (state, ends there)
        self.held: list[dict[int, tuple[int, tuple[int, ...]]]] = [{} for _ in a.link]
        for s in sorted(range(1, len(a.link)), key=a.length.__getitem__):
            own: dict[int, list[int]] = {}
            for k, end in sorted(a.ends[s]):
                if k >= len(self.phrases):
                    own.setdefault(k, []).append(end)
            self.held[s] = self.held[a.link[s]] | {k: (s, tuple(ends)) for k, ends in own.items()}

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for words of no template."""
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[place] == hashes, self.numbers[place], -1)

    def stream(self, words: list[int], offset: int) -> tuple[list[tuple[int, int]], list[tuple[int, tuple[int, ...], int, int]]]:
        """(places, matches) of a run of known words that begins at word ``offset``.

        places: (phrase, first word).  matches: (template, ends in it, length,
        word past the end) of the long runs that can't be extended to the right
        in their template.
        """
        a = self.automaton
        moves, link, length, phrase_at = a.next, a.link, a.length, self.phrase_at
        state = run = 0
        places, matches = [], []
        running: dict[int, tuple[int, tuple[int, ...]]] = {}

        def ended(now: dict[int, tuple[int, tuple[int, ...]]], end: int) -> None:
            for k, (size, ends) in running.items():
                if k not in now or now[k][0] != size + 1:
                    matches.append((k, ends, size, end))

        for i, w in enumerate(words):
            while state and w not in moves[state]:
                state = link[state]
                run = length[state]
            state = moves[state].get(w, 0)
            run = run + 1 if state else 0
            for k in phrase_at[state]:
                size = len(self.sequences[k])
                if run >= size:
                    places.append((k, offset + i + 1 - size))
            now = {}
            if run >= self.least:
                for k, (s, ends) in self.held[state].items():
                    size = run if s == state else length[s]
                    if size >= min(LEAST_RUN, len(self.sequences[k])):
                        now[k] = (size, ends)
            if running:
                ended(now, offset + i)
            running = now
        ended({}, offset + len(words))
        return places, matches

    def chains(self, matches: list[tuple[int, tuple[int, ...], int, int]]) -> list[Span]:
        """The covered spans of templates, from the matches of a text in order."""
        open_: dict[int, list[list]] = {}
        skip = len(self.phrases)
        spans: list[Span] = []

        def close(k: int, chain: list) -> None:
            size = len(self.sequences[k])
            cover = chain[3] / size
            if cover >= LEAST_COVER and all(any(a <= v < b for a, b in chain[4]) for v in self.versions[k - skip]):
                spans.append(Span(self.templates[k - skip][0], k - skip, chain[0], chain[1], min(1.0, cover)))

        for k, template_ends, run, end in matches:
            for template_end in template_ends:
                start, best = end - run, None
                for chain in open_.get(k, []):
                    # chain: text start, text end, template end, words covered, ranges of the template
                    new = min(run, template_end - chain[2])
                    if chain[1] - run < start <= chain[1] + MOST_GAP and new > 0 and end > chain[1] and (best is None or chain[3] > best[3]):
                        best = chain
                # a whole copy is a chain by itself
                if best is None or run == len(self.sequences[k]):
                    open_.setdefault(k, []).append([start, end, template_end, run, [(template_end - run, template_end)]])
                else:
                    new = min(run, template_end - best[2], end - best[1])
                    best[3] += new
                    best[4].append((template_end - new, template_end))
                    best[1], best[2] = end, template_end
            # chains that no later match can reach
            for k, held in open_.items():
                for chain in [c for c in held if c[1] + MOST_GAP < end - run]:
                    close(k, chain)
                    held.remove(chain)
        for k, held in open_.items():
            for chain in held:
                close(k, chain)
        return sorted(spans, key=lambda s: (s.start, s.end, s.template))

    def scan(self, numbers: np.ndarray) -> tuple[list[tuple[int, int]], list[Span]]:
        """(places of phrases, covered spans) of a text given by its word numbers."""
        known = np.flatnonzero(numbers >= 0)
        if len(known) < 2:
            return [], []
        cut = np.flatnonzero(np.diff(known) > 1) + 1
        firsts, lasts = np.r_[0, cut], np.r_[cut, len(known)]
        long = lasts - firsts >= 2
        places, matches = [], []
        for a, b in zip(firsts[long].tolist(), lasts[long].tolist()):
            at = int(known[a])
            found, more = self.stream(numbers[at : at + b - a].tolist(), at)
            places += found
            matches += more
        return places, self.chains(matches) if matches else []


def _documents(raw: np.ndarray, at: np.ndarray, index: LicenseIndex):
    """Yield (row, word numbers) of every text with words."""
    held: list[np.ndarray] = []
    holder = -1
    for rows, starts, buffer in pieces(raw, at):
        first, _, hashes = words_of(_WORDS[buffer])
        numbers = index.number(hashes)
        bounds = np.searchsorted(first, starts)
        for k, row in enumerate(rows.tolist()):
            part = numbers[bounds[k] : bounds[k + 1]]
            if row != holder:
                if holder >= 0:
                    yield holder, held[0] if len(held) == 1 else np.concatenate(held)
                held, holder = [], row
            held.append(part)
    if holder >= 0:
        yield holder, held[0] if len(held) == 1 else np.concatenate(held)


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, places and spans of every document.

    places: array of (label, start), each place of a phrase in text order.
    spans: array of (label, template, start, end, cover), the covered spans of
    templates.  Words count from 0.  Null and empty texts have no words and
    empty arrays; repeated rows are scanned alike; an empty table gives an
    empty result; columns beyond doc_id and text are not read.
    """
    place = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType())])
    span = T.StructType([T.StructField("label", T.StringType()), T.StructField("template", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("cover", T.DoubleType())])
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(place)), T.StructField("spans", T.ArrayType(span))])
    place_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    span_type = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))

    def run(batches):
        index = LicenseIndex(phrases, templates)
        for batch in batches:
            n = batch.num_rows
            words, places, spans = np.zeros(n, np.int64), [[]] * n, [[]] * n
            for row, numbers in _documents(*utf8_views(batch.column("text")), index):
                words[row] = len(numbers)
                found, covered = index.scan(numbers)
                if found:
                    places[row] = [{"label": index.phrases[k][0], "start": at} for k, at in sorted(found, key=lambda x: (x[1], x[0]))]
                if covered:
                    spans[row] = [vars(s) for s in covered]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(places, place_type), pa.array(spans, span_type)], names=["doc_id", "n_words", "places", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
