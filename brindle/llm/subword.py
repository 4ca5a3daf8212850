"""Subword-bag embeddings with a softmax output, trained in numpy.

A text is a bag of hashed features: its words and the character n-grams (on
UTF-8 bytes, word edges included) of its words.  Embeddings of the features
are averaged; a linear softmax gives the label.  Embeddings and softmax are
trained jointly by stochastic gradient descent.

The softmax of an average of embeddings only needs, for each feature, the
product of its embedding with the difference of the two softmax rows.  The
fitted model is therefore carried as one number per bucket, and scoring is a
gather and a sum over the bytes of a text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from brindle.llm.textbytes import PIECE_BYTES, class_table, hash_spans, pieces, relax

#: What a text of label 1 that falls below the threshold costs, under the goal keep.
KEEP = 4

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Settings:
    """What is fixed before training."""

    keep: str = "word"  # which bytes make up words, see class_table
    lower: bool = True
    window_words: int = 0  # 0: a text is one bag; else bags of so many words, a text's score is its largest
    sizes: tuple[int, ...] = (3, 4, 5)
    bits: int = 18
    echo: bool = False  # a word that repeats the one before it is a feature too
    dim: int = 8
    epochs: int = 12
    rate: float = 0.3
    decay: float = 1e-6
    seed: int = 7
    target: float = 0.5  # the score that the best threshold is moved to
    goal: str = "accuracy"  # what that threshold is best for: accuracy, or keep (a lost text of label 1 weighs as much as KEEP others)
    least_texts: int = 2  # features of fewer training texts get no vector
    prior: float = 0.0  # so many features without meaning are added to every bag
    most_bags: float = 4.0  # a text of more bags teaches as much as so many


@dataclass
class Model:
    settings: Settings
    gain: np.ndarray  # per bucket
    bias: float = 0.0
    slope: float = 1.0
    notes: dict = field(default_factory=dict)

    def scores(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores in 0..1 of the texts of a column; empty texts get that of no evidence."""
        return scores_of(self, raw, at)


def features(mapped: np.ndarray, sizes: tuple[int, ...], bits: int, starts: np.ndarray | None = None):
    """Yield (first byte, bucket) arrays: all words, then the n-grams of each size.

    With the ``starts`` of the texts, words that repeat their predecessor come
    too, in a bucket that all of them share.
    """
    black = mapped != 32
    edge = np.flatnonzero(black[1:] != black[:-1]) + 1
    first, last = edge[0::2], edge[1::2]
    shift = np.uint64(64 - bits)
    if len(first):
        words = hash_spans(mapped, first, last)
        yield first, ((words * _MIX) >> shift).astype(np.int64)
        if starts is not None:
            again = np.flatnonzero(words[1:] == words[:-1]) + 1
            text = np.searchsorted(starts, first, "right")
            again = again[text[again] == text[again - 1]]
            yield first[again], np.full(len(again), (1 << bits) - 1, np.int64)
    wide = mapped.astype(np.uint64) + np.uint64(1)
    running, inside, done = wide, None, 1
    for n in sizes:
        while done < n and len(running) > 1:
            if done >= 2:  # the byte at done - 1 is now inside
                step = black[done - 1 :][: len(running) - 1]
                inside = step if inside is None else inside[: len(step)] & step
            running = running[:-1] * _STEP + wide[done:]
            done += 1
        if done < n or inside is None:
            break
        where = np.flatnonzero(inside[: len(running)])
        value = running[where] + np.uint64(n)
        value ^= value >> np.uint64(29)
        yield where, ((value * _MIX) >> shift).astype(np.int64)


def bags(mapped: np.ndarray, starts: np.ndarray, window_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each bag, index of its text in the piece); bag 0 begins at 0."""
    if not window_words:
        return starts[:-1] - 1, np.arange(len(starts) - 1)
    black = mapped != 32
    begins = np.flatnonzero(black[1:] & ~black[:-1]) + 1
    text = np.searchsorted(starts, begins, "right") - 1
    lead = np.searchsorted(begins, starts[:-1])
    place = np.arange(len(begins)) - lead[text]
    # a short rest joins the bag before it
    words = np.diff(np.r_[lead, len(begins)])[text]
    cut = (place % window_words == 0) & ((place == 0) | (words - place >= window_words // 2))
    return begins[cut] - 1, text[cut]


def scores_of(model: Model, raw: np.ndarray, at: np.ndarray, limit: int = PIECE_BYTES) -> np.ndarray:
    """A text's largest bag score, or that of its one bag."""
    s = model.settings
    table = class_table(s.keep, s.lower)
    n = len(at) - 1
    total, count = np.zeros(n), np.zeros(n)
    best = np.full(n, -np.inf)
    for rows, starts, buffer in pieces(raw, at, limit):
        mapped = table[buffer]
        first, text = bags(mapped, starts, s.window_words)
        if not len(first):
            continue
        value = np.zeros(len(mapped), np.float32)
        number = np.zeros(len(mapped), np.int8)
        for where, bucket in features(mapped, s.sizes, s.bits, starts if s.echo else None):
            value[where] += model.gain[bucket]
            number[where] += 1
        sums = np.add.reduceat(value, first, dtype=np.float64)
        sizes = np.add.reduceat(number, first, dtype=np.int64)
        if s.window_words:
            np.maximum.at(best, rows[text], sums / np.maximum(sizes + s.prior, 1))
        else:
            np.add.at(total, rows, sums)
            np.add.at(count, rows, sizes)
    if not s.window_words:
        best = total / np.maximum(count + s.prior, 1)
    best[~np.isfinite(best)] = 0.0
    return 1.0 / (1.0 + np.exp(-np.clip(model.slope * best + model.bias, -30, 30)))


def _column(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    return np.frombuffer(b"".join(texts), np.uint8), at


def _bags_of_pieces(texts: list[bytes], s: Settings):
    """Yield (text of each bag, bag of each feature, bucket, number) piece by piece; no feature twice in a bag."""
    table = class_table(s.keep, s.lower)
    raw, at = _column(texts)
    for texts_in, starts, buffer in pieces(raw, at, PIECE_BYTES // 4):
        mapped = table[buffer]
        first, text = bags(mapped, starts, s.window_words)
        if not len(first):
            continue
        keys = []
        for where, bucket in features(mapped, s.sizes, s.bits, starts if s.echo else None):
            bag = (np.searchsorted(first, where, "right") - 1).clip(0)
            keys.append((bag << s.bits) | bucket)
        key, number = np.unique(np.concatenate(keys), return_counts=True)
        yield texts_in[text], key >> s.bits, (key & ((1 << s.bits) - 1)).astype(np.int32), number


def sparse_bags(texts: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bags of the texts as (text of each bag, its features, bounds, bucket, number) in rows of bags.

    Features of fewer than ``least_texts`` texts are left out (a first pass
    counts them); a bag's features are counted with them.  Numbers are held as
    halves: exact to 2,048, to a thousandth beyond.
    """
    spread = np.zeros(1 << s.bits, np.int32)
    if s.least_texts > 1:
        for text, bag, bucket, _ in _bags_of_pieces(texts, s):
            once = np.unique((text[bag] << s.bits) | bucket)
            spread += np.bincount(once & ((1 << s.bits) - 1), minlength=1 << s.bits).astype(np.int32)
    owner, held, sizes, buckets, numbers = [], [], [], [], []
    for text, bag, bucket, number in _bags_of_pieces(texts, s):
        common = spread[bucket] >= s.least_texts if s.least_texts > 1 else np.ones(len(bucket), bool)
        owner.append(text)
        held.append(np.bincount(bag, number, len(text)) + s.prior)
        sizes.append(np.bincount(bag[common], minlength=len(text)))
        buckets.append(bucket[common])
        numbers.append(np.minimum(number[common], 60_000).astype(np.float16))
    if not owner:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float16)
    return np.concatenate(owner), np.concatenate(held), np.r_[0, np.cumsum(np.concatenate(sizes))], _drained(buckets), _drained(numbers)


def _drained(parts: list[np.ndarray]) -> np.ndarray:
    """The parts in one array, each let go when it is copied."""
    out, at = np.empty(sum(map(len, parts)), parts[0].dtype), 0
    for k, part in enumerate(parts):
        out[at : at + len(part)] = part
        at += len(part)
        parts[k] = part[:0].copy()
    return out


def _descend(bounds, bucket, number, held, owner, labels, s: Settings) -> tuple[np.ndarray, float]:
    """Joint stochastic gradient descent; returns (gain per bucket, bias).

    ``owner`` is the text of each bag, in order.
    """
    rng = np.random.default_rng(s.seed)
    embed = ((rng.random((1 << s.bits, s.dim)) - 0.5) / s.dim).astype(np.float32)
    out = np.zeros((s.dim, 2), np.float32)
    out[:, 0], out[:, 1] = rng.normal(0, 0.5, s.dim), rng.normal(0, 0.5, s.dim)
    rate_sq = np.full(1 << s.bits, 1e-4, np.float32)
    out_sq, bias, bias_sq = np.full_like(out, 1e-4), np.zeros(2), np.full(2, 1e-4)
    weight = np.minimum(1.0, s.most_bags / np.bincount(owner)[owner])
    base = np.log(np.clip(np.bincount(labels, weight, minlength=2), 1, None) / max(1.0, weight.sum()))
    bias += base
    for _ in range(s.epochs):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), 64):
            part = order[k : k + 64]
            sizes = bounds[part + 1] - bounds[part]
            part, sizes = part[sizes > 0], sizes[sizes > 0]
            if not len(part):
                continue
            ends = np.cumsum(sizes)
            place = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(bounds[part], sizes)
            b, x = bucket[place], (number[place] / np.repeat(held[part], sizes)).astype(np.float32)
            hidden = np.add.reduceat(embed[b] * x[:, None], ends - sizes, axis=0)
            logit = hidden @ out + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1.0
            p *= weight[part][:, None]
            back = (p @ out.T).astype(np.float32)
            g = np.repeat(back, sizes, axis=0) * x[:, None]
            grad_out = hidden.T @ p
            # per-feature step sizes (one accumulator for all of a feature's dimensions)
            ids, inverse = np.unique(b, return_inverse=True)
            step = np.empty((len(ids), s.dim), np.float32)
            for d in range(s.dim):
                step[:, d] = np.bincount(inverse, g[:, d], len(ids))
            rate_sq[ids] += (step**2).mean(1)
            embed[ids] -= s.rate * step / np.sqrt(rate_sq[ids])[:, None]
            out_sq += grad_out**2
            out -= (0.1 * s.rate * grad_out / np.sqrt(out_sq)).astype(np.float32)
            grad_bias = p.sum(0)
            bias_sq += grad_bias**2
            bias -= 0.1 * s.rate * grad_bias / np.sqrt(bias_sq)
            embed[ids] *= 1.0 - s.decay
    gain = embed @ (out[:, 1] - out[:, 0])
    taught = np.zeros(len(gain), bool)
    taught[bucket] = True
    gain[~taught] = 0.0
    return gain, float(bias[1] - bias[0])


def _threshold(logit: np.ndarray, labels: np.ndarray, goal: str) -> float:
    """The logit that best divides the labels; halfway between neighbours."""
    order = np.argsort(-logit, kind="stable")
    z, y = logit[order], labels[order]
    hits = np.cumsum(y)
    taken = np.arange(1, len(y) + 1)
    value = (KEEP if goal == "keep" else 1) * hits - (taken - hits)
    last = np.r_[z[1:] != z[:-1], True]
    value = np.where(last, value, -1)
    k = int(np.flatnonzero(value == value.max())[-1])
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1.0)


def fit(texts: list[bytes], labels: list[int], s: Settings) -> Model:
    """Fit on whole texts; ``labels`` are 0 or 1.  Equal texts count once.

    A fifth of the texts (by position) only sets the threshold that is moved
    to ``s.target``; the final weights come from the other four fifths.  Below
    25 texts, or with one label among the fifth, all texts do both.  With no
    labelled text, or one label only, every score is that label's share
    (0.5 without any).
    """
    once: dict[bytes, int] = {}
    for t, y in zip(texts, labels, strict=True):
        once.setdefault(t, int(y))
    texts, y = list(once), np.array(list(once.values()), np.int64)
    blank = Model(s, np.zeros(1 << s.bits, np.float32))
    if not len(y) or y.min() == y.max():
        blank.bias = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return blank
    aside = np.arange(len(y)) % 5 == 4
    if len(y) < 25 or len(set(y[~aside])) < 2:
        aside[:] = False
    owner, held, bounds, bucket, number = sparse_bags([t for t, a in zip(texts, aside) if not a], s)
    gain, bias = _descend(bounds, bucket, number, held, owner, y[~aside][owner], s)
    del bucket, number
    relax()
    model = Model(s, gain.astype(np.float32), bias)
    judge = aside if aside.any() and len(set(y[aside])) == 2 else ~aside
    p = model.scores(*_column([t for t, a in zip(texts, judge) if a]))
    logit = np.log(p / (1 - p))
    cut = _threshold(logit, y[judge], s.goal)
    model.bias += float(np.log(s.target / (1 - s.target))) - cut
    model.notes = {"texts": int(len(y)), "cut": cut}
    return model
