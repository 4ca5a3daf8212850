"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word is a row of symbols.  A segment tree holds, for every place, the rank of
the pair that begins there; its root is the leftmost pair of lowest rank.  A
merge changes three leaves, so it costs a logarithmic number of node updates,
and merging ends when the root has no pair.  The words that a piece of input
needs are merged in step with each other: row k of the arrays is word k's tree.
Few words of a length (long ones mostly) have their trees in plain lists.

The vocabulary file is read with the standard json module; the tokenizers
library gives only its own normaliser and splitter, for texts with characters
outside of Latin script (elsewhere the same split is done by a pattern), and for
all texts if the file's normaliser or splitter isn't the one of that pattern.
Files of another kind than word-end byte-level BPE are refused.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_NONE = np.int64(1) << np.int64(62)
#: So many words of a length are merged in step; fewer one by one.
LEAST_ROWS = 8
#: The normaliser and splitter that ``splitter`` and ``plain`` stand for.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
#: Words whose codes a worker keeps; beyond, it begins anew.
CACHE_WORDS = 250_000
#: Code points of text that are split into words at a time.
SLICE_CHARS = 1 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = [""] * 256, 0x100
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b] = chr(spare)
            spare += 1
    return letters


class PairRanks:
    """(left id, right id) -> rank, for arrays: open addressing with linear probing."""

    def __init__(self, pairs: np.ndarray):
        self.bits = max(8, int(len(pairs)).bit_length() + 4)
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, -1, np.int64)
        keys = (pairs[:, 0] << 32) | pairs[:, 1]
        _, first = np.unique(keys, return_index=True)
        todo = np.sort(first)
        slot, self.probes = self._slot(keys[todo]), 0
        while len(todo):
            self.probes += 1
            free = np.flatnonzero(self.keys[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.ranks[slot[put]] = keys[todo[put]], todo[put]
            rest = np.setdiff1d(np.arange(len(todo)), put)
            todo, slot = todo[rest], (slot[rest] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, -1 for what isn't a pair."""
        keys = (left << 32) | right
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.ranks[slot], -1)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out


class WordBpe:
    """A byte-level BPE vocabulary file whose words end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        plain_only = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        level = split[-1] if split else {}
        if model["type"] != "BPE" or any(model.get(k) for k in plain_only) or level.get("type") != "ByteLevel" or level.get("add_prefix_space") or level.get("use_regex") or spec["post_processor"] or spec["decoder"]:
            raise ValueError(f"{path} is no vocabulary of the kind that is read here")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"added tokens of {path} match in ways that are not read here")
        self.known_split = spec["normalizer"] == NORMALIZER and split[:-1] == [SPLIT]
        self.path, self.added = path, {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for t, k in (*vocab.items(), *self.added.items()):
            self.tokens[k] = t
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = PairRanks(np.array([(vocab[a], vocab[b]) for a, b in pairs], np.int64).reshape(-1, 2))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # (left, right) -> rank, as the array form has it: the first of equal pairs
        self.rank_of: dict[tuple[int, int], int] = {}
        for k, (a, b) in enumerate(pairs):
            self.rank_of.setdefault((vocab[a], vocab[b]), k)
        self.merged_list, self.inner_list, self.final_list = self.merged.tolist(), self.inner.tolist(), self.final.tolist()
        self.splitter = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.lead = os.path.commonprefix(list(self.added))
        self.marks = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.plain = re.compile(r"[\t\n\r\x20-\x7e\xa0-\xff]*")
        self.codes: dict[str, str] = {}
        self.spelt: dict[str, str] = {}
        self._library = None

    # merging

    def merge_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word (bytes of one split unit, not empty)."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        leaves = 1 << np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64)
        for width in np.unique(leaves):
            rows = np.flatnonzero(leaves == width)
            if len(rows) < LEAST_ROWS:
                for i in rows:
                    out[i] = self._merge_alone(words[i], int(width))
                continue
            step = max(LEAST_ROWS, (1 << 18) // int(width))
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                symbols = self._merge_block([words[i] for i in part], int(width))
                for i, ids in zip(part, symbols):
                    out[i] = ids
        return out

    def _merge_alone(self, word: bytes, width: int) -> list[int]:
        """Ids of one word, its segment tree in a list."""
        n, rank_of, merged = len(word), self.rank_of, self.merged_list
        symbol = [self.inner_list[b] for b in word]
        symbol[-1] = self.final_list[word[-1]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none = 1 << 62
        tree = [none] * (2 * width)
        for k in range(n - 1):
            r = rank_of.get((symbol[k], symbol[k + 1]))
            if r is not None:
                tree[width + k] = r * width + k
        for k in range(width - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

        def put(leaf: int, value: int) -> None:
            k = width + leaf
            tree[k] = value
            while k > 1:
                other = tree[k ^ 1]
                if other < value:
                    value = other
                k >>= 1
                if tree[k] == value:
                    return  # nothing changes above
                tree[k] = value

        while tree[1] < none:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            follow = after[gone]
            symbol[at] = fresh = merged[rank]
            symbol[gone] = -1
            after[at] = follow
            put(gone, none)
            r = None
            if follow < n:
                before[follow] = at
                r = rank_of.get((fresh, symbol[follow]))
            put(at, none if r is None else r * width + at)
            lead = before[at]
            if lead >= 0:
                r = rank_of.get((symbol[lead], fresh))
                put(lead, none if r is None else r * width + lead)
        return [s for s in symbol if s >= 0]

    def _merge_block(self, words: list[bytes], width: int) -> list[list[int]]:
        n = len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(n), sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        symbol = np.zeros((n, width + 1), np.int64)
        symbol[row, place] = self.inner[flat]
        symbol[np.arange(n), sizes - 1] = self.final[flat[np.cumsum(sizes) - 1]]
        after = np.broadcast_to(np.arange(1, width + 2), (n, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
        alive = np.zeros((n, width), bool)
        alive[row, place] = True
        # leaves are nodes width .. 2 * width - 1; a key orders by rank, then place
        tree = np.full((n, 2 * width), _NONE, np.int64)
        rank = self.ranks(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()).reshape(n, width)
        has = (np.arange(width) + 1 < sizes[:, None]) & (rank >= 0)
        tree[:, width:] = np.where(has, rank * width + np.arange(width), _NONE)
        level = width
        while level > 1:
            np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, level // 2 : level])
            level //= 2
        active = np.flatnonzero(tree[:, 1] < _NONE)
        while len(active):
            root = tree[active, 1]
            at, rank = root % width, root // width
            gone = after[active, at]
            follow = after[active, gone]
            symbol[active, at] = fresh = self.merged[rank]
            alive[active, gone] = False
            after[active, at] = follow
            inside = follow < sizes[active]
            before[active[inside], follow[inside]] = at[inside]
            lead = before[active, at]
            first = lead >= 0
            right = self.ranks(fresh, symbol[active, np.minimum(follow, width)])
            left = self.ranks(symbol[active, np.maximum(lead, 0)], fresh)
            tree[active, width + gone] = _NONE
            tree[active, width + at] = np.where(inside & (right >= 0), right * width + at, _NONE)
            led = active[first]
            tree[led, width + lead[first]] = np.where(left[first] >= 0, left[first] * width + lead[first], _NONE)
            for rows, leaf in ((active, gone), (active, at), (led, lead[first])):
                node = (leaf + width) >> 1
                for _ in range(width.bit_length() - 1):
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node = node >> 1
            active = active[tree[active, 1] < _NONE]
        kept = np.flatnonzero(alive.ravel())
        ids = symbol[:, :-1].ravel()[kept].tolist()
        ends = np.cumsum(alive.sum(1)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    # texts

    def split(self, text: str) -> list[str]:
        """The units of a text, as the vocabulary's normaliser and splitter give them.

        Units are words; an added token stands for itself.
        """
        if self.marks and self.lead in text:
            parts = self.marks.split(text)
            if len(parts) > 1:
                return [u for k, p in enumerate(parts) for u in ([p] if k % 2 else self._split(p))]
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if self.known_split and self.plain.fullmatch(text):
            return self.splitter.findall(text.lower())
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        if self._library.normalizer is not None:
            text = self._library.normalizer.normalize_str(text)
        return self.splitter_of_library(text)

    def splitter_of_library(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def learn(self, units: set[str]) -> None:
        """Make sure that ``codes`` and ``spelt`` know the units."""
        new = [u for u in units if u not in self.codes]
        if not new:
            return
        if len(self.codes) + len(new) > CACHE_WORDS:
            self.codes, self.spelt = {}, {}
            new = list(units)
        words = [u for u in new if u not in self.added]
        for u in new:
            if u in self.added:
                self.codes[u], self.spelt[u] = str(self.added[u]), self.decode([self.added[u]])
        for u, ids in zip(words, self.merge_words([w.encode() for w in words])):
            self.codes[u] = " ".join(map(str, ids))
            self.spelt[u] = self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: tokens with one space between (the file names no decoder)."""
        return " ".join([self.tokens[k] for k in ids])

    def encode(self, text: str) -> list[int]:
        units = self.split(text)
        self.learn(set(units))
        return [int(k) for u in units for k in self.codes[u].split(" ")]

    def digest(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: number of ids, sha256 of the ids, sha256 of the decoded text."""
        split = [self.split(t) for t in texts]
        units: set[str] = set()
        for s in split:
            units.update(s)
        self.learn(units)
        codes, spelt, out = self.codes, self.spelt, []
        for s in split:
            ids = " ".join([codes[u] for u in s])
            decoded = " ".join([spelt[u] for u in s])
            out.append((ids.count(" ") + 1 if s else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBpe:
    """The vocabulary, read once in each worker."""
    return WordBpe(path)


def _slices(texts: list[str]):
    """(first, past the last) of runs of texts of about SLICE_CHARS."""
    a = held = 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= SLICE_CHARS:
            yield a, k + 1
            a, held = k + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """All columns of ``docs`` and ``token_ids`` (array of int): the whole texts, encoded.

    A null text counts as empty and has no ids; ids, repeats and other columns
    pass through (a column already named token_ids is replaced); an empty table
    gives an empty result.
    """
    base = docs.drop("token_ids")
    schema = T.StructType([*base.schema, T.StructField("token_ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        bpe = vocabulary(path)
        for batch in batches:
            texts = _texts(batch.column("text"))
            for a, b in _slices(texts):
                ids = [bpe.encode(t) for t in texts[a:b]]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, "token_ids"])

    return base.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, skip: frozenset[int] = frozenset()) -> DataFrame:
    """All columns of ``encoded`` and ``decoded``: the text of ``token_ids`` without ids of ``skip``."""
    base = encoded.drop("decoded")
    schema = T.StructType([*base.schema, T.StructField("decoded", T.StringType())])

    def run(batches):
        bpe = vocabulary(path)
        for batch in batches:
            texts = [bpe.decode([k for k in ids or [] if k not in skip]) for ids in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return base.mapInArrow(run, schema)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document.

    What ``encode_documents`` and ``decode_documents`` give, digested where it
    is made, so that no id leaves the worker.  Null and empty texts: 0 ids and
    the digests of the empty string.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        bpe = vocabulary(path)
        for batch in batches:
            texts = _texts(batch.column("text"))
            found = [x for a, b in _slices(texts) for x in bpe.digest(texts[a:b])]
            n, ids, decoded = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)
