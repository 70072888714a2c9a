"""BPE encoding and decoding: a segment tree over the ranks of adjacent pairs, many words at a time."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import id_and_text, scan_texts, with_schema

NONE = np.int64(1) << 62
#: Cells of the trees worked on together, and words kept encoded in each of a task's two generations.
TREE_CELLS, CACHED_WORDS = 1 << 19, 120_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


def character_classes() -> dict[str, str]:
    """What stands in a character class for each class name of a pattern, by Python's Unicode tables.

    White space leaves out the four separators 1C to 1F, as Unicode's property does.
    """
    ranges: dict[str, list[list[int]]] = {"L": [], "N": [], "S": []}
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        kind = unicodedata.category(char)[0]
        kind = "S" if char.isspace() and not 0x1C <= code <= 0x1F else kind
        if kind in "LN" or kind == "S" and char.isspace():
            own = ranges[kind]
            if own and own[-1][1] == code - 1:
                own[-1][1] = code
            else:
                own.append([code, code])
    text = {k: "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in v) for k, v in ranges.items()}
    return {r"\p{L}": text["L"], r"\p{N}": text["N"], r"\s": text["S"]}


def split_pattern(definition: str) -> str:
    """The file's split pattern, its class names (which stand inside square brackets) written out."""
    splits = json.loads(definition)["pre_tokenizer"]["pretokenizers"]
    pattern = next(p["pattern"]["Regex"] for p in splits if p["type"] == "Split")
    for name, members in character_classes().items():
        pattern = pattern.replace(name, members)
    return pattern


class Tokenizer:
    """A tokenizer file's word BPE: NFC, lower case, split by its pattern, bytes, merges by rank, word ends."""

    def __init__(self, definition: str, pattern: str | None = None):
        whole = json.loads(definition)
        model = whole["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in whole["added_tokens"]}
        self.tokens = {i: t for t, i in (*vocab.items(), *self.special.items())}
        self.split_special = re.compile(
            "(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")"
        ) if self.special else None
        self.pattern = re.compile(pattern or split_pattern(definition))
        letters = byte_characters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def _leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank and place of each pair as one number, so that the least is the leftmost of the lowest rank."""
        key = left.astype(np.int64) << 20 | right
        i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        known = (self.pair_keys[i] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.pair_ranks[i] << 32 | at, NONE)

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """Merge each row (words padded with -1 to a power of two) until no pair has a rank.

        Every row has its own segment tree; a step merges the pair at each live root,
        renews the three leaves it touches and the nodes above them.  Place ``size``
        is a sentinel before the first and after the last symbol.
        """
        rows_all, size = symbols.shape
        own = np.full((rows_all, size + 1), -1, np.int32)
        own[:, :size] = symbols
        after = np.tile(np.arange(1, size + 2), (rows_all, 1))
        before = np.tile(np.r_[size, np.arange(size)], (rows_all, 1))
        tree = np.full((rows_all, 2 * size), NONE)
        tree[:, size:] = self._leaves(own[:, :-1], own[:, 1:], np.arange(size))
        level = size // 2
        while level:
            tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
            level //= 2
        rows = np.arange(rows_all)
        while len(rows):
            root = tree[rows, 1]
            rows, root = rows[root < NONE], root[root < NONE]
            if not len(rows):
                break
            at, rank = root & 0xFFFFFFFF, root >> 32
            gone = after[rows, at]
            then, first = after[rows, gone], before[rows, at]
            own[rows, at] = self.made[rank]
            own[rows, gone] = -1
            after[rows, at] = then
            before[rows, then] = at
            leaf = np.stack([gone, at, first])
            value = np.stack([np.full(len(rows), NONE),
                              self._leaves(own[rows, at], own[rows, then], at),
                              self._leaves(own[rows, first], own[rows, at], first)])
            node = np.where(leaf < size, leaf + size, 0)  # node 0 is nobody's child
            tree[rows, node] = value
            step = size
            while step > 1:
                node >>= 1
                step >>= 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        return own[:, :size]

    def encode_pieces(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """The ids of each piece (a match of the pattern), encoded with others of like length."""
        raw = [p.encode() for p in pieces]
        out: list[tuple[int, ...]] = [()] * len(raw)
        by_size: dict[int, list[int]] = {}
        for k, b in enumerate(raw):
            by_size.setdefault(max(2, 1 << (len(b) - 1).bit_length()), []).append(k)
        for size, members in by_size.items():
            height = max(1, TREE_CELLS // size)
            for s in range(0, len(members), height):
                part = members[s:s + height]
                joined = np.frombuffer(b"".join(raw[k] for k in part), np.uint8)
                lengths = np.array([len(raw[k]) for k in part])
                symbols = np.full((len(part), size), -1, np.int32)
                symbols[np.arange(size) < lengths[:, None]] = self.inner[joined]
                ends = np.cumsum(lengths) - 1
                symbols[np.arange(len(part)), lengths - 1] = self.last[joined[ends]]
                done = self.merge(symbols)
                kept = done >= 0
                cuts = np.r_[0, np.cumsum(kept.sum(1))].tolist()
                flat = done[kept].tolist()
                for i, k in enumerate(part):
                    out[k] = tuple(flat[cuts[i]:cuts[i + 1]])
        return out

    def _learn(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of every word; two generations of words stay known, the older one goes when the younger is full."""
        known: dict[str, tuple[int, ...]] = {}
        new: list[str] = []
        young, old = self.young, self.old
        for w in words:
            ids = young.get(w)
            if ids is None:
                ids = old.get(w)
                if ids is None:
                    new.append(w)
                    continue
                young[w] = ids
            known[w] = ids
        if new:
            split = [self.pattern.findall(w) for w in new]
            pieces = list(dict.fromkeys(chain.from_iterable(split)))
            ids_of = dict(zip(pieces, self.encode_pieces(pieces), strict=True))
            for w, parts in zip(new, split, strict=True):
                known[w] = ids_of[parts[0]] if len(parts) == 1 else tuple(
                    chain.from_iterable([ids_of[p] for p in parts]))
                if len(w) < 64:
                    young[w] = known[w]
        if len(young) > CACHED_WORDS:
            self.young, self.old = {}, young
        return known

    def _words(self, text: str) -> list[str]:
        """Stretches between blanks and line feeds, normalised; no piece crosses them."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower().replace("\n", " ").split(" ")

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        parts: list[list[list[str] | int]] = []
        for t in texts:
            t = t or ""
            if self.split_special is not None and "<|" in t:
                parts.append([self.special.get(x) if x in self.special else self._words(x)
                              for x in self.split_special.split(t) if x])
            else:
                parts.append([self._words(t)])
        words = {w for doc in parts for p in doc if isinstance(p, list) for w in p}
        known = self._learn(words)
        out = []
        for doc in parts:
            ids: list[int] = []
            for p in doc:
                if isinstance(p, int):
                    ids.append(p)
                else:
                    ids.extend(chain.from_iterable([known[w] for w in p]))
            out.append(ids)
        return out

    def decode(self, ids: Iterable[int] | None) -> str:
        """Tokens joined by blanks, as the file names no decoder; special tokens stay, unknown ids go."""
        get = self.tokens.get
        return " ".join([t for t in map(get, ids or ()) if t is not None])


def read_definition(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _shared(spark: SparkSession, definition: str):
    """One vocabulary file, of a size that does not grow, and its pattern."""
    return spark.sparkContext.broadcast((definition, split_pattern(definition)))


def _lists(values: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.fromiter(chain.from_iterable(values), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_decode(docs: DataFrame, definition: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row its id, ``ids`` (array of int) and ``decoded``, the text those ids decode to.

    ``definition`` is the tokenizer file's text.  One narrow pass.  Null and empty texts
    have no ids and decode to the empty text; repeated rows repeat; null ids stay null.
    """
    docs = id_and_text(docs, doc_id, text)
    shared = _shared(docs.sparkSession, definition)

    def start() -> Callable[[list], dict[str, list]]:
        own = Tokenizer(*shared.value)

        def work(texts: list) -> dict[str, list]:
            ids = own.encode_batch(texts)
            return {"ids": _lists(ids), "decoded": [own.decode(x) for x in ids]}

        return work

    return scan_texts(docs, with_schema(docs, ("ids", "array<int>"), ("decoded", "string")), start)


def encode(docs: DataFrame, definition: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the ids of ``encode_decode``."""
    docs = id_and_text(docs, doc_id, text)
    shared = _shared(docs.sparkSession, definition)

    def start() -> Callable[[list], dict[str, list]]:
        own = Tokenizer(*shared.value)
        return lambda texts: {"ids": _lists(own.encode_batch(texts))}

    return scan_texts(docs, with_schema(docs, ("ids", "array<int>")), start)
