"""Periodic runs of words, found over a Re-Pair grammar, and texts without their repeats.

A run is a stretch of at least ``least`` words and two periods, with its smallest period,
that no neighbouring word continues.  Null and empty texts have no words, no runs and the
empty text; every row comes back once, equal rows with equal results.  Texts are taken
whole, in batches of some hundred thousand words that share one grammar; words never pair
across texts, so batching decides nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from .common import id_and_text, with_schema

LEAST = 12
#: Bytes of text that make a batch full; a longer text is a batch of its own.
BATCH_BYTES = 2 << 20
#: Pairs of places that are compared at once.
CHUNK = 1 << 20
# Two primes below 2**31, so that products fit 64 bits.
PRIMES = (2147483647, 2147483629)


class Rules(NamedTuple):
    """Distinct nonterminals of at least the asked size, and every place in the text where one is derived."""

    first: np.ndarray   # place of one derivation of each
    left: np.ndarray    # words of its left part
    size: np.ndarray    # words of both parts
    rule: np.ndarray    # for each derivation: which nonterminal
    place: np.ndarray   # and where it begins


def grammar(words: np.ndarray, owner: np.ndarray, least: int = LEAST) -> Rules:
    """Re-Pair in rounds: pairs are counted, and each place gives way only to a more frequent pair beside it.

    A round replaces all pairs that win everywhere they meet another (ties by a hash of
    the pair, equal pairs that overlap from the left), until none occurs twice; what is
    left of a text is paired up evenly to one start symbol.
    """
    n_words = len(words)
    symbol, place, text = words.astype(np.int64), np.arange(n_words), owner
    sizes = np.ones(int(words.max()) + 1 if n_words else 1, np.int64)
    known, names = np.empty(0, np.int64), np.empty(0, np.int64)
    derived, lefts, totals = [], [], []  # per batch of new symbols: (symbol, place); per symbol: words

    def replace(at: np.ndarray, new: np.ndarray) -> None:
        nonlocal symbol, place, text
        derived.append((new, place[at]))
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        symbol = symbol.copy()
        symbol[at] = new
        symbol, place, text = symbol[keep], place[keep], text[keep]

    while len(symbol) > 1:
        key = symbol[:-1] << 32 | symbol[1:]
        inside = text[:-1] == text[1:]
        mixed = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        cell = (mixed >> np.uint64(42)).astype(np.int64)
        seen = np.bincount(cell[inside], minlength=1 << 22)
        maybe = np.flatnonzero(inside & (seen[cell] > 1))  # a pair alone in its cell occurs once
        pairs, which, count = np.unique(key[maybe], return_inverse=True, return_counts=True)
        if not (count > 1).any():
            break
        order = np.lexsort((pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), count))
        rank = np.empty(len(pairs), np.int64)
        rank[order] = np.arange(1, len(pairs) + 1)
        rank[count < 2] = 0
        strength = np.zeros(len(key) + 2, np.int64)  # one more at either end
        strength[maybe + 1] = rank[which]
        begin = np.flatnonzero(np.diff(strength, prepend=-1))  # stretches of one strength: one pair, or overlapping equal ones
        end = np.append(begin[1:], len(strength))
        value = strength[begin]
        wins = value > 0
        wins[1:] &= value[1:] > value[:-1]
        wins[:-1] &= value[:-1] > value[1:]
        begin, end = begin[wins], end[wins]
        count = (end - begin + 1) // 2
        at = np.repeat(begin - 2 * np.concatenate([[0], np.cumsum(count)[:-1]]), count) + 2 * np.arange(count.sum()) - 1
        used, new = np.unique(key[at], return_inverse=True)
        old = np.searchsorted(known, used)
        old_ok = old < len(known)
        old_ok[old_ok] = known[old[old_ok]] == used[old_ok]
        name = np.empty(len(used), np.int64)
        name[old_ok] = names[old[old_ok]]
        fresh = used[~old_ok]
        name[~old_ok] = len(sizes) + np.arange(len(fresh))
        a, b = sizes[fresh >> 32], sizes[fresh & 0xFFFFFFFF]
        lefts.append(a)
        totals.append(a + b)
        sizes = np.concatenate([sizes, a + b])
        known, names = np.concatenate([known, fresh]), np.concatenate([names, name[~old_ok]])
        by_key = np.argsort(known)
        known, names = known[by_key], names[by_key]
        replace(at, name[new])

    while True:
        start = np.searchsorted(text, text)  # first symbol of the same text
        at = np.flatnonzero((np.arange(len(symbol)) - start) % 2 == 0)
        at = at[at + 1 < len(symbol)]
        at = at[text[at] == text[at + 1]]
        if not len(at):
            break
        a, b = sizes[symbol[at]], sizes[symbol[at + 1]]
        lefts.append(a)
        totals.append(a + b)
        new = len(sizes) + np.arange(len(at))
        sizes = np.concatenate([sizes, a + b])
        replace(at, new)

    if not derived:
        return Rules(*(np.empty(0, np.int64) for _ in range(5)))
    base = len(sizes) - sum(map(len, totals))
    rule, where = (np.concatenate(x) for x in zip(*derived))
    left, total = np.concatenate(lefts), np.concatenate(totals)
    rule = rule - base
    large = total >= least
    number = np.cumsum(large) - 1
    own = large[rule]
    rule, where = number[rule[own]], where[own]
    first = np.empty(int(large.sum()), np.int64)
    first[rule[::-1]] = where[::-1]
    return Rules(first, left[large], total[large], rule, where)


class Equal:
    """Whether stretches of words are equal, by prefix hashes to two moduli; places and lengths are arrays."""

    def __init__(self, words: np.ndarray, seed: int):
        random = np.random.default_rng(seed)
        self.sums, self.powers = [], []
        for p in PRIMES:
            value = random.integers(1, p, int(words.max()) + 1 if len(words) else 1, np.int64)
            base, power = int(random.integers(1 << 20, p)), np.ones(1, np.int64)
            while len(power) <= len(words):
                power = np.concatenate([power, power * pow(base, len(power), p) % p])
            sums = np.concatenate([[0], np.cumsum(value[words] * power[:len(words)] % p)]) % p
            self.sums.append(sums)
            self.powers.append(power)

    def __call__(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For ``i < j``."""
        out = np.ones(len(i), bool)
        for p, s, power in zip(PRIMES, self.sums, self.powers):
            out &= (s[i + size] - s[i]) % p * power[j - i] % p == (s[j + size] - s[j]) % p
        return out

    def ahead(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that follow ``i`` and ``j`` alike, ``most`` at most."""
        return self._longest(most, lambda k, at: self(i[at], j[at], k))

    def back(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words before ``i`` and ``j`` that are alike."""
        return self._longest(most, lambda k, at: self(i[at] - k, j[at] - k, k))

    @staticmethod
    def _longest(most: np.ndarray, equal: Callable) -> np.ndarray:
        low, high = np.zeros(len(most), np.int64), most.astype(np.int64)
        while len(at := np.flatnonzero(low < high)):
            k = (low[at] + high[at] + 1) // 2
            yes = equal(k, at)
            low[at[yes]] = k[yes]
            high[at[~yes]] = k[~yes] - 1
        return low


def boundary_runs(words: np.ndarray, rules: Rules, equal: Equal, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(rule, start in it, end in it, period) of stretches that cross, or touch, a rule's boundary, each rule once.

    With period q the words at the boundary equal those q further, or q before.  These
    two places agree over ``max(q, least - q)`` words in all, hence over half of that
    on one side.  Three words on a side are compared first, then that half, then all.
    """
    if not len(words):
        return tuple(np.empty(0, np.int64) for _ in range(4))
    padded = np.concatenate([words, np.full(4, -1, words.dtype)]).astype(np.int64)
    mixed = padded[:-2] * 0x9E3779B1 + padded[1:-1] * 0x85EBCA77 + padded[2:] * 0xC2B2AE3D
    three = (mixed ^ mixed >> 31).astype(np.int32)
    begin, middle, end = rules.first, rules.first + rules.left, rules.first + rules.size
    found = []
    for ahead in (True, False):
        most = np.minimum(end - middle if ahead else middle - begin, rules.size // 2)
        bounds = np.concatenate([[0], np.cumsum(most)])
        at = 0
        while at < len(most):
            stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK, side="right")) - 1)
            n = most[at:stop]
            q = np.arange(1, bounds[stop] - bounds[at] + 1, dtype=np.int32) - np.repeat((bounds[at:stop] - bounds[at]).astype(np.int32), n)
            i = np.repeat(middle[at:stop].astype(np.int32), n)
            j = i + q
            if not ahead:
                i, j = i - q, i
            like = np.flatnonzero((three[i] == three[j]) | (three[i - 3] == three[j - 3]))
            r = at + np.searchsorted(bounds[at + 1:stop + 1] - bounds[at], like, side="right")
            i, j, q = (x[like].astype(np.int64) for x in (i, j, q))
            half = (np.maximum(q, least - q) + 1) // 2
            after, before = j + half <= end[r], i - half >= begin[r]
            after[after] = equal(i[after], j[after], half[after])
            before &= ~after
            before[before] = equal(i[before] - half[before], j[before] - half[before], half[before])
            keep = after | before
            r, i, j, q = r[keep], i[keep], j[keep], q[keep]
            s, e = i - equal.back(i, j, i - begin[r]), j + equal.ahead(i, j, end[r] - j)
            keep = e - s >= np.maximum(least, 2 * q)
            found.append((r[keep], (s - begin[r])[keep], (e - begin[r])[keep], q[keep]))
            at = stop
    r, s, e, q = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 4
    return _least_period(r, s, e, q)


def _least_period(group: np.ndarray, s: np.ndarray, e: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of equal stretches the one of least period: its multiples continue exactly as far."""
    order = np.lexsort((q, e, s, group))
    group, s, e, q = group[order], s[order], e[order], q[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (group[1:] != group[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    return group[keep], s[keep], e[keep], q[keep]


def maximal(text: np.ndarray, s: np.ndarray, e: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of a period that lie in a longer one of it go; those left overlap by less than a period."""
    order = np.lexsort((-e, s, q, text))
    text, s, e, q = text[order], s[order], e[order], q[order]
    if not len(s):
        return text, s, e, q
    new = np.ones(len(s), bool)
    new[1:] = (text[1:] != text[:-1]) | (q[1:] != q[:-1])
    lift = np.cumsum(new) * (int(e.max()) + 1)  # ends of later groups are above all earlier ones
    reach = np.maximum.accumulate(e + lift)
    keep = new.copy()
    keep[1:] |= (e + lift)[1:] > reach[:-1]
    return _least_period(text[keep], s[keep], e[keep], q[keep])


def runs_of(words: np.ndarray, begin: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs, by text, start and period; text k has ``words[begin[k]:begin[k + 1]]``."""
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    rules, seed = grammar(words, owner, least), 0
    by_rule = np.argsort(rules.rule, kind="stable")
    place = rules.place[by_rule]
    known = np.searchsorted(rules.rule[by_rule], np.arange(len(rules.first) + 1))
    while True:
        r, s, e, q = boundary_runs(words, rules, Equal(words, seed), least)
        n = known[r + 1] - known[r]
        which = np.repeat(known[r] - np.concatenate([[0], np.cumsum(n)[:-1]])[:len(n)], n) + np.arange(n.sum())
        at = place[which]
        text, s, e, q = maximal(owner[at], at + np.repeat(s, n), at + np.repeat(e, n), np.repeat(q, n))
        if all((words[a:b - p] == words[a + p:b]).all() for a, b, p in zip(s.tolist(), e.tolist(), q.tolist())):
            break
        seed += 1  # two different stretches had one hash
    order = np.lexsort((q, s, text))
    text, s, e, q = text[order], s[order], e[order], q[order]
    return text, s - begin[text], e - s, q


class Collapser:
    """Runs of each text of a batch, and the texts without what a run repeats after its first period."""

    def __init__(self, least: int):
        self.least = least

    def __call__(self, texts: list[list[bytes]]) -> tuple[list[list[dict]], list[bytes]]:
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int32, sum(map(len, texts)))
        begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        runs: list[list[dict]] = [[] for _ in texts]
        for k, s, n, q in zip(*(x.tolist() for x in runs_of(ids, begin, self.least))):
            runs[k].append({"start": s, "length": n, "period": q})
        return runs, [self.kept(t, own) for t, own in zip(texts, runs)]

    @staticmethod
    def kept(words: list[bytes], runs: list[dict]) -> bytes:
        if runs:
            gone = np.zeros(len(words) + 1, np.int64)
            for r in runs:
                gone[r["start"] + r["period"]] += 1
                gone[r["start"] + r["length"]] -= 1
            words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
        return b" ".join(words)


def collapse_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST,
                  rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """A row a document: ``doc_id``, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    Words are parted by blanks and ASCII controls 09 to 0D; ``collapsed`` has the kept ones,
    one blank between.  ``rewrite`` may change the words of a document before.
    """
    rows = id_and_text(docs, doc_id, text)
    schema = with_schema(rows, ("n_words", "long"), ("runs", "array<struct<start:long,length:long,period:long>>"), ("collapsed", "string"))
    columns = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        collapse = Collapser(least)
        for batch in batches:
            size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH_BYTES)))
                part = batch.slice(at, stop - at)
                ids = part.column("doc_id")
                texts = [t.encode().split() if t else [] for t in part.column("text").to_pylist()]
                if rewrite:
                    texts = [rewrite(i, t) for i, t in zip(ids.to_pylist(), texts)]
                runs, kept = collapse(texts)
                yield pa.RecordBatch.from_arrays([ids.cast(columns.field(0).type), pa.array(map(len, texts), pa.int64()),
                                                  pa.array(runs, columns.field("runs").type), pa.array(kept, pa.string())], schema=columns)
                at = stop

    return rows.mapInArrow(run, schema)
