"""Language-model scores by a probabilistic suffix tree over tokens, letters below its root, and a unigram base."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby, islice
from math import log10

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, store

#: The end of a text as a token; no word holds white space.
END = b"\n"
#: Longest context in bytes, least share of all symbols a context needs, and least gain (a G statistic) to be kept.
DEPTH, LEAST_SHARE, LEAST_GAIN = 6, 4e-6, 50.0
#: Occurrences and gain (a G statistic) that a context of one or two tokens needs to be a state, whatever the corpus.
LEAST_COUNT, LEAST_TOKEN_GAIN = 8, 50.0
#: Contexts of at least a place in so many are spread over the buckets; their sums are broadcast, at most so many.
HEAD_GRAMS = 10_000
#: Tokens in a chunk (a longer text is a chunk), and places that a bucket gets on average.
CHUNK_TOKENS, BUCKET_PLACES = 800_000, 1_000_000
#: The number of what stands before the first token of a text, and odd constants that mix the bits of a hash.
START, MIX, MIX2, MIX3 = np.uint64(0), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15), np.uint64(0x94D049BB133111EB)
CACHED_WORDS = 200_000
_MESSAGE = ("bucket int, chunk long, context binary, second binary, runs binary, hot binary, word binary, expected binary, "
            "learned binary, others binary")
_REPLY = "chunk long, bucket int, counts binary, kinds binary, hot array<struct<context:long,n:long,t:long,g:double>>"


def tokens_of(text: str | None) -> list[bytes]:
    """Words between white space with A-Z lowered, then one end; as UTF-8, whose other letters hold no ASCII bytes."""
    return [*(text or "").encode().lower().split(), END]


def held_out(doc_id: str = "doc_id", parts: int = 7, part: int = 2) -> Column:
    """Whether an id is never learned from: its text's crc32 leaves ``part`` by ``parts``; a null id's is that of no bytes."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == part


def symbols_of(words: list[bytes], depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each context length: keys of (context, next symbol), and the number of the word of each.

    A word is read as blank, bytes, blank, the first blank only as context; the end is
    read as one symbol after a blank.  A key has the context's bytes above the symbol's.
    """
    parts = [b" " + END if w == END else b" " + w + b" " for w in words]
    buffer = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    sizes = np.array([len(p) for p in parts], np.int64)
    word = np.repeat(np.arange(len(parts)), sizes)
    place = np.arange(len(buffer)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(place > 0)
    key = buffer[at]
    for d in range(depth + 1):
        if d:
            deep = place[at] >= d
            at, key = at[deep], key[deep]
            key = key + (buffer[at - d] << (8 * d))
        yield d, key, word[at]


def count_contexts(words: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(d, ctx, key, c): how often each symbol follows each context of d bytes in the counted tokens.

    Sums of a task go to the tasks of their contexts, each of which has at most 256 symbols.
    """
    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys)
        keys = keys[order]
        heads = cuts_of(keys)[:-1]
        return [(keys[heads], np.add.reduceat(counts[order], heads))] if len(keys) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(depth + 1)]
        fresh = 0

        def tables() -> Iterator[pa.RecordBatch]:
            for d, (keys, counts) in ((d, x) for d, parts in enumerate(kept) if parts for x in summed(parts)):
                for k in range(0, len(keys), 100_000):
                    part = keys[k:k + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), d, np.int32)), pa.array(part), pa.array(counts[k:k + 100_000])],
                        names=["d", "key", "c"])

        for batch in batches:
            for k in range(0, batch.num_rows, 20_000):
                part = batch.slice(k, 20_000)
                weight = part.column("c").to_numpy()
                for d, keys, word in symbols_of(part.column("w").to_pylist(), depth):
                    kept[d].append((keys, weight[word]))
                    fresh += len(keys)
            if fresh > 2_000_000:
                kept, fresh = [summed(parts) if parts else [] for parts in kept], 0
            if not fresh and sum(len(k) for parts in kept for k, _ in parts) > 2_000_000:
                yield from tables()
                kept = [[] for _ in range(depth + 1)]
        yield from tables()

    return (words.select("w", "c").mapInArrow(run, "d int, key long, c long").withColumn("ctx", F.shiftright("key", 8))
            .repartition("d", "ctx").groupBy("d", "ctx", "key").agg(F.sum("c").alias("c")))


def learn_tree(words: DataFrame, depth: int = DEPTH, least_share: float = LEAST_SHARE,
               least_gain: float = LEAST_GAIN) -> dict[bytes, dict[int, int]]:
    """The retained contexts with the counts of their next symbols.

    A context must hold at least ``least_share`` of all symbols, which bounds the tree to
    ``depth / least_share`` contexts whatever the corpus, and its distribution must differ from
    that of the context one byte shorter by twice the count times the divergence (the G
    statistic) of at least ``least_gain``.  The suffixes of a retained context stay with it.
    """
    symbols = F.octet_length("w") + F.when(F.col("w") == F.lit(END), 0).otherwise(1)  # a word and a blank, or the end
    total = words.agg(F.sum(F.col("c") * symbols)).first()[0] or 0
    own = store(count_contexts(words, depth).withColumn("n", F.sum("c").over(Window.partitionBy("d", "ctx")))
                .where(F.col("n") >= max(1.0, least_share * total)), "context-counts")
    above = own.select((F.col("d") + 1).alias("d"), F.col("key").alias("up"), F.col("c").alias("uc"), F.col("n").alias("un"))
    up = F.expr("key & (shiftleft(1L, 8 * d) - 1)")
    gain = 2 * F.col("c") * F.log(F.col("c") / F.col("n") * F.col("un") / F.col("uc"))
    tested = (own.where("d > 0").withColumn("up", up).join(above, ["d", "up"])
              .groupBy("d", "ctx").agg(F.sum(gain).alias("gain")).where(F.col("gain") >= least_gain).drop("gain"))
    name = lambda d, ctx: int(ctx).to_bytes(int(d), "big")
    kept = {name(r.d, r.ctx) for r in tested.collect()}  # bounded, as are the pairs below
    kept = {s[k:] for s in kept for k in range(len(s))} | {b""}
    tree: dict[bytes, dict[int, int]] = {s: {} for s in kept}
    table = own.select("d", "key", "c").toArrow()
    for d, key, c in zip(*(table.column(i).to_pylist() for i in range(3)), strict=True):
        s = name(d, key >> 8)
        if s in tree:
            tree[s][key & 255] = c
    discard(own)
    return tree


class SuffixTree:
    """Scores symbols from the state of the longest retained suffix; states and moves are worked out as they are met."""

    def __init__(self, tree: dict[bytes, dict[int, int]]):
        self.tree = tree
        self.totals = {s: sum(c.values()) for s, c in tree.items()}
        self.moves: dict[bytes, dict[int, tuple[float, bytes]]] = {}
        self.words: dict[bytes, float] = {}
        self.start = self.state(b" ")
        # The same as arrays: states by number, each a length above its bytes; counts by state and symbol.
        names = sorted({b"", *tree}, key=lambda s: (len(s), s))
        self.numbers = {s: i for i, s in enumerate(names)}
        self.values = np.array([(len(s) << 56) | int.from_bytes(s, "big") for s in names], np.int64)
        self.parents = np.array([self.numbers[self.state(s[1:])] for s in names], np.int64)
        self.sums = np.array([self.totals.get(s, 0) for s in names], np.float64)
        self.seen = np.array([len(tree.get(s, ())) for s in names], np.float64)
        pairs = [((i << 8) | x, tree[s][x]) for i, s in enumerate(names) for x in sorted(tree.get(s, ()))]
        self.keys, self.counts = (np.array([*x, 0], np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), ())))
        self.keys[-1] = np.iinfo(np.int64).max
        # The moves met so far by number of state and symbol, in order.
        self.codes, self.gains, self.nexts = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def state(self, context: bytes) -> bytes:
        for k in range(max(0, len(context) - 16), len(context) + 1):
            if context[k:] in self.tree:
                return context[k:]
        return b""

    def chance(self, state: bytes, symbol: int) -> float:
        """Counts smoothed by the parent's chance, weighted with the number of symbols seen (Witten and Bell)."""
        counts = self.tree.get(state, {})
        if not state:
            return (counts.get(symbol, 0) + 1) / (self.totals.get(b"", 0) + 257)
        seen = len(counts)
        return (counts.get(symbol, 0) + seen * self.chance(state[1:], symbol)) / (self.totals[state] + seen) \
            if seen else self.chance(state[1:], symbol)

    def step(self, state: bytes, symbol: int) -> tuple[float, bytes]:
        move = log10(self.chance(state, symbol)), self.state(state + bytes((symbol,)))
        self.moves.setdefault(state, {})[symbol] = move
        return move

    def score(self, token: bytes) -> float:
        """log10 of the token's probability."""
        known = self.words.get(token)
        if known is None:
            moves, state, known = self.moves, self.start, 0.0
            for symbol in token if token == END else token + b" ":
                try:
                    gain, state = moves[state][symbol]
                except KeyError:
                    gain, state = self.step(state, symbol)
                known += gain
            if len(self.words) >= CACHED_WORDS:
                self.words.clear()
            if len(token) < 64:
                self.words[token] = known
        return known


    def learn(self, codes: np.ndarray) -> None:
        """Works out moves that are met for the first time; their codes are in order."""
        state, symbol = codes >> 8, codes & 255

        def count(states: np.ndarray) -> np.ndarray:
            key = (states << 8) | symbol
            at = np.searchsorted(self.keys, key)
            return np.where(self.keys[at] == key, self.counts[at], 0)

        chain = [state]
        while chain[-1].any():
            chain.append(self.parents[chain[-1]])
        chance = (count(np.zeros_like(state)) + 1) / (self.sums[0] + 257)
        for of in chain[::-1]:
            seen = self.seen[of]
            chance = np.where((of > 0) & (seen > 0), (count(of) + seen * chance) / np.maximum(self.sums[of] + seen, 1), chance)
        gains = [log10(x) for x in chance.tolist()]
        size, grown = (self.values[state] >> 56) + 1, ((self.values[state] & ((1 << 48) - 1)) << 8) | symbol
        nexts = np.zeros_like(state)
        for n in range(1, 8):  # the longest suffix that is a state, at last
            value = (n << 56) | (grown & ((1 << (8 * n)) - 1))
            at = np.minimum(np.searchsorted(self.values, value), len(self.values) - 1)
            nexts = np.where((size >= n) & (self.values[at] == value), at, nexts)
        place = np.searchsorted(self.codes, codes) + np.arange(len(codes))
        rest = np.ones(len(self.codes) + len(codes), bool)
        rest[place] = False

        def merged(old: np.ndarray, new: object) -> np.ndarray:
            out = np.empty(len(rest), old.dtype)
            out[rest], out[place] = old, new
            return out

        self.codes, self.gains, self.nexts = (
            merged(*x) for x in ((self.codes, codes), (self.gains, gains), (self.nexts, nexts)))

    def scores(self, tokens: list[bytes]) -> np.ndarray:
        """``score`` of each token, one symbol of all tokens after another; long tokens one by one."""
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        long = sizes >= 64
        parts = [b"" if far else w if w == END else w + b" " for w, far in zip(tokens, long.tolist(), strict=True)]
        buffer = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        heads = np.cumsum(sizes) - sizes
        out, state = np.zeros(len(tokens)), np.full(len(tokens), self.numbers[self.start])
        for k in range(int(sizes.max(initial=0))):
            live = np.flatnonzero(sizes > k)
            code = (state[live] << 8) + buffer[heads[live] + k]
            own, _, at = distinct(code)
            move = np.searchsorted(self.codes, own)
            new = own[np.append(self.codes, -1)[move] != own]
            if len(new):
                self.learn(new)
                move = np.searchsorted(self.codes, own)
            move = move[at]
            out[live] += self.gains[move]
            state[live] = self.nexts[move]
        for i in np.flatnonzero(long).tolist():
            out[i] = self.score(tokens[i])
        return out


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of pairs of numbers or hashes."""
    mixed = left * MIX
    mixed = ((mixed ^ (mixed >> np.uint64(29))) + right * MIX3) * MIX2
    return mixed ^ (mixed >> np.uint64(32))


def planes(values: np.ndarray) -> bytes:
    """Numbers as all first bytes, then all second ones and so on, compressed: high bytes, mostly equal, cost little.

    Whole numbers from 0 are cut to the bytes that the largest needs; the first byte tells how many.
    """
    if values.dtype.kind in "iu" and (values.dtype.kind == "u" or values.min(initial=0) >= 0):
        values = values.astype(np.min_scalar_type(int(values.max(initial=0))))
    return bytes((values.itemsize,)) + zstandard.ZstdCompressor(level=1).compress(
        values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())


def numbers(data: bytes, kind: type) -> np.ndarray:
    raw, size, kind = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8), data[0], np.dtype(kind)
    held = np.dtype(f"u{size}") if size < kind.itemsize else kind
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(held).ravel().astype(kind, copy=False)


def split_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, as ``tokens_of`` gives them but without the ends, and the number of each text's."""
    raw = [(t or "").encode() for t in texts.to_pylist()]
    buffer = np.frombuffer(b"".join(r + b"\n" for r in raw).lower(), np.uint8)
    white = (buffer == 32) | ((buffer >= 9) & (buffer <= 13))
    edges = np.flatnonzero(np.diff(white, prepend=True))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buffer[~white])])
    heads = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return words, np.diff(np.searchsorted(starts, heads))


def chunk_texts(texts: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """(doc_id, text, learn, scored) as chunks of whole texts: distinct tokens, and each place as the number of its token."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held = 0
        tokens: list[pa.Array] = []
        counts: list[np.ndarray] = []
        parts: list[pa.RecordBatch] = []

        def chunk() -> pa.RecordBatch:
            rows, own = pa.Table.from_batches(parts).combine_chunks(), np.concatenate(counts)
            flag = lambda name: rows[name].to_numpy().astype(np.uint8).tobytes()
            ids = rows["doc_id"].combine_chunks()
            coded = pa.concat_arrays(tokens).dictionary_encode()
            places, known = coded.indices.to_numpy(), coded.dictionary
            end = int(places[:own[0]].max(initial=-1)) + 1  # ends are numbered as they are met too
            places = np.insert(places + (places >= end), np.cumsum(own), end)
            known = pa.concat_arrays([known[:end], pa.array([END], pa.binary()), known[end:]])
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), one(ids), pa.array([(own + 1).tobytes()]), pa.array([flag("learn")]),
                pa.array([flag("scored")]), one(known), pa.array([planes(places.astype(np.int32))])],
                names=["chunk", "ids", "sizes", "learn", "scored", "words", "places"])

        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                part = batch.slice(k, 100)
                words, own = split_texts(part.column("text"))
                ends = np.cumsum(own)
                begun = 0
                for i, size in enumerate((own + 1).tolist(), 1):
                    held += size
                    if held >= chunk_tokens or i == len(own):
                        first = int(ends[begun - 1]) if begun else 0
                        tokens.append(words[first:int(ends[i - 1])])
                        counts.append(own[begun:i])
                        parts.append(part.slice(begun, i - begun).select(["doc_id", "learn", "scored"]))
                        begun = i
                    if held >= chunk_tokens:
                        yield chunk()
                        held, number = 0, number + 1
                        tokens, counts, parts = [], [], []
        if counts:
            yield chunk()

    return texts.select("doc_id", "text", "learn", "scored").mapInArrow(
        run, f"chunk long, ids array<{kind}>, sizes binary, learn binary, scored binary, words array<binary>, "
             "places binary")


def count_tokens(chunks: DataFrame) -> DataFrame:
    """(w, c, m): every token with its number in texts to learn from, and in all; summed over chunks of a task before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def summed() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).group_by("w", use_threads=False).aggregate([("c", "sum"), ("m", "sum")])
            yield from table.select(["w", "c_sum", "m_sum"]).rename_columns(["w", "c", "m"]).to_batches(50_000)
            held.clear()

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                words = row.column("words").flatten()
                sizes, learn, places = (row.column(x)[0].as_py() for x in ("sizes", "learn", "places"))
                places, learned = numbers(places, np.int32), np.repeat(
                    np.frombuffer(learn, np.uint8), np.frombuffer(sizes, np.int64))
                held.append(pa.RecordBatch.from_arrays(
                    [words, *(pa.array(np.bincount(places, x, len(words)).astype(np.int64)) for x in (learned, None))],
                    names=["w", "c", "m"]))
                if sum(x.num_rows for x in held) > 1_000_000 or sum(x.nbytes for x in held) > 1 << 26:
                    yield from summed()
        if held:
            yield from summed()

    return (chunks.select("sizes", "learn", "words", "places").mapInArrow(run, "w binary, c long, m long")
            .groupBy("w").agg(F.sum("c").alias("c"), F.sum("m").alias("m")))


def cuts_of(values: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin, and the end."""
    inner = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate([np.zeros(min(1, len(values)), np.int64), inner, np.full(1, len(values))])


def together(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Small rows in batches of a bounded number."""
    while some := list(islice(rows, 32)):
        yield pa.RecordBatch.from_pylist(some, schema=schema)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, a place of each, and the number of the value at each place.

    Small values are sorted together with their places in one number, which takes half the time.
    """
    bits = len(values).bit_length()
    if values.dtype == np.int64 and int(values.max(initial=0)) >> (63 - bits) == 0:
        packed = np.sort((values << bits) | np.arange(len(values)))
        order = packed & ((1 << bits) - 1)
        cuts = cuts_of(packed >> bits)
    else:
        order = np.argsort(values)
        cuts = cuts_of(values[order])
    one, at = order[cuts[:-1]], np.empty(len(values), np.int64)
    at[order] = np.repeat(np.arange(len(one)), np.diff(cuts))
    return values[one], one, at


def dealt(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """The places of bucket numbers in order; numbers of 16 bits are sorted by digits."""
    return np.argsort(bucket.astype(np.min_scalar_type(buckets)), kind="stable")


#: The columns of a message with the numbers of a context's tokens; small numbers, where their hash would be as long as any.
PARTS = ("context", "second")


def named(parts: tuple[np.ndarray, ...]) -> np.ndarray:
    """What contexts of one or two tokens are called."""
    return parts[0] if len(parts) == 1 else joined(*parts)


class Level:
    """The distinct (context, token) runs of a chunk, laid out by the buckets that count them over all chunks."""

    def __init__(self, code: np.ndarray, bits: int, learned: np.ndarray, buckets: int, parts: tuple[np.ndarray, ...],
                 hot: np.ndarray, words: np.ndarray):
        """``code`` is the context above ``bits`` of token at each place; parts (the numbers of a context's tokens) and hot
        are by context, words by token."""
        own, _, self.at = distinct(code)
        self.context, self.token = own >> bits, own & ((1 << bits) - 1)
        self.learned = np.bincount(self.at, learned, len(own)).astype(np.int32)
        self.placed = np.bincount(self.at, minlength=len(own)).astype(np.int32)
        self.parts, self.hot, self.words = parts, hot, words[self.token]
        self.names = names = named(parts)
        name = names[self.context]
        spread = np.flatnonzero(hot[self.context])
        name[spread] = joined(name[spread], self.words[spread])
        bucket = name % np.uint64(buckets)
        self.order = dealt(bucket, buckets)
        bucket = bucket[self.order]
        cuts = cuts_of(bucket)
        self.slices = {int(bucket[a]): self.order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)}

    def messages(self, chunk: int, below: np.ndarray) -> Iterator[dict]:
        """One row a bucket; ``below`` is by run the chance of its token after the context one token shorter."""
        learned = self.learned > 0  # others may have no such chance, and count for nothing
        expected = np.zeros(len(below))
        expected[learned] = self.learned[learned] * np.log(below[learned])
        for bucket, at in self.slices.items():
            cuts = cuts_of(self.context[at])
            first = self.context[at[cuts[:-1]]]
            yield {"bucket": bucket, "chunk": chunk, **{k: planes(x[first]) for k, x in zip(PARTS, self.parts)},
                   "runs": planes(np.diff(cuts).astype(np.int32)), "hot": planes(self.hot[first]),
                   "word": planes(self.words[at]),
                   "expected": planes(np.add.reduceat(expected[at], cuts[:-1])),
                   "learned": planes(self.learned[at]), "others": planes(self.placed[at] - self.learned[at])}

    def read(self, replies: list[dict], sums: tuple[np.ndarray, ...]) -> None:
        """Sets ``count`` and ``often`` by run, ``seen`` and ``state`` by context; those of hot contexts are in ``sums``."""
        counts, kinds = np.zeros(len(self.context), np.int64), np.zeros(len(self.names), np.int64)
        for reply in replies:
            at = self.slices[reply["bucket"]]
            counts[at] = numbers(reply["counts"], np.int64)
            kinds[self.context[at[cuts_of(self.context[at])[:-1]]]] = numbers(reply["kinds"], np.int64)
        names, values = sums
        if len(names):
            hot = np.flatnonzero(self.hot)
            found = np.minimum(np.searchsorted(names, self.names[hot]), len(names) - 1)
            same = names[found] == self.names[hot]
            kinds[hot[same]] = values[found[same]]
        self.count, self.often = counts >> 1, (counts & 1).astype(bool)
        self.seen, self.state = kinds >> 1, (kinds & 1).astype(bool)


def kinds_of(n: np.ndarray, t: np.ndarray, g: np.ndarray, least_gain: float) -> np.ndarray:
    """Twice the distinct tokens of a context, and one more if it is a state.

    ``g`` is the sum over its training places of the log of its token's count in it over the chance
    after the shorter context; less n log n, twice, it is the G statistic.
    """
    return (2 * t + (2 * (g - n * np.log(np.maximum(n, 1))) >= least_gain)).astype(np.int64)


def count_runs(messages: DataFrame, buckets: int, often: float, least_gain: float) -> DataFrame:
    """Replies to the messages of a level: counts over all chunks, each context's distinct tokens and whether it is a state.

    A context is in one bucket, but a hot one in all; of those a bucket gives what it has.
    A count is doubled, and odd where the run stands ``often`` times in all texts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        if not rows:
            return
        whole = lambda name, kind: np.concatenate([numbers(r[name], kind) for r in rows])
        hot, runs = whole("hot", np.bool_), [numbers(r["runs"], np.int32) for r in rows]
        contexts, runs = [len(x) for x in runs], np.concatenate(runs)
        names = named(tuple(whole(k, np.uint64) for k in PARTS if rows[0][k] is not None))
        places = np.add.reduceat(runs, np.cumsum([0, *contexts[:-1]])).tolist()
        context = np.repeat(np.arange(len(runs)), runs)
        _, first, at = distinct(joined(names[context], whole("word", np.uint64)))
        count = np.bincount(at, whole("learned", np.int32))
        placed = count + np.bincount(at, whole("others", np.int32))
        own, one, group = distinct(names)
        of = group[context[first]]
        seen = count > 0
        gain = np.zeros(len(count))
        gain[seen] = count[seen] * np.log(count[seen])
        t, n, gains = (np.bincount(of, x, len(own)) for x in (seen, count, gain))
        gains -= np.bincount(group, whole("expected", np.float64), len(own))
        kinds = kinds_of(n, t, gains, least_gain)
        answer = (count.astype(np.int64) * 2 + (placed >= often))[at]
        head = np.flatnonzero(hot[one])
        made = {"chunk": -1, "bucket": rows[0]["bucket"], "hot": [
            {"context": int(own[k].view(np.int64)), "n": int(n[k]), "t": int(t[k]), "g": float(gains[k])} for k in head]}
        schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()), ("kinds", pa.binary()),
                            ("hot", pa.list_(pa.struct([("context", pa.int64()), ("n", pa.int64()), ("t", pa.int64()),
                                                        ("g", pa.float64())])))])
        yield pa.RecordBatch.from_pylist([made], schema=schema)

        def replies() -> Iterator[dict]:
            i = j = 0
            for r, m, k in zip(rows, places, contexts, strict=True):
                yield {"chunk": r["chunk"], "bucket": r["bucket"], "counts": planes(answer[i:i + m]),
                       "kinds": planes(kinds[group[j:j + k]])}
                i, j = i + m, j + k

        yield from together(replies(), schema)

    return messages.repartitionById(buckets, F.col("bucket")).mapInArrow(run, _REPLY)


def hot_sums(replies: DataFrame, least_gain: float) -> tuple[np.ndarray, np.ndarray]:
    """The hot contexts' names in order and their ``kinds_of``, over all buckets; as many as can be hot."""
    found = (replies.where("chunk < 0").select(F.explode("hot").alias("x")).select("x.*")
             .groupBy("context").agg(*(F.sum(x).alias(x) for x in "ntg")).toArrow())
    names = found.column("context").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(names)
    return names[order], kinds_of(*(found.column(x).to_numpy()[order] for x in "ntg"), least_gain)


def look_up(requests: DataFrame, entries: DataFrame, buckets: int) -> DataFrame:
    """(chunk, bucket, at, number, counts, chances, often): the entries of each request's tokens, in their order.

    Tokens are numbered too within their bucket, by falling count, so that later messages are small.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        table = [r for r in rows if r["chunk"] < 0]
        if not table:
            return
        whole = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in table])
        names = whole("word", np.uint64)
        order = np.argsort(names)
        names = names[order]
        counts, chances, often = (whole(n, k)[order] for n, k in (
            ("counts", np.int64), ("chances", np.float32), ("often", np.bool_)))
        number = np.zeros(len(names), np.uint32)
        number[np.argsort(-counts, kind="stable")] = np.arange(len(names), dtype=np.uint32)
        for r in rows:
            if r["chunk"] >= 0:
                at = np.searchsorted(names, np.frombuffer(r["word"], np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["chunk"]], pa.int64()), pa.array([r["bucket"]], pa.int32()),
                     *(pa.array([x], pa.binary()) for x in (
                         r["at"], planes(number[at]), planes(counts[at]), planes(chances[at]), often[at].tobytes()))],
                    names=["chunk", "bucket", "at", "number", "counts", "chances", "often"])

    return requests.unionByName(entries, allowMissingColumns=True).repartitionById(buckets, F.col("bucket")).select(
        "chunk", "bucket", "at", "word", "counts", "chances", "often").mapInArrow(
        run, "chunk long, bucket int, at binary, number binary, counts binary, chances binary, often binary")


def by_bucket(names: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    bucket = names % np.uint64(buckets)
    order = dealt(bucket, buckets)
    cuts = cuts_of(bucket[order])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def smoothed(c: np.ndarray, n: np.ndarray, seen: np.ndarray, below: np.ndarray) -> np.ndarray:
    """log10 of a count smoothed by the chance of the shorter context (Witten and Bell)."""
    rest = below + np.log10(np.maximum(seen, 1) / (n + seen))
    return np.where(c > 0, np.log10((c + seen * 10.0 ** below) / (n + seen)), rest)


class Chunk:
    """A chunk with what the tables have said of its tokens, its pairs and its runs of three, as far as they have."""

    def __init__(self, rows: list[dict], made: dict):
        self.row = next(r for r in rows if r["kind"] == 0)
        self.sizes = np.frombuffer(self.row["sizes"], np.int64)
        self.places = numbers(self.row["places"], np.int32).astype(np.int64)
        learned = np.repeat(np.frombuffer(self.row["learn"], np.uint8), self.sizes)
        buckets, least = made["buckets"], made["least_count"]
        width = int(self.places.max()) + 2  # every text has an end
        bits = width.bit_length()
        heads = np.cumsum(self.sizes) - self.sizes
        self.count, self.chance = np.zeros(width, np.int64), np.zeros(width)
        often, names = np.zeros(width, bool), np.full(width, START)
        for r in rows:
            if r["kind"] == 1:
                at = numbers(r["at"], np.int32)
                names[at] = numbers(r["number"], np.uint32).astype(np.uint64) * np.uint64(buckets) + np.uint64(r["bucket"] + 1)
                self.count[at] = numbers(r["counts"], np.int64)
                if "chances" in r:  # only the last pass reads them
                    self.chance[at] = numbers(r["chances"], np.float32)
                often[at] = np.frombuffer(r["often"], np.bool_)
        self.count[-1], often[-1] = made["texts"], True
        before = np.r_[width - 1, self.places[:-1]]
        before[heads] = width - 1
        self.one = np.flatnonzero(self.count[before] >= least)
        self.pairs = pairs = Level((before[self.one] << bits) | self.places[self.one], bits, learned[self.one], buckets,
                                   (names,), often, names)
        if "pairs" not in made:
            return
        pairs.read([r for r in rows if r["kind"] == 2], made["pairs"])
        pair = np.full(len(self.places), -1, np.int64)
        pair[self.one] = pairs.at
        earlier = np.r_[-1, pair[:-1]]
        earlier[heads] = -1
        self.two = np.flatnonzero((earlier >= 0) & (np.append(pairs.count, 0)[earlier] >= least))
        self.above = pair[self.two]
        self.runs = Level((earlier[self.two] << bits) | self.places[self.two], bits, learned[self.two], buckets,
                          (names[pairs.context], names[pairs.token]), pairs.often, names)
        if "runs" in made:
            self.runs.read([r for r in rows if r["kind"] == 3], made["runs"])

    def pair_messages(self, total: int) -> Iterator[dict]:
        return self.pairs.messages(self.row["chunk"], self.count[self.pairs.token] / max(1, total))

    def run_messages(self) -> Iterator[dict]:
        below = np.zeros(len(self.runs.context))
        below[self.runs.at] = self.pairs.count[self.above] / self.count[self.pairs.context[self.above]]
        return self.runs.messages(self.row["chunk"], below)

    def scores(self) -> np.ndarray:
        """Of each place the log10 chance of its token after the longest retained context."""
        out, one, pairs, runs = self.chance[self.places], np.zeros(len(self.places)), self.pairs, self.runs
        one[self.one] = smoothed(pairs.count, self.count[pairs.context], pairs.seen[pairs.context],
                                 self.chance[pairs.token])[pairs.at]
        state = self.one[pairs.state[pairs.context][pairs.at]]
        out[state] = one[state]
        state = np.flatnonzero(runs.state[runs.context][runs.at])
        at, place = runs.at[state], self.two[state]
        context = runs.context[at]
        out[place] = smoothed(runs.count[at], pairs.count[context], runs.seen[context], one[place])
        return out


#: The tree of a worker's last task, with the moves worked out so far.
_LAST_TREE: dict[str, SuffixTree] = {}


def tree_of(name: str, letters) -> SuffixTree:
    """The tree of a broadcast, kept from task to task."""
    if name not in _LAST_TREE:
        _LAST_TREE.clear()
        _LAST_TREE[name] = SuffixTree(letters.value)
    return _LAST_TREE[name]


def score_texts(docs: DataFrame, training: DataFrame | Column, *, doc_id: str = "doc_id", text: str = "text",
                depth: int = DEPTH, least_share: float = LEAST_SHARE, least_gain: float = LEAST_GAIN,
                least_count: int = LEAST_COUNT, least_token_gain: float = LEAST_TOKEN_GAIN,
                head_grams: int = HEAD_GRAMS, chunk_tokens: int = CHUNK_TOKENS,
                bucket_places: int = BUCKET_PLACES) -> DataFrame:
    """For each row of ``docs``: ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    ``training`` is the condition on the rows of ``docs`` that are learned from as well, or other
    texts in the column ``text`` of a table.  ``score`` is the model's log10
    probability of the tokens in their order, each from the longest retained run of up to two
    tokens before it.  Such a run is a state if it stands ``least_count`` times in the training
    texts and the tokens after it differ from those after the run one token shorter by a G
    statistic of ``least_token_gain`` (above 0); chances are smoothed by those of its suffixes.
    Below the contexts is a token's corpus count c, smoothed
    by the letters' tree p with the weight of the distinct tokens, (c + V p) / (N + V), so unseen
    tokens are scored by the tree.  ``base_score`` is that of add-one unigrams.

    Texts are read once and stored as chunks of numbered tokens.  A chunk sends its distinct tokens, pairs
    (after tokens of ``least_count``) and runs of three (after such pairs) to buckets of a hash of the context
    and gets the counts of all chunks back; a context with more than one place in ``head_grams`` is
    spread over all buckets by token too, and only its sums, at most so many, are broadcast.  A bucket holds
    about ``bucket_places`` places of tokens, as many as its share of all.  None of the counts is collected.
    Null and empty texts are one end; without
    training texts the base is 0 and the tree uniform over bytes; repeated rows repeat, each by
    itself; null ids stay null; other columns are not read.
    """
    flags = lambda learn, scored: (learn.alias("learn"), scored.alias("scored"))
    own = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"), *flags(
        F.coalesce(training, F.lit(False)) if isinstance(training, Column) else F.lit(False), F.lit(True)))
    kind = own.schema["doc_id"].dataType
    if not isinstance(training, Column):
        own = own.unionByName(training.select(F.lit(None).cast(kind).alias("doc_id"), training[text].cast("string").alias("text"),
                                              *flags(F.lit(True), F.lit(False))))
    context = docs.sparkSession.sparkContext
    chunks = store(chunk_texts(own, chunk_tokens), "token-chunks")
    words = store(count_tokens(chunks), "token-counts")
    total, placed, distinct, texts = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)),
        F.coalesce(F.sum(F.when(F.col("w") == F.lit(END), F.col("c"))), F.lit(0))).first()
    buckets, bound = placed // bucket_places + 1, max(1.0, placed / head_grams)
    letters = context.broadcast(learn_tree(words.where("c > 0").select("w", "c"), depth, least_share, least_gain))
    types, tree_name = max(1, distinct), uuid.uuid4().hex
    below, weight = log10(total + distinct + 1), log10(total + types)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = tree_of(tree_name, letters)
        held: list[tuple[np.ndarray, ...]] = []

        def entries() -> pa.RecordBatch:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            dealt_out = list(by_bucket(whole[0], buckets))
            return pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in dealt_out], pa.int32()), pa.array([-1] * len(dealt_out), pa.int64()),
                 *(pa.array([x[at].tobytes() for _, at in dealt_out], pa.binary()) for x in whole)],
                names=["bucket", "chunk", "word", "counts", "chances", "often"])

        for batch in batches:
            own, counts, chances = batch.column("w").to_pylist(), batch.column("c").to_numpy(), []
            for c, p in zip(counts.tolist(), tree.scores(own).tolist(), strict=True):
                chances.append((log10(c + types * 10.0 ** p) if c else p + log10(types)) - weight)
            names = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
            held.append((names, counts, np.array(chances, np.float32), batch.column("m").to_numpy() >= bound))
            if sum(len(x[0]) for x in held) >= 1_000_000:
                yield entries()
                held.clear()
        if held:
            yield entries()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, own in zip(batch.column("chunk").to_pylist(), batch.column("words").to_pylist(), strict=True):
                names = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
                asked = list(by_bucket(names, buckets))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in asked], pa.int32()), pa.array([chunk] * len(asked), pa.int64()),
                     pa.array([planes(at.astype(np.int32)) for _, at in asked], pa.binary()),
                     pa.array([names[at].tobytes() for _, at in asked], pa.binary())],
                    names=["bucket", "chunk", "at", "word"])

    tables = [store(look_up(
        chunks.select("chunk", "words").mapInArrow(ask, "bucket int, chunk long, at binary, word binary"),
        words.mapInArrow(spell, "bucket int, chunk long, word binary, counts binary, chances binary, often binary"),
        buckets), "token-entries")]
    discard(words)
    made = {"buckets": buckets, "least_count": least_count, "texts": texts}

    def gathered(*unread: str) -> DataFrame:
        """Each chunk with its replies, one after another in a task."""
        rows = chunks.drop("words").withColumn("kind", F.lit(0))
        for k, t in enumerate(tables, 1):
            rows = rows.unionByName((t.drop("hot") if k > 1 else t).withColumn("kind", F.lit(k)), allowMissingColumns=True)
        return rows.where("chunk >= 0").drop(*unread).repartition("chunk").sortWithinPartitions("chunk")

    def each(state: dict):
        def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
            rows = (r for batch in batches for k in range(0, batch.num_rows, 32) for r in batch.slice(k, 32).to_pylist())
            for _, own in groupby(rows, lambda r: r["chunk"]):
                yield Chunk(list(own), state)
        return chunked

    def messages(level: str, state: dict) -> DataFrame:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        schema, chunked = to_arrow_schema(_parse_datatype_string(_MESSAGE)), each(state)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in chunked(batches):
                yield from together(chunk.pair_messages(total) if level == "pairs" else chunk.run_messages(), schema)

        return gathered("ids", "scored", "chances").mapInArrow(run, _MESSAGE)

    for level in ("pairs", "runs"):
        tables.append(store(count_runs(messages(level, made), buckets, bound, least_token_gain), f"token-{level}"))
        made = made | {level: hot_sums(tables[-1], least_token_gain)}
    chunked = each(made)
    result = f"doc_id {kind.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunked(batches):
            row, n = np.repeat(np.arange(len(chunk.sizes)), chunk.sizes), len(chunk.sizes)
            count = chunk.count[chunk.places]
            values = [np.bincount(row, x, n) for x in (
                count > 0, np.log10(count + 1) - below, chunk.scores())]
            yield pa.RecordBatch.from_arrays(
                [chunk_ids(chunk.row["ids"]), pa.array(chunk.sizes), pa.array(values[0].astype(np.int64)),
                 pa.array(np.full(n, total, np.int64)), pa.array(values[1]), pa.array(values[2])],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]).filter(
                pa.array(np.frombuffer(chunk.row["scored"], np.uint8).astype(bool)))

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    chunk_ids = lambda ids: pa.array(ids, id_type)
    return gathered().mapInArrow(score, result)
