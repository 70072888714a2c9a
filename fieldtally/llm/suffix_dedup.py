"""Dedup of repeated byte strings by a sparse suffix sort with polynomial hashes.

A string of ``length`` bytes repeats only if the least hash among its ``gram``-byte
substrings repeats, at the same place in it.  So every window of a text belongs to one
anchor, its leftmost least gram; windows of one anchor form a context, and only contexts
whose gram occurs elsewhere with other surroundings need their suffixes sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, row_key, store

# An odd base, its inverse modulo 2**64, and two odd constants that mix the bits of a hash.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Windows of a text hashed together; longer texts go piece by piece.
PIECE = 1 << 18
#: Windows sorted together in a task, and contexts of a gram beyond which its windows are counted by their own hash.
BATCH_WINDOWS, GROUP_CONTEXTS = 200_000, 10_000
#: Share of those windows, as one in so many, above which a hash is met by broadcast.
HOT = 10_000


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    out = []
    for factor in (BASE, INVERSE):
        p = np.full(n, factor, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Prefixes:
    """Prefix polynomial hashes of a buffer; ``place`` numbers its bytes so that equal substrings hash alike."""

    def __init__(self, buffer: np.ndarray, place: np.ndarray | None, up: np.ndarray, down: np.ndarray):
        self.place, self.down = place, down
        weight = up[:len(buffer)] if place is None else up[place]
        self.sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * weight, out=self.sums[1:])

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        shift = self.down[start] if self.place is None else self.down[self.place[start]]
        return (self.sums[start + size] - self.sums[start]) * shift


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    least, step = values, 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    rest = width - step
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def contexts_of(raw: bytes, length: int, gram: int, up: np.ndarray,
                down: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """First window, number of windows, the anchor's distance from the first, gram hash and context hash of each context."""
    for begin in range(0, len(raw) - length + 1, PIECE):
        piece = np.frombuffer(raw, np.uint8, min(len(raw) - begin, PIECE + length - 1), begin)
        hashes = Prefixes(piece, None, up, down)
        n = len(piece) - gram + 1
        grams = (hashes.sums[gram:] - hashes.sums[:-gram]) * down[:n]
        mixed = (grams ^ (grams >> np.uint64(29))) * MIX
        low = np.uint64((1 << 19) - 1)  # places of a piece take 19 bits
        least = sliding_least((mixed & ~low) | np.arange(n, dtype=np.uint64), length - gram + 1)
        anchor = (least & low).astype(np.int64)
        first = np.r_[0, np.flatnonzero(np.diff(anchor)) + 1]
        count = np.diff(np.r_[first, len(anchor)])
        at = anchor[first]
        for lo, k, a, g in zip((first + begin).tolist(), count.tolist(), (at - first).tolist(),
                               mixed[at].view(np.int64).tolist(), strict=True):
            mark = xxhash.xxh3_64_intdigest(raw[lo:lo + k + length - 1], a)
            yield lo, k, a, g, mark - (mark >> 63 << 64)


class SuffixSorter:
    """Sorts windows of a buffer within groups: bottom-up mergesort, suffixes compared by hashes.

    The common extension of two suffixes is found by binary search on prefix hashes, so a
    comparison takes steps in the logarithm of ``length``.  All groups and runs of a
    level merge together: an element's place is its own in its run plus the number of
    elements of the sibling run before it, again found by binary search.
    """

    def __init__(self, buffer: np.ndarray, place: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int):
        self.buffer, self.starts, self.length = buffer, starts, length
        self.hashes = Prefixes(buffer, place, *powers(int(place.max(initial=0)) + 2))
        self.whole = self.hashes.of(starts, length)
        self.sizes = np.repeat(sizes, sizes)
        self.heads = np.repeat(np.cumsum(sizes) - sizes, sizes)

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair of windows."""
        out = np.zeros(len(a), np.int8)
        differ = np.flatnonzero(self.whole[a] != self.whole[b])
        x, y = self.starts[a[differ]], self.starts[b[differ]]
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.length)
        for _ in range(int(self.length - 1).bit_length()):  # equal at low, different at high
            middle = (low + high) >> 1
            same = self.hashes.of(x, middle) == self.hashes.of(y, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle)
        low = np.minimum(low, self.length - 1)
        out[differ] = np.sign(self.buffer[x + low].astype(np.int16) - self.buffer[y + low])
        return out

    def sort(self) -> np.ndarray:
        order = np.arange(len(self.starts))
        local = order - self.heads
        width = 1
        while width < self.sizes.max(initial=0):
            slots = np.flatnonzero(self.sizes > width)
            me, j, head = order[slots], local[slots], self.heads[slots]
            run = j // width
            sibling = (run ^ 1) * width
            low = np.zeros(len(slots), np.int64)
            high = np.clip(self.sizes[slots] - sibling, 0, width)
            second = (run & 1).astype(np.int8)  # equal elements of the first run stay before those of the second
            live = np.flatnonzero(low < high)
            while len(live):
                middle = (low[live] + high[live]) >> 1
                before = self.compare(order[head[live] + sibling[live] + middle], me[live]) < second[live]
                low[live] = np.where(before, middle + 1, low[live])
                high[live] = np.where(before, high[live], middle)
                live = live[low[live] < high[live]]
            order = order.copy()
            order[head + (run >> 1) * 2 * width + j - run * width + low] = me
            width *= 2
        return order

    def repeated(self) -> np.ndarray:
        """Whether each window equals another of its group; hash matches are verified byte by byte."""
        order = self.sort()
        out = np.zeros(len(order), bool)
        pairs = np.flatnonzero((self.whole[order[:-1]] == self.whole[order[1:]]) & (self.heads[:-1] == self.heads[1:]))
        wrong: set[int] = set()
        for k in range(0, len(pairs), 1 << 14):
            part = pairs[k:k + (1 << 14)]
            a, b = order[part], order[part + 1]
            reach = np.arange(self.length)
            true = (self.buffer[self.starts[a][:, None] + reach]
                    == self.buffer[self.starts[b][:, None] + reach]).all(1)
            out[a[true]] = out[b[true]] = True
            wrong.update(self.heads[part[~true]].tolist())
        for head in wrong:  # unlike windows of one hash: that group again, by its bytes
            members = range(head, head + int(self.sizes[head]))
            seen: dict[bytes, list[int]] = {}
            for i in members:
                s = int(self.starts[i])
                seen.setdefault(self.buffer[s:s + self.length].tobytes(), []).append(i)
            for same in seen.values():
                out[same] = len(same) > 1
        return out


def _context_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    schema = "_key long, lo int, n int, a int, g long, e long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, down = powers(PIECE + length + 1)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                columns: list[list[int]] = [[] for _ in range(6)]
                for key, raw in zip(part.column("_key").to_pylist(), part.column("raw").to_pylist(), strict=True):
                    for found in contexts_of(raw, length, gram, up, down):
                        for c, v in zip(columns, (key, *found), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32() if i in (1, 2, 3) else pa.int64()) for i, c in enumerate(columns)],
                    names=["_key", "lo", "n", "a", "g", "e"])

    return docs.select("_key", "raw").mapInArrow(run, schema)


def _chunks(met: DataFrame, length: int) -> DataFrame:
    """The bytes of each context to sort, under its gram."""
    schema = "g long, _key long, lo int, n int, a int, only boolean, bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200).to_pydict()
                out = [(w["g"], key, w["lo"], w["n"], w["a"], w["only"], raw[w["lo"]:w["lo"] + w["n"] + length - 1])
                       for key, raw, wanted in zip(part["_key"], part["raw"], part["wanted"], strict=True) for w in wanted]
                names = ["g", "_key", "lo", "n", "a", "only", "bytes"]
                kinds = [*[pa.int64()] * 2, *[pa.int32()] * 3, pa.bool_(), pa.binary()]
                for s in range(0, len(out), 50_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[i] for r in out[s:s + 50_000]], t) for i, t in enumerate(kinds)], names=names)

    return met.mapInArrow(run, schema)


def _hashed_repeats(met: DataFrame, length: int) -> DataFrame:
    """As _repeated_windows, for very frequent grams: windows meet as counts of 128-bit hashes, whatever their number.

    Hashes of over one window in ``HOT`` are at most so many and meet their windows by broadcast.
    """
    schema = "_key long, lo int, only boolean, h1 long, h2 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200).to_pydict()
                out: list[tuple] = []
                for key, raw, wanted in zip(part["_key"], part["raw"], part["wanted"], strict=True):
                    for w in wanted:
                        for p in range(w["lo"], w["lo"] + w["n"]):
                            mark = xxhash.xxh3_128_digest(raw[p:p + length])
                            out.append((key, p, w["only"], *(int.from_bytes(x, "little", signed=True)
                                                             for x in (mark[:8], mark[8:]))))
                kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
                for s in range(0, len(out), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out[s:s + 50_000]], t)
                                                      for i, t in enumerate(kinds)], names=["_key", "lo", "only", "h1", "h2"])

    windows = store(met.mapInArrow(run, schema), "hashed-windows")
    repeated = store(windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"), "repeated-hashes")
    bound = windows.count() / HOT
    hot = F.broadcast(repeated.where(F.col("n") > bound).drop("n"))
    rest, own = repeated.where(F.col("n") <= bound).drop("n"), windows.where("only")
    found = own.join(hot, ["h1", "h2"]).unionByName(own.join(hot, ["h1", "h2"], "left_anti").join(rest, ["h1", "h2"]))
    return found.select("_key", "lo", F.col("lo").alias("hi"))


def _repeated_windows(chunks: DataFrame, length: int) -> DataFrame:
    """Ranges of windows of contexts that occur once (``only``) which are repeated nevertheless."""
    schema = "_key long, lo int, hi int"

    def solve(groups: list[list[dict]]) -> list[tuple[int, int, int]]:
        rows = [r for g in groups for r in g]
        sizes = np.array([len(r["bytes"]) for r in rows])
        counts = np.array([r["n"] for r in rows])
        buffer = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
        place = np.arange(len(buffer)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = np.repeat(np.cumsum(sizes) - sizes, counts) + within
        # Equal windows have their anchor at the same distance, so each distance is a group of its own.
        distance = np.repeat(np.array([r["a"] for r in rows]), counts) - within
        group = np.repeat(np.repeat(np.arange(len(groups)), [len(g) for g in groups]), counts)
        order = np.lexsort((distance, group))
        new = (np.diff(group[order]) != 0) | (np.diff(distance[order]) != 0)
        members = np.diff(np.r_[0, np.flatnonzero(new) + 1, len(order)])
        flags = np.zeros(len(order), bool)
        flags[order] = SuffixSorter(buffer, place, starts[order], members, length).repeated()
        found, at = [], 0
        for r in rows:
            own = flags[at:at + r["n"]]
            at += r["n"]
            if r["only"] and own.any():
                edge = np.flatnonzero(np.diff(np.r_[0, own.astype(np.int8), 0]))
                found += [(r["_key"], r["lo"] + int(a), r["lo"] + int(b) - 1)
                          for a, b in zip(edge[::2], edge[1::2], strict=True)]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
                                              names=["_key", "lo", "hi"])

        groups: list[list[dict]] = []
        last, windows, place = None, 0, None
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                for r in batch.slice(k, 2000).to_pylist():
                    if place == (place := (r["g"], r["_key"], r["lo"])):
                        continue  # a repeated row's
                    if r["g"] != last:
                        if windows >= BATCH_WINDOWS:
                            yield table(solve(groups))
                            groups, windows = [], 0
                        groups.append([])
                        last = r["g"]
                    groups[-1].append(r)
                    windows += r["n"]
        if groups:
            yield table(solve(groups))

    return chunks.repartition("g").sortWithinPartitions("g", "_key", "lo").mapInArrow(run, schema)


def repeated_ranges(docs: DataFrame, length: int, gram: int, group_contexts: int) -> DataFrame:
    """(_key, lo, hi): ranges of window starts whose ``length`` bytes start elsewhere too; ``docs`` has _key and raw.

    Contexts that occur twice are repeated as a whole.  The others of a repeated gram are
    sorted with one copy of each different context of that gram; a gram with more than
    ``group_contexts`` of them has its windows hashed and counted before equal ones meet, so no task
    holds them all; only where there are such grams, their texts are shuffled once more.
    Contexts are worked out once and stored, 36 bytes each, until their places are known.
    """
    contexts = store(_context_rows(docs, length, gram), "contexts")
    place = F.xxhash64("_key", "lo")  # a long, which is aggregated in place; two of a context are only sorted twice
    by_context = contexts.groupBy("g", "e").agg(F.count("*").alias("copies"), F.min(place).alias("one"))
    by_gram = by_context.groupBy("g").agg(  # reads ``one`` as well, so that both sides share a shuffle
        F.count("one").alias("m"), F.sum("copies").alias("all")).where("all > 1")
    flags = store(by_context.join(by_gram.select("g", "m"), "g"), "repeated-contexts")
    rows = store(contexts.join(flags, ["g", "e"]).select(
        "_key", "lo", "n", "a", "g", "m", (F.col("copies") > 1).alias("twice"),
        ((F.col("m") > 1) & (F.col("one") == place)).alias("wanted"),
    ).where("twice or wanted"), "context-places")
    discard(contexts)
    discard(flags)

    def meet(part: DataFrame) -> DataFrame:
        wanted = part.groupBy("_key").agg(  # bounded by the document's contexts
            F.collect_set(F.struct("lo", "n", "a", "g", (~F.col("twice")).alias("only"))).alias("wanted"))
        return docs.select("_key", "raw").join(wanted, "_key")

    few, many = (rows.where("wanted").where(x) for x in (F.col("m") <= group_contexts, F.col("m") > group_contexts))
    single = store(_repeated_windows(_chunks(meet(few), length), length), "repeated-windows")
    if many.limit(1).count():
        single = single.unionByName(_hashed_repeats(meet(many), length))
    return rows.where("twice").select("_key", "lo", (F.col("lo") + F.col("n") - 1).alias("hi")).unionByName(single)


def drop_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 200,
                 gram: int = 48, group_contexts: int = GROUP_CONTEXTS) -> DataFrame:
    """For each row: ``n_bytes``, ``removed`` (array of start, end in bytes) and ``kept``, the bytes that stay.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else,
    in the same or another row; texts are UTF-8, matches never cross rows and are judged on
    the input.  Null texts are empty; short ones stay whole; repeated rows are copies of
    one another, so all their bytes go if there are enough; null ids stay null; other
    columns are not read.  Rows are told apart by 64 bits of id and text.

    Texts are shuffled twice, by key; else only hashes and the bytes of contexts to sort move.
    """
    docs = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    docs = docs.select("doc_id", row_key().alias("_key"), _raw(F.col("text")).alias("raw"))
    ranges = (repeated_ranges(docs, length, gram, group_contexts)
              .groupBy("_key").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")))
    met = docs.join(ranges, "_key", "left").select("doc_id", "raw", "ranges")
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()),
        T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()),
                                                           T.StructField("end", T.IntegerType())]))),
        T.StructField("kept", T.BinaryType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                sizes, cuts, kept = [], [], []
                for raw, own in zip(part.column("raw").to_pylist(), part.column("ranges").to_pylist(), strict=True):
                    spans: list[list[int]] = []
                    for a, b in sorted((r["lo"], r["hi"] + length) for r in own or ()):
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], b)
                        else:
                            spans.append([a, b])
                    edges = [0, *(x for s in spans for x in s), len(raw)]
                    sizes.append(len(raw))
                    cuts.append([{"start": a, "end": b} for a, b in spans])
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(columns.field(0).type),
                     *(pa.array(x, columns.field(i).type) for i, x in enumerate((sizes, cuts, kept), 1))],
                    schema=columns)

    return met.mapInArrow(run, schema)


def _raw(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")
