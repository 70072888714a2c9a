"""N-gram Jaccard self-join with Bayesian pruning of MinHash candidates and exact verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, store

NGRAM, THRESHOLD = 5, 0.8
#: MinHash values, those of a band, values compared between two looks at the posterior, and its tolerance.
HASHES, BAND, STEP, TOLERANCE = 128, 5, 32, 1e-6
#: A block's n-grams, each document counting so many more; words whose hash a task keeps.
BLOCK, PER_DOCUMENT, CACHED_WORDS = 300_000, 150, 200_000
# Multipliers of an n-gram's five word hashes, and what mixes the sum's bits.
POSITION = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, 65)], np.uint64)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def minhash_functions(n: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


class Shingler:
    """Sorted distinct 64-bit n-gram hashes of a text; fewer words than n make one n-gram, none makes none."""

    def __init__(self, ngram: int):
        self.ngram, self.known = ngram, {}
        self.factors = minhash_functions()

    def shingles(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array([known[w] for w in words], np.uint64)
        n = min(self.ngram, len(h))
        total = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            total += h[k:len(h) - n + 1 + k] * POSITION[k]
        total ^= total >> np.uint64(31)
        total *= MIX
        return np.unique(total ^ (total >> np.uint64(29)))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        a, b = self.factors
        x = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
        least = np.full(len(a), 0xFFFFFFFF, np.uint32)
        for k in range(0, len(x), 1024):
            np.minimum(least, (x[k:k + 1024] * a + b).min(0), out=least)
        return least


def bands_of(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row, the band's number mixed in."""
    n = signatures.shape[1] // BAND
    parts = signatures[:, :n * BAND].reshape(len(signatures), n, BAND).astype(np.uint64) + np.uint64(1)
    keys = (parts * POSITION[:BAND]).sum(2, dtype=np.uint64) + POSITION[:n] * MIX
    keys ^= keys >> np.uint64(32)
    return keys * MIX


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest equal values among ``n`` at which similarity >= threshold keeps a posterior of ``tolerance``.

    Under a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at
    the threshold is the chance of at most m successes in n + 1 trials.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n


class Verifier:
    """Links within one block, or between two, of documents."""

    def __init__(self, threshold: float, tolerance: float):
        self.threshold = threshold
        self.needed = [(k, k + STEP, least_matches(k + STEP, threshold, tolerance)) for k in range(0, HASHES, STEP)]

    def candidates(self, bands: np.ndarray, rows: np.ndarray, columns: np.ndarray,
                   same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs that share a band, some rows at a time."""
        height = max(1, (1 << 20) // max(1, len(columns)))
        for k in range(0, len(rows), height):
            part = rows[k:k + height]
            equal = np.zeros((len(part), len(columns)), bool)
            for b in range(bands.shape[1]):
                equal |= bands[part, b][:, None] == bands[columns, b][None, :]
            if same:
                equal &= part[:, None] < columns[None, :]
            i, j = np.nonzero(equal)
            if len(i):
                yield part[i], columns[j]

    def pruned(self, signatures: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose posterior stays above the tolerance at every look."""
        matches = np.zeros(len(i), np.int32)
        for a, b, least in self.needed:
            for k in range(0, len(i), 1 << 16):
                s = slice(k, k + (1 << 16))
                matches[s] += (signatures[i[s], a:b] == signatures[j[s], a:b]).sum(1, dtype=np.int32)
            keep = matches >= least
            i, j, matches = i[keep], j[keep], matches[keep]
        return i, j

    def verified(self, sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of at least the threshold, by exact set sizes."""
        sizes = np.array([len(s) for s in sets])
        if len(i) <= 100:
            common = np.array([len(np.intersect1d(sets[a], sets[b], True)) for a, b in zip(i, j, strict=True)], float)
        else:
            used, inverse = np.unique(np.r_[i, j], return_inverse=True)
            x, y = inverse[:len(i)], inverse[len(i):]
            values = np.concatenate([sets[u] for u in used])
            owner = np.repeat(np.arange(len(used)), sizes[used])
            _, column, count = np.unique(values, return_inverse=True, return_counts=True)
            shared = count[column] > 1
            renumber = np.cumsum(count > 1) - 1
            column, owner = renumber[column[shared]], owner[shared]
            order = np.argsort(column, kind="stable")
            column, owner = column[order], owner[order]
            width = max(64, (1 << 22) // len(used))
            total = np.zeros((len(used), len(used)), np.float32) if len(used) <= 4096 else None
            common = np.zeros(len(i))
            for c in range(0, int(renumber[-1]) + 1 if len(renumber) else 0, width):
                a, b = np.searchsorted(column, (c, c + width))
                dense = np.zeros((len(used), width), np.float32)
                dense[owner[a:b], column[a:b] - c] = 1
                if total is not None:
                    total += dense @ dense.T
                else:
                    for k in range(0, len(i), 1 << 12):
                        s = slice(k, k + (1 << 12))
                        common[s] += np.einsum("ij,ij->i", dense[x[s]], dense[y[s]])
            if total is not None:
                common = total[x, y].astype(float)
        keep = common >= self.threshold * (sizes[i] + sizes[j] - common) - 1e-9
        return i[keep], j[keep]

    def links(self, signatures: np.ndarray, sets: list[np.ndarray], first: np.ndarray,
              second: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        bands = bands_of(signatures)
        others = first if second is None else second
        for i, j in self.candidates(bands, first, others, second is None):
            i, j = self.pruned(signatures, i, j)
            if len(i):
                i, j = self.verified(sets, i, j)
                if len(i):
                    yield i, j


def text_class() -> Column:
    """Sixteen bytes that name equal texts; null for a null text."""
    return F.unhex(F.md5(F.col("text").cast("binary")))


def _signatures(docs: DataFrame, ngram: int) -> DataFrame:
    """(t, n, sig) of each text with n-grams; copies repeat."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(ngram)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                n, sig = [], []
                for text in part.column("text").to_pylist():
                    s = own.shingles(text)
                    n.append(len(s))
                    sig.append(own.signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column("t"), pa.array(n, pa.int32()), pa.array(sig, pa.binary())],
                                                 names=["t", "n", "sig"])

    return docs.select("t", "text").mapInArrow(run, "t binary, n int, sig binary").where("n > 0")


def _bands(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4000):
                part = batch.slice(k, 4000)
                if not part.num_rows:
                    continue
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
                keys = bands_of(sig).view(np.int64)
                rows = pa.array(np.repeat(np.arange(len(keys)), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.column("t").take(rows)], names=["key", "t"])

    return nodes.select("t", "sig").mapInArrow(run, "key long, t binary")


def _blocks(nodes: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of candidates, (t, block), of bounded weight, and the pairs of blocks that share a band.

    Candidates are brought home to the least class reached over two steps through shared
    bands, so that likely links lie in one block; a home that is too heavy is dealt by hash.
    Where a candidate lies only decides what is compared together, not whether it is.
    """
    near = members.groupBy("t").agg(F.min("least").alias("home"))
    bucket = members.join(near, "t").groupBy("key").agg(F.min("home").alias("home"))
    home = members.join(bucket, "key").groupBy("t").agg(F.min("home").alias("home"))
    weighed = store(home.join(nodes.select("t", "n"), "t"), "join-homes")
    parts = weighed.groupBy("home").agg(F.ceil(F.sum(F.col("n") + PER_DOCUMENT) / BLOCK).alias("parts"))
    blocks = store(weighed.join(parts, "home").select(
        "t", F.xxhash64("home", F.pmod(F.xxhash64("t"), F.col("parts"))).alias("block")), "join-blocks")
    met = members.select("key", "t").join(blocks, "t").select("key", "block").distinct()
    other = met.select("key", F.col("block").alias("other"))
    return blocks, met.join(other, "key").where("block <= other").select("block", "other").distinct()


def _unit_links(units: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(t, root, links): each document's links within its unit and the least class it is connected with there."""
    def solve(rows: list[dict], verifier: Verifier) -> list[tuple[bytes, bytes, int]]:
        unique = {(r["t"], r["side"]): r for r in rows}
        rows = [unique[k] for k in sorted(unique)]
        if len(rows) < 2:
            return []
        signatures = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint32).reshape(-1, HASHES)
        sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
        side = np.array([r["side"] for r in rows])
        first = np.flatnonzero(side == 0)
        second = np.flatnonzero(side == 1) if side.any() else None
        root, links = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        for i, j in verifier.links(signatures, sets, first, second):
            links += np.bincount(i, minlength=len(rows)) + np.bincount(j, minlength=len(rows))
            while True:  # least root over links until nothing moves
                least = np.minimum(root[i], root[j])
                before = root.copy()
                np.minimum.at(root, root[i], least)
                np.minimum.at(root, root[j], least)
                np.minimum.at(root, i, least)
                np.minimum.at(root, j, least)
                root = root[root]
                if (root == before).all():
                    break
        return [(rows[k]["t"], rows[root[k]]["t"], int(links[k])) for k in np.flatnonzero(links)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verifier = Verifier(threshold, tolerance)
        names = ["t", "root", "links"]

        def table(found: list[tuple[bytes, bytes, int]]) -> pa.RecordBatch:
            kinds = (pa.binary(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names=names)

        rows, last = [], None
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                for r in batch.slice(k, 500).to_pylist():
                    if (r["block"], r["other"]) != last:
                        if rows:
                            yield table(solve(rows, verifier))
                        rows, last = [], (r["block"], r["other"])
                    rows.append(r)
        if rows:
            yield table(solve(rows, verifier))

    return units.repartition("block", "other").sortWithinPartitions("block", "other").mapInArrow(
        run, "t binary, root binary, links long")


def components(edges: DataFrame) -> DataFrame:
    """(t, root): the least member of each connected component, for every node of ``edges`` (t, root).

    Alternates large-star and small-star rounds, each written to the shared folder, until
    no edge changes; the rounds grow with the logarithm of the longest path.
    """
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("t", "root").bitwiseAND((1 << 40) - 1))).first())

    edges = store(edges.where("t <> root").select(
        F.greatest("t", "root").alias("t"), F.least("t", "root").alias("root")).distinct(), "components")
    seen = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("root").alias("t"), F.col("t").alias("root")))
        least = both.groupBy("t").agg(F.min("root").alias("m")).select("t", F.least("t", "m").alias("m"))
        large = (both.join(least, "t").where("root > t").select(F.col("root").alias("t"), F.col("m").alias("root"))
                 .where("t <> root").distinct())
        least = large.groupBy("t").agg(F.min("root").alias("m"))
        small = large.join(least, "t")
        edges = store(small.select(F.col("root").alias("t"), F.col("m").alias("root")).where("t <> root")
                      .unionByName(least.select("t", F.col("m").alias("root"))).distinct(), "components")
        now = state(edges)
        if now == seen:
            return edges
        seen = now


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", ngram: int = NGRAM,
                    threshold: float = THRESHOLD, tolerance: float = TOLERANCE, naming: bool = False) -> DataFrame:
    """For each row: ``t`` (its text's class), ``class_id``, ``n_links`` and ``n_copies``.

    Documents are linked if the Jaccard similarity of their sets of ``ngram`` lowered words
    is at least ``threshold``; ``class_id`` is the least id connected by links or equal
    texts, ``n_links`` the number of different texts linked, ``n_copies`` of other rows of
    the same text.

    Equal texts become one node first.  Nodes meet where one of 25 bands of five MinHash
    values is equal (missing a pair of similarity 0.8 with chance 5e-5, one of 0.85 with
    4e-7); candidates are compared 32 values at a time and dropped once the posterior of
    reaching the threshold is under ``tolerance``; the rest is verified on whole n-gram sets.
    Comparisons run in pairs of blocks of bounded weight, and only counts and one root a
    document leave a block.  Each pair of blocks gets the n-gram sets of both, so what is sent for
    a group of different near copies grows with the square of its blocks; copies count once.

    Null texts and texts without words link to nothing; null texts are classes by
    themselves, other equal texts one class; fewer words than ``ngram`` are one n-gram;
    repeated rows are copies; ids that are null never name a class unless all are; other
    columns are not read.  ``naming`` adds ``names``: whether id and text are those that name the class,
    the least of the texts that have its id.
    """
    docs = id_and_text(docs, doc_id, text).withColumn("t", text_class())
    nodes = store(_signatures(docs, ngram).groupBy("t").agg(F.first("n").alias("n"), F.first("sig").alias("sig")),
                  "join-nodes")
    bands = _bands(nodes)
    buckets = bands.groupBy("key").agg(F.count("*").alias("size"), F.min("t").alias("least")).where("size > 1")
    members = store(bands.join(buckets.drop("size"), "key"), "join-members")
    blocks, pairs = _blocks(nodes, members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(ngram)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                made = [own.shingles(x).tobytes() for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("t"), part.column("block"), pa.array(made, pa.binary())], names=["t", "block", "shingles"])

    ids = docs.groupBy("t").agg(F.min("doc_id").alias("one"), F.count("*").alias("rows"))
    ids = store(ids, "join-classes")
    chosen = blocks.join(ids.select("t", "one"), "t").alias("c")
    texts = docs.alias("d").join(chosen, (F.col("d.t") == F.col("c.t")) & F.col("d.doc_id").eqNullSafe(F.col("c.one")))
    sets = texts.select("d.t", "d.text", "c.block").mapInArrow(run, "t binary, block long, shingles binary")
    full = store(sets.join(nodes.select("t", "sig"), "t"), "join-sets")
    left = pairs.join(full, "block").select("block", "other", F.lit(0).alias("side"), "t", "sig", "shingles")
    right = pairs.where("block <> other").join(
        full.withColumnRenamed("block", "other"), "other").select(
        "block", "other", F.lit(1).alias("side"), "t", "sig", "shingles")
    found = store(_unit_links(left.unionByName(right), threshold, tolerance), "join-links")
    roots = components(found.select("t", "root"))
    links = found.groupBy("t").agg(F.sum("links").alias("n_links"))
    classes = (ids.where(F.col("t").isNotNull()).join(roots, "t", "left").join(links, "t", "left")
               .select("t", "one", "rows", F.coalesce("root", "t").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    classes = store(classes, "join-nodes-classed")
    first = [F.min_by("t", F.struct(F.col("one").isNull(), "one", "t")).alias("first")] if naming else []
    names = classes.groupBy("root").agg(F.min("one").alias("class_id"), *first)
    names_it = [(F.col("t") == F.col("first")).alias("names")] if naming else []
    named = classes.join(names, "root").select("t", "class_id", "n_links", (F.col("rows") - 1).alias("n_copies"), *names_it)
    names_it = [F.coalesce(F.col("names") & F.col("doc_id").eqNullSafe(F.col("class_id")), F.lit(True)).alias("names")] if naming else []
    return docs.select("doc_id", "t").join(named, "t", "left").select(
        "doc_id", "t", *names_it, F.when(F.col("t").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"))


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", ngram: int = NGRAM,
                         threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` with one row of each class: of the least id in it, and of that id's least text.

    Of repeated rows of that id and text one stays, whichever if they differ in other columns.  Rows with
    a null id go where the class has another id, and one stays where it has none; null texts all stay.
    """
    found = store(near_duplicates(docs, doc_id=doc_id, text=text, ngram=ngram, threshold=threshold, tolerance=tolerance,
                                  naming=True).where(F.col("t").isNotNull()).select("doc_id", "t", "names"), "join-named")
    free = next(n for n in map("_near{}".format, range(len(docs.columns) + 1)) if not any(c.startswith(n) for c in docs.columns))
    ids = [F.col("doc_id").alias(f"{free}_id"), F.col("t").alias(f"{free}_t")]
    gone = found.where(~F.col("names")).select(*ids).distinct()
    again = found.where("names").groupBy("doc_id", "t").count().where("count > 1").select(*ids)
    own = F.unhex(F.md5(docs[text].cast("string").cast("binary")))

    def same(rows: DataFrame, keys: DataFrame):
        return (own == keys[f"{free}_t"]) & rows[doc_id].eqNullSafe(keys[f"{free}_id"])

    kept = docs.join(gone, same(docs, gone), "left_anti")
    if again.isEmpty():
        return kept
    repeated = kept.join(again, same(kept, again), "left_semi").withColumn(f"{free}_t", own)
    return kept.join(again, same(kept, again), "left_anti").unionByName(
        repeated.dropDuplicates([doc_id, f"{free}_t"]).drop(f"{free}_t"))
