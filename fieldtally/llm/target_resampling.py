"""Importance resampling towards a target: hashed n-gram weights, perturbed scores, and the top share by a quantile sketch.

Null texts have no words, hence no features and weight 0; a null id is hashed as the
text ``<seed>:`` and comes after all others among equal scores.  Rows equal in id and
score are told apart by their place in a stored table, so exactly the asked number is
drawn.  Every row of the input comes back once; an empty table gives an empty one, and
an empty target makes every gain depend on the source alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.operators.ordering import global_rank

from .common import id_and_text, scan_texts, store, with_schema

BUCKETS = 10_000
#: Longest run of words that is a feature.
RUN = 3
SHARE = (5, 100)
LEAST_WORDS = 20
SEED = 42
#: Rank error of the sketch as a part of all rows is one over this; brackets start at twice that on either side.
ACCURACY = 10_000
_DIRECT = 64

# A byte of a word: digits, small letters, and every byte of a character above 7F.
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


class Crc:
    """CRC-32 of many byte ranges at once, and of their concatenations without looking at the bytes again."""

    def __init__(self):
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
        self.step = step
        one = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        made = [one]
        for _ in range(_DIRECT):
            one = step[one & 255] ^ (one >> 8)
            made.append(one)
        #: What 0 to 63 further zero bytes make of each byte of a checksum; then of 64, 128, 256 ... bytes.
        self.near = np.stack(made[:_DIRECT])
        self.far = [made[_DIRECT]]

    @staticmethod
    def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
        return table[0][c & 255] ^ table[1][c >> 8 & 255] ^ table[2][c >> 16 & 255] ^ table[3][c >> 24]

    def shift(self, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Checksums ``c`` moved on by ``n`` zero bytes; xor with the next part's checksum joins the two."""
        low, near = n & _DIRECT - 1, self.near
        out = near[low, 0, c & 255] ^ near[low, 1, c >> 8 & 255] ^ near[low, 2, c >> 16 & 255] ^ near[low, 3, c >> 24]
        high, k = n // _DIRECT, 0
        while high.any():
            if k == len(self.far):
                self.far.append(self._apply(self.far[-1], self.far[-1]))
            at = np.flatnonzero(high & 1)
            out[at] = self._apply(self.far[k], out[at])
            high, k = high >> 1, k + 1
        return out

    def of_ranges(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Checksums of ``data[start:start + size]`` for each range."""
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        c = np.full(len(order), 0xFFFFFFFF, np.uint32)
        longer = int(np.searchsorted(-size, -_DIRECT))  # over 64 bytes: byte by byte would take too many steps
        raw = data.tobytes() if longer else b""
        for k in range(longer):
            c[k] = zlib.crc32(raw[start[k]:start[k] + size[k]]) ^ 0xFFFFFFFF
        for at in range(int(size[longer]) if longer < len(size) else 0):
            end = int(np.searchsorted(-size, -at))  # ranges longer than ``at``
            part = c[longer:end]
            c[longer:end] = self.step[(part ^ data[start[longer:end] + at]) & 255] ^ (part >> 8)
        out = np.empty_like(c)
        out[order] = c ^ np.uint32(0xFFFFFFFF)
        return out


class Features:
    """The buckets of all runs of words of a batch of texts."""

    def __init__(self, buckets: int, run: int):
        self.crc, self.buckets, self.run = Crc(), buckets, run

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Words a text, and for each length of a run (text number, bucket) of every run."""
        raw = [t.encode().lower() if t else b"" for t in texts]
        begin = np.cumsum([0, *(len(r) + 1 for r in raw)])
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        word = _IS_WORD[data].view(np.int8)
        edge = np.diff(word, prepend=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = end - start
        owner = np.searchsorted(begin, start, side="right") - 1
        own = self.crc.of_ranges(data, start, size)
        # Checksum of a blank and the word, which is what a run goes on by.
        blank = np.full(len(own), zlib.crc32(b" "), np.uint32)
        more = self.crc.shift(blank, size) ^ own
        out, now = [(owner, own % self.buckets)], own
        for k in range(1, self.run):
            now = self.crc.shift(now[:-1], size[k:] + 1) ^ more[k:] if len(now) else now
            inside = owner[k:] == owner[:len(now)]
            out.append((owner[k:][inside], now[inside] % self.buckets))
        return np.bincount(owner, minlength=len(texts)), out


def bucket_counts(docs: DataFrame, *, text: str = "text", buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """How many features of the table fall into each bucket: a task sends one row a bucket, the driver gets ``buckets`` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, seen = Features(buckets, run), np.zeros(buckets, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                for _, found in features.of(batch.column(0).slice(k, 500).to_pylist())[1]:
                    seen += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["bucket", "n"])

    counted = docs.select(docs[text].cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    total = np.zeros(buckets, np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[bucket] = n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed bucket shares, rounded down."""
    b, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def perturbation(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variable drawn by the hash of seed and id, rounded down."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    chance = (F.conv(head, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.ln(-F.ln(chance))).cast("long")


def score(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
          seed: int = SEED, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """A row a document: ``doc_id``, ``n_words``, ``n_features``, ``weight`` (sum of gains) and ``score`` (perturbed)."""
    gain = gains(bucket_counts(docs, text=text, buckets=buckets, run=run),
                 bucket_counts(target, text=target_text, buckets=buckets, run=run))

    def start():
        features = Features(buckets, run)

        def work(texts: list) -> dict[str, pa.Array]:
            n_words, found = features.of(texts)
            n_features, weight = (np.zeros(len(texts), np.int64) for _ in range(2))
            for owner, at in found:
                n_features += np.bincount(owner, minlength=len(texts))
                up_to = np.concatenate([[0], np.cumsum(gain[at])])  # whole numbers stay exact
                ends = np.searchsorted(owner, np.arange(len(texts) + 1))
                weight += np.diff(up_to[ends])
            return {"n_words": pa.array(n_words.astype(np.int64)), "n_features": pa.array(n_features),
                    "weight": pa.array(weight)}

        return work

    rows = id_and_text(docs, doc_id, text)
    weighed = scan_texts(rows, with_schema(rows, ("n_words", "long"), ("n_features", "long"), ("weight", "long")), start)
    return weighed.withColumn("score", F.col("weight") + perturbation(F.col("doc_id"), seed))


def bracket(rows: DataFrame, value: str, k: int, n: int, accuracy: int = ACCURACY) -> tuple[int | None, int | None, int]:
    """Values (low, high) with the ``k``-th greatest of ``n`` rows between them, and how many rows lie above ``high``.

    A sketch proposes ever wider brackets in one pass; rows outside are counted exactly,
    and a bracket that misses is widened.  None is an open end, with which none can miss.
    """
    margins = [2 * 4 ** i / accuracy for i in range(6)]
    at = 1 - k / n
    wanted = [min(1.0, max(0.0, at + s * m)) for m in margins for s in (-1, 1)]
    found = rows.agg(F.percentile_approx(value, wanted, accuracy)).head()[0]
    pairs = [(None if wanted[i] <= 0 else found[i], None if wanted[i + 1] >= 1 else found[i + 1])
             for i in range(0, len(wanted), 2)]
    for low, high in [*pairs, (None, None)]:
        over = F.lit(False) if high is None else F.col(value) > high
        under = F.lit(False) if low is None else F.col(value) < low
        above, below = rows.agg(F.count_if(over), F.count_if(under)).head()
        if above < k <= n - below:
            return low, high, above
    raise AssertionError("an open bracket holds every row")


def resample(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
             share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS,
             run: int = RUN, accuracy: int = ACCURACY) -> DataFrame:
    """``score`` and ``rank``: of the N documents of ``least_words`` and more, the N * share highest get 1, 2, 3 ...

    Ties go to the smaller id.  Only rows in the bracket are sorted to find who is drawn, and
    rows above it to number them; all others pass by unsorted.
    """
    scored = store(score(docs, target, doc_id=doc_id, text=text, target_text=target_text, seed=seed, buckets=buckets, run=run)
                   .withColumn("_row", F.monotonically_increasing_id()), "resampling")
    can = F.col("n_words") >= least_words
    able = scored.where(can)
    n = able.count()
    k = n * share[0] // share[1]
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    unranked = F.lit(None).cast("long").alias("rank")
    if k == 0:
        return scored.select(*columns, unranked)
    low, high, above = bracket(able, "score", k, n, accuracy)
    over = F.lit(False) if high is None else F.col("score") > high
    within = ~over if low is None else ~over & (F.col("score") >= low)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row")]
    first = global_rank(able.where(over), order).select(*columns, F.col("rank").cast("long"))
    then = global_rank(able.where(within), order)
    place = (F.col("rank") + above).cast("long")
    then = then.select(*columns, F.when(place <= k, place).alias("rank"))
    rest = scored.where(~can | ~(over | within)).select(*columns, unranked)
    return first.unionByName(then).unionByName(rest)


def draw(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose id is drawn; rows that share an id are drawn together."""
    drawn = resample(docs, target, doc_id=doc_id, **options).where(F.col("rank").isNotNull())
    ids = drawn.select(F.col("doc_id").alias("_drawn_id")).distinct()
    return docs.join(ids, docs[doc_id].eqNullSafe(ids["_drawn_id"]), "left_semi")
