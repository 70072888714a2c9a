"""Substring dedup on sliding sentence spans: runs of sentences hashed, joined globally, later ones removed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, row_key, store, with_schema

# Fixed value: pieces that make up the whole text, each up to its closing marks or line feeds.
PIECE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
WORD = re.compile(r"\w")
#: Share of all runs, as one in so many, above which a hash is met by broadcast.
HOT = 10_000


def sentences_of(text: str | None) -> list[tuple[int, int, list[str]]]:
    """Start, end and lowered words of each sentence; together they cover the text.

    A piece without a letter or digit belongs to the sentence before it, at the start of a
    text to the one after.
    """
    found: list[tuple[int, int, list[str]]] = []
    lead = 0
    for m in PIECE.finditer(text or ""):
        piece = m[0]
        if WORD.search(piece):
            found.append((m.start() if found else lead, m.end(), piece.lower().split()))
        elif found:
            found[-1] = (found[-1][0], m.end(), found[-1][2])
    return found


def runs_of(sentences: list[tuple[int, int, list[str]]], several: int, least_words: int,
            alone_words: int) -> Iterator[tuple[int, int]]:
    """First and last number of the runs that start or end at each sentence, each run once.

    The shortest runs of at least ``several`` sentences and ``least_words`` words from a
    sentence, and up to one; a sentence of ``alone_words`` is a run by itself too.  What
    is a run depends on its own sentences only, and any longer stretch is covered by runs in it.
    """
    sizes = [len(w) for _, _, w in sentences]
    found = {(i, i) for i, size in enumerate(sizes) if size >= alone_words}
    j, total = -1, 0
    for i in range(len(sizes)):
        while j + 1 < len(sizes) and (total < least_words or j - i + 1 < several):
            j += 1
            total += sizes[j]
        if total >= least_words and j - i + 1 >= several:
            found.add((i, j))
        total -= sizes[i]
    i, total = 0, 0
    for j in range(len(sizes)):
        total += sizes[j]
        while j - i >= several and total - sizes[i] >= least_words:
            total -= sizes[i]
            i += 1
        if total >= least_words and j - i + 1 >= several:
            found.add((i, j))
    yield from sorted(found)


def repeated_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", several: int = 2,
                   least_words: int = 20, alone_words: int = 40) -> DataFrame:
    """Per document (doc_id, _key) with any: ``spans``, the non-first repeated runs (first, last sentence).

    Runs are those of runs_of.  A run's first occurrence is the one of the least (doc_id, place); documents are told
    apart by id and text.  Runs are hashed to 128 bits, stored without texts, and counted
    before equal ones meet.  Hashes of over one run in ``HOT`` are at most so many and meet
    their runs by broadcast; the others, none of them frequent, by a join.
    """
    docs = id_and_text(docs, doc_id, text).withColumn("_key", row_key())
    schema = with_schema(docs, ("_key", "long"), ("first", "int"), ("last", "int"), ("h1", "long"), ("h2", "long"))
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                row, first, last, h1, h2 = [], [], [], [], []
                for r, t in enumerate(part.column("text").to_pylist()):
                    sentences = sentences_of(t)
                    marks = [xxhash.xxh3_128_digest(" ".join(w).encode()) for _, _, w in sentences]
                    for i, j in runs_of(sentences, several, least_words, alone_words):
                        mark = xxhash.xxh3_128_digest(b"".join(marks[i:j + 1]))
                        row.append(r)
                        first.append(i)
                        last.append(j)
                        h1.append(int.from_bytes(mark[:8], "little", signed=True))
                        h2.append(int.from_bytes(mark[8:], "little", signed=True))
                at = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(at).cast(columns.field(0).type), part.column("_key").take(at),
                     pa.array(first, pa.int32()), pa.array(last, pa.int32()),
                     pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], schema=columns)

    runs = store(docs.select("doc_id", "_key", "text").mapInArrow(run, schema), "sentence-runs")
    place = F.struct("doc_id", "_key", "first")
    repeated = store(runs.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("origin"))
                     .where(F.col("n") > 1), "repeated-runs")
    bound = runs.count() / HOT
    hot = F.broadcast(repeated.where(F.col("n") > bound).drop("n"))
    rest = repeated.where(F.col("n") <= bound).drop("n")
    met = runs.join(hot, ["h1", "h2"]).unionByName(runs.join(hot, ["h1", "h2"], "left_anti").join(rest, ["h1", "h2"]))
    later = met.where(~place.eqNullSafe(F.col("origin")))
    return (later.groupBy("doc_id", "_key")
            .agg(F.collect_set(F.struct("first", "last")).alias("spans")))  # bounded by the document's sentences


def dedup_sentences(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", several: int = 2,
                    least_words: int = 20, alone_words: int = 40) -> DataFrame:
    """For each row: ``n_sentences``, ``n_removed``, ``removed`` (start, end in code points) and ``kept_text``.

    Sentences that any non-first repeated run covers are removed; what is kept stays as it
    is.  Texts meet their spans in one shuffle by the document's key.  Null and empty texts
    have no sentences and stay; rows equal in id and text are one document and get equal
    results; null ids stay null; other columns are not read.
    """
    spans = repeated_spans(docs, doc_id=doc_id, text=text, several=several, least_words=least_words,
                           alone_words=alone_words)
    docs = id_and_text(docs, doc_id, text).withColumn("_key", row_key())
    met = docs.alias("d").join(spans.alias("s"), (F.col("d._key") == F.col("s._key"))
                               & F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")), "left").select(
        "d.doc_id", "d.text", "s.spans")
    schema = with_schema(docs, ("n_sentences", "int"), ("n_removed", "int"),
                         ("removed", "array<struct<start:int,end:int>>"), ("kept_text", T.StringType()))
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                n, gone, cuts, texts = [], [], [], []
                for t, own in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    sentences = sentences_of(t)
                    flags = bytearray(len(sentences))
                    for s in own or ():
                        flags[s["first"]:s["last"] + 1] = b"\1" * (s["last"] + 1 - s["first"])
                    removed: list[list[int]] = []
                    for f, (a, b, _) in zip(flags, sentences, strict=True):
                        if f and removed and removed[-1][1] == a:
                            removed[-1][1] = b
                        elif f:
                            removed.append([a, b])
                    edges = [0, *(x for r in removed for x in r), len(t or "")]
                    n.append(len(sentences))
                    gone.append(sum(flags))
                    cuts.append([{"start": a, "end": b} for a, b in removed])
                    texts.append(None if t is None else "".join(
                        [t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(columns.field(0).type),
                     *(pa.array(x, columns.field(i).type) for i, x in enumerate((n, gone, cuts, texts), 1))],
                    schema=columns)

    return met.mapInArrow(run, schema)
