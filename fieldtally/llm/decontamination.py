"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of all items."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_texts, id_and_text, scan_texts, store, with_schema

# Fixed value: a word, in the UTF-8 bytes of a text whose A-Z are lowered; all bytes of other letters are above 7F.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 13
#: Bytes of items in one automaton; more items make further automata, each with a pass of its own.
AUTOMATON_BYTES = 32 << 20


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []


def windows_of(words: list[bytes], window: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    """All runs of ``window`` words; a shorter item that has words is one window."""
    if words:
        for i in range(max(1, len(words) - window + 1)):
            yield tuple(words[i:i + window])


def build(items: list[tuple[str | None, str | None]], window: int):
    """Word numbers (from 1) and the automaton over sequences of them; its values are (length, item ids)."""
    import ahocorasick

    numbers: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set] = {}
    for item, text in items:
        for run in windows_of(words_of(text), window):
            key = tuple(numbers.setdefault(w, len(numbers) + 1) for w in run)
            owners.setdefault(key, set()).add(item)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, ids in owners.items():
        automaton.add_word(key, (len(key), ids))
    if owners:
        automaton.make_automaton()
    return numbers, automaton if owners else None


class Scanner:
    """Finds the words of a text that lie in an occurrence of any window of a chunk's items; built once in a task."""

    def __init__(self, chunk, window: int):
        self.numbers, self.automaton = build(chunk.value, window)

    def scan(self, texts: list[str | None], flags: list[bytes | None] | None = None,
             items: list[list | None] | None = None) -> list[tuple[list[bytes], bytearray | None, set]]:
        """For each text its words, the flags of the words hit (None: none is) and the items.

        ``flags`` and ``items`` are what other chunks gave for the same texts.
        """
        none = [None] * len(texts)
        get, out = self.numbers.get, []
        for text, before, names in zip(texts, flags or none, items or none, strict=True):
            words, hit, ids = words_of(text), bytearray(before) if before else None, set(names or ())
            for end, (length, owners) in self.automaton.iter(tuple([get(w, 0) for w in words])) if self.automaton else ():
                if hit is None:
                    hit = bytearray(len(words))
                hit[end - length + 1:end + 1] = b"\1" * length
                ids |= owners
            out.append((words, hit, ids))
        return out


def spans_of(text: str, flags: bytearray) -> list[tuple[int, int]]:
    """Maximal runs of hit words as code point offsets of the original text, end exclusive."""
    raw = text.encode()
    runs: list[list[int]] = []
    last = -2
    for k, m in enumerate(WORD.finditer(raw.lower())):
        if flags[k]:
            if last == k - 1:
                runs[-1][1] = m.end()
            else:
                runs.append([m.start(), m.end()])
            last = k
    out, byte, char = [], 0, 0
    for a, b in runs:
        char += len(raw[byte:a].decode())
        size = len(raw[a:b].decode())
        out.append((char, char + size))
        char, byte = char + size, b
    return out


def _chunks(benchmark: DataFrame, item_id: str, item_text: str, limit: int) -> list:
    """The items in broadcasts of at most about ``limit`` bytes each, dealt by a hash of the id.

    Each chunk comes to the driver by itself; an item longer than the limit is a chunk.
    """
    items = benchmark.select(benchmark[item_id].cast("string").alias("item"),
                             benchmark[item_text].cast("string").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // limit) or 1
    context = benchmark.sparkSession.sparkContext
    dealt = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [context.broadcast([tuple(r) for r in items.where(dealt == c).collect()]) for c in range(n)]


def _scanned(docs: DataFrame, text: str, chunks: list, window: int) -> tuple[DataFrame, list[str]]:
    """``docs`` with two last columns, the flags and items that ``chunks`` give, and their names; a stored pass a chunk.

    Each pass holds one automaton, built once in a task, and goes on from the flags of
    the pass before; without chunks ``docs`` stay as they are.
    """
    if not chunks:
        return docs, []
    free = next(n for n in map("_hit{}".format, range(len(docs.columns) + 1))
                if not any(c.lower().startswith(n) for c in docs.columns))
    names, at = [free, f"{free}_items"], docs.columns.index(text)
    docs = docs.withColumns({names[0]: F.lit(None).cast("binary"), names[1]: F.lit(None).cast("array<string>")})

    def through(chunk) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(chunk, window)
            for batch in batches:
                for k in range(0, batch.num_rows, 1000):
                    part = batch.slice(k, 1000)
                    columns = part.columns
                    found = scanner.scan(*(columns[c].to_pylist() for c in (at, -2, -1)))
                    yield pa.RecordBatch.from_arrays(
                        [*columns[:-2], pa.array([bytes(f) if f else None for _, f, _ in found], columns[-2].type),
                         pa.array([list(i) or None for _, _, i in found], columns[-1].type)], schema=part.schema)

        return run

    for chunk in chunks:
        docs = store(docs.mapInArrow(through(chunk), docs.schema), "contamination-pass")
    return docs, names


def contamination(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  min_share: float = 0.05, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """For each row: ``n_words``, ``n_hit``, ``items`` (sorted as strings), ``spans`` and ``contaminated``.

    A word is hit if it lies in any occurrence of a window of ``window`` consecutive words
    of an item; a row is contaminated if it has a hit and at least ``min_share`` of its words
    are hit.  Spans are the maximal runs of hit words in code points of the original text.
    One narrow pass; items beyond ``automaton_bytes`` take a stored pass more for each
    so many bytes.  Null and empty texts have no words and are clean; items without words
    have no window; items with a null id hit but are not listed; repeated rows repeat.
    """
    docs = id_and_text(docs, doc_id, text)
    chunks = _chunks(benchmark, item_id, item_text, automaton_bytes)
    docs, before = _scanned(docs, "text", chunks[:-1], window)
    last = chunks[-1]
    schema = with_schema(docs, ("n_words", "long"), ("n_hit", "long"), ("items", "array<string>"),
                         ("spans", "array<struct<start:int,end:int>>"), ("contaminated", "boolean"))

    def start() -> Callable[..., dict[str, list]]:
        scanner = Scanner(last, window)

        def work(texts: list, *earlier: list) -> dict[str, list]:
            found = scanner.scan(texts, *earlier)
            n = [len(w) for w, _, _ in found]
            hit = [sum(f) if f else 0 for _, f, _ in found]
            return {
                "n_words": n, "n_hit": hit,
                "items": [sorted(i for i in ids if i is not None) for _, _, ids in found],
                "spans": [[{"start": a, "end": b} for a, b in spans_of(t, f)] if f else []
                          for t, (_, f, _) in zip(texts, found, strict=True)],
                "contaminated": [h > 0 and h >= min_share * k - 1e-9 for h, k in zip(hit, n, strict=True)],
            }

        return work

    return scan_texts(docs, schema, start, before)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id",
                      item_text: str = "text", window: int = WINDOW, min_share: float = 0.05,
                      automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The rows of ``docs`` that ``contamination`` finds clean, with all their columns.

    Null and empty texts and texts without words stay, whatever their other columns hold; repeated rows stay or
    go together; empty tables give no rows, an empty ``benchmark`` keeps all.
    """
    chunks = _chunks(benchmark, item_id, item_text, automaton_bytes)
    docs, before = _scanned(docs, text, chunks[:-1], window)
    last = chunks[-1]

    def start() -> Callable[..., list[bool]]:
        scanner = Scanner(last, window)
        return lambda *given: [not f or sum(f) < min_share * len(w) - 1e-9 for w, f, _ in scanner.scan(*given)]

    return filter_texts(docs, text, start, before)
