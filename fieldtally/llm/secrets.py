"""Secret scan: fixed shapes, and sliding-window entropy per character class with an allow list."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, scan_texts, with_schema

# The three base shapes, their least lengths, and the words one of which an assignment has.
ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "entropy_hex", "entropy_base64", "entropy_base32", "entropy_lower")
# By class, its characters (base32 in all its alphabets), the window and the bits a character needs.
CLASSES = {
    "entropy_hex": (re.compile(r"[0-9A-Fa-f]{20,}"), 20, 2.9),
    "entropy_base64": (re.compile(r"[A-Za-z0-9+/_=-]{24,}"), 24, 4.0),
    "entropy_base32": (re.compile(r"[A-Z0-9]{24,}"), 24, 3.5),
    "entropy_lower": (re.compile(r"[a-z0-9]{24,}"), 24, 3.5),
}
# What is no secret though it looks random.
ALLOWED = (
    r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",  # a UUID
    r"(?i)example|dummy|placeholder|xxxx",
    r"(?i)abcdefghij|0123456789",
    r"^\d+$",
    r"^(?:[A-Za-z]+[/_=-]+)*[A-Za-z]+$",  # words and paths
)
DIGITS = re.compile(r"[0-9]+")
MASK = "[SECRET]"


def entropy_windows(run: str, window: int, least: float) -> list[tuple[int, int]]:
    """Maximal stretches of ``run`` covered by windows of at least ``least`` bits a character.

    The window slides one character at a time; its sum of c * log2(c) changes by
    the two counts that change, so a run costs time in its length only.
    """
    if len(run) < window:
        return []
    term = [0.0, *(c * math.log2(c) for c in range(1, window + 2))]
    counts: dict[str, int] = {}
    total, found = 0.0, []
    for i, new in enumerate(run):
        c = counts.get(new, 0)
        counts[new] = c + 1
        total += term[c + 1] - term[c]
        if i >= window:
            old = run[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += term[c - 1] - term[c]
        if i >= window - 1 and math.log2(window) - total / window >= least - 1e-9:
            start = i - window + 1
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((start, i + 1))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The three fixed shapes, leftmost and non-overlapping per kind."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def mixed(kind: str, piece: str) -> bool:
    """Whether a stretch mixes characters as keys do and joined words, with a number or not, do not.

    Base64 has capitals, small letters and digits; the classes of one case have letters
    between digits.
    """
    if kind == "entropy_base64":
        return (any(c.isdigit() for c in piece) and any(c.isupper() for c in piece)
                and any(c.islower() for c in piece))
    return kind == "entropy_hex" or len(DIGITS.findall(piece)) > 1


def outside(start: int, end: int, cut: Sequence[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What remains of a range without the sorted, separate ranges ``cut``."""
    for k in range(max(0, bisect_right(cut, (start, 1 << 60)) - 1), len(cut)):
        s, e = cut[k]
        if s >= end:
            break
        if e > start:
            if s > start:
                yield start, s
            start = e
    if start < end:
        yield start, end


def entropy_spans(text: str, taken: Sequence[tuple[int, int]], allowed: re.Pattern,
                  literals: frozenset[str]) -> list[tuple[str, int, int]]:
    """Spans the method adds: random-looking stretches outside what is taken and not allowed.

    Windows slide over what a run has besides taken spans and allowed matches, so
    neither hides its surroundings; a found stretch must mix characters and be no allowed string itself.
    """
    found = []
    for kind, (shape, window, least) in CLASSES.items():
        own = []
        for m in shape.finditer(text):
            if m[0] in literals:
                continue
            for start, end in outside(m.start(), m.end(), taken):
                if end - start < window:
                    continue
                rest = text[start:end]
                cut = [(x.start(), x.end()) for x in allowed.finditer(rest) if x.end() > x.start()]
                for lo, hi in outside(0, len(rest), cut):
                    for a, b in entropy_windows(rest[lo:hi], window, least):
                        piece = rest[lo + a:lo + b]
                        if mixed(kind, piece) and piece not in literals and not allowed.search(piece):
                            own.append((kind, start + lo + a, start + lo + b))
        if own:
            taken = _merged([*taken, *((s, e) for _, s, e in own)])
            found += own
    return found


def _merged(spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def finder(allow_patterns: Sequence[str] = ALLOWED,
           allow_literals: Sequence[str] = ()) -> Callable[[str | None], list[tuple[str, int, int]]]:
    """A function from a text to its spans, by start and then kind."""
    allowed = re.compile("|".join(f"(?:{p})" if not p.startswith("(?i)") else f"(?i:{p[4:]})"
                                  for p in allow_patterns) or r"(?!)")
    literals, order = frozenset(allow_literals), {k: i for i, k in enumerate(KINDS)}
    shortest = min(w for _, w, _ in CLASSES.values())

    def find(text: str | None) -> list[tuple[str, int, int]]:
        if not text:
            return []
        spans = base_spans(text)
        if max(map(len, text.split()), default=0) >= shortest:
            spans += entropy_spans(text, _merged([(s, e) for _, s, e in spans]), allowed, literals)
        return sorted(spans, key=lambda x: (x[1], order[x[0]]))

    return find


def scan_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
                 allow_patterns: Sequence[str] = ALLOWED, allow_literals: Sequence[str] = ()) -> DataFrame:
    """For each row its id and ``spans``: an array of (kind, start, end) in code points, end exclusive.

    One narrow pass without shuffles.  Null and empty texts have no spans; repeated rows
    give repeated results; a null id stays null; further columns are not read.
    """
    docs = id_and_text(docs, doc_id, text)
    schema = with_schema(docs, ("spans", "array<struct<kind:string,start:int,end:int>>"))

    def start() -> Callable[[list], dict[str, list]]:
        find = finder(allow_patterns, allow_literals)
        return lambda texts: {"spans": [[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in texts]}

    return scan_texts(docs, schema, start)


def mask_secrets(docs: DataFrame, *, text: str = "text", length: str | None = "n_chars", mask: str = MASK,
                 allow_patterns: Sequence[str] = ALLOWED, allow_literals: Sequence[str] = ()) -> DataFrame:
    """``docs`` with every found span of the text replaced by ``mask``; overlapping spans become one.

    All rows and columns stay.  The column ``length``, where there is one, is set to the
    new length of the changed texts; null texts stay null.
    """
    at = docs.columns.index(text)
    size_at = docs.columns.index(length) if length in docs.columns else None

    def run(batches):
        find = finder(allow_patterns, allow_literals)
        for batch in batches:
            columns = list(batch.columns)
            texts = batch.column(at).to_pylist()
            sizes = batch.column(size_at).to_pylist() if size_at is not None else []
            for i, t in enumerate(texts):
                spans = _merged([(s, e) for _, s, e in find(t)])
                if spans:
                    cut = [0, *(x for s in spans for x in s), len(t)]
                    texts[i] = mask.join(t[a:b] for a, b in zip(cut[::2], cut[1::2], strict=True))
                    if sizes:
                        sizes[i] = len(texts[i])
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if sizes:
                columns[size_at] = pa.array(sizes, batch.schema.field(size_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
