"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_texts, id_and_text, scan_texts, with_schema

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"\w+")


def sentences_of(text: str | None) -> Iterator[tuple[int, int, list[str]]]:
    """Start, end and lowered words of each sentence that has a word."""
    for m in SENTENCE.finditer(text or ""):
        words = WORD.findall(m[0].lower())
        if words:
            yield m.start(), m.end(), words


#: Lengths of the word beginnings that are features beside the word, and words whose weight a task keeps.
BEGINNINGS, CACHED_WORDS = (4, 5, 6), 200_000


def features_of(word: str) -> list[str]:
    """The word and its beginnings, for words of one stem that are rare one by one."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n)]


class Model:
    """Feature weights and the intercept of a sentence's log odds."""

    def __init__(self, weights: dict[str, float], intercept: float):
        self.weights, self.intercept = weights, intercept
        self.known: dict[str, float] = {}

    def _weight(self, word: str) -> float:
        w = self.known.get(word)
        if w is None:
            if len(self.known) >= CACHED_WORDS:
                self.known.clear()
            w = self.known[word] = sum([self.weights.get(f, 0.0) for f in features_of(word)])
        return w

    def sentence_odds(self, text: str | None) -> list[tuple[int, int, float]]:
        weight, b = self._weight, self.intercept
        return [(s, e, b + sum([weight(w) for w in set(words)])) for s, e, words in sentences_of(text)]

    @staticmethod
    def combined(odds: list[float]) -> float:
        """Noisy-or: the chance that at least one sentence is toxic; 0 for no sentence."""
        if not odds:
            return 0.0
        return float(-np.expm1(-np.logaddexp(0.0, np.array(odds)).sum()))

    def score(self, text: str | None) -> float:
        return self.combined([z for _, _, z in self.sentence_odds(text)])


def train(examples: list[tuple[str | None, int]], *, least_docs: int = 4, max_features: int = 4_000,
          rounds: int = 150, ridge: float = 0.1, rate: float = 0.15) -> Model:
    """Fit by gradient steps on the documents' log loss; ``examples`` must be a bounded sample.

    Features are the ``max_features`` whose presence in documents goes most with the label,
    by the chi-square of the four counts.  Examples of one label only teach nothing: then
    no document is called toxic.

    With A the sum of softplus(z) over a document's sentences its probability is
    1 - exp(-A), so the gradient by z is the sentence's own probability times 1 for a
    clean document and -exp(-A) / (1 - exp(-A)) for a toxic one.
    """
    seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
    bags: list[tuple[list[set[str]], int]] = []
    pool: dict[str, str] = {}  # equal words are one object in all sentences
    for text, label in examples:
        own = [{pool.setdefault(w, w) for w in words} for _, _, words in sentences_of(text)]
        if own:
            seen[label].update({f for w in set().union(*own) for f in features_of(w)})
            bags.append((own, label))
    y = np.array([label for _, label in bags], float)
    if not len(y) or y.min() == y.max():
        return Model({}, -10.0)
    names = [f for f in seen[0].keys() | seen[1].keys() if seen[0][f] + seen[1][f] >= least_docs]
    one, none = (np.array([seen[k][f] for f in names], float) for k in (1, 0))
    toxic, n = y.sum(), len(y)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = n * (one * (n - toxic - none) - none * (toxic - one)) ** 2 / (
            toxic * (n - toxic) * (one + none) * (n - one - none))
    best = sorted(zip(-np.nan_to_num(chi), names, strict=True))[:max_features]
    del seen, names, pool
    words = [f for _, f in best]
    number = {w: i for i, w in enumerate(words)}
    feature, sentence, owner = [], [], []
    for doc, (own, _) in enumerate(bags):
        for s in own:
            ids = [number[f] for w in s for f in features_of(w) if f in number]
            feature.extend(ids)
            sentence.extend([len(owner)] * len(ids))
            owner.append(doc)
    f, s, d = (np.array(x, np.int32) for x in (feature, sentence, owner))
    del feature, sentence, owner, bags
    v, b = np.zeros(len(words)), -6.0
    m, u = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for step in range(1, rounds + 1):
        z = np.clip(np.bincount(s, v[f], len(d)) + b, -30, 30)
        a = np.bincount(d, np.logaddexp(0.0, z), len(y))
        pull = np.where(y > 0, -1.0 / np.expm1(np.maximum(a, 1e-6)), 1.0)
        g = pull[d] / (1.0 + np.exp(-z))
        grad = np.r_[np.bincount(f, g[s], len(words)) + ridge * v, g.sum()]
        m = 0.9 * m + 0.1 * grad
        u = 0.99 * u + 0.01 * grad * grad
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(u / (1 - 0.99 ** step)) + 1e-6)
        v, b = v - move[:-1], b - move[-1]
        if step == rounds * 2 // 3:
            rate *= 0.3
    heavy = np.abs(v) > 1e-3
    return Model({w: float(x) for w, x, h in zip(words, v, heavy, strict=True) if h}, float(b))


def held_out(doc_id: str = "doc_id", parts: int = 5) -> F.Column:
    """Whether an id is never learned from: its text's crc32 leaves 0 by ``parts``; a null id's is that of no bytes."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == 0


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
        label: str = "toxic", parts: int = 5, max_examples: int = 4_000) -> Model:
    """A model from at most ``max_examples`` labelled documents that are not held out.

    The sample has the least hashes of the id among labelled ids, half at most of it toxic
    where there are enough of both; its ids, bounded, are broadcast, so texts are not
    shuffled.  Ids with null or contradictory labels are left out; of several texts of an id the
    least counts.
    """
    docs = id_and_text(docs, doc_id, text)
    marked = (labels.select(labels[doc_id].alias("doc_id"), labels[label].cast("int").alias("y"))
              .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id", parts))
              .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z"))
              .where(F.col("y") == F.col("z")).drop("z"))
    halves = [marked.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
              for y, n in ((1, max_examples // 2), (0, max_examples - max_examples // 2))]
    chosen = halves[0].unionByName(halves[1])
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return train([(r.text, r.y) for r in rows.sort(F.xxhash64("doc_id"), "doc_id").collect()])


def score_toxicity(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text",
                   least: float = 0.5) -> DataFrame:
    """For each row its id, ``score`` from 0 to 1 and ``offending``: sentences whose own chance reaches ``least``.

    Offending sentences are (start, end, score) in code points.  One narrow pass with the
    bounded model.  Null and empty texts and texts without words score 0 and offend
    nowhere; repeated rows repeat; null ids stay null.
    """
    docs = id_and_text(docs, doc_id, text)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))
    schema = with_schema(docs, ("score", "double"),
                         ("offending", "array<struct<start:int,end:int,score:double>>"))
    cut = float(np.log(least / (1 - least)))

    def start() -> Callable[[list], dict[str, list]]:
        own = Model(*shared.value)

        def work(texts: list) -> dict[str, list]:
            odds = [own.sentence_odds(t) for t in texts]
            return {"score": [own.combined([z for _, _, z in o]) for o in odds],
                    "offending": [[{"start": a, "end": e, "score": float(1 / (1 + np.exp(-z)))}
                                   for a, e, z in o if z >= cut] for o in odds]}

        return work

    return scan_texts(docs, schema, start)


def drop_toxic(docs: DataFrame, model: Model, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``least``, with all their columns.

    Null and empty texts score 0 and stay; repeated rows go or stay together; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))

    def start() -> Callable[[list], list[bool]]:
        own = Model(*shared.value)
        return lambda texts: [own.score(t) < least for t in texts]

    return filter_texts(docs, text, start)
