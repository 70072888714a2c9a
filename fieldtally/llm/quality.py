"""Quality rules on lines that many documents of a host share; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

# White space, and the characters counted as symbols.
SPACE = "\t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` evaluated once, also where lambdas inside ``body`` read it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACE, " " * len(SPACE)), " "), "")


def repeat_words(words: Column, window: int = 3) -> Column:
    """Words in windows of three that occur twice or more among ``words``, the first included.

    Windows are compared by 64-bit hashes: sorted by (hash, place), equal neighbours are
    repeats; their places, sorted, cover min(window, distance to the place before) new words.
    """
    def places(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.struct(
            F.xxhash64(*(F.get(w, i + k) for k in range(window))).alias("h"), i.alias("p")))
        return let(F.sort_array(hashes), lambda s: F.sort_array(F.filter(F.transform(s, lambda x, i: F.when(
            (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["p"])), lambda p: p.isNotNull())))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(p, start, lambda a, x: F.struct(
            x.alias("last"), (a["n"] + F.least(F.lit(window), x - a["last"])).alias("n")), lambda a: a["n"])

    return let(words, lambda w: F.when(F.size(w) >= window, covered(places(w))).otherwise(F.lit(0).cast("long")))


def normal_line(line_words: Column) -> Column:
    """Words joined by single blanks, A-Z lowered, digit runs as one zero."""
    return F.regexp_replace(F.translate(F.array_join(line_words, " "), CAPITALS, SMALL), "[0-9]+", "0")


def line_rules(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source",
               max_docs: int = 10, max_share: float = 0.002, least_kept: float = 0.5, least_words: int = 50,
               max_repeat: float = 0.5) -> DataFrame:
    """One row for each row: counts of the text, lines removed, and whether the document stays.

    A line (with a word; normalised, hashed to 64 bits) is removed in a host where more than
    ``max_docs`` distinct ids and more than ``max_share`` of the host's ids have it.
    ``base_failed``: under ``least_words`` words, or repeated windows over ``max_repeat`` of
    them.  ``kept``: not base_failed, and at least ``least_kept`` of the words remain.

    Texts are read once; per row the counts and one (hash, words) pair a line are stored,
    and only those are exploded and shuffled, counted before a host's rows meet.  Null texts
    are empty; a null host is a host of its own; rows with a null id are judged but not
    counted; repeated rows count once for each id and each get their row; columns besides
    the three are not read.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[host].cast("string").alias("host"),
                       F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    rows = rows.select("*", words_of(F.col("text")).alias("words"), F.filter(
        F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), words_of(x).alias("words"))),
        lambda x: F.size(x["words"]) > 0).alias("lines"))
    measured = store(rows.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", "host",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.translate("text", SPACE + " ", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines.line"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        F.transform("lines", lambda x: F.struct(
            F.xxhash64(normal_line(x["words"])).alias("h"), F.size(x["words"]).alias("n"))).alias("lines"),
    ), "line-rules")

    present = measured.where(F.col("doc_id").isNotNull())
    sizes = present.groupBy("host").agg(F.count_distinct("doc_id").alias("host_docs"))
    shared = (present.select("host", "doc_id", F.explode(F.array_distinct("lines.h")).alias("h"))
              .groupBy("host", "h").agg(F.count_distinct("doc_id").alias("docs")).where(F.col("docs") > max_docs))
    frequent = (shared.alias("a").join(sizes.alias("b"), F.col("a.host").eqNullSafe(F.col("b.host")))
                .where(F.col("docs") > max_share * F.col("host_docs")).select("a.host", "a.h"))
    lines = measured.select("uid", "host", F.explode("lines").alias("x")).select("uid", "host", "x.h", "x.n")
    removed = (lines.alias("l").join(frequent.alias("f"), (F.col("l.h") == F.col("f.h"))
                                     & F.col("l.host").eqNullSafe(F.col("f.host")))
               .groupBy("uid").agg(F.count("*").alias("n_removed_lines"), F.sum("n").alias("n_removed_words")))
    kept_words = F.col("n_words") - F.coalesce("n_removed_words", F.lit(0))
    base = (F.col("n_words") < least_words) | (F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return measured.drop("lines").join(removed, "uid", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.coalesce("n_removed_lines", F.lit(0)).alias("n_removed_lines"), kept_words.alias("n_kept_words"),
        base.alias("base_failed"), (~base & (kept_words >= least_kept * F.col("n_words"))).alias("kept"))
