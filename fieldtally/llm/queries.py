"""The corpus operators bound to the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.session import scratch_table

from . import (bpe, decontamination, ngram_join, periodic_runs, quality, secrets, sentence_spans, sharding, suffix_dedup,
               suffix_tree_lm, target_resampling, toxicity, warc)
from .common import sha256, table
from .oracle import ORACLES


def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", "class_id", "n_links", "n_copies")


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        sha256(F.array_join("items", ",")).alias("items_sha256"), "contaminated",
        F.size("spans").cast("long").alias("n_spans"))


def op3_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return quality.line_rules(table(spark, folder, "documents"))


def _joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, folder, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select(
        "doc_id", *(of(k).alias(f"n_{k}") for k in secrets.BASE_KINDS),
        sha256(_joined(base)).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = suffix_dedup.drop_repeats(table(spark, folder, "documents"), length=200)
    return done.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.score_toxicity(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


def op7_suffix_tree_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held = suffix_tree_lm.held_out()
    return suffix_tree_lm.score_texts(docs, ~held).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def word_bpe() -> str:
    """The definition of the public word BPE that the contract names."""
    import public_tokenizers

    return bpe.read_definition(public_tokenizers.path("word_bpe_49k.json"))


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    done = bpe.encode_decode(table(spark, folder, "documents"), word_bpe())
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        sha256(F.col("decoded")).alias("decoded_sha256"))


def op9_sentence_spans(spark: SparkSession, folder: str) -> DataFrame:
    done = sentence_spans.dedup_sentences(table(spark, folder, "documents"))
    return done.select("doc_id", "n_sentences", "n_removed", "removed",
                       sha256(F.coalesce("kept_text", F.lit(""))).alias("kept_sha256"))


def op10_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.hilbert_shards(table(spark, folder, "documents"), shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op11_target_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = target_resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def with_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's change of every tenth document: from some word on it repeats a stretch of its own. Null ids change nothing."""
    h = crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    done = periodic_runs.collapse_runs(table(spark, folder, "documents"), rewrite=with_period)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("less"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    start, length, period = -F.col("_longest.before"), F.col("_longest.length"), -F.col("_longest.less")
    return done.withColumn("_longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        sha256(lines).alias("runs_sha256"), sha256(F.col("collapsed")).alias("collapsed_sha256"))


def op13_warc(spark: SparkSession, folder: str) -> DataFrame:
    legacy, archives = scratch_table(spark, "arc"), scratch_table(spark, "warc")
    warc.write_arc(table(spark, folder, "pages"), legacy)
    warc.arc_to_warc(spark, legacy, archives)
    return warc.read_warc(spark, archives, payloads=False).where("warc_type IN ('response', 'revisit')").select(
        F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
        F.col("warc_type").alias("record_type"), F.col("refers_to_key").cast("long").alias("refers_to"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_decontamination": op2_decontamination,
        "op3_line_frequency": op3_line_frequency,
        "op4_secret_scan": op4_secret_scan,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_toxicity": op6_toxicity,
        "op7_suffix_tree_lm": op7_suffix_tree_lm,
        "op8_bpe": op8_bpe,
        "op9_sentence_spans": op9_sentence_spans,
        "op10_hilbert_shards": op10_hilbert_shards,
        "op11_target_resampling": op11_target_resampling,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_warc": op13_warc,
    }


def llm_oracles() -> dict[str, str]:
    return dict(ORACLES)
