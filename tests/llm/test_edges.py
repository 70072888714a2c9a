"""Cases every corpus operator must take: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import public_tokenizers
import pytest
from pyspark.sql import types as T

import corpus_pipeline
from fieldtally.llm import (bpe, decontamination, ngram_join, quality, secrets, sentence_spans, sharding,
                            suffix_dedup, suffix_tree_lm, toxicity)

LONG = "word another thing here. " * 6000
CLASHING = ("n_words", "score", "spans", "shard", "slot", "t", "_key", "uid", "ids", "kept", "raw", "size", "h", "w", "c", "_gone_t",
            "_near0_t", "_shard_doc", "_slot", "d0", "all")
ROWS = [
    (1, "The same small text, twice in the table."), (1, "The same small text, twice in the table."),
    (2, "The same small text, twice in the table."), (None, "A text without an id."), (None, None), (3, None),
    (4, ""), (5, "   \n\t "), (6, LONG), (7, LONG), (8, "x"), (9, "A" * 5000), (10, "\U0001F600 naïve Ünïcode \x00 text"),
]
DEFINITION = bpe.read_definition(public_tokenizers.path("word_bpe_49k.json"))


def documents(spark, rows):
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        *(T.StructField(c, T.StringType()) for c in CLASHING)])
    full = [(i, t, "en" if i else None, None if i == 4 else "src0", len(t) if t is not None else None,
             *("extra" for _ in CLASHING)) for i, t in rows]
    return spark.createDataFrame(full, schema)


def others(spark):
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, None), (None, 1, 1), (6, 1, 0), (1, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "The same small text, twice in the table."), (None, "A text without an id."),
                                       (2, None), (3, ""), (3, "another item")], "item_id long, text string")
    return labels, benchmark


OPERATORS = {
    "ngram_join": lambda d, lab, ben: ngram_join.near_duplicates(d),
    "ngram_drop": lambda d, lab, ben: ngram_join.drop_near_duplicates(d),
    "decontamination": lambda d, lab, ben: decontamination.contamination(d, ben),
    "decontamination_drop": lambda d, lab, ben: decontamination.drop_contaminated(d, ben),
    "quality": lambda d, lab, ben: quality.line_rules(d),
    "secrets": lambda d, lab, ben: secrets.scan_secrets(d),
    "secrets_mask": lambda d, lab, ben: secrets.mask_secrets(d),
    "suffix": lambda d, lab, ben: suffix_dedup.drop_repeats(d, length=60, gram=16),
    "toxicity": lambda d, lab, ben: toxicity.score_toxicity(d, toxicity.fit(d, lab)),
    "toxicity_drop": lambda d, lab, ben: toxicity.drop_toxic(d, toxicity.fit(d, lab)),
    "lm": lambda d, lab, ben: suffix_tree_lm.score_texts(d, d),
    "bpe": lambda d, lab, ben: bpe.encode_decode(d, DEFINITION),
    "sentences": lambda d, lab, ben: sentence_spans.dedup_sentences(d),
    "shards": lambda d, lab, ben: sharding.hilbert_shards(d),
}
ALL_ROWS = [k for k in OPERATORS if not k.endswith("_drop")]


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    out = OPERATORS[name](documents(spark, ROWS), *others(spark)).collect()
    if name in ALL_ROWS:
        assert sorted(map(str, [r.doc_id for r in out])) == sorted(str(i) for i, _ in ROWS)
        same = [r.asDict(True) for r in out if r.doc_id == 1]
        if name == "shards":
            same = [{k: v for k, v in r.items() if k not in ("slot", "shard")} for r in same]
        assert same[0] == same[1]
    else:
        assert {r.doc_id for r in out} <= {i for i, _ in ROWS} and len(out[0]) == 5 + len(CLASHING)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    labels, benchmark = others(spark)
    assert OPERATORS[name](documents(spark, []), labels.limit(0), benchmark.limit(0)).count() == 0
    rows = OPERATORS[name](documents(spark, [(1, None), (2, "")]), labels.limit(0), benchmark.limit(0)).count()
    assert rows <= 2 and (rows == 2 or name not in ALL_ROWS)


def test_defined_results_of_odd_rows(spark):
    docs = documents(spark, ROWS)
    labels, benchmark = others(spark)
    by_id = lambda df: {r.doc_id: r for r in df.collect() if r.doc_id is not None}
    near = by_id(ngram_join.near_duplicates(docs))
    assert near[2].class_id == 1 and near[2].n_copies == 2 and near[7].class_id == 6
    assert near[3].class_id == 3 and near[3].n_copies == 0 and near[4].class_id == 4
    kept = [r.doc_id for r in ngram_join.drop_near_duplicates(docs).collect()]
    assert 2 not in kept and 7 not in kept and {1, 3, 4, 6} <= set(kept) and kept.count(None) == 2
    assert kept.count(1) == 1  # of repeated rows one stays
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, words), (3, words + " more"),
            (None, "no id at all"), (None, "no id at all"), (None, None), (None, None)]
    left = [(r.doc_id, r.text) for r in ngram_join.drop_near_duplicates(documents(spark, rows)).collect()]
    assert sorted(left, key=str) == sorted([(1, "a b c d e f"), (3, min(words, words + " more")), (None, "no id at all"), (None, None), (None, None)], key=str)
    found = by_id(decontamination.contamination(docs, benchmark))
    assert found[1].contaminated and found[1].items == ["1"] and not found[3].contaminated and found[4].n_words == 0
    clean = {r.doc_id for r in decontamination.drop_contaminated(docs, benchmark).collect()}
    assert {1, 2}.isdisjoint(clean) and {3, 4, 6} <= clean
    cut = by_id(suffix_dedup.drop_repeats(docs, length=60, gram=16))
    assert cut[3].n_bytes == 0 and bytes(cut[3].kept) == b"" and bytes(cut[9].kept) == b"" and bytes(cut[8].kept) == b"x"
    assert bytes(cut[6].kept) == b"" and bytes(cut[2].kept) == b"The same small text, twice in the table."
    scores = by_id(toxicity.score_toxicity(docs, toxicity.fit(docs, labels)))
    assert scores[3].score == scores[4].score == 0.0 and all(0 <= r.score <= 1 for r in scores.values())
    masked = by_id(secrets.mask_secrets(docs))
    assert masked[3].text is None and masked[9].text == "A" * 5000
    lm = by_id(suffix_tree_lm.score_texts(docs, docs))
    assert lm[3].n_tokens == lm[4].n_tokens == 1 and lm[8].n_tokens == 2
    spans = by_id(sentence_spans.dedup_sentences(docs))
    assert spans[3].kept_text is None and spans[4].kept_text == "" and spans[2].n_removed == 0
    assert spans[7].kept_text == "" and spans[6].kept_text != ""


def test_pipeline_takes_odd_rows(spark, folder):
    labels, benchmark = others(spark)
    docs = documents(spark, ROWS)
    labels.write.parquet(f"{folder}/labels.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/stage{k}")
        now = spark.read.parquet(f"{folder}/stage{k}")
    done = corpus_pipeline.run(spark, folder)
    key = lambda r: (str(r.doc_id), r.decoded_sha256)
    assert sorted(map(key, done.collect())) == sorted(map(key, now.collect()))
    assert {3, 4, 6, 8, 9, 10} <= {r.doc_id for r in now.collect()} and 7 not in {r.doc_id for r in now.collect()}
