"""Target resampling, periodic runs and archive conversion against plain versions, and on odd rows."""

import base64
import gzip
import hashlib
import math
import random
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from fieldtally.llm import periodic_runs, target_resampling, warc
from fieldtally.llm.oracle import ORACLES
from fieldtally.llm.queries import with_period
from test_edges import LONG, ROWS, documents
from tools.check_oracle import normal

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_target_resampling", "op13_warc"])
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got, want = normal(entry.queries()[name](spark, SMALL).toPandas()), normal(db.sql(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want) > 0
    for c in got.columns:
        assert [repr(v) for v in got[c]] == [repr(v) for v in want[c]], c


def test_new_operators_are_registered():
    assert {"op11_target_resampling", "op12_periodic_runs", "op13_warc"} <= set(entry.queries())


# 11: target resampling

def plain_features(text, buckets=target_resampling.BUCKETS):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words, now = [], b""
    for b in low + b" ":
        if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128:
            now += bytes([b])
        elif now:
            words.append(now)
            now = b""
    runs = [b" ".join(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [crc32(r) % buckets for r in runs]


def test_features_of_any_text():
    rng = random.Random(4)
    texts = [None, "", "a", " \n\x00", "é" * 500, "x" * 63 + " " + "y" * 64 + " " + "z" * 65 + " " + "w" * 5000, LONG,
             *("".join(rng.choice("ab Z9-é\U0001F600\n") for _ in range(rng.randrange(300))) for _ in range(40))]
    n_words, found = target_resampling.Features(10_000, 3).of(texts)
    for i, t in enumerate(texts):
        want, buckets = plain_features(t)
        assert n_words[i] == want
        assert Counter(b for owner, at in found for b in at[owner == i].tolist()) == Counter(buckets)


def plain_resample(docs, target, share=(5, 100), least=20):
    feats = {k: plain_features(t) for k, (_, t) in enumerate(docs)}
    s, t = Counter(), Counter()
    for _, f in feats.values():
        s.update(f)
    for text in target:
        t.update(plain_features(text)[1])
    sa, ta = float(sum(s.values())), float(sum(t.values()))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (sa + 10000) / ((s[b] + 1.0) * (ta + 10000))))
    rows = []
    for k, (i, _) in enumerate(docs):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, feats[k][1]))
        rows.append((i, len(feats[k][1]), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), feats[k][0]))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[:len(able) * share[0] // share[1]]
    return rows, [(r[0], r[3]) for r in drawn]


@pytest.mark.parametrize("share, accuracy", [((5, 100), 10_000), ((1, 2), 10_000), ((30, 100), 20), ((1, 1), 10_000), ((1, 1000), 10_000)])
def test_draws_the_highest(spark, share, accuracy):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(40)]
    docs = [(i % 280 if i % 50 else None, " ".join(rng.choices(vocabulary, k=rng.choice([0, 5, 19, 20, 21, 60])))) for i in range(300)]
    docs += docs[:9] + [(900 + k, "tie " * 30) for k in range(30)]
    target = ["w1 w2 w3 tie tie tie", None, "", "w4"]
    out = target_resampling.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
                                     spark.createDataFrame([(t,) for t in target], "text string"),
                                     share=share, accuracy=accuracy).collect()
    rows, drawn = plain_resample(docs, target, share)
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in out), key=key) == sorted((r[:4] for r in rows), key=key)
    got = sorted((r for r in out if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.score) for r in got] == drawn


def test_bracket_is_widened_until_it_holds(spark):
    rows = spark.range(5000)
    for accuracy in (2, 10, 10_000):
        for k in (1, 7, 2500, 4999, 5000):
            low, high, above = target_resampling.bracket(rows, "id", k, 5000, accuracy)
            value = 5000 - k
            assert (low is None or low <= value) and (high is None or value <= high)
            assert above == (0 if high is None else 4999 - high)


def test_resampling_of_odd_rows(spark):
    docs, target = documents(spark, ROWS), spark.createDataFrame([("word another thing",)], "text string")
    out = target_resampling.resample(docs, target, share=(1, 2)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in ROWS)
    assert {r.doc_id for r in out if r["rank"]} == {7}  # 6 and 7 have equal texts, the hash of the id decides
    assert all(r.weight == 0 and r.n_features == 0 for r in out if r.doc_id in (3, 4, 5))
    drawn = target_resampling.draw(docs, target, share=(1, 2))
    assert drawn.columns == docs.columns and [r.doc_id for r in drawn.collect()] == [7]
    assert target_resampling.resample(documents(spark, []), target).count() == 0
    assert {r["rank"] for r in target_resampling.resample(docs, target.limit(0), share=(0, 1)).collect()} == {None}


# 12: periodic runs

def plain_runs(words, least=12):
    best = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, 2 * q):
                best.setdefault((s, i + q), q)
            i += i == s
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_plain_ones():
    rng = random.Random(2)
    for _ in range(300):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            words = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.choice([0, 1, 11, 12, 40, 150]))]
            for _ in range(rng.randrange(3) if words else 0):
                a = rng.randrange(len(words))
                p = 1 + rng.randrange(1 + (len(words) - a) // 2)
                for i in range(a, rng.randrange(a, len(words)) + 1):
                    words[i] = words[a + (i - a) % p]
            texts.append(words)
        begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        found = list(zip(*(x.tolist() for x in periodic_runs.runs_of(np.array(sum(texts, []), np.int32), begin))))
        assert found == [(k, *r) for k, t in enumerate(texts) for r in plain_runs(t)]


def test_rules_derive_the_text():
    rng = random.Random(3)
    words = np.array([rng.randrange(4) for _ in range(400)] + list(range(5, 25)) * 4, np.int32)
    rules = periodic_runs.grammar(words, np.zeros(len(words), np.int64), least=2)
    assert len(rules.first) < len(rules.rule)  # repeated pairs are one rule
    for r, at in zip(rules.rule, rules.place):
        n = rules.size[r]
        assert 0 < rules.left[r] < n and (words[at:at + n] == words[rules.first[r]:rules.first[r] + n]).all()
    assert rules.size.max() == len(words)


def test_query_equals_plain_version(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall())
    out = {r.doc_id: r for r in entry.queries()["op12_periodic_runs"](spark, SMALL).collect()}
    assert out.keys() == texts.keys() and sum(r.n_runs > 0 for r in out.values()) > 10
    for i, t in texts.items():
        words = (t or "").encode().split()
        n, h = len(words), crc32(str(i).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = plain_runs(words)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        digest = lambda b: hashlib.sha256(b).hexdigest()
        s, m, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        assert out[i].asDict() == {
            "doc_id": i, "n_runs": len(runs), "start": s, "length": m, "period": q, "exponent_milli": q and 1000 * m // q,
            "runs_sha256": digest("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()),
            "collapsed_sha256": digest(b" ".join(w for k, w in enumerate(words) if k not in gone))}


def test_runs_of_odd_rows(spark):
    out = periodic_runs.collapse_runs(documents(spark, ROWS)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in ROWS)
    by_id = {r.doc_id: r for r in out}
    assert by_id[6].collapsed == LONG.strip().split("here.")[0] + "here." and [tuple(r) for r in by_id[6].runs] == [(0, 24000, 4)]
    assert by_id[3].collapsed == by_id[4].collapsed == by_id[5].collapsed == "" and by_id[3].runs == []
    assert by_id[10].collapsed == "\U0001F600 naïve Ünïcode \x00 text"
    assert periodic_runs.collapse_runs(documents(spark, [])).count() == 0
    assert with_period(None, [b"a"] * 20) == [b"a"] * 20


# 13: archives

def arc(version, records, name="old"):
    return warc.arc_opening(version, name, "20010203040506") + b"\n" + b"".join(r + b"\n" for r in records)


def test_both_versions_and_odd_records_are_read():
    page = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>a\n\nhttp://x.org/ 1.2.3.4 20010101000000 text/html 5\n</p>"
    for version in (1, 2):
        records = [warc.arc_record(version, "http://a.org/b c", "1.2.3.4", "199912312359", "text/html", page, offset=7, name="old.arc"),
                   b"this is not a header line\nnor is this\n", warc.arc_record(version, "dns:a.org", "1.1.1.1", "2001", "text/dns", b"20010101\na.org. IN A"),
                   warc.arc_record(version, "http://empty.org/", None, "20019999000000", None, b"")]
        content = arc(version, records)
        content = content[:-1] + b"\r\n" + warc.arc_record(version, "ftp://cut.org/", None, "20020101000000", "image/gif", b"x" * 50)[:-20]
        found = list(warc.parse_arc("old.arc", content))
        assert [r[3] for r in found] == ["filedesc://old.arc", "http://a.org/b%20c", None, "dns:a.org", "http://empty.org/", "ftp://cut.org/"]
        assert found[1][9] == page and found[1][7] == ("200" if version == 2 else None) and {r[2] for r in found} == {version}
        assert found[2][10] and found[2][9] == records[1] + b"\n" and len(found[5][9]) == 30 and found[5][8] == 50
        made = [dict(zip([c.split()[0] for c in warc.CONVERTED.split(", ")], warc.convert_record(r))) for r in found]
        assert [m["warc_type"] for m in made] == ["warcinfo", "response", "resource", "resource", "resource", "resource"]
        assert made[1]["warc_date"] == "1999-12-31T23:59:00Z" and made[3]["warc_date"] == "2001-01-01T00:00:00Z"
        assert made[4]["warc_date"] == "1970-01-01T00:00:00Z" and made[3]["content_type"] == "text/dns" and made[5]["truncated"]
        assert made[1]["payload_digest"] == base64.b32encode(hashlib.sha1(page.split(b"\r\n\r\n", 1)[1]).digest()).decode()
        assert len({m["record_id"] for m in made}) == 6 and made == [dict(zip(made[0], warc.convert_record(r))) for r in found]
    assert list(warc.parse_arc("none", b"")) == []


def test_fields_are_taken_as_the_file_names_them():
    block = b"1 1 Archive\nURL Archive-date IP-address Content-type Archive-length\n"
    content = b"filedesc://x 20000101000000 0.0.0.0 text/plain %d\n" % len(block) + block + b"\nhttp://a/ 20000102000000 9.9.9.9 text/html 2\nhi\n"
    assert list(warc.parse_arc("x", content))[1][3:8] == ("http://a/", "9.9.9.9", "20000102000000", "text/html", None)


def test_pages_come_back_and_equal_ones_are_revisits(spark, folder):
    texts = ["same", None, "", "WARC/1.1\r\n\r\nWARC/1.1\r\n", "y" * 300_000, "ünï\U0001F600\x00"]
    rows = [(k if k % 7 else None, None if k % 5 == 0 else f"http://h{k % 3}.org/a b{k}", texts[k % 6]) for k in range(60)] + [(59, "again", texts[5])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    warc.write_arc(pages, f"{folder}/arc", archive_bytes=400_000)
    warc.arc_to_warc(spark, f"{folder}/arc", f"{folder}/warc", archive_bytes=400_000)
    out = warc.read_warc(spark, f"{folder}/warc").where("warc_type <> 'warcinfo'").collect()
    last = {t or "": max(i for i, _, u in rows if (u or "") == (t or "") and i is not None) for t in texts}
    want = sorted((str(i), len((t or "").encode()), base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode(),
                   "response" if i == last[t or ""] else "revisit", "None" if i == last[t or ""] else str(last[t or ""])) for i, _, t in rows)
    assert sorted((str(r.key), r.payload_bytes, r.payload_digest, r.warc_type, str(r.refers_to_key)) for r in out) == want
    ids = {r.record_id: r for r in out}
    assert len(ids) == len(out)
    for r in out:
        if r.warc_type == "revisit":
            assert ids[r.refers_to_id].key == r.refers_to_key and r.payload == b"" and ids[r.refers_to_id].payload_digest == r.payload_digest
        else:
            assert base64.b32encode(hashlib.sha1(r.payload).digest()).decode() == r.payload_digest
    assert {r.uri for r in out if r.key == "59"} == {"http://h2.org/a%20b59", "again"}
    import glob
    files = glob.glob(f"{folder}/warc/part-*")
    assert len(files) > 4 and all(gzip.open(f).read(8) == b"WARC/1.1" for f in files)


def test_hot_payloads_are_met_apart(spark, folder, monkeypatch):
    monkeypatch.setattr(warc, "HOT_SHARE", 3)
    pages = spark.range(90).selectExpr("id AS page_id", "'http://a.org/' AS url", "IF(id % 2 = 0, 'hot', concat('p', id % 9)) AS html", "1 AS key", "2 AS offset")
    warc.write_arc(pages, f"{folder}/arc")
    found = Counter(int(r.refers_to_key) for r in warc.revisits(warc.convert(spark, f"{folder}/arc", blocks=False)).collect())
    last = {f"p{k}": max(i for i in range(1, 90, 2) if i % 9 == k) for k in range(9)} | {"hot": 88}
    assert found == {v: 44 if k == "hot" else 4 for k, v in last.items()}
    assert warc.revisits(warc.convert(spark, f"{folder}/arc", blocks=False), least_bytes=4).count() == 0


def test_empty_pages(spark, folder):
    warc.write_arc(spark.createDataFrame([], "page_id long, url string, html string"), f"{folder}/arc")
    warc.arc_to_warc(spark, f"{folder}/arc", f"{folder}/warc")
    assert warc.read_warc(spark, f"{folder}/warc").count() == 0


def test_changed_records_raise():
    good = warc.warc_record([("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:" + warc.base32_sha1(b"body"))], b"body")
    assert list(warc.parse_warc("f", good + b"\r\n\r\n"))[0][-1] == b"body"
    for bad in (good[:-1], good[:-1] + b"!", b"x" + good):
        with pytest.raises(ValueError):
            list(warc.parse_warc("f", bad))
