import collections
import math
import re

import numpy as np

from gridweave.llm import quality as Q

TEXTS = [None, "", "a b", "a b c a b c d\n\n a\na\na", "é è é è é è <|>", "\n\n", "x", "one two three " * 40, " ".join(f"w{i}" for i in range(49)), " ".join(f"w{i}" for i in range(50)), "long " * 30_000]


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    tri = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    marked = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked))


def brute_bucket(g: bytes) -> int:
    h = int.from_bytes(g, "little") * 0x9E3779B1 % 2**32
    h ^= h >> 15
    return (h * 0x85EBCA77 % 2**32) >> (32 - Q.BUCKET_BITS)


def brute_grams(text):
    b = (text or "").encode()
    return [brute_bucket(b[i : i + Q.GRAM]) for i in range(len(b) - Q.GRAM + 1)]


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(1_000_000 + i, t, "en", "s", 0) for i, t in enumerate(TEXTS)], docs.schema)
    docs = docs.unionByName(odd)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = docs.collect()
    trusted = {r.doc_id for r in labels.where("quality = 1").collect()}
    raw, target = collections.Counter(), collections.Counter()
    for r in rows:
        raw.update(g := brute_grams(r.text))
        if r.doc_id in trusted:
            target.update(g)
    size, nt, nr = 1 << Q.BUCKET_BITS, target.total(), raw.total()
    ratio = [round(1e6 * (math.log((target[b] + 0.5) / (nt + 0.5 * size)) - math.log((raw[b] + 0.5) / (nr + 0.5 * size)))) for b in range(size)]
    got = {r.doc_id: r for r in Q.judged(docs, labels).collect()}
    assert len(got) == len(rows)
    for r in rows:
        x, g = brute(r.text), brute_grams(r.text)
        failed = x[0] < 50 or 100 * x[4] > 50 * x[0]
        score = sum(ratio[b] for b in g) / max(1, len(g)) / 1e6
        o = got[r.doc_id]
        assert tuple(o[c] for c in Q.BASE) == x and o.base_failed == failed
        assert abs(o.score - score) < 3e-6 and o.kept == (not failed and score >= Q.THRESHOLD)


def test_labelled_documents(spark):
    """Held out: good documents that pass the base rules stay, bad ones go."""
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    fit, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = Q.judged(spark.read.parquet(f"{d}/documents.parquet"), fit).join(held, "doc_id").where("not base_failed").toPandas()
    assert got[got.quality == 1].kept.all() and not got[got.quality == 0].kept.any()


def test_edges(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.judged(docs, labels).count() == 0
    one = spark.createDataFrame([(None, "a " + " ".join(f"w{i}" for i in range(60)), "x")] * 2, docs.schema)
    got = Q.judged(one, labels).collect()
    assert len(got) == 2 and all(r.kept and r.score == 0 for r in got)
    assert Q.trusted_ids(spark.createDataFrame([(None, 1, 0), (5, 1, 0), (5, 1, 0), (6, 0, 0)], labels.schema)).tolist() == [5]
    assert np.array_equal(Q.log_ratios(one, np.array([], np.int64)), np.zeros(1 << Q.BUCKET_BITS))


def test_rare_junk(spark):
    """With junk counted at 1/100 of its share, no labelled junk passes and no good document is lost; with the constant some junk does."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").groupBy("doc_id").agg(Q.F.max("quality").alias("quality"))
    docs = spark.read.parquet(f"{d}/documents.parquet").join(labels, "doc_id").select("doc_id", "text", "quality").cache()
    good, bad = docs.where("quality = 1"), docs.where("quality = 0")
    trusted = Q.trusted_ids(labels)
    clean, target = Q.gram_counts(good, trusted)
    raw = clean + Q.gram_counts(bad, trusted)[0] / 100
    least = Q.held_out_threshold(docs, trusted, raw, target)
    ratio = Q.ratios(raw, target.sum(axis=0))
    top, low = {}, {}
    for name, part in (("good", good), ("bad", bad)):
        column = part.toArrow()["text"].combine_chunks()
        score = Q.scores(column, ratio)[~Q.failed(Q.base_features(column))]
        top[name], low[name] = score.max(), score.min()
    assert low["good"] >= least > top["bad"] > Q.THRESHOLD


def test_query_holds_out(spark):
    """The query's verdict is by the held-out threshold."""
    from gridweave.llm import queries

    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    trusted = Q.trusted_ids(labels)
    least = Q.held_out_threshold(docs, trusted, *Q.gram_counts(docs, trusted))
    want = {r.doc_id: not r.base_failed and r.score >= least for r in Q.judged(docs, labels).collect()}
    assert least != Q.THRESHOLD and {r.doc_id: r.kept for r in queries.op3_quality(spark, d).collect()} == want


def test_every_trusted_document_counts(spark, monkeypatch):
    """The target is of all documents labelled good, over 20,000 too, whether their ids are sent to all tasks or joined."""
    n = 20_500
    docs = spark.range(2 * n).selectExpr("id * 3 as doc_id", "concat('t', id % 7, ' ', repeat('w', cast(id % 5 as int))) as text").repartition(6)
    labels = spark.range(2 * n).selectExpr("id * 3 as doc_id", "cast(id % 2 as int) as quality").repartition(5)
    want = np.zeros((Q.FOLDS, 1 << Q.BUCKET_BITS))
    for i, k in enumerate(range(1, 2 * n, 2)):
        np.add.at(want[i % Q.FOLDS], brute_grams(f"t{k % 7} {'w' * (k % 5)}"), 1)
    folds = Q.trusted_folds(labels)
    assert sorted((r.doc_id, r.fold) for r in folds.collect()) == [(3 * k, i % Q.FOLDS) for i, k in enumerate(range(1, 2 * n, 2))]
    assert np.array_equal(Q.gram_counts(docs, folds)[1], want)
    monkeypatch.setattr(Q, "TRUSTED_SENT", 100)
    assert np.array_equal(Q.gram_counts(docs, folds)[1], want)
    assert np.array_equal(Q.log_ratios(docs, Q.trusted_ids(labels)), Q.log_ratios(docs, folds))
