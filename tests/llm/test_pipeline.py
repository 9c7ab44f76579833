"""Every stage against a brute-force form on what its predecessor gave, so that the whole run is compared."""

import collections
import math
import re

import numpy as np
import public_tokenizers
import pytest
import test_line_dedup
import test_pii
import test_quality
from tokenizers import Tokenizer

import corpus_pipeline as C
from gridweave.llm import pii
from gridweave.llm import quality as Q

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def good(rows, labels):
    """Rows of (doc_id, text, ...) that pass, by the threshold from held-out scores."""
    grams = [test_quality.brute_grams(r[1]) for r in rows]
    trusted = sorted({d for d, q, _ in labels if q == 1 and d is not None})
    fold = {d: i % Q.FOLDS for i, d in enumerate(trusted)}
    size = 1 << Q.BUCKET_BITS
    raw, part = np.zeros(size), np.zeros((Q.FOLDS, size))
    for r, g in zip(rows, grams, strict=True):
        np.add.at(raw, g, 1)
        if r[0] in fold:
            np.add.at(part[fold[r[0]]], g, 1)

    def ratio(target):
        return np.rint(1e6 * (np.log((target + 0.5) / (target.sum() + 0.5 * size)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * size))))

    features = [test_quality.brute(r[1]) for r in rows]
    bad = [x[0] < 50 or 100 * x[4] > 50 * x[0] for x in features]
    score = lambda g, t: t[g].sum() / max(1, len(g)) / 1e6
    held = [score(g, ratio(part.sum(axis=0) - part[fold[r[0]]])) for r, g, b in zip(rows, grams, bad, strict=True) if r[0] in fold and not b]
    least, whole = np.quantile(held, Q.LOW_QUANTILE) - Q.MARGIN, ratio(part.sum(axis=0))
    return [r for r, g, b in zip(rows, grams, bad, strict=True) if not b and score(g, whole) >= least]


def distinct(rows):
    shingles = []
    for r in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "")
        w = re.findall(r"[^\x20\x09-\x0d]+", w)
        shingles.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = shingles[i], shingles[j]
            if a == b or min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b) > 0:
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r)
    return [min(g, key=lambda r: r[0]) for g in groups.values()]


def redacted(text, spans):
    if text is None:
        return None
    out, at = [], 0
    for kind, s, e in sorted(((k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(",") if x)), key=lambda x: (x[1], pii.KINDS.index(x[0]), x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def with_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    prose = " ".join(f"word{i % 97} and {i}" for i in range(60))
    odd = [(900_001, None), (900_002, ""), (900_003, prose), (900_004, prose + " end"), (None, prose), (900_005, "long " * 30_000), (900_003, prose)]
    return docs.unionByName(spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in odd], docs.schema))


def test_stages_are_the_brute_forms(spark, tmp_path):
    docs = with_odd_rows(spark)
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    columns, seen = docs.columns, {}
    for name, stage in C.STAGES:
        before = rows_of(docs)
        path = f"{tmp_path}/{name.replace(' ', '-')}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs
        if name == "packing":
            break
        assert docs.columns == columns
        after = rows_of(docs)
        if name == "quality rules":
            assert after == sorted(good(before, labels), key=str)
        elif name == "line dedup":
            pairs = [(r[0], r[1]) for r in before]
            test_line_dedup.learn(spark, pairs)
            assert sorted(((r[0], r[1]) for r in after), key=str) == sorted(((d, t) for d, t, _ in test_line_dedup.brute(pairs)), key=str)
        elif name == "SimHash near-dedup":
            assert after == sorted(distinct(before), key=str) and len(after) < len(before)
        else:
            found = test_pii.brute({i: r[1] for i, r in enumerate(before)})
            assert sorted(((r[0], r[1]) for r in after), key=str) == sorted(((r[0], redacted(r[1], found[i][-1])) for i, r in enumerate(before)), key=str)
        if name in ("line dedup", "PII"):
            assert all(r[4] == (None if r[1] is None else len(r[1])) for r in after)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = collections.defaultdict(list)
    for r in docs.collect():
        pieces[r.doc_id].append(r)
    for r in seen["PII"].collect():
        got = [x for p in sorted(pieces[r.doc_id], key=lambda p: p.start) for x in p.ids]
        assert got == [*lib.encode(r.text or "", add_special_tokens=False).ids, 1]
    windows = collections.Counter()
    for r in docs.collect():
        windows[r.sequence_id] += r.length
    assert max(windows.values()) <= 2048 and math.ceil(sum(windows.values()) / 2048) + 1 >= len(windows)


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_edges_of_stages(spark, name):
    """Empty tables, tables of nulls, and extra columns with the names used inside."""
    stage, clash = dict(C.STAGES)[name], ["own", "doc", "this", "gone", "lines", "spans", "node", "score", "removed_chunks", "_0", "_row", "chars"]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(f'{c} string' for c in clash)}"
    assert stage(spark, spark.createDataFrame([], schema), SF).count() == 0
    text = " ".join(f"w{i} mail a{i}@b.org" for i in range(60))
    rows = [(None, None, None, None, None, *clash), (7, text, "en", "s", 1, *clash), (7, text, "en", "s", 1, *clash)]
    out = stage(spark, spark.createDataFrame(rows, schema), SF).collect()
    if name == "packing":
        assert {r.doc_id for r in out} == {None, 7}
    else:
        assert all(r[c] == c for r in out for c in clash)
        assert len(out) == {"line dedup": 3, "SimHash near-dedup": 2, "PII": 3}.get(name, len(out))


def test_run(spark):
    rows = C.run(spark, SF).collect()
    assert rows and all(len(r.ids) == r.length for r in rows)
