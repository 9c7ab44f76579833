import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from gridweave.llm import phrases as P

SCHEMA = "doc_id long, text string, lang string, n long, words string"


def brute(rows, least, share=100, most=2000):
    """Rows (text, lang) to (lang, rank, phrase, a, l, r, n, score)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, 6):
                for i in range(len(ws) - m + 1):
                    f[lang, *ws[i : i + m]] += 1
    kept = {p: c for p, c in f.items() if c >= least}
    out = []
    for p, a in kept.items():
        lang, ws = p[0], p[1:]
        if len(ws) < 2:
            continue
        best = min((1000 * a * n[lang] // (f[lang, *ws[:k]] * f[lang, *ws[k:]]), k, f[lang, *ws[:k]], f[lang, *ws[k:]]) for k in range(1, len(ws)))
        inside = lambda q, ws=ws: any(q[i : i + len(ws)] == ws for i in range(len(q) - len(ws) + 1))
        if any(q[0] == lang and len(q) - 1 > len(ws) and 100 * c >= share * a and inside(q[1:]) for q, c in kept.items()):
            continue
        out.append((lang, " ".join(ws), a, best[2], best[3], n[lang], best[0]))
    ranked = []
    for lang in {o[0] for o in out}:
        mine = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))[:most]
        ranked += [(o[0], i + 1, *o[1:]) for i, o in enumerate(mine)]
    return sorted(ranked)


def result(spark, rows, least, share=100, most=2000):
    docs = spark.createDataFrame([(1, t, g, 0, "clash") for t, g in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in P.collocations(docs, least, share, most).collect())


def corpus(seed=1, docs=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["Été", "ÉTÉ", "x y", "a\x1cb", "ß"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = []
    for i in range(docs):
        ws = rng.choices(vocabulary, weights, k=rng.randrange(200))
        for _ in range(rng.randrange(6)):
            ws[rng.randrange(len(ws) + 1) : 0] = ["New", "York", "City", "Hall"][: rng.randrange(2, 5)]
        rows.append(("".join(w + rng.choice([" "] * 9 + ["\t", ". ", ",", "\n", "  ", " ! ", "\x0b", "\r\n"]) for w in ws), rng.choice(["en", "fr", None, "und"])))
    return rows + [(None, "en"), ("", "en"), (" . ;\t", "fr"), ("one", None)]


@pytest.mark.parametrize(("share", "known"), [(100, 1 << 20), (60, 3)])
def test_against_brute_force(spark, monkeypatch, share, known):
    monkeypatch.setattr(P, "KNOWN_MOST", known)
    rows = corpus()
    got = result(spark, rows, 5, share)
    assert len(got) > 100 and got == brute(rows, 5, share)


@pytest.mark.parametrize("known", [1 << 20, 3])
def test_many_ranges_and_chunks(spark, monkeypatch, known):
    """Phrases that touch the ends of ranges, and texts longer than a chunk."""
    for name, value in {"KNOWN_MOST": known, "CHUNK_TOKENS": 50, "BLOCK_BYTES": 40, "RANGE_TOKENS": 90, "SAMPLED": 0.5}.items():
        monkeypatch.setattr(P, name, value)
    rows = corpus(2)
    rows.append((" ".join(t or "" for t, _ in rows), "en"))
    assert result(spark, rows, 4) == brute(rows, 4)


def test_one_phrase_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(P, "RANGE_TOKENS", 40)
    monkeypatch.setattr(P, "CHUNK_TOKENS", 60)
    monkeypatch.setattr(P, "SAMPLED", 0.9)
    rows = [(f"of the w{i} x{i % 7}.", "en") for i in range(300)] + [("of the", "en")] * 40
    assert result(spark, rows, 3) == brute(rows, 3)


def test_ties_and_most(spark):
    rows = [(f"{a} {b}.", "en") for a, b in ("ab", "cd", "éf", "zf", "Zg", "é0") for _ in range(3)]
    got = result(spark, rows, 3, most=3)
    assert got == brute(rows, 3, most=3) and len(got) == 3


def test_words_that_share_an_id_get_another_seed(spark, monkeypatch):
    real = P.id_of
    monkeypatch.setattr(P, "id_of", lambda lang, word, seed: P.F.lit(77).cast("long") if seed < 2 else real(lang, word, seed))
    words, seed = P.checked_counts(spark.createDataFrame([(1, "a b É a", "en", 0, "")], SCHEMA))
    assert seed == 2 and sorted((r.word, r.n) for r in words.collect()) == [("a", 2), ("b", 1), ("É", 1)]
    assert all(P.word_id("en", 2)(r.word.encode()) == r.id % (1 << 64) for r in words.collect())


def test_empty_table(spark):
    assert P.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert result(spark, [("a b", "en")], 2) == []


@pytest.mark.parametrize("size", [50, 70_000])
def test_parts_keep_windows(size):
    rng = np.random.default_rng(0)
    values = np.concatenate([[0], np.sort(rng.integers(1, 1 << 63, size, dtype=np.uint64))])
    columns = [rng.integers(0, size + 1, 2 * size).astype(np.int32) for _ in range(5)]
    ids, places, counts = P.unpacked_part(P.packed_part(values, columns, np.arange(2 * size)))
    assert all((ids[places[k]] == values[columns[k]]).all() for k in range(5)) and (counts == np.arange(2 * size)).all()
    ids, places, counts = P.unpacked_part(P.packed_part(None, columns, np.arange(2 * size)))
    assert not len(ids) and all((places[k] == columns[k]).all() for k in range(5)) and (counts == np.arange(2 * size)).all()


def test_exact_beyond_64_bits():
    """The quotient of products of more than 64 bits, as the score takes it."""
    con = duckdb.connect()
    a, n, l, r = 10**9 + 7, 3 * 10**12 + 1, 10**9 + 9, 10**9 + 21  # noqa: E741
    assert con.execute(f"SELECT (1000::HUGEINT * {a} * {n}) // ({l}::HUGEINT * {r})").fetchone()[0] == 1000 * a * n // (l * r)


def test_score_in_spark_is_exact(spark):
    a, n, l, r = 9 * 10**14 + 7, 9 * 10**16 + 1, 9 * 10**14 + 9, 9 * 10**15 + 21  # noqa: E741
    d = spark.createDataFrame([(a, n, l, r)], "a long, n long, l1 long, r1 long")
    assert d.select(P.score(1)).first()[0] == 1000 * a * n // (l * r)
