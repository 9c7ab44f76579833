import collections
import math
import random
import re
from hashlib import sha256

from gridweave.llm import pii
from gridweave.llm.pii import F

WORD = r"[^\x20\x09-\x0D]"


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base(t):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return out


def words_of(t):
    return [(m.start(), m.end(), m[0].lower()) for m in re.finditer(rf"{WORD}+", t)]


def context(t, at):
    """The two words before the word that place ``at`` lies in."""
    w = words_of(t)
    i = next(i for i, (a, b, _) in enumerate(w) if a <= at < b)
    return f"{w[i - 2][2]} {w[i - 1][2]}" if i >= 2 else None


def tokens(t, old):
    for a, b, _ in words_of(t):
        core = re.sub("^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "", t[a:b])
        start = b - len(re.sub("^[^A-Za-z0-9]+", "", t[a:b]))
        if len(core) >= 6 and (len(re.sub("[^0-9]", "", core)) >= 4 or "@" in core) and not any(start < e and s < start + len(core) for s, _, e, _ in old):
            yield start, start + len(core), core, a


def brute(texts):
    texts = {i: t or "" for i, t in texts.items()}
    bases, new, edges = {i: base(t) for i, t in texts.items()}, {i: [] for i in texts}, collections.Counter()
    seeds = set()
    for i, t in texts.items():
        for start, _, end, _ in bases[i]:
            seeds.add(t[start:end].lower())
            edges[context(t, start), t[start:end].lower()] += 1
        new[i] = [(s, e, v, context(t, a)) for s, e, v, a in tokens(t, bases[i])]
        for _, _, v, c in new[i]:
            edges[c, v.lower()] += 1
    edges = {k: n for k, n in edges.items() if k[0]}
    values = collections.Counter(c for c, _ in edges)
    occ = collections.Counter()
    for t in texts.values():
        w = [x for _, _, x in words_of(t)]
        occ.update(" ".join(p) for p in zip(w, w[1:], strict=False))
    edges = {k: n for k, n in edges.items() if values[k[0]] >= pii.MIN_VALUES}
    score = {v: float(v in seeds) for _, v in edges}
    conf = {}
    for _ in range(pii.ROUNDS):
        gain = collections.Counter()
        for (c, v), n in edges.items():
            gain[c] += n * score[v]
        conf = {c: min(1.0, g / occ[c]) for c, g in gain.items()}
        doubt = collections.Counter()
        for (c, v), n in edges.items():
            doubt[v] += n * math.log(1 - min(conf[c], 0.999))
        score = {v: 1.0 if v in seeds else 1 - math.exp(doubt[v]) for v in score}
    out = {}
    say = lambda x: ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(x))
    for i in texts:
        extra = [(s, 4, e, "context") for s, e, _, c in new[i] if conf.get(c, 0) >= pii.LEAST_CONFIDENCE]
        out[i] = [*(sum(x[3] == k for x in bases[i]) for k in pii.KINDS[:4]), sha256(say(bases[i]).encode()).hexdigest(), say(bases[i] + extra)]
    return out


def fixture():
    r = random.Random(5)
    word = lambda: "".join(r.choice("aeioubdfg") for _ in range(r.randint(2, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = [f"{prose(8)} mail me: x{i}.{word()}@host.example.org {prose(5)} from address 10.{i}.3.255 end" for i in range(8)]
    texts += [f"{prose(4)} mail me: unseen-{i}4{i}88@intranet, {prose(3)} from address AB-{i}{i}123-9. x" for i in range(3)]
    texts += [f"{prose(5)} in year 1984{i}55 {prose(4)} +1 (743) 555-38{i}4 and 4785380592391139 {prose(3)}" for i in range(4)]
    texts += ["a@b.c_d@e.f 300.1.2.3.4 1.2.3.4.5.6.7.8 12 -34 4785 3805 9239 1139-1 +12 +1(((((9", "", None, "x" * 5_000 + "@", "1" * 5_000 + " " + "1-" * 3_000, "éé é@é.é +49 30 1234567\n\n\t 001.02.3.4"]
    return dict(enumerate(texts))


def test_against_brute_force(spark):
    texts = fixture()
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, spans string")
    got = {r[0]: list(r[1:]) for r in pii.digests(pii.found_spans(docs)).collect()}
    want = brute(texts)
    assert got == want
    assert sum("context" in v[-1] for v in got.values()) == 3


def spans_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digests(pii.found_spans(docs)).collect()}
    want = brute(dict(enumerate(texts)))
    assert got == {i: w[-1] for i, w in want.items()}
    return got


def test_contexts_by_word_position(spark):
    """Words of a context may be matches themselves, long, and far apart."""
    pairs = ["form b", "form 27", "1984 27", "f@x 2", "a" * 50 + " " + "b" * 70, "form\t\n  c"]
    texts = []
    for pair in pairs:
        texts += [f"some words and {pair} x{i}@host.example.org then" for i in range(6)]
        texts += [f"other words {pair} unseen-4477 end", f"{pair} +4477889900112 +49-30-123456 end"]
    got = spans_of(spark, [*texts, "short 5551234 fax 5559999"])
    assert all("context" in got[8 * k + 6] for k in range(len(pairs)))


def test_very_long_text(spark):
    text = " ".join(f"word{i % 7} id{i}99" if i % 3 else f"mail me: u{i}@h.org" for i in range(3_000))
    got = spans_of(spark, [text, "mail me: unseen-9911", ""])
    assert got[1] == "context:9:20"


def test_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r[0]: list(r[1:]) for r in pii.digests(pii.found_spans(docs)).collect()}
    assert got == brute({r.doc_id: r.text for r in docs.collect()})


def test_redacted_and_empty(spark):
    schema = "doc_id long, text string, kind string"
    docs = spark.createDataFrame([(None, "to a.b@c.de and 1.2.3.4!", "k"), (1, None, "k"), (2, "clean", "k"), (2, "clean", "k")], schema)
    assert sorted(map(tuple, pii.redacted(docs).collect()), key=str) == sorted([(None, "to <EMAIL> and <IP>!", "k"), (1, None, "k"), (2, "clean", "k"), (2, "clean", "k")], key=str)
    empty = spark.createDataFrame([], schema)
    assert pii.redacted(empty).count() == 0 and pii.found_spans(empty).count() == 0


def test_clashing_columns(spark):
    names = ["_0", "_1", "this", "_text", "_row", "_base", "_tokens", "_seeds", "_s", "_in", "_own", "_new", "context", "own", "doc", "spans", "base_spans", "s"]
    docs = spark.createDataFrame([(i, "to a.b@c.de and 1.2.3.4!", *(f"{c}{i}" for c in names)) for i in range(2)], ["doc_id", "text", *names])
    for out, lost in ((pii.found_spans(docs), {"spans", "base_spans"}), (pii.redacted(docs), set())):
        rows = out.collect()
        assert len(rows) == 2 and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names if c not in lost)
    assert [r.text for r in rows] == ["to <EMAIL> and <IP>!"] * 2


def test_every_pattern_is_scored(spark):
    """10,001 frequent contexts do not push out a sure one of three values."""
    rows = [(f"common c{i}", f"{v}{i:05d}99", False) for i in range(10_001) for v in (1, 2, 3, 4)]
    rows += [("mail me:", f"x{v}@host.org", True) for v in range(3)]
    docs = spark.createDataFrame([(" ".join(f"{c} {v}" for c, v, _ in rows),)], "text string")
    got = {r.context: r.confidence for r in pii.confident(docs, spark.createDataFrame(rows, "context string, value string, seed boolean")).collect()}
    assert len(got) == 10_002 and got["mail me:"] == 1.0


def test_hot_contexts_and_values_are_dealt(spark, monkeypatch):
    """One context and one value in all documents: the same spans wherever their rows are dealt to."""
    texts = [f"ref code AB{i:05d}x and phone call +1 555 010 {i:04d} or my id QQ777777 mail a{i}@b.example" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    read = lambda: sorted((r.doc_id, [tuple(s) for s in r.spans]) for r in pii.found_spans(docs).collect())
    plain = read()
    monkeypatch.setattr("gridweave.llm.shared.HOT_ROWS", 2)
    assert read() == plain


def test_many_spans_of_one_text_are_redacted_in_line(spark):
    text = " ".join(f"a{i}@b.example," for i in range(3_000))
    docs = spark.createDataFrame([(1, text), (2, "x"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.redacted(docs).collect()} == {1: " ".join(["<EMAIL>,"] * 3_000), 2: "x", 3: None}
