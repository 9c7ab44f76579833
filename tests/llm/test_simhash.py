import random
import re

import numpy as np
import pytest
import xxhash

from gridweave.llm import simhash as S


def brute_fp(text, k=4):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    sh = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    ids = sorted(fps)
    a, label = np.array([fps[i] for i in ids], np.uint64), {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(a[k + 1 :] ^ a[k]) <= 4):
            x, y = find(i), find(ids[k + 1 + j])
            label[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(900_001, None, "", "", 0), (900_002, " \n", "", "", 0), (900_003, "One TWO", "", "", 0), (900_004, "one two", "", "", 0), (900_005, "é Éa \x85b c\xa0d e", "", "", 0)], docs.schema)
    docs = docs.unionByName(odd)
    fps = {r.doc_id: brute_fp(r.text) for r in docs.collect()}
    want = brute_components(fps)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in S.near_duplicates(docs).collect()}
    assert got == {i: (fps[i], want[i]) for i in fps}


def test_groups_and_cut_shards(spark, monkeypatch):
    """Chains and dense clusters, with shards cut again as soon as they have some members."""
    r = random.Random(2)
    flip = lambda x, n: x ^ sum(1 << b for b in r.sample(range(64), n))
    fps = [r.getrandbits(64) for _ in range(150)] + [0, (1 << 64) - 1]
    seed = r.getrandbits(64)
    for _ in range(200):  # a dense cluster
        fps.append(flip(seed, r.randint(1, 6)))
    chain = r.getrandbits(64)
    for _ in range(40):
        chain = flip(chain, 4)
        fps.append(chain)
    fps = list(dict.fromkeys(fps))
    want = brute_components(dict(enumerate(fps)))
    rows = [(i, S.signed(f)) for i, f in enumerate(fps)]
    monkeypatch.setattr(S, "SHARD_MOST", 60)
    monkeypatch.setattr(S, "SLAB_ROWS", 64)
    nodes = spark.createDataFrame([(f,) for _, f in rows], "fp long").cache()
    root = {n.node: n.root for n in S.components(S.links(nodes, 4)).collect()}
    groups = {}
    for i, f in rows:
        groups.setdefault(root.get(f, f), []).append(i)
    assert {i: min(v) for v in groups.values() for i in v} == want
    assert len(set(want.values())) < 200


def test_masks_cover_all_pairs():
    r = random.Random(7)
    for n in (1_000, 10**8, 10**11, 10**14):
        masks = S.first_masks(n, 4)
        for _ in range(300):
            d = sum(1 << b for b in r.sample(range(64), 4))
            assert any(not d & m for m in masks)


def test_representatives_and_edges(spark):
    schema = "doc_id long, text string, lang string"
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(3, text, "a"), (2, text, "b"), (2, text, "b"), (9, None, "c"), (8, "", "c"), (5, "quite another text here", "d")], schema)
    assert sorted(r.doc_id for r in S.representatives(docs).collect()) == [2, 5, 8]
    assert S.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert S.simhash(b"a " * 100_000, 4) & (1 << 64) - 1 == brute_fp("a a a a")


def test_near_copies_by_similarity(spark):
    """Pairs of 5-word Jaccard similarity of 0.8 and more are linked, those below are not."""
    r = random.Random(3)
    prose = lambda n: [f"w{r.getrandbits(40)}" for _ in range(n)]
    rows, copies = [], set()
    for i in range(60):
        words = prose(300)
        rows.append((2 * i, " ".join(words)))
        edits = (1, 3, 6, 16)[i % 4]  # 5 shingles of 296 each: similarity 0.97, 0.90, 0.82, 0.57
        for k in range(edits):
            words[10 + 18 * k] = "changed"
        rows.append((2 * i + 1, " ".join(words)))
        copies |= {2 * i + 1} if edits < 16 else set()
    rows += [(7_000, rows[0][1]), (None, rows[0][1]), (None, "another text"), (None, "one more text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(x) for x in S.representatives(docs).collect()]
    want = [x for x in rows[:120] if x[0] not in copies] + rows[-2:]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_one_row_a_component(spark):
    """Rows that share a doc_id but not their text stay apart, rows of a component do not stay twice."""
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (1, "quite another text"), (None, "a b"), (None, "c d"), (2, text)], "doc_id long, text string")
    got = sorted((tuple(x) for x in S.representatives(docs).collect()), key=str)
    assert got == sorted([(1, text), (1, "quite another text"), (None, "a b"), (None, "c d")], key=str)


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_block_links():
    """What links within a block, or between two, join is what all their pairs join."""
    r = random.Random(6)
    for sides in (1, 2):
        base = r.sample(range(10**9), 60)
        sets = [sorted({*r.sample(base, r.randrange(50, 61)), *(r.getrandbits(40) for _ in range(r.randrange(5)))}) for _ in range(40)] + [[], [7]]
        side = [k % sides for k in range(len(sets))]
        label = list(range(len(sets)))
        find = lambda i: i if label[i] == i else find(label[i])  # noqa: B023,E731
        for i, x in enumerate(sets):
            for j in range(i):
                if (sides == 1 or side[i] != side[j]) and len({*x} & {*sets[j]}) >= 0.8 * len({*x} | {*sets[j]}):
                    a, b = find(i), find(j)
                    label[max(a, b)] = min(a, b)
        want = {(i + 100, find(i) + 100) for i in range(len(sets)) if find(i) != i}
        rows = S.pa.table({"node": [i + 100 for i in range(len(sets))], "side": S.pa.array(side, S.pa.int32()), "set": S.pa.array(sets, S.pa.list_(S.pa.int64()))})
        got = S.block_links(rows, 80)
        assert {*zip(got["u"].to_pylist(), got["v"].to_pylist(), strict=True)} == want and 5 < len(want) < 40


@pytest.mark.parametrize("blocks", [(8, 64), (5, 4)])
def test_large_buckets_are_tested_in_blocks(spark, monkeypatch, blocks):
    """All nodes in one bucket: the components are those of all pairs, chains and near misses included."""
    r = random.Random(4)
    texts = []
    for g in range(6):
        words = [f"w{r.getrandbits(40)}" for _ in range(120)]
        for k in range(14):
            for _ in range(g):  # a walk: the further apart, the less alike
                words[r.randrange(120)] = f"x{r.getrandbits(40)}"
            texts.append(" ".join(words))
    texts = list(dict.fromkeys(texts))
    label = list(range(len(texts)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    monkeypatch.setattr(S, "ALL_PAIRS", 2)
    monkeypatch.setattr(S, "LEAST_BLOCKS", blocks[0])
    monkeypatch.setattr(S, "BLOCK_LEAST", blocks[1])
    monkeypatch.setattr(S, "COLUMNS", 50)
    monkeypatch.setattr("gridweave.llm.shared.HOT_ROWS", 20)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = docs.select(S.F.col("doc_id").alias("node"), "doc_id", S.F.xxhash64("text").alias("own"), S.F.array(S.F.lit(1).cast("long")).alias("bands"))
    roots = {x.node: x.root for x in S.components(S.similar_links(nodes, docs, 5, 80)).collect()}
    assert [roots.get(i, i) for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    assert 8 < len({find(i) for i in range(len(texts))}) < 60


def test_clashing_columns_long_and_empty(spark):
    names = ["_0", "_1", "this", "_in", "_own", "own", "doc", "node", "best", "bands", "words", "_doc", "fp", "root"]
    long = " ".join(f"word{i}" for i in range(50_000))
    docs = spark.createDataFrame([(i, t, *(f"{c}{i}" for c in names)) for i, t in enumerate([long, long + " end", "short one"])], ["doc_id", "text", *names])
    got = {x.doc_id: x for x in S.representatives(docs).collect()}
    assert sorted(got) == [0, 2] and all(got[i][c] == f"{c}{i}" for i in got for c in names)
    assert S.representatives(docs.limit(0)).count() == 0
    assert len({x.component_id for x in S.near_duplicates(docs).collect()}) == 2


def test_texts_around_a_common_passage_are_not_tested_in_pairs(spark, monkeypatch):
    """300 texts that share 400 words and have 60 of their own are alike to 0.76: none is linked, and hardly a pair is
    tested; of those among them with fewer words of their own every group is found."""
    tested = []
    real = S.with_shared
    monkeypatch.setattr(S, "with_shared", lambda pairs, sets: tested.append(pairs.count()) or real(pairs, sets))
    common = " ".join(f"c{i}" for i in range(400))
    own = lambda k, n: " ".join(f"o{k}x{i}" for i in range(n))
    texts = [f"{own(k, 30)} {common} {own(k + 1000, 30)}" for k in range(300)]
    docs = lambda rows: spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    assert S.representatives(docs(texts)).count() == 300
    assert sum(tested) <= 300 * 9  # n log n
    tested.clear()
    near = [f"{own(5000 + k, 20)} {common} {own(6000 + k, 20)}" for k in range(60)]
    assert S.representatives(docs(texts + near)).count() == 301
    # the 60 are alike each other to 0.83, and to the rest to 0.798
    assert sum(tested) <= 360 * 60


def test_candidates_come_from_simhashes(spark, monkeypatch):
    """Candidates are what trees of SimHashes link: all pairs within the radius that a table deals together, in large
    shards too; at a similarity of 0.8 a pair in 2,500 is missed by the tables."""
    r = random.Random(8)
    hashes, alike = [], []
    for k in range(400):
        shared = [r.getrandbits(64) for _ in range(160)]
        for extra in (20, 20):
            hashes.append(S.np.array(shared + [r.getrandbits(64) for _ in range(extra)], S.np.uint64))
        alike.append((2 * k, 2 * k + 1))
    group = [r.getrandbits(64) for _ in range(300)]
    hashes += [S.np.array(group[: 300 - k % 7], S.np.uint64) for k in range(100)]
    prints = [S.wide_simhash(h).tolist() for h in hashes]
    nodes = spark.createDataFrame(list(enumerate(prints)), "node long, prints array<long>").repartition(4).cache()
    near = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(prints[a][: S.COMPARED], prints[b][: S.COMPARED], strict=True)) <= S.WIDE_RADIUS
    by = S.tables(len(hashes))
    met = lambda a, b: any((prints[a][w] ^ prints[b][w]) & mask == 0 for w, mask in by)
    label = list(range(len(hashes)))
    find = lambda i: i if label[i] == i else find(label[i])
    for a in range(len(hashes)):
        for b in range(a):
            if met(a, b) and near(a, b):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    found = {x.node: x.root for x in S.components(S.print_links(nodes)).collect()}
    assert [found.get(i, i) for i in range(len(hashes))] == [find(i) for i in range(len(hashes))]
    assert sum(find(a) == find(b) for a, b in alike) >= 398 and len({find(i) for i in range(len(hashes))}) >= 380
    monkeypatch.setattr(S, "SAMPLE", 1)
    monkeypatch.setattr(S, "SHARD_MOST", 20)
    monkeypatch.setattr(S, "VISITS", 50)
    monkeypatch.setattr("gridweave.llm.shared.HOT_ROWS", 20)
    assert {x.node: x.root for x in S.components(S.print_links(nodes)).collect()} == found


def test_prints_are_of_different_shingles(spark):
    """A shingle counts once, as in the similarity: repeating a passage of one text moves no bit but those of its seams."""
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:30] * 9 + words))], "doc_id long, text string")
    one, two = (S.np.array(r.prints, S.np.int64) for r in S.with_prints(docs, 5).orderBy("doc_id").collect())
    assert S.np.bitwise_count((one ^ two).view(S.np.uint64)).sum() < 64 * S.WIDE * S.BIT_DIFFERS


def test_components_take_few_tasks(spark, monkeypatch):
    """Stars, a chain, and hubs of the smallest and the largest id, found by many tasks: their components, in so few tasks
    that rounds leave little on disk (files and logs of 211 tasks a stage made 0.7 GB of an input of 0.1 GB)."""
    r = random.Random(9)
    ids = r.sample(range(10**12), 4_000)
    edges = [(ids[k], ids[k - k % 4]) for k in range(1_200)]  # stars
    edges += [(ids[k], ids[k + 1]) for k in range(1_200, 1_500)]
    edges += [(ids[k], -1) for k in range(2_000, 3_000)] + [(ids[k], 10**13) for k in range(3_000, 4_000)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    edges *= 3
    r.shuffle(edges)
    monkeypatch.setattr("gridweave.llm.shared.HOT_ROWS", 200)
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    tracker = spark.sparkContext.statusTracker()
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        d = spark.createDataFrame([(max(e), min(e)) for e in edges], "u long, v long").repartition(16).cache()
        d.count()
        for slab in (1_000_000, 50):
            monkeypatch.setattr(S, "SLAB_EDGES", slab, raising=False)
            spark.sparkContext.setJobGroup(f"components {slab}", "")
            got = S.components(d).collect()
            assert len(got) == len({x.node for x in got})
            assert {x.node: x.root for x in got} == {x: find(x) for x in root if find(x) != x}
            stages = {s for j in tracker.getJobIdsForGroup(f"components {slab}") for s in tracker.getJobInfo(j).stageIds}
            tasks = sum(s.numCompletedTasks for s in map(tracker.getStageInfo, stages) if s)
            assert tasks <= 16 * 80  # the form before: 2,121
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
