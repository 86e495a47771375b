import hashlib
import random

import numpy as np
import pytest

from chunkwise.llm import near_dup, queries, suffix_dedup
from chunkwise.llm import components as components_module
from chunkwise.llm.components import components, merged
from chunkwise.llm.suffix_sort import COVER, PERIOD, window_classes
from llm_rows import AWKWARD, PROSE, frame

SF = "/root/testdata/sf0.01"


def removed(rows, length=50):
    """Brute force: (n_bytes, n_removed, n_spans, kept sha256) by row; ids in order, null last."""
    last = 1 << 63
    seen, out = {}, {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            seen[w] = min(seen.get(w, last + 1), last if i is None else i)
    for k, (i, t) in enumerate(rows):
        b = (t or "").encode()
        edge = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] < (last if i is None else i):
                edge[s] += 1
                edge[s + length] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out[k] = (str(i), len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted(out.values())


def result(df):
    return sorted((str(r["_rest"]["doc_id"]), r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("block", [1 << 30, 200_000])
def test_suffix_query(spark, block, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op5_suffix_dedup(spark, SF).collect())
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got == removed(rows) and sum(r[2] for r in got) > 0


def test_suffix_awkward(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 20_000)
    cut = [r for r in AWKWARD if r[0] not in (8, 9)]
    rows = cut + [(20, "A" * 300), (21, "B" + "A" * 120 + "C"), (22, "x" + PROSE[10:90] + "\0" * 60), (23, "\0" * 60), (None, PROSE),
                  (-5, "日本語" * 40), (24, "本語" + "日本語" * 30)]
    assert result(suffix_dedup.dedup(frame(spark, rows))) == removed(rows)
    texts = {(r["doc_id"], r["text"]) for r in suffix_dedup.dedup_texts(frame(spark, rows)).collect()}
    assert (5, PROSE) not in texts and (4, PROSE) in texts and (1, "") in texts and (None, "no id here") in texts
    assert suffix_dedup.dedup_texts(frame(spark, rows)).columns == frame(spark, rows).columns
    assert suffix_dedup.dedup(frame(spark, [])).count() == 0
    long = [(8, "word " * 30000), (9, "Z" * 100_000), (10, "word " * 20)]
    got = result(suffix_dedup.dedup(frame(spark, long)))
    assert [g[:4] for g in got] == [("10", 100, 100, 1), ("8", 150000, 0, 0), ("9", 100000, 0, 0)]


def test_suffix_many_parts_and_one_id(spark, monkeypatch):
    """More key partitions than shuffle partitions, a passage in every block, and one id (or none) for all rows."""
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 2_000)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 2_000)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(30)) + PROSE[:120] + " ".join(rng.choice(words) for _ in range(30)) + str(k)
    rows = [(k, text(k)) for k in range(300)]
    assert result(suffix_dedup.dedup(frame(spark, rows))) == removed(rows)
    for one in (7, None):
        same = [(one, t) for _, t in rows]
        assert result(suffix_dedup.dedup(frame(spark, same))) == removed(same)
        most = same[:200] + [(i if one is None else i - 500, t) for i, t in rows[200:]]
        assert result(suffix_dedup.dedup(frame(spark, most))) == removed(most)


def test_suffix_random(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 1500)
    rng = random.Random(3)
    parts = ["".join(rng.choice("abc ") for _ in range(rng.randint(20, 120))) for _ in range(12)]
    rows = [(rng.randint(0, 40), "".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))) for _ in range(60)]
    assert result(suffix_dedup.dedup(frame(spark, rows))) == removed(rows)


def test_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))
    rng = np.random.default_rng(0)
    for _ in range(10):
        buf = rng.integers(97, 97 + rng.integers(1, 4), 1500).astype(np.uint8)
        starts = np.sort(rng.choice(1450, 400, replace=False))
        got = window_classes(buf, starts, 50)
        b = buf.tobytes()
        want = [b[s:s + 50] for s in starts]
        assert len(set(zip(got.tolist(), want))) == len(set(want)) == len(set(got.tolist()))


def classes(rows):
    """Brute force over all pairs: Jaccard of distinct five-word shingles."""
    sets = []
    for i, t in rows:
        w = (t or "").lower().encode().split()
        sets.append((i, tuple(w), {tuple(w[k:k + 5]) for k in range(len(w) - 4)}))
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    where = {}
    for k, (_, w, s) in enumerate(sets):
        near = {}
        for g in s:
            for j in where.get(g, ()):
                near[j] = near.get(j, 0) + 1
            where.setdefault(g, []).append(k)
        near.update({j: 1e9 for j in where.get(w, ())})
        where.setdefault(w, []).append(k)
        for j, c in near.items():
            if c >= 0.8 * (len(s) + len(sets[j][2]) - c):
                top[find(k)] = find(j)
    low = {}
    for k, (i, *_) in enumerate(sets):
        low[find(k)] = min(low.get(find(k), 1 << 62), -1 if i is None else i)
    return sorted((str(i), low[find(k)]) for k, (i, *_) in enumerate(sets))


def test_near_query(spark):
    got = sorted((str(r.doc_id), r.class_id) for r in queries.op7_minhash_near_dedup(spark, SF).collect())
    assert got == classes([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])


def test_near_group(spark):
    """A large group around one text whose members differ from one another, and a chain."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(200)]
    rows = [(1000, " ".join(base))]
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(200)] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    for i in range(300):  # a larger group, with copies of copies
        w = rng.choice(rows)[1].split()
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(200)] = rng.choice(vocabulary)
        rows.append((5000 + i, " ".join(w)))
    step = [rng.choice(vocabulary) for _ in range(100)]
    for i in range(8):
        rows.append((2000 + i, " ".join(step[4 * i:] + [rng.choice(vocabulary) for _ in range(4 * i)])))
    rows += [(3000 + i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(50)]
    got = sorted((str(r.doc_id), r.class_id) for r in near_dup.near_duplicates(frame(spark, rows)).collect())
    assert got == classes(rows)


def test_near_awkward(spark):
    rows = [r for r in AWKWARD if r[0] is not None]
    got = sorted((str(r.doc_id), r.class_id) for r in near_dup.near_duplicates(frame(spark, rows)).collect())
    assert got == classes(rows)
    kept = near_dup.keep_one(frame(spark, AWKWARD))
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {None, 1, 4, 7, 8, 9, 10} and kept.columns == frame(spark, []).columns
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0 and near_dup.keep_one(frame(spark, [])).count() == 0


def test_order_matters():
    words = [f"w{k}" for k in range(100)]
    a = near_dup.first_seen(near_dup.shingles(" ".join(words)))
    b = near_dup.first_seen(near_dup.shingles(" ".join(words[50:] + words[:50])))
    assert near_dup.alignment(a, a) == 1.0 and near_dup.alignment(a, b) == 0.0
    s = near_dup.shingles("a b c d e f " * 3)
    assert len(set(near_dup.labelled(s).tolist())) == len(s)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200 + k) for k in range(30)] + [(5, 5)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(41)}, 100: 100, **{200 + k: 100 for k in range(30)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_merged(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (20, 21)], "a long, b long")
    links = spark.createDataFrame([(3, 11), (2, 10), (1, 3), (30, 21), (40, 41)], "a long, b long")
    got = dict(merged(components(edges), links).collect())
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 20: 20, 21: 20, 30: 20, 40: 40, 41: 40}
    assert dict(merged(components(edges), edges).collect()) == dict(components(edges).collect())


def test_edges_of_a_large_group(spark, monkeypatch):
    """5000 near copies of one text: one class, and edges stay near the number of texts."""
    rng = random.Random(17)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 5000):
        w = list(base)
        for _ in range(rng.randint(1, 2)):
            w[rng.randrange(150)] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    seen = []

    def counted(edges):
        seen.append(edges.count())
        return components(edges)

    monkeypatch.setattr(near_dup, "components", counted)
    monkeypatch.setattr(components_module, "components", counted)
    got = {r.class_id for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {0} and sum(seen) <= 3 * len(rows)


def labels_of(texts):
    """Brute force over all pairs, by matrix: smallest position of each text's class."""
    sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    code = {g: k for k, g in enumerate(sorted(set().union(*sets)))}
    x = np.zeros((len(texts), len(code)), np.float32)
    for k, s in enumerate(sets):
        x[k, [code[g] for g in s]] = 1
    shared, n = x @ x.T, x.sum(axis=1)
    near = shared >= 0.8 * (n[:, None] + n[None, :] - shared) - 1e-3
    label = np.arange(len(texts))
    while True:
        low = np.where(near, label[None, :], len(texts)).min(axis=1)
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label.tolist()
        label = low


def test_near_blocks(spark):
    """Thousands of template texts of shared blocks with variants: every class in full."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(5000)]
    variants = [[" ".join(rng.choice(vocabulary) for _ in range(16)) for _ in range(4)] for _ in range(12)]
    texts = sorted({" ".join(rng.choice(v) if rng.random() < 0.55 else v[0] for v in variants) for _ in range(3000)})
    rng.shuffle(texts)
    want = labels_of(texts)
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(frame(spark, list(enumerate(texts)))).collect()}
    assert 100 < len(set(want)) < len(texts) - 100
    assert [got[k] for k in range(len(texts))] == want


def test_near_settled_in_blocks(monkeypatch):
    """Blocks of two sides and of one give the same classes as all pairs."""
    rng = random.Random(5)
    found = []
    base = rng.sample(range(1 << 40), 60)
    for _ in range(80):
        found.append(np.array([x if rng.random() < 0.9 else rng.randrange(1 << 40) for x in base], np.uint64))
    ids, side = np.arange(80), np.zeros(80, np.int32)
    pairs = [(a, b) for a in range(80) for b in range(a) if near_dup.alignment(found[a], found[b]) > 0]
    def merged(edges):
        top = list(range(80))
        for a, b in edges:
            x, y = top[a], top[b]
            top = [x if t == y else t for t in top]
        return {frozenset(k for k in range(80) if top[k] == t) for t in top}
    assert merged(near_dup.links_across(side, ids, ids, found)) == merged(pairs)
    side[40:] = 1
    assert merged(near_dup.links_across(side, ids, ids, found)) == merged([(a, b) for a, b in pairs if a >= 40 > b])


def test_near_short_and_repeated(spark):
    """Texts of a few words with one more, and a text with the same text written twice."""
    rng = random.Random(13)
    rows = []
    for k in range(150):
        w = [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(rng.choice((8, 9, 10, 14, 30, 36, 40, 45, 60)))]
        twin = w + w if k % 3 == 0 and len(w) > 20 else w + ["more"] if k % 2 else ["more"] + w
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(twin))]
    got = sorted((str(r.doc_id), r.class_id) for r in near_dup.near_duplicates(frame(spark, rows)).collect())
    assert got == classes(rows) and len({c for _, c in got}) == 150


def test_short_keys_are_exact():
    rng = random.Random(17)
    for _ in range(3000):
        a = rng.sample(range(1 << 50), rng.randint(4, 32))
        b = list(a)
        for _ in range(rng.randint(1, 5)):
            if rng.random() < 0.5:
                b.insert(rng.randint(0, len(b)), rng.randrange(1 << 50))
            elif len(b) > 1:
                b.pop(rng.randrange(len(b)))
        a, b = np.array(a, np.uint64), np.array(b, np.uint64)
        if near_dup.alignment(a, b):
            assert np.intersect1d(near_dup.keys_of(a), near_dup.keys_of(b)).size


def test_keep_one_of_equal_ids(spark):
    """Rows with null or equal ids and unrelated texts stay; of equal texts one does."""
    other = " ".join(f"v{k}" for k in range(60))
    rows = [(None, PROSE), (None, other), (None, "a b c"), (7, "x y z"), (7, "p q r s t u"), (7, "x  Y z"), (8, other + " end"), (9, "p q r s t u")]
    kept = sorted((str(r["doc_id"]), r["text"].lower().split()) for r in near_dup.keep_one(frame(spark, rows)).collect())
    assert kept == sorted((str(i), t.split()) for i, t in [(None, PROSE.lower()), (None, other), (None, "a b c"), (7, "x y z"), (7, "p q r s t u")])
