import random

import pytest

from chunkwise.llm import line_dedup as ld
from chunkwise.llm import queries
from chunkwise.llm.common import shared_path
from llm_rows import AWKWARD, frame

SF = "/root/testdata/sf0.01"


def plainly(rows, known=None, threshold=10, min_chars=1):
    """(id, lines, dropped, rest) of ``rows`` against the lines of ``known``."""
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    n = {}
    for _, t in rows if known is None else known:
        for k in {key(x) for x in (t or "").split("\n")}:
            n[k] = n.get(k, 0) + 1
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or n.get(key(x), 0) < threshold]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()), key=str)


def new(spark, **kw):
    return ld.LineIndex.create(spark, shared_path(spark, "test-lines"), **kw)


def some_rows(seed, n, first=0):
    rng = random.Random(seed)
    return [(first + k, "\n".join(rng.choice([f"line {rng.randrange(60)}", f"  LINE {rng.randrange(9)}\t", "", f"own {seed} {k}", "Ä", "ä", "日本"])
                                  for _ in range(rng.randrange(12)))) for k in range(n)]


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    index = new(spark).insert(docs)
    want = plainly(rows)
    assert got(index.clean(docs)) == want and sum(w[2] for w in want) > 0
    assert got(index.clean(docs, filter_bytes=0)) == want
    assert queries.op12_line_dedup(spark, SF).count() == len(rows)


@pytest.mark.parametrize("filter_bytes", [ld.FILTER_BYTES, 0])
def test_changes_are_reversible(spark, filter_bytes):
    a, b, c = some_rows(1, 60), some_rows(2, 80, 100), some_rows(3, 50, 300)
    df = {k: frame(spark, v) for k, v in {"a": a, "b": b, "c": c, "ab": a + b, "abc": a + b + c, "ac": a + c}.items()}
    one = new(spark, shards=3).insert(df["a"])
    two = one.insert(df["b"])
    three = two.insert(df["c"])
    back = three.delete(df["b"])
    clean = lambda index, docs, **kw: got(index.clean(docs, filter_bytes=filter_bytes, **kw))
    assert clean(one, df["a"]) == plainly(a)
    assert clean(two, df["ab"]) == plainly(a + b)
    assert clean(three, df["abc"]) == plainly(a + b + c)
    assert clean(back, df["ac"]) == plainly(a + c)
    # lines of documents that are not in the index
    assert clean(back, df["b"], inserted=False) == plainly(b, a + c)
    # an insert that is undone leaves the counts and the filters' keys as they were
    undone = back.delete(df["c"])
    counts = lambda x: {(r.hi, r.lo): r.n for r in x.counts().collect()}
    assert counts(undone) == counts(one)
    held = lambda x: {r.shard: r.held for r in x.filters().collect() if r.held}
    assert held(undone) == held(one)
    # versions: an earlier one, and the last one found by path
    assert clean(back.at(one.version), df["a"]) == plainly(a)
    assert ld.LineIndex.open(spark, back.path).version == undone.version
    gone = undone.delete(df["a"])
    assert counts(gone) == {} and not held(gone)
    assert clean(gone, df["a"]) == plainly(a, [])


def test_deleting_what_is_not_there(spark):
    index = new(spark).insert(frame(spark, some_rows(1, 5)))
    with pytest.raises(ValueError):
        index.delete(frame(spark, [(1, "never seen")]))


def test_filters_grow_and_parts_merge(spark, monkeypatch):
    monkeypatch.setattr(ld, "MAX_PARTS", 2)
    index, seen, sizes = new(spark, shards=2, threshold=2), [], []
    for step in range(4):
        rows = [(1000 * step + k, f"row {step} {k // 2}\nall") for k in range(40 * (step + 1))]
        seen += rows
        index = index.insert(frame(spark, rows))
        sizes.append(max(r.buckets for r in index.filters().collect()))
        assert got(index.clean(frame(spark, seen))) == plainly(seen, threshold=2)
    assert sizes[-1] > sizes[0] and len(index.parts) <= 2


def test_cuckoo_overflow_and_removal():
    rng = random.Random(5)
    f = ld.Cuckoo(4)
    keys = [rng.getrandbits(64) for _ in range(40)]  # 16 slots: the rest goes to the stash
    keys += [7, 7, 7 << 40, 0]
    for k in keys:
        f.add(k)
    import numpy as np

    look = lambda ks: ld.Filters(1, [(0, f.buckets, f.slots.tobytes(), f.stash)]).contains(np.zeros(len(ks), np.int64), np.array(ks, np.uint64).view(np.int64))
    assert f.stash and look(keys).all() and not look([rng.getrandbits(64) for _ in range(1000)]).any()
    rng.shuffle(keys)
    while keys:
        f.remove(keys.pop())
        assert not keys or look(keys).all()
    assert f.held == 0 and not f.slots.any() and not f.stash
    with pytest.raises(ValueError):
        f.remove(7)


def test_awkward(spark):
    rows = AWKWARD + [(50 + k, "Same Line\nİ line\nzeile") for k in range(12)] + [(None, "same line \n\x0bZEILE")] * 3 + [(70, "\n" * 30)]
    for kw in ({}, {"filter_bytes": 0}):
        index = new(spark).insert(frame(spark, rows))
        assert got(index.clean(frame(spark, rows), **kw)) == plainly(rows)
        index = new(spark, threshold=3, min_chars=6).insert(frame(spark, rows))
        assert got(index.clean(frame(spark, rows), **kw)) == plainly(rows, threshold=3, min_chars=6)
        empty = new(spark).insert(frame(spark, []))
        assert got(empty.clean(frame(spark, []), **kw)) == [] and got(empty.clean(frame(spark, rows), inserted=False, **kw)) == plainly(rows, [])
