import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkwise.llm import prefix_trie as pt
from chunkwise.llm import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, a long, depth long, node string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


def plainly(rows):
    """All columns by lists and one dictionary of prefixes."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, sha(sha(role or "") + sha(text or "")), role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    ids, members, parent, weight, end = {(None, None): 0}, [[]], [None], [0], {}
    for c, seq in sorted(built.items()):
        at = 0
        members[0].append(c)
        for t in seq:
            if (at, t) not in ids:
                ids[at, t] = len(members)
                members.append([])
                parent.append(at)
                weight.append(len(t[1].encode()))
            at = ids[at, t]
            members[at].append(c)
        end[c] = at
    depth, kids, n = [0] * len(members), [0] * len(members), len(members)
    for v in range(1, n):
        depth[v] = depth[parent[v]] + 1
        kids[parent[v]] += 1
    leaves, saved = [int(k == 0) for k in kids], [(len(m) - 1) * w for m, w in zip(members, weight)]
    for v in range(n - 1, 0, -1):  # children have higher numbers
        leaves[parent[v]] += leaves[v]
        saved[parent[v]] += saved[v]
    ends = defaultdict(list)
    for c, v in sorted(end.items()):
        ends[v].append(str(c))
    if not built:
        return []
    return sorted(((members[v][0], depth[v], None if not v else members[parent[v]][0], len(members[v]), kids[v], leaves[v], saved[v],
                    hashlib.sha256(",".join(ends[v]).encode()).hexdigest()) for v in range(n)), key=str)


def got(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=str)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op13_prefix_trie(spark, SF)) == plainly(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_tables(spark, seed, monkeypatch):
    """Few distinct turns, so prefixes are shared; long conversations, so chains are; nulls, ties and gaps."""
    monkeypatch.setattr(pt, "BLOCK", 4)
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(150), 90):
        for t in range(rng.choice([1, 2, 3, 9, 10, 14, 40])):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["u", "u", None, ""]), rng.choice(["a", "a", "a", "bß", None])))
    rows += rows[:20] + [(None, 1, "u", "no conversation"), (10 ** 15 + 2, 0, "u\na", "b"), (10 ** 15 + 1, 0, "u", "a\nb")]
    assert got(pt.trie(frame(spark, rows))) == plainly(rows)


def test_hot_tables(spark):
    """A conversation of thousands of turns with a copy, and thousands of equal short ones and of only children of the root."""
    rows = [(c, t, "u", f"t{t}") for c in (0, 3) for t in range(3000)]
    rows += [(c, t, "u", f"same {t}") for c in range(5, 1505) for t in range(3)]
    rows += [(c, t, "u", f"{c} {t}") for c in range(2000, 3000) for t in range(2)]
    assert got(pt.trie(frame(spark, rows))) == plainly(rows)


def test_many_children_beyond_the_block(spark, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK", 16)
    rows = [(c, t, "u", "first" if t == 0 else f"{c}") for c in range(0, 600) for t in range(2)]
    assert got(pt.trie(frame(spark, rows))) == plainly(rows)


def test_empty(spark):
    assert got(pt.trie(frame(spark, []))) == []
    assert got(pt.trie(frame(spark, [(None, 1, "u", "x")]))) == []
    # conversation 2 has turn 1 only, takes 0 to 8 first turns of an absent one and may lose its own
    for c in range(1, 12):
        assert got(pt.trie(frame(spark, [(c, None, None, None)]))) == plainly([(c, None, None, None)])
        if c > 2:
            break


def test_running_sums(spark):
    rng = random.Random(9)
    rows = [(rng.choice([1, 1, 1, 2, 5]), k, rng.randrange(1 << 62)) for k in range(5000)]
    df = spark.createDataFrame(rows, "g long, k long, v long").repartition(13)
    done = pt.running(df, "g", ["k"], lambda b: [b.column("v").to_numpy().view(np.uint64), np.ones(b.num_rows, np.uint64)], ["s", "n"])
    sums, want = defaultdict(lambda: [0, 0]), {}
    for g, k, v in sorted(rows):
        before = list(sums[g])
        sums[g] = [(before[0] + v) % (1 << 64), before[1] + 1]
        want[k] = (*sums[g], *before)
    assert {r.k: (r.s % (1 << 64), r.n, r.s_before % (1 << 64), r.n_before) for r in done.collect()} == want
    assert done.where(F.col("n") < 1).count() == 0
