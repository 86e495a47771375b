"""Semantic chunker: golden cases (FIXTURES 4), batch carry-over, Spark wiring."""

import numpy as np
import pytest

from chunkwise.operators.semantic import (SemanticOptions, assemble, optimal_threshold, segment_document,
                                          similarity_scores, split_indices)

GOLDEN = {
    "A": ([120, 120, 120, 120], [.9, .2, .9], 0.747927, 1, [2], [[0, 1], [2, 3]], [[0, 1], [2, 3]]),
    "B": ([60, 480, 300], [.8, .8], 0.8, 1, [], [[1], [2]], [[0], [1], [2]]),
    "C": ([40, 40, 120, 120], [.1, .9, .2], 0.317945, 1, [1, 3], [[0, 1, 2], [3]], [[0, 1, 2], [3]]),
    "D": ([200, 700, 150], [.5, .4], 0.510533, 3, [1, 2], [[0], [1], [2]], [[0], [1], [2]]),
    "E": ([20] * 8, [.9, .3, .8, .2, .7, .4, .6], 0.343431, 5, [2, 4], [list(range(8))], [list(range(8))]),
    "F": ([300, 150], [.4], 0.4, 1, [], [[0, 1]], [[0, 1]]),
}


@pytest.mark.parametrize("case", sorted(GOLDEN))
def test_golden(case):
    tc, sc, thr, rounds, idx, drop, keep = GOLDEN[case]
    t, r = optimal_threshold(np.array(tc), np.array(sc), SemanticOptions())
    assert abs(t - thr) < 1e-6 and r == rounds
    si = [int(x) for x in split_indices(np.array(sc), t)]
    assert si == idx
    assert assemble(tc, si, SemanticOptions(short_buffer="drop")) == drop
    assert assemble(tc, si, SemanticOptions(short_buffer="keep")) == keep


def ref_chunk(texts, vec_of, count_of, o):
    """Plain-Python statement of the reference's batch loop, on texts."""
    out, last = [], ""
    for s in range(0, len(texts), o.batch_size):
        batch = texts[s:s + o.batch_size]
        if last:
            batch = [last] + batch
        vecs = np.array([vec_of(t) for t in batch])
        n = len(vecs)
        sims = []
        for i in range(1, n):
            ctx = vecs[max(0, i - o.window):i].mean(axis=0)
            sims.append(float(vecs[i] @ ctx / (np.linalg.norm(vecs[i]) * np.linalg.norm(ctx))))
        sims = np.round(np.array(sims), 9)
        counts = np.array([count_of(t) for t in batch])
        thr, _ = optimal_threshold(counts, sims, o)
        idx = set(int(i) + 1 for i in np.nonzero(sims < thr)[0])
        chunks, cur, c = [], [], 0
        for d, t in enumerate(counts):
            if (d + 1) in idx and o.min_tokens <= c + t <= o.max_tokens:
                cur.append(batch[d]); chunks.append("\n".join(cur)); cur, c = [], 0
                continue
            if c + t > o.max_tokens:
                if cur and (c >= o.min_tokens or o.short_buffer == "keep"):
                    chunks.append("\n".join(cur))
                cur, c = [], 0
            cur.append(batch[d]); c += t
        if cur:
            chunks.append("\n".join(cur))
        if len(chunks) > 1:
            out.extend(chunks[:-1]); last = chunks[-1]
        else:
            last = chunks[0]
    if last:
        out.append(last)
    return out


def test_carry_over_matches_reference_loop():
    """C8 with small batches (the carry-over is never reached on driver data)."""
    rng = np.random.default_rng(7)
    vocab = [f"w{i}" for i in range(30)]
    for trial in range(40):
        n = int(rng.integers(1, 23))
        texts = [" ".join(rng.choice(vocab, size=int(rng.integers(5, 160)))) for _ in range(n)]

        def counts(t):
            return np.bincount([int(w[1:]) for w in t.split()], minlength=30).astype(float)

        def vec_of(t):
            v = counts(t)
            return v / np.linalg.norm(v)

        def count_of(t):
            return len(t.split()) + 2

        for mode in ("keep", "drop"):
            o = SemanticOptions(batch_size=4, min_tokens=60, max_tokens=200, short_buffer=mode)
            raw = np.array([counts(t) for t in texts])
            groups = segment_document([count_of(t) for t in texts], raw, o, raw=True)
            got = ["\n".join(texts[i] for i in g) for g in groups]
            assert got == ref_chunk(texts, vec_of, count_of, o), (trial, mode)


def test_keep_loses_no_piece():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 30))
        tc = rng.integers(10, 600, size=n)
        v = rng.normal(size=(n, 8))
        groups = segment_document(tc, v, SemanticOptions(batch_size=5), raw=True)
        assert [p for g in groups for p in g] == list(range(n))


def test_scores_first_row_none():
    v = np.eye(3)
    s = similarity_scores(v, 5)
    assert len(s) == 2 and np.allclose(s, 0)


def test_spark_semantic_matches_numpy(spark):
    from pyspark.sql import functions as F

    from chunkwise.functions.text import normalize_text
    from chunkwise.operators.embed import HashingEmbedder
    from chunkwise.operators.semantic import with_semantic_chunks
    from chunkwise.operators.split import with_token_chunks

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "doc_id", normalize_text(F.col("text")).alias("t"))
    o = SemanticOptions(piece_size=120, batch_size=3)
    e = HashingEmbedder()
    got = with_semantic_chunks(docs, "t", "chunks", e, o, groups_col="groups").select("doc_id", "groups")
    pieces = with_token_chunks(docs, "t", "p", size=120).select(
        "doc_id", "p", e.embed_many_raw(F.col("p")).alias("raw"))
    from chunkwise.functions.text import token_count
    pieces = pieces.withColumn("tc", F.transform("p", lambda x: token_count(x)))
    ref = {r["doc_id"]: segment_document(list(r["tc"]), np.array([list(v) for v in r["raw"]]) if r["raw"] else
                                         np.zeros((0, 384)), o) for r in pieces.collect()}
    for r in got.collect():
        assert [list(g) for g in r["groups"]] == ref[r["doc_id"]]


def test_row_form_and_chunker_agree_on_vectors_of_any_length(spark):
    import numpy as np

    from chunkwise.operators import semantic as SE

    rng = np.random.default_rng(3)
    v = rng.normal(size=(30, 6)) * rng.uniform(0.1, 50, size=(30, 1))
    df = spark.createDataFrame([(1, i, [float(x) for x in row]) for i, row in enumerate(v)], "g int, pos int, vec array<double>")
    got = [r["score"] for r in SE.context_similarity(df, "g", "pos", "vec").orderBy("pos").collect()][1:]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert np.allclose(got, SE.similarity_scores(unit, 5), atol=2e-9)


def test_bisection_fold_equals_the_plain_statement(spark):
    """The JVM-side fold against the NumPy statement, for random batches and options."""
    import random

    import numpy as np

    from chunkwise.operators import semantic as SE

    rng = random.Random(12)
    for o in (SE.SemanticOptions(), SE.SemanticOptions(min_tokens=30, max_tokens=60, tolerance=0, adjustment=0.003)):
        rows, want = [], {}
        for g in range(150):
            n = rng.choice([1, 2, 3, 5, 20, 64])
            t = [rng.randrange(1, rng.choice([20, 300])) for _ in range(n)]
            s = [None] + [round(rng.choice([rng.random(), 0.5, 0.9]), 9) for _ in range(n - 1)]
            rows += [(g, k, t[k], s[k]) for k in range(n)]
            want[g] = SE.optimal_threshold(np.array(t), np.array(s[1:], float), o)
        df = spark.createDataFrame(rows, "g int, k int, t int, s double").repartition(4)
        got = {r.g: (r.threshold, r.rounds) for r in SE.thresholds(df, "g", "k", "t", "s", o).collect()}
        assert got == want
        assert "Python" not in SE.thresholds(df, "g", "k", "t", "s", o)._jdf.queryExecution().executedPlan().toString()


def test_rounds_over_rows_equal_the_chunker(spark):
    """C8 with carry-over: the row form in rounds against the chunker that holds a document's pieces in one row."""
    import random

    from pyspark.sql import functions as F

    from chunkwise.operators import semantic as SE
    from chunkwise.operators.embed import ArrowEmbedder, HashingEmbedder
    from chunkwise.operators.semantic_rounds import chunk_pieces
    from chunkwise.operators.split import split_tokens

    rng = random.Random(21)
    topics = [[f"{t}{k}" for k in range(12)] for t in "abcdef"]
    docs = []
    for d in range(30):
        topic, words = rng.choice(topics), []
        for _ in range(rng.choice([0, 5, 60, 150, 260])):
            topic = rng.choice(topics) if rng.random() < 0.02 else topic
            words.append(rng.choice(topic) + rng.choice(["", "", "", ".", ". "]))
        docs.append((d, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for keep in ("keep", "drop"):
        o = SE.SemanticOptions(piece_size=17, min_tokens=25, max_tokens=80, batch_size=4, short_buffer=keep)
        emb = HashingEmbedder(48)
        whole = SE.with_semantic_chunks(df, "text", "chunks", emb, o, groups_col="g")
        want = sorted((r.doc_id, k, c, len(g)) for r in whole.collect() for k, (c, g) in enumerate(zip(r.chunks, r.g)))
        pieces = split_tokens(df, size=o.piece_size)
        got = sorted(map(tuple, chunk_pieces(pieces, emb, o=o).collect()))
        assert got == want and max(n for _, _, _, n in got) > 1 and max(k for _, k, _, _ in got) > 3
        assert chunk_pieces(pieces.limit(0), emb, o=o).count() == 0
    # any other embedder, and two key columns
    def letters(texts):
        import numpy as np

        return np.array([[t.count(c) + 0.01 for c in "abcdef"] for t in texts.to_pylist()])

    emb = ArrowEmbedder(letters, 6)
    o = SE.SemanticOptions(piece_size=17, min_tokens=25, max_tokens=80, batch_size=5)
    want = sorted((r.doc_id, k, c) for r in SE.with_semantic_chunks(df, "text", "chunks", emb, o).collect() for k, c in enumerate(r.chunks))
    two = split_tokens(df, size=o.piece_size).withColumn("part", F.lit("x"))
    assert sorted((r.doc_id, r.chunk_no, r.text) for r in chunk_pieces(two, emb, ["part", "doc_id"], o=o).collect()) == want
