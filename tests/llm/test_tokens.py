import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from chunkwise.llm import packing, pieces, queries, token_counts
from chunkwise.llm.common import shared_path, written
from llm_rows import AWKWARD, frame

SF = "/root/testdata/sf0.01"
BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def expected_pieces(rows, capacity=1024):
    tok = Tokenizer.from_file(BPE)
    out = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return sorted(out, key=str)


def check_places(rows, capacity=1024):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_query(spark):
    rows = queries.op2_best_fit_packing(spark, SF).collect()
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == expected_pieces(texts)
    assert check_places(rows) <= 1.006 * -(-sum(r.length for r in rows) // 1024)


def test_packing_awkward(spark):
    rows = AWKWARD + [(20, "x<|endoftext|> y <|endoftext|>")]
    got = packing.pack_documents(frame(spark, rows), BPE).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == expected_pieces(rows)
    check_places(got)
    assert packing.pack_documents(frame(spark, []), BPE).count() == 0
    one = packing.pack_documents(frame(spark, [(1, None)]), BPE, with_ids=True).collect()
    assert [(r.length, r.ids, r.offset) for r in one] == [(1, [2], 0)]


def test_layouts_random():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        cap = int(rng.integers(5, 200))
        lengths, counts = np.unique(rng.integers(1, cap + 1, int(rng.integers(1, 3000))), return_counts=True)
        lay = packing.Layouts(dict(zip(lengths.tolist(), counts.tolist())), cap)
        used = {}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            for s, o in zip(*lay.place(n, np.arange(c))):
                used.setdefault(int(s), []).append((int(o), n))
        assert len(used) == lay.bins
        for parts in used.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= cap


def test_two_for_one():
    """The smallest piece of a greedy bin gives way to two that fit better."""
    lay = packing.Layouts({60: 1, 30: 1, 25: 1, 15: 1}, 100)
    assert sorted(lay._fill(np.bincount([60, 30, 25, 15], minlength=101))) == [15, 25, 60]


def test_counts_query(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    rows = {r["doc_id"]: r for r in queries.op10_token_counts(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        n = len(sp.encode(r["text"]))
        assert (rows[r["doc_id"]].n_tokens, rows[r["doc_id"]].n_bytes, rows[r["doc_id"]].over_limit) == (n, len(r["text"].encode()), n > 4096)


def test_counts_cache(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    cache = shared_path(spark, "test-cache")
    rows = AWKWARD + [(20, " two  spaces "), (21, "a▁b"), (22, "<s> [INST] </s>")]
    got = token_counts.count_tokens(frame(spark, rows), SP, cache).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(sp.encode(t or ""))) for i, t in rows)
    n = spark.read.parquet(cache).count()
    assert n == len({t or "" for _, t in rows})
    # a second call encodes only what is new, and answers the rest from the table
    again = token_counts.count_tokens(frame(spark, rows + [(30, "new text")]), SP, cache)
    assert again.count() == len(rows) + 1 and spark.read.parquet(cache).count() == n + 1
    spark.createDataFrame([(bytes(32), "other version", 5)], token_counts.CACHE_SCHEMA).write.mode("append").parquet(cache)
    assert token_counts.stored(spark, cache, token_counts.tokenizer_digest(SP)).count() == n + 1
    assert token_counts.count_tokens(frame(spark, []), SP, cache).count() == 0


def test_pieces_query(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    got = {r["doc_id"]: r for r in queries.op1_sentencepiece(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r, want in zip(rows, sp.encode([r["text"] for r in rows], num_threads=1)):
        assert got[r["doc_id"]]["ids"] == want and got[r["doc_id"]]["decoded_equal"]


def test_pieces_awkward(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    rows = AWKWARD + [(20, " two  spaces "), (21, "a▁b"), (22, "<s> [INST] </s>"), (23, "\0"), (24, " " * 40 + "y")]
    enc = written(pieces.encode(frame(spark, rows), SP), "encoded")
    assert sorted((str(r.doc_id), list(r.ids)) for r in enc.collect()) == sorted((str(i), sp.encode(t or "")) for i, t in rows)
    back = pieces.decode(enc, SP).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), (t or "").replace("▁", " ")) for i, t in rows)
    assert pieces.encode(frame(spark, []), SP).count() == 0


def test_merges_random():
    import random

    model, sp, rng = pieces.Model(SP), sentencepiece.SentencePieceProcessor(model_file=SP), random.Random(5)
    parts = ["a", "b", "e", "t", "th", "in", "er", " ", "  ", "\n", "é", "1", "0", ".", "▁", "ing", "日", "\0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(800)]
    got = [x.tolist() for x in model.encode_batch(texts)]
    assert got == sp.encode(texts, num_threads=1)
    assert [model.decode(x) for x in got] == sp.decode(got)


def test_units_are_matched_once(monkeypatch):
    """Words that differ by characters no piece joins to them share the matching of their units."""
    model, sp, seen = pieces.Model(SP), sentencepiece.SentencePieceProcessor(model_file=SP), []
    match = pieces.Model.match
    monkeypatch.setattr(pieces.Model, "match", lambda self, words: seen.extend(words) or match(self, words))
    texts = ["orthesinre\nab orthesinre", "orthesinre\n\northesinre", " orthesinre\n"]
    for _ in range(2):
        assert [x.tolist() for x in model.encode_batch(texts)] == sp.encode(texts, num_threads=1)
    assert seen.count("▁orthesinre") == 1 and len(seen) == len(set(seen))
    assert not any("\n" in w for w in seen if len(w) > 1)


def test_forgotten_words(monkeypatch):
    import random

    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    monkeypatch.setattr(pieces, "WORD_CHARS", 5)
    monkeypatch.setattr(pieces, "INDEXED", 50)
    model, sp, rng = pieces.Model(SP), sentencepiece.SentencePieceProcessor(model_file=SP), random.Random(7)
    for _ in range(30):
        texts = ["".join(rng.choice(["the", "in", "7", ",", "\n", " ", " ", "é", "▁", "\0", "ñ日"]) for _ in range(rng.randint(0, 40))) for _ in range(5)]
        assert [x.tolist() for x in model.encode_batch(texts)] == sp.encode(texts, num_threads=1)
        assert len(model.words.known) <= 20 and all(len(w) <= 5 for w in model.words.older)
    assert model.encode_batch([]) == [] and [x.tolist() for x in model.encode_batch([""])] == [[]]


def test_decode_any_ids(spark):
    model = pieces.Model(SP)
    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    good = [sp.encode(t) for t in ("one two", " é\n日 x", "a▁b", "", "  ")]
    raw = [model.byte[b] for b in "日".encode()]
    odd = [[sp.bos_id(), *good[0]], raw[:1], raw[1:] + good[0], [raw[0], sp.bos_id(), *raw[1:]], [sp.unk_id(), *raw], [10 ** 6, -5], [good[0][0], None]]
    rows = [good, [*good, None], [[]], [None, []], *[[o, good[1]] for o in odd]]
    for k, own in enumerate(rows):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(own)], "doc_id long, ids array<int>").coalesce(1)
        got = [r.text for r in pieces.decode(df, SP).orderBy("doc_id").collect()]
        assert got == [model.decode(x or []) for x in own], k


def test_suffix_array_order():
    rng = np.random.default_rng(3)
    for n, letters, depth in ((1, 2, 16), (5, 1, 16), (300, 2, 40), (400, 70, 16), (200, 0x10FFFF, 9)):
        codes = rng.integers(0, letters, n)
        own = pieces.suffix_array(codes, depth).tolist()
        heads = [codes[i:i + depth].tolist() for i in own]
        assert sorted(own) == list(range(n)) and heads == sorted(heads)


def test_second_call_encodes_nothing(spark):
    """The query with a cache folder of the session: the second call finds every count."""
    spark.conf.set(queries.TOKEN_CACHE, shared_path(spark, "session-cache"))
    try:
        first = {tuple(r) for r in queries.op10_token_counts(spark, SF).collect()}
        n = spark.read.parquet(spark.conf.get(queries.TOKEN_CACHE)).count()

        def refuse(texts, path):
            assert texts.isEmpty()
            return encode(texts, path)

        encode, token_counts.encode_counts = token_counts.encode_counts, refuse
        try:
            again = {tuple(r) for r in queries.op10_token_counts(spark, SF).collect()}
        finally:
            token_counts.encode_counts = encode
        assert again == first and spark.read.parquet(spark.conf.get(queries.TOKEN_CACHE)).count() == n
    finally:
        spark.conf.unset(queries.TOKEN_CACHE)
    assert token_counts.tokenizer_digest(SP)[:16] in token_counts.default_cache(spark, SP)


def test_many_misses_move_by_row(spark, monkeypatch):
    from chunkwise.llm import common

    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    got = token_counts.count_tokens(frame(spark, AWKWARD), SP, shared_path(spark, "test-cache")).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(sp.encode(t or ""))) for i, t in AWKWARD)


def changed_model(tmp_path, message, *field):
    """The model file with a field of its trainer (2) or normaliser (3) message set: later fields win."""
    own = bytes(field)
    with open(SP, "rb") as f:
        data = f.read() + bytes([message << 3 | 2, len(own)]) + own
    path = str(tmp_path / "changed.model")
    with open(path, "wb") as f:
        f.write(data)
    return path


def test_other_models_are_told_apart(tmp_path):
    import pytest

    from chunkwise.llm.encoders import SentencePieceCounts, model_faults

    assert model_faults(sentencepiece.SentencePieceProcessor(model_file=SP)) == []
    for message, field in ((2, (3 << 3, 1)), (3, (4 << 3, 1)), (3, (3 << 3, 0))):
        path = changed_model(tmp_path, message, *field)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        with pytest.raises(ValueError):
            pieces.Model(path)
        counts = SentencePieceCounts(path)
        for t in ("one two", " a  b ", "", "x"):
            assert counts.count(t) == len(sp.encode(t))
