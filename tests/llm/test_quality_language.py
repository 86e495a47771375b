import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chunkwise.llm import language, quality, queries
from llm_rows import AWKWARD, PROSE, frame

SF = "/root/testdata/sf0.01"


def brute(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    grams = Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
    hit = set()
    for k in range(len(words) - 7):
        if grams[tuple(words[k:k + 8])] > 1:
            hit.update(range(k, k + 8))
    joined = b"".join(words)
    n = len(words)
    return (n, len(joined.decode()), sum(joined.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")),
            len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n)


def test_measures_against_brute_force(spark):
    got = {r["doc_id"]: r for r in queries.op8_quality_rules(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t)
        assert not (r.base_failed and r.kept)


def test_quality_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = queries.op8_quality_rules(spark, SF).join(labels, "doc_id").where("n_words >= 20").groupBy("quality", "kept").count().collect()
    counts = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert counts.get((0, True), 0) == 0
    assert counts.get((1, False), 0) <= 0.01 * counts[1, True]


def test_awkward_rows(spark):
    df = frame(spark, AWKWARD)
    rows = quality.judge(df).collect()
    assert len(rows) == len(AWKWARD)
    by = {r["doc_id"]: r for r in rows}
    assert by[1].n_words == by[2].n_words == by[3].n_words == 0 and not by[1].kept
    assert by[4].kept and by[8].n_repeat_words == 30000 and by[9].n_words == 1
    kept = quality.clean(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 4, 5, 6, 10]
    assert quality.judge(frame(spark, [])).count() == 0 and quality.clean(frame(spark, [])).count() == 0


def test_lines(spark):
    nav = "Home | News | Sport | Weather | Contact"
    text = PROSE + "\n" + nav + "\n" + "ALL THE NEWS!! BUY IT NOW!!" + "\n" + PROSE[::-1]
    row = quality.clean(frame(spark, [(1, text)])).first()
    assert row["text"] == PROSE + "\n" + PROSE[::-1] and row["n_chars"] == len(row["text"])
    assert not quality.judge_text(((nav + "\n") * 1 + "\n".join(f"{w} | {w}a | {w}b | {w}c | {w}d" for w in "abcdefgh")).encode())[6]


@pytest.mark.parametrize("words", [["a"] * 9, list("abcdefgh") * 2, list("abcdefghi"), [], ["x"], list("abcabcabcabc")])
def test_repeat_words(words):
    data = [w.encode() for w in words]
    assert quality.repeat_words(data) == brute(" ".join(words))[4]


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op9_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    assert sum(r["lang_pred"] == r["lang"] for r in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["rejected"] for r in rows) <= 0.01 * len(rows)


def test_language_awkward(spark):
    docs = frame(spark, [*[(i, PROSE, "en") for i in range(20, 25)], (30, "Der Fluss fließt an der alten Mühle vorbei.", "de"),
                         (31, "unlabelled", None), (32, None, "fr"), *AWKWARD])
    samples = language.sample(docs)
    assert list(samples) == ["en", "de"]
    rows = {r["doc_id"]: r for r in language.identify(docs, samples).collect()}
    assert rows[1]["lang_pred"] == rows[2]["lang_pred"] == rows[3]["lang_pred"] == "und" and rows[1]["score"] == 0
    assert rows[5]["lang_pred"] == "en" and rows[30]["lang_pred"] == "de"
    kept = language.keep_identified(docs, samples)
    assert kept.columns == docs.columns and kept.where("doc_id = 5").first()["lang"] == "en"
    assert kept.where("doc_id in (1, 2, 3)").count() == 0
    assert language.sample(frame(spark, [])) == {}
    assert language.identify(frame(spark, [(1, "abc")]), {}).first()["lang_pred"] == "und"
    assert language.identify(frame(spark, []), samples).count() == 0


def test_no_learning_from_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = language.sample(docs, ~queries.held_out())
    b = language.sample(docs.withColumn("text", F.when(queries.held_out(), F.lit("quatsch")).otherwise(F.col("text"))), ~queries.held_out())
    assert a == b and all(len(x) <= language.SAMPLE_DOCS * language.SAMPLE_CHARS * 4 for x in a.values())


def test_lines_of_other_scripts_have_marks():
    """Prose that ends in its own script's marks is no list of words; without any mark it is."""
    from chunkwise.llm import quality

    prose = {"hi": "यह एक लंबा वाक्य है जो नदी और गाँव की कहानी कहता है।", "ar": "هذه جملة طويلة تحكي قصة النهر والقرية في الشتاء؟",
             "zh": "这 是 一 个 很 长 的 句子 讲述 河流 的 故事。", "am": "ይህ ስለ ወንዙ እና ስለ መንደሩ የሚናገር በጣም ረጅም ዓረፍተ ነገር ነው።",
             "hy": "Սա երկար նախադասություն է որը պատմում է գետի և գյուղի մասին։"}
    for text in prose.values():
        lines = "\n".join(f"{text[:-1]} {k}{text[-1]}" for k in range(20)).encode()
        assert all(not quality.line_fails(x, x.split()) for x in lines.split(b"\n"))
        bare = text[:-1].encode()
        assert quality.line_fails(bare, bare.split()) == (len(bare.split()) >= quality.PLAIN_WORDS)
