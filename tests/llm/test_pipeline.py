import corpus_pipeline as cp
from chunkwise.llm import language, quality
from chunkwise.llm.common import written
from llm_rows import AWKWARD, PROSE, frame
from test_dedup import classes, removed

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Every stage against the plain statement of its decision, on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(cp.STAGES):
        out = written(stage(spark, docs, SF), name)
        if k < len(cp.STAGES) - 1:
            assert out.schema.names == docs.schema.names
        seen.append((docs, out))
        docs = out
    before, after = ({r["doc_id"]: r["text"] for r in df.collect()} for df in seen[0])
    want = {i: quality.judge_text(t.encode()) for i, t in before.items()}
    assert after == {i: w[9] for i, w in want.items() if w[6]}
    before, after = ({r["doc_id"]: r["text"] for r in df.collect()} for df in seen[1])
    c = language.Compressors(language.sample(seen[1][0]))
    assert after.keys() == {i for i, t in before.items() if c.predict(t)[2] >= language.MIN_MARGIN}
    before, after = ({r["doc_id"]: r["text"] for r in df.collect()} for df in seen[2])
    assert {str(i) for i in after} == {i for i, c in classes(list(before.items())) if int(i) == c}
    before, after = ({r["doc_id"]: r["text"] for r in df.collect()} for df in seen[3])
    gone = {int(r[0]): r for r in removed(list(before.items()))}
    assert after.keys() == {i for i, r in gone.items() if r[2] < r[1] or not r[2]}
    assert {r["doc_id"] for r in seen[4][1].collect()} == after.keys()
    run = cp.run(spark, SF)
    assert run.count() == seen[4][1].count() and run.columns == seen[4][1].columns


def test_awkward(spark):
    docs = frame(spark, [(i, t, "en") for i, t in AWKWARD] + [(40, PROSE, "de")])
    for _, stage in cp.STAGES:
        docs = written(stage(spark, docs, ""), "awkward")
    assert docs.count() > 0
    docs = frame(spark, [])
    for _, stage in cp.STAGES:
        docs = written(stage(spark, docs, ""), "empty")
    assert docs.count() == 0
