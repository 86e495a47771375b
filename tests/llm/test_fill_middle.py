import hashlib
import random
import re

import numpy as np

from chunkwise.llm import fill_middle as fm
from chunkwise.llm import queries
from llm_rows import AWKWARD, PROSE, frame

SF = "/root/testdata/sf0.01"


def plainly(doc_id, text, rate=90, spm=20):
    """The contract's statement with string slices."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in range(0, 32, 8))
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows_of(df):
    return [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in df.collect()]


def test_whole_table_and_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = rows_of(fm.restore(fm.transform(docs)))
    assert sorted(got) == sorted((i, *plainly(i, t), t) for i, t in texts.items())
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    query = {r.doc_id: (r.output_sha256, r.restored_sha256) for r in queries.op11_fill_middle(spark, SF).collect()}
    assert query == {i: (sha(plainly(i, t)[4]), sha(t)) for i, t in texts.items()}


def test_awkward(spark):
    rows = AWKWARD + [(k, t) for k, t in enumerate([PROSE, "a<P", "x<P>y", "<<S", "M><M", ">", "日本語のテキスト", "é‍😀", "\n\n", "A"], 100)]
    got = rows_of(fm.restore(fm.transform(frame(spark, rows), rate=100)))
    key = lambda r: (str(r[0]), r[5])
    assert sorted(got, key=key) == sorted(((i, *plainly(i, t or "", 100), t or "") for i, t in rows), key=key)
    assert rows_of(fm.restore(fm.transform(frame(spark, [])))) == []


def test_random_texts_and_rates():
    rng = random.Random(3)
    for k in range(3000):
        text = "".join(rng.choices(["<", ">", "P", "S", "M", "a", "b", "é", "日", "😀", " ", "\n", "<S", "M>", "\0"], k=rng.randrange(12)))
        for rate, spm in ((100, 0), (100, 100), (100, 50)):
            n, form, p, m, out = fm.transform_text(k, text.encode(), rate, spm)
            out = out if isinstance(out, str) else out.decode()
            assert (n, form, p, m, out) == plainly(k, text, rate, spm)
            assert fm.rebuilt(out.encode(), form).decode() == text


def test_rotation_in_blocks(monkeypatch):
    monkeypatch.setattr(fm, "BLOCK", 3)
    for n in range(0, 40, 3):
        for m in range(n + 1):
            a = np.arange(n, dtype=np.uint8)
            fm.exchange(a, 0, m, n)
            assert a.tolist() == [*range(m, n), *range(m)]
