"""Property tests: Spark expressions against plain-Python statements on random texts."""

import math
import re

import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkwise.functions import text as TX
from chunkwise.operators import split as SP

TOK = regex.compile(r"[一-鿿]|[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")
ALPHABET = "ab é中,.;!? \n\t"
texts = st.lists(st.text(alphabet=ALPHABET, max_size=120), min_size=1, max_size=25)


def py_sentences(t):
    m = re.sub(r"([.!?;])\s+", "\\1\x01", t)
    m = re.sub(r"\s*\n\s*", "\x01", m)
    return [p for p in (re.sub(r"^\s+|\s+$", "", x) for x in m.split("\x01")) if p]


def py_units(t, cap):
    out = []
    for s in py_sentences(t):
        n = len(TOK.findall(s))
        if n <= cap:
            out.append((s, " ", n))
            continue
        for w in (w for w in re.split(r"\s+", s) if w):
            toks = TOK.findall(w)
            if len(toks) <= cap:
                out.append((w, " ", len(toks)))
            else:
                for j in range(math.ceil(len(toks) / cap)):
                    out.append(("".join(toks[j * cap:(j + 1) * cap]), " " if j == 0 else "",
                                min(len(toks) - j * cap, cap)))
    return out


def py_chunks(t, size):
    cap = size - 2
    units = py_units(t, cap)
    spans, a, c = [], 0, 0
    for i, (_, _, n) in enumerate(units):
        if c > 0 and c + n > cap:
            spans.append((a, i - 1))
            a, c = i, n
        else:
            c += n
    if units:
        spans.append((a, len(units) - 1))
    return [re.sub("^ ", "", "".join(s + t for t, s, _ in units[x:y + 1])) for x, y in spans]


def _df(spark, items):
    return spark.createDataFrame([(i, t) for i, t in enumerate(items)], "id long, text string")


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(items=texts, size=st.sampled_from([4, 8, 20]))
def test_token_splitter_matches_statement(spark, items, size):
    rows = _df(spark, items).select("id", SP.token_chunks(F.col("text"), size).alias("c")).orderBy("id").collect()
    for r in rows:
        assert list(r["c"]) == py_chunks(items[r["id"]], size), repr(items[r["id"]])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(items=texts)
def test_clean_fold_count_match_statement(spark, items):
    rows = _df(spark, items).select("id", TX.clean_text("text").alias("c"), TX.fold_newlines("text").alias("f"),
                                    TX.token_count("text").alias("n")).orderBy("id").collect()
    for r in rows:
        t = items[r["id"]]
        lines = [ln.strip(" \t") for ln in t.split("\n")]
        assert r["c"] == "\n".join(ln for ln in lines if ln)
        assert r["f"] == t.replace("\n\n", "\x01").replace("\n", " ").replace("\x01", "\n\n")
        assert r["n"] == len(TOK.findall(t)) + 2
