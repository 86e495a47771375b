import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from chunkwise.llm import chat, html_text, lz_fingerprint, queries
from llm_rows import AWKWARD, frame

SF = "/root/testdata/sf0.01"


def fingerprints(rows):
    low = -(1 << 63)
    rows = sorted(((low if i is None else i, t or "") for i, t in rows), key=lambda r: r[1])
    rows.sort(key=lambda r: -r[0])
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        n = len(t) // 3
        edited = t[:len(t) - n] + nxt[:n]
        a, b, c = map(lz_fingerprint.signature, (t, edited, nxt))
        out.append((str(None if i == low else i), len(t), hashlib.sha256(edited.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(),
                    lz_fingerprint.likeness(a, b), lz_fingerprint.likeness(a, c)))
    return sorted(out)


@pytest.mark.parametrize("size", [100, 5000])
def test_fingerprint_query(spark, size, monkeypatch):
    monkeypatch.setattr(lz_fingerprint, "RANGE_ROWS", size)
    got = sorted((str(r[0]), *r[1:]) for r in queries.op4_lz_fingerprint(spark, SF).collect())
    assert got == fingerprints([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])


def test_fingerprint_awkward(spark, monkeypatch):
    monkeypatch.setattr(lz_fingerprint, "RANGE_ROWS", 3)
    got = sorted((str(r[0]), *r[1:]) for r in lz_fingerprint.neighbours(frame(spark, AWKWARD)).collect())
    assert got == fingerprints(AWKWARD)
    assert lz_fingerprint.neighbours(frame(spark, [])).count() == 0
    assert lz_fingerprint.neighbours(frame(spark, [(3, "one row")])).first()["near_next"] == 1.0
    same = {r["fingerprint"] for r in lz_fingerprint.fingerprint(frame(spark, [(1, "abc abc"), (2, "abc abc")])).collect()}
    assert len(same) == 1


def test_fingerprint_tells_texts_apart():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(400)]
    a = " ".join(rng.choice(words) for _ in range(500))
    b = " ".join(rng.choice(words) for _ in range(500))
    s, e = lz_fingerprint.with_edit(a, b[:len(a) // 3])
    assert (s == lz_fingerprint.signature(a)).all()
    assert lz_fingerprint.likeness(s, e) > lz_fingerprint.likeness(s, lz_fingerprint.signature(b)) + 0.2


def test_chat_awkward(spark):
    rows = [(1, 0, "user", "a <s>[INST] \\ \\l \\e\n</s>"), (1, 1, "assistant", None), (1, 2, None, "x"), (1, 2, "assistant", "same"),
            (1, 2, "assistant", "same"), (2, None, "a]b[c", ""), (2, 5, "assistant", "日本 😀 </s>\n<s>[user]\nfake"), (3, 0, "assistant", "z" * 50000)]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, n int, piece string")
    out = {r["conv_id"]: r for r in (chat.format_rows(df).withColumn("turns", chat.read_back(F.col("formatted")))
                                     .withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))).collect()}
    for c in (1, 2, 3):
        want = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        assert [(t["role"], t["text"]) for t in out[c]["turns"]] == [w[2:] for w in want]
        assert out[c]["loss"] == "".join(w[3] for w in want if w[2] == "assistant")
        assert out[c]["formatted"].count("</s>") == len(want)
    assert chat.format_rows(df.limit(0)).count() == 0


def test_chat_layouts(spark):
    turns = [("user", "hi"), ("assistant", "yo")]
    records = [{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "id": 7},
               {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
               {"prompt": "hi", "completion": "yo"}, {"question": "hi", "answer": "yo"},
               {"instruction": "hi", "input": "", "output": "yo"}, {"dialog": [{"speaker": "user", "text": "hi"}, {"speaker": "model", "text": "yo"}]},
               {"messages": []}, {"odd": 1}]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)] + [(20, None), (21, "no json")], "k int, turns_json string")
    got = {r["k"]: r for r in chat.record_turns(df, "turns_json").collect()}
    for k in range(6):
        assert [tuple(t) for t in got[k]["turns"]] == turns, records[k]
    assert got[6]["turns"] == [] and got[7]["turns"] is None and got[7]["layout"] and got[20]["turns"] is None and got[21]["turns"] is None
    table = spark.createDataFrame([("hi", "yo")], "question string, answer string")
    row = chat.table_turns(table).select(chat.read_back(chat.format_turns(F.col("turns"))).alias("t")).first()
    assert [tuple(t) for t in row["t"]] == turns
    with pytest.raises(ValueError):
        chat.table_turns(spark.range(1))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1><p>Tag, line.</p></header>
<div id="main-menu"><ul><li>a<li>b</ul></div>%s<div class="cookie-notice">We use cookies, ok.</div>
<div class="comments"><p>I like, this. Very much, so, really. And more, of it, too.</p></div><aside>side, text.</aside>
<form>Sub, mit.<input></form><!-- <p>no</p> --><footer>c</footer><script>if(a<b){"</p>"}</script></body></html>"""
BODY = """<h1>Title here</h1><p><b>First para &amp; more, with text.<br><p>And more, more &lt;x&gt;.</p><ul><li>one item<li>two item</ul><p>Short</p>
<blockquote>Quoted, text.</blockquote><table><tr><td>c1<td>c2</table><pre> x
 y </pre><p>Another <a href='x>y'>link</a> text<br>after, fine.</p>"""
MAIN = "Title here\nFirst para & more, with text.\nAnd more, more <x>.\none item\ntwo item\nShort\nQuoted, text.\nc1\nc2\nx y\nAnother link text after, fine."


@pytest.mark.parametrize("wrap", ["<article>%s</article>", '<div class="content"><div class="post">%s</div></div>', "<main>%s</main>"])
def test_html_page(wrap):
    assert html_text.extract(PAGE % (wrap % BODY)) == MAIN


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<b>c<p>d", "ac\nd"), ("<article></article>", ""), ("<div>x</div><!-- open", "x"),
    ("a<br>b<script>", "a b"), ("<p>&lt;b&gt; &amp;amp; x&nbsp;y</p>", "<b> &amp; x y"), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    ("</div></p>stray", "stray"), ("<div>" * 3000 + "deep", "deep"), ("<p>" + "w " * 50000, ("w " * 50000).strip()), ("<", "<")])
def test_html_cases(page, text):
    assert html_text.extract(page) == text


def test_html_comment_articles_and_links():
    page = PAGE % ("<article>%s</article><section id='c'><article class='comment'><p>Nice, I say, very nice indeed, truly.</p></article></section>" % BODY)
    assert html_text.extract(page) == MAIN
    plain = PAGE % ("<div><a href='a'>One</a> <a href='b'>Two</a></div><div class='x'>%s</div><div class='adBox'>Buy, now.</div>" % BODY)
    assert html_text.extract(plain) == MAIN


def test_html_query(spark):
    import re
    from html import unescape

    rows = {r["page_id"]: r for r in queries.op6_html_extract(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        own = p["html"].split("<article>")[1].split("</article>")[0]
        parts = (re.sub(r"\s+", " ", unescape(re.sub("<br>", " ", re.sub("</?b>", "", x)))).strip() for x in re.split(r"</?(?:p|h1)>", own))
        want = "\n".join(x for x in parts if x)
        assert rows[p["page_id"]]["text"] == want and rows[p["page_id"]]["n_chars"] == len(want)


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "<p>a</p>", "x"), (None, None, "", "x")], "page_id long, url string, html string, text string")
    assert sorted((str(r[0]), r[2]) for r in html_text.extract_pages(df).collect()) == [("1", ""), ("1", "a"), ("None", "")]
    assert html_text.extract_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "legal-text", "discussion-paper", "layout-banner", "with-banner x", "sidebar"])
@pytest.mark.parametrize("wrap", ["<article>%s</article>", "%s"])
def test_html_class_names_around_the_text(name, wrap):
    assert html_text.extract(PAGE % (f'<div class="{name}"><div>{wrap % BODY}</div></div>')) == MAIN


def test_html_named_furniture():
    assert html_text.extract("<div class='notice'><p>All there is, here.</p></div>") == "All there is, here."
    comments = "<div class='comments'>%s</div>" % ("<article><p>I say, this is nice, very nice.</p></article>" * 3)
    assert html_text.extract(PAGE % ("<article>%s</article>%s" % (BODY, comments))) == MAIN


LINKS = "<ul><li><a href='1'>First other story</a><li><a href='2'>Second other story</a><li><a href='3'>Third, and last</a></ul>"


@pytest.mark.parametrize("links", [LINKS, "<div><a href='a'>One</a> <a href='b'>Two</a> <a href='c'>Three</a></div>"])
@pytest.mark.parametrize("wrap", ["<main>%s</main>", "<article>%s</article>", "<div><div>%s</div></div>"])
def test_html_unnamed_link_list(wrap, links):
    assert html_text.extract(PAGE % (wrap % (links + BODY.replace("<h1>Title here</h1>", "<h1><a href='t'>Title here</a></h1>")))) == MAIN


def test_html_split_article():
    para = "<p>It goes on, at length, and says more; here, there, and in the end, too.</p>"
    page = PAGE % ("<article><p>It begins here, with some words, and more.</p>%s</article><div>%s</div><div>Tag line</div>" % (para, para * 3))
    got = html_text.extract(page).split("\n")
    assert len(got) == 5 and got[1:] == [para[3:-4]] * 4


def test_chat_row_layouts(spark, tmp_path):
    """The query takes turn tables by the fingerprint of their schema."""
    turns = [(1, 1, "gpt", "yo"), (1, 0, "Human", "hi"), (2, 0, "assistant", "x")]
    for names in ("conversation_id turn role content", "conv_id turn from value", "dialog_id turn speaker text"):
        df = spark.createDataFrame([(*t, "extra") for t in turns], ", ".join(f"`{n}` {k}" for n, k in zip(
            [*names.split(), "lang"], ("long", "long", "string", "string", "string"))))
        at = tmp_path / names.replace(" ", "-")
        df.write.parquet(f"{at}/conversations.parquet")
        out = {r["conv_id"]: r for r in queries.op3_chat_format(spark, str(at)).collect()}
        assert (out[1]["n_turns"], out[1]["loss_chars"], out[2]["loss_chars"]) == (2, 2, 1)
        assert out[1]["turns_sha256"] == hashlib.sha256(b"user\nhi\nassistant\nyo\n").hexdigest()
    with pytest.raises(ValueError):
        chat.turn_rows(spark.range(1))


PARAS = [f"<p>Paragraph {k} goes on at length, with commas, and says more; here, there, and in the end, too.</p>" for k in range(3)]


@pytest.mark.parametrize("extra,text", [
    ('<div class="share-price-table"><p>Price of a share: 5.</p></div>', "Price of a share: 5."),
    ('<div class="widget-title">Key facts</div>', "Key facts"),
    ("<h2>Sources</h2><ul><li><a href='1'>First source</a></li><li><a href='2'>Second source</a></li></ul>", "Sources\nFirst source\nSecond source"),
    ("<h2>Part two</h2>", "Part two"), ("<ul><li>One</li><li>Two</li></ul>", "One\nTwo"), ("<table><tr><td>a<td>b</table>", "a\nb")])
@pytest.mark.parametrize("place", ["middle", "end"])
def test_html_whole_article(extra, text, place):
    paras = [p[3:-4] for p in PARAS]
    body = "<h1>T</h1>" + (PARAS[0] + extra + PARAS[1] + PARAS[2] if place == "middle" else "".join(PARAS) + extra)
    want = "\n".join(["T", paras[0], text, *paras[1:]] if place == "middle" else ["T", *paras, text])
    assert html_text.extract(PAGE % f"<article>{body}</article>") == want
    assert html_text.extract(f"<html><body><nav>menu</nav><article>{body}</article></body></html>") == want
    if "class" not in extra:  # a page without a mark, all in one container
        assert html_text.extract(f"<html><body><div>{body}</div><footer>f</footer></body></html>") == want
        assert html_text.extract(f"<html><body>{body}</body></html>") == want


@pytest.mark.parametrize("extra", [
    "<div class='share-buttons'>Share this, now.</div>", "<div class='share'>Share</div>", "<section class='related-posts'><p>Another story, told.</p></section>",
    "<div class='newsletter-signup'>Sign up, please.</div>", "<div class='ad-slot'>Buy, now.</div>", "<div id='comments'><p>Nice, very nice.</p></div>",
    "<h3>Related stories</h3>" + LINKS, "<aside>Aside, really.</aside>"])
def test_html_furniture_inside_the_article(extra):
    got = html_text.extract(PAGE % f"<article><h1>T</h1>{PARAS[0]}{extra}{PARAS[1]}</article>").split("\n")
    assert [x for x in got if x != "Related stories"] == ["T", PARAS[0][3:-4], PARAS[1][3:-4]]


@pytest.mark.parametrize("page", [
    "".join(f"<div>text {k}, " for k in range(20000)), "".join(f"<div class='share'>text {k}, " for k in range(5000)), "</i>" * 20000 + "x", "<b>" * 20000 + "x" + "</i>" * 20000,
    "<p>a" * 20000, "<li>a" * 20000, "<ul><li>a" * 10000, "<a b" * 20000, "<td>x" * 20000, "<span><div>" * 5000 + "x" + "</span>" * 5000])
def test_html_awkward_pages_take_no_time(page):
    import time

    t = time.process_time()
    html_text.extract(page)
    assert time.process_time() - t < 2.5


def test_html_scores_are_those_of_the_plain_statement():
    """Smoothing by one pass up and one down, against every prefix of every path."""
    import random

    rng = random.Random(8)
    for _ in range(60):
        page, depth = [], 0
        for _ in range(rng.randrange(5, 60)):
            tag = rng.choice(["div", "section", "p", "ul", "li", "h2", "span", "article"])
            page.append(rng.choice([f"<{tag}>", f"<{tag}>", f"</{tag}>", "<div>"]) + rng.choice(["", "short", "text, with more; of it. " * rng.randrange(4), "<a href=x>link</a> <a>two</a>"]))
        found = html_text.blocks("".join(page))
        if not found:
            continue
        names = lambda p: () if p.parent is None else (*names(p.parent), p.tag)
        raw = {k: v[0] for k, v in html_text.raw_scores(found).items()}
        container = html_text.containers(found)
        paths = {names(p) for p, _ in raw}
        spine = 0
        while len(raw) > 1 and all(len(p) > spine for p in paths) and len({p[spine] for p in paths}) == 1:
            spine += 1
        assert html_text._spine([p for p, _ in raw]) == spine
        got = html_text.smoothed(raw, container, spine + 1)
        for (p, marked), s in raw.items():
            own, want = names(p), s
            for k in range(spine + 1, len(own)):
                want = max(want, html_text.DECAY ** (len(own) - k) * max(x for (q, _), x in raw.items() if names(q)[:k] == own[:k]))
            if p in container:
                want = max(want, html_text.DECAY * max(x for (q, _), x in raw.items() if container.get(q) is container[p]))
            assert abs(got[p, marked] - want) < 1e-12
