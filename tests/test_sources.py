"""File sources, page and part assembly, digests."""

import io
import os
import zipfile


from chunkwise.sources import pages as PG
from chunkwise.sources.docx import docx_bytes_to_text
from chunkwise.sources.files import extract_text, list_files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def make_docx(path):
    body = (f'<w:document {W}><w:body>'
            '<w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>world</w:t></w:r></w:p>'
            '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p>'
            '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>inner</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
            '</w:tc></w:tr></w:tbl>'
            '<w:p><w:r><w:t>end</w:t></w:r></w:p></w:body></w:document>')
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", body)
    with open(path, "wb") as f:
        f.write(buf.getvalue())


FRONT_MATTER_MD = """---
subject: Bread baking
rating: 4
---
Weigh the flour first.
# Dough
## Second rise


"""


def test_docx_order_and_nesting(tmp_dir):
    p = os.path.join(tmp_dir, "a.docx")
    make_docx(p)
    with open(p, "rb") as f:
        data = f.read()
    assert docx_bytes_to_text(data) == "Hello worldcellinnerend"
    assert docx_bytes_to_text(data, "\n") == "Hello world\ncell\ninner\nend"


def test_file_tree_dispatch(spark, tmp_dir):
    os.makedirs(os.path.join(tmp_dir, "sub"))
    files = {"bread.md": FRONT_MATTER_MD, "note.txt": "Plain words, one line; nothing else.",
             "UPPER.MD": "# Title\nBody *em* and [link](http://x)", "noext": "x", "data.csv": "a,b",
             "empty.txt": "", "sub/deep.txt": "deep"}
    for name, body in files.items():
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.write(body)
    make_docx(os.path.join(tmp_dir, "sub", "d.docx"))
    with open(os.path.join(tmp_dir, "sub", "broken.docx"), "wb") as f:
        f.write(b"not a zip")
    out = {os.path.basename(r["file_path"]): r for r in extract_text(list_files(spark, tmp_dir)).collect()}
    # a zero-length file gets no split, hence no row (it would yield no chunk anyway)
    assert len(out) == 8 and "empty.txt" not in out
    assert out["bread.md"]["text"].split("\n")[:3] == ["Weigh the flour first.", "Dough", "Second rise"]
    assert out["note.txt"]["text"].startswith("Plain words")
    assert out["UPPER.MD"]["text"] == "Title\nBody em and link"
    assert out["noext"]["error"].startswith("unsupported") and out["data.csv"]["error"] == "unsupported: csv"
    assert out["deep.txt"]["text"] == "deep"
    assert out["d.docx"]["text"] == "Hello worldcellinnerend"
    assert out["broken.docx"]["text"] is None and out["broken.docx"]["error"].startswith("docx:")
    assert all(r["size"] >= 0 and r["modified_at"] is not None for r in out.values())


def test_single_file_passes_through(spark, tmp_dir):
    p = os.path.join(tmp_dir, "one.txt")
    with open(p, "w") as f:
        f.write("solo")
    rows = extract_text(list_files(spark, p)).collect()
    assert [r["text"] for r in rows] == ["solo"]


def test_pdf_pages(spark):
    pages = spark.createDataFrame([(1, 2, "b1  \nb2"), (1, 1, "a1 \n a2\t"), (2, 1, "x")],
                                  "doc_id long, page_no int, text string")
    got = {r["doc_id"]: r["text"] for r in PG.assemble_pages(pages).collect()}
    assert got == {1: "a1 a2b1b2", 2: "x"}


def test_parts_stop_at_first_gap(spark):
    parts = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 4, "d"), (2, 2, "x"), (3, 1, "p")],
                                  "id long, part_no int, body string")
    got = {r["id"]: (r["n_parts"], r["n_chars"]) for r in PG.reassemble_parts(parts).collect()}
    assert got == {1: (2, 2), 3: (1, 1)}  # id 2 has no part 1: nothing to assemble


def test_digests(spark):
    c = spark.createDataFrame([(1, "abc"), (2, "abd"), (3, "zzz")], "id long, content string")
    e = spark.createDataFrame([(1, "900150983cd24fb0d6963f7d28e17f72"), (2, "900150983cd24fb0d6963f7d28e17f72")],
                              "id long, expected_md5 string")
    got = {r["id"]: r["status"] for r in PG.check_digests(c, e).collect()}
    assert got == {1: "ok", 2: "changed", 3: "missing"}
