"""

Every query reads the driver tables (whole tables, whole texts) and is
paired, where SQL can state it, with a DuckDB statement over the same
parquet views.  Column names match on both sides.  Vectors are compared as
exploded (id, dim, value) rows or as rounded fingerprints; long strings are
compared whole.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pyarrow as pa  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

import chunkwise  # noqa: E402,F401
from chunkwise.operators.answer import answer_questions  # noqa: E402
from chunkwise.functions import text as TX  # noqa: E402
from chunkwise.operators import split as SP  # noqa: E402
from chunkwise.operators.embed import HashingEmbedder, first_vector  # noqa: E402
from chunkwise.operators.render import prompts  # noqa: E402
from chunkwise.operators.retrieve import nearest, top_k  # noqa: E402
from chunkwise.plans.ingest import chunk_documents  # noqa: E402
from chunkwise.plans.rag import answer_markdown, retrieve  # noqa: E402
from chunkwise.session import ensure_checkpoint_dir  # noqa: E402
from chunkwise.operators import mutate as MU  # noqa: E402
from chunkwise.operators import scan as SC  # noqa: E402
from chunkwise.operators import semantic as SE  # noqa: E402
from chunkwise.sources import pages as PG  # noqa: E402
from chunkwise.sources.files import FileEach  # noqa: E402
from chunkwise.sources.tables import VersionedTable  # noqa: E402
from chunkwise.streaming import status as ST  # noqa: E402
from chunkwise.schemas import files_schema  # noqa: E402
from chunkwise.session import plan_bytes, scratch_path, shuffles_removed  # noqa: E402

try:  # the training-data operators and their pipeline, if they are there
    import corpus_pipeline as CP
    from chunkwise.llm import queries as LQ
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "chunkwise.llm"):
        raise
    CP = LQ = None

try:  # the stub generator below runs in Python workers, which need not import this file
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass

SF_SMOKE = "/root/testdata/sf0.001"
K = 5
MAX_D = 0.6
CHUNK = 256
PIECE = 500
T6_WORDS = 50
NOW = 1_700_000_000
LATER = 1_700_000_500


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def _prep(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)


# ---------------------------------------------------------------------------
# SQL building blocks (DuckDB).  Each mirrors one chunkwise function.

TOK = r"[\x{4e00}-\x{9fff}]|[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def s_clean(x: str) -> str:
    t = f"regexp_replace({x}, '(?m)^[ \\t]+', '', 'g')"
    t = f"regexp_replace({t}, '(?m)[ \\t]+$', '', 'g')"
    t = f"regexp_replace({t}, '\\n{{2,}}', chr(10), 'g')"
    return f"regexp_replace({t}, '\\A\\n+|\\n+\\z', '', 'g')"


def s_fold(x: str) -> str:
    return (f"array_to_string(list_transform(string_split({x}, chr(10) || chr(10)), "
            f"lambda part: replace(part, chr(10), ' ')), chr(10) || chr(10))")


def s_ntok(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{TOK}'))"


def s_sentences(x: str) -> str:
    # chr(1) marks the cuts of texts that hold none themselves
    m = f"regexp_replace({x}, '([.!?;])\\s+', '\\1' || chr(1), 'g')"
    m = f"regexp_replace({m}, '([。！？；]+)\\s*', '\\1' || chr(1), 'g')"
    m = f"regexp_replace({m}, '\\s*\\n\\s*', chr(1), 'g')"
    return (f"list_filter(list_transform(string_split({m}, chr(1)), "
            f"lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')")


def s_units(x: str, cap: int, ntok=s_ntok) -> str:
    """Units of the token splitter; ``sep`` is '' after a sentence with a full-width end."""
    s_ntok = ntok
    windows = (f"list_transform(range(0, ceil({s_ntok('w')} / {cap})::BIGINT), lambda j: "
               f"{{'t': array_to_string(regexp_extract_all(w, '{TOK}')[j * {cap} + 1 : (j + 1) * {cap}], ''), "
               f"'s': CASE WHEN j = 0 AND (k > 1 OR i = 1 OR NOT regexp_matches(q[i - 1], '[。！？；]$')) THEN ' ' ELSE '' END, "
               f"'n': least({s_ntok('w')} - j * {cap}, {cap})::INTEGER}})")
    sep = "CASE WHEN i = 1 OR NOT regexp_matches(q[i - 1], '[。！？；]$') THEN ' ' ELSE '' END"
    words = (f"flatten(list_transform(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> ''), "
             f"lambda w, k: CASE WHEN {s_ntok('w')} <= {cap} "
             f"THEN [{{'t': w, 's': CASE WHEN k > 1 THEN ' ' ELSE {sep} END, 'n': {s_ntok('w')}::INTEGER}}] ELSE {windows} END))")
    return (f"list_transform([{s_sentences(x)}], lambda q: flatten(list_transform(q, lambda s, i: CASE WHEN {s_ntok('s')} <= {cap} "
            f"THEN [{{'t': s, 's': {sep}, 'n': {s_ntok('s')}::INTEGER}}] ELSE {words} END)))[1]")


def s_pack(u: str, cap: int) -> str:
    """Greedy packing fold state; finish with :func:`s_pack_finish`."""
    return (f"list_reduce(list_transform({u}, lambda v: v.n), lambda st, x: "
            f"CASE WHEN st.c > 0 AND st.c + x > {cap} "
            f"THEN {{'out': list_append(st.out, {{'a': st.a, 'b': st.i}}), 'a': st.i + 1, 'c': x, 'i': st.i + 1}} "
            f"ELSE {{'out': st.out, 'a': st.a, 'c': st.c + x, 'i': st.i + 1}} END, "
            f"{{'out': []::STRUCT(a INTEGER, b INTEGER)[], 'a': 1, 'c': 0, 'i': 0}})")


def s_pack_overlap(u: str, cap: int, overlap: int) -> str:
    """The fold with overlap: ``w`` holds the counts of the open chunk's units; a new chunk
    starts with its last ``k`` units, as many as fit the overlap and, with ``x``, the cap."""
    k = (f"len(list_filter(range(1, len(st.w)), lambda m: list_sum(st.w[len(st.w) - m + 1 :]) <= {overlap} "
         f"AND list_sum(st.w[len(st.w) - m + 1 :]) + x <= {cap}))")
    return (f"list_reduce(list_transform({u}, lambda v: v.n), lambda st, x: "
            f"CASE WHEN st.c > 0 AND st.c + x > {cap} "
            f"THEN {{'out': list_append(st.out, {{'a': st.a, 'b': st.i}}), 'a': (st.i + 1 - {k})::INTEGER, "
            f"'c': (coalesce(list_sum(st.w[len(st.w) - {k} + 1 :]), 0) + x)::INTEGER, 'i': st.i + 1, "
            f"'w': list_append(st.w[len(st.w) - {k} + 1 :], x)}} "
            f"ELSE {{'out': st.out, 'a': st.a, 'c': st.c + x, 'i': st.i + 1, 'w': list_append(st.w, x)}} END, "
            f"{{'out': []::STRUCT(a INTEGER, b INTEGER)[], 'a': 1, 'c': 0, 'i': 0, 'w': []::INTEGER[]}})")


def s_pack_finish(r: str) -> str:
    return f"CASE WHEN {r}.i >= {r}.a THEN list_append({r}.out, {{'a': {r}.a, 'b': {r}.i}}) ELSE {r}.out END"


def s_span_texts(u: str, spans: str) -> str:
    return (f"list_transform({spans}, lambda sp: regexp_replace(array_to_string("
            f"list_transform({u}[sp.a : sp.b], lambda v: v.s || v.t), ''), '^ ', ''))")


def s_chunks_cte(size: int, src: str = "documents", overlap: int = 0, cap: int | None = None, ntok=s_ntok) -> str:
    """CTE chain ending in ``ch(doc_id, source, pos, text)`` (T1 -> T2 -> T5)."""
    cap = cap or size - 2
    pack = s_pack_overlap("u", cap, overlap) if overlap else s_pack("u", cap)
    return f"""
d0 AS (SELECT doc_id, source, {s_fold(s_clean('text'))} AS t FROM {src}),
d1 AS (SELECT doc_id, source, {s_units('t', cap, ntok)} AS u FROM d0),
d2 AS (SELECT doc_id, source, u, {pack} AS r FROM d1),
d3 AS (SELECT doc_id, source, {s_span_texts('u', s_pack_finish('r'))} AS cs FROM d2),
ch AS (SELECT doc_id, source, unnest(range(len(cs)))::INTEGER AS pos, unnest(cs) AS text FROM d3)"""


def s_embed_cte(src: str, id_col: str, text_col: str, prefix: str, dim: int = 384) -> str:
    """CTEs ``{prefix}v(id, b, w)``: nonzero entries of the hashed, normalised vectors
    and ``{prefix}n(id, nv)`` their norms (computed from the FLOAT values)."""
    return f"""
{prefix}tk AS (SELECT {id_col} AS id, md5(unnest(regexp_extract_all(lower({text_col}), '{TOK}'))) AS m FROM {src}),
{prefix}hb AS (SELECT id, (('0x' || substr(m, 1, 8))::BIGINT % {dim})::INTEGER AS b,
       CASE WHEN (('0x' || substr(m, 9, 1))::INTEGER % 2) = 0 THEN 1 ELSE -1 END AS s FROM {prefix}tk),
{prefix}ag AS (SELECT id, b, sum(s)::DOUBLE AS v FROM {prefix}hb GROUP BY ALL),
{prefix}nr AS (SELECT id, sqrt(sum(v * v)) AS nv FROM {prefix}ag GROUP BY ALL),
{prefix}v AS (SELECT a.id, a.b, (a.v / r.nv)::FLOAT AS w FROM {prefix}ag a JOIN {prefix}nr r USING (id) WHERE r.nv > 0),
{prefix}n AS (SELECT id, sqrt(sum(w::DOUBLE * w::DOUBLE)) AS nv FROM {prefix}v GROUP BY ALL)"""


def s_hits_cte(k: int = K, max_d: float = MAX_D) -> str:
    """Needs qv/qn (queries) and cv/cn (chunks) from s_embed_cte and ``ch`` rows
    keyed by chunk_id; gives ``hits(query_id, chunk_id, file_path, text, distance, rnk)``."""
    return f"""
dots AS (SELECT q.id AS query_id, c.id AS chunk_id, sum(q.w::DOUBLE * c.w::DOUBLE) AS dp
         FROM qv q JOIN cv c ON q.b = c.b GROUP BY ALL),
dist AS (SELECT d.query_id, d.chunk_id, round(greatest(1 - d.dp / (a.nv * b.nv), 0), 9) AS distance
         FROM dots d JOIN qn a ON a.id = d.query_id JOIN cn b ON b.id = d.chunk_id),
hits AS (SELECT t.query_id, t.chunk_id, x.file_path, x.text, t.distance,
         row_number() OVER (PARTITION BY t.query_id ORDER BY t.distance, t.chunk_id) AS rnk
         FROM dist t JOIN chx x ON x.chunk_id = t.chunk_id
         WHERE t.distance >= 0 AND t.distance < {max_d}
         QUALIFY rnk <= {k})"""


CHX_CTE = """
chx AS (SELECT source || '/' || doc_id::VARCHAR || '.txt#' || lpad(pos::VARCHAR, 10, '0') AS chunk_id, source || '/' || doc_id::VARCHAR || '.txt' AS file_path,
        pos, text FROM ch)"""

def dirty_spark():
    return F.concat(F.lit("  "), F.replace(F.col("text"), F.lit("\n"), F.lit(" \n\n\t ")), F.lit(" \n\n"))



DIRTY_SQL = "'  ' || replace(text, chr(10), ' ' || chr(10) || chr(10) || chr(9) || ' ') || ' ' || chr(10) || chr(10)"
def runs_spark():
    return F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n\n")), F.lit(", "), F.lit(",\n"))



RUNS_SQL = "replace(replace(text, '. ', '.' || chr(10) || chr(10) || chr(10)), ', ', ',' || chr(10))"


# ---------------------------------------------------------------------------
# Queries

def _file_each(rows):
    """A writer of a folder and file per ``doc_id``, by the tasks."""
    return FileEach(rows, "doc_id")


#: Largest file of a stream's source, as one task writes it.
SOURCE_FILE_BYTES = 256 << 20


def _in_files(rows, least):
    """``rows`` dealt into ``least`` files, more where these would be large."""
    return rows.repartition(max(least, -(-plan_bytes(rows) // SOURCE_FILE_BYTES)))


def q_s1_file_tree_ingest(spark, sf):
    """S1-S3 + E4 on files Spark derives from the documents table: each
    document written as its own .txt file (one folder per doc_id), then the
    tree is listed recursively, dispatched on extension, decoded, cleaned and
    chunked like any registered folder."""
    from chunkwise.plans.files import chunk_files, files_under

    root = scratch_path(spark, "s1-tree")
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    _file_each(docs).text(root)
    files, _ = files_under(spark, [root])
    chunks, failures = chunk_files(files, size=CHUNK, now=0)
    doc = F.regexp_extract("file_path", r"doc_id=(\d+)", 1).cast("long")
    return chunks.select(doc.alias("doc_id"), "pos", "text", TX.token_count("text").alias("n_tokens"))


def q_t1_clean(spark, sf):
    d = _t(spark, sf, "documents")
    return d.select("doc_id", TX.clean_text(dirty_spark()).alias("text"))


def q_t2_fold_newlines(spark, sf):
    d = _t(spark, sf, "documents")
    return d.select("doc_id", TX.fold_newlines(runs_spark()).alias("text"))


CONTROL_SQL = "replace(replace(text, '. ', chr(1) || '.' || chr(10) || chr(1)), ', ', chr(10) || chr(10) || chr(1))"


def q_t2_control_chars(spark, sf):
    """T2 on texts that hold control characters of their own: they are kept."""
    t = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit("\u0001.\n\u0001")), F.lit(", "), F.lit("\n\n\u0001"))
    return _t(spark, sf, "documents").select("doc_id", TX.fold_newlines(t).alias("text"))


def q_t3_token_count(spark, sf):
    d = _t(spark, sf, "documents")
    return d.select("doc_id", TX.token_count("text").alias("n_tokens"))


def _token_split(spark, sf, size):
    d = _t(spark, sf, "documents").select("doc_id", TX.normalize_text(F.col("text")).alias("text"))
    out = SP.split_tokens(d, "text", size=size, keep=["doc_id"])
    return out.select("doc_id", F.col("pos").cast("int").alias("pos"), "text",
                      TX.token_count("text").alias("n_tokens"))


def q_t5_token_chunks(spark, sf):
    return _token_split(spark, sf, CHUNK)


CJK_SQL = "replace(replace(replace(text, '. ', '。'), ', ', '，'), ' ', '')"
OVERLAP = 32


def q_t5_cjk(spark, sf):
    """T5 on documents in the manner of Chinese: full-width ends, no blanks."""
    t = F.replace(F.replace(F.replace(F.col("text"), F.lit(". "), F.lit("。")), F.lit(", "), F.lit("，")), F.lit(" "), F.lit(""))
    d = _t(spark, sf, "documents").select("doc_id", TX.normalize_text(t).alias("text"))
    return SP.split_tokens(d, "text", size=CHUNK, keep=["doc_id"]).select("doc_id", F.col("pos").cast("int").alias("pos"), "text")


def q_t5_overlap(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", TX.normalize_text(F.col("text")).alias("text"))
    return SP.split_tokens(d, "text", size=CHUNK, overlap=OVERLAP, keep=["doc_id"]).select("doc_id", F.col("pos").cast("int").alias("pos"), "text")


def quarter_bytes(texts: pa.Array) -> pa.Array:
    """A counter stated in SQL: a token for every four bytes begun."""
    import pyarrow.compute as pc

    return pc.divide(pc.add(pc.binary_length(texts.cast(pa.binary())), 3), 4)


def _counter():
    from chunkwise.functions.counter import TokenCounter

    return TokenCounter(quarter_bytes, special=3)


def q_t3_custom_counter(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", TX.token_count("text", _counter()).alias("n_tokens"))


def q_t5_custom_counter(spark, sf):
    """T5 by a counter of the user."""
    c = chunk_documents(_t(spark, sf, "documents"), size=CHUNK, counter=_counter(), add_time=0)
    return c.select("chunk_id", "pos", "text")


def q_e4_pdf_pages(spark, sf):
    """English documents are text files, the others PDFs whose pages (a document's lines) come from a
    page provider; it has none for the Spanish ones."""
    from chunkwise.plans.files import chunk_files

    d = _t(spark, sf, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "en", ".txt").otherwise(".pdf"))
    files = d.select(path.alias("path"), F.timestamp_seconds(F.lit(NOW)).alias("modificationTime"), F.octet_length("text").cast("long").alias("length"),
                     F.col("text").cast("binary").alias("content"), F.col("source").alias("root_path"))

    def provider(pdfs):
        lines = pdfs.join(d.where("lang <> 'es'").select(path.alias("path")), "path", "left_semi")
        return lines.select(F.col("path").alias("file_path"), F.posexplode(F.split(F.decode("content", "UTF-8"), "\n", -1)).alias("page_no", "text"))

    chunks, failures = chunk_files(files, pdf_pages=provider, size=CHUNK, now=0)
    return (chunks.select("file_path", "pos", "text", F.lit(None).cast("string").alias("error"))
            .unionByName(failures.select("file_path", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("text"), "error")))


def q_t4_token_pieces(spark, sf):
    return _token_split(spark, sf, PIECE)


def q_t6_sentence_pack(spark, sf):
    d = _t(spark, sf, "documents")
    out = SP.split_sentences(d, "text", n_words=T6_WORDS, keep=["doc_id"])
    return out.select("doc_id", F.col("pos").cast("int").alias("pos"), "text")


def q_e2_hash_embed(spark, sf):
    e = HashingEmbedder()
    b = _t(spark, sf, "benchmark").select("item_id", e.embed("text").alias("v"))
    # outer form: a plain generator would make Catalyst re-run the embedder in an inferred filter
    x = b.select("item_id", F.posexplode_outer("v").alias("dim", "value")).where(F.col("value") != 0)
    return x.select("item_id", F.col("dim").cast("int").alias("dim"), F.round(F.col("value").cast("double"), 6).alias("value"))


def _chunks(spark, sf, size=CHUNK):
    return chunk_documents(_t(spark, sf, "documents"), size=size, add_time=0)


def q_e3_large_doc_ids(spark, sf):
    """E3 with ids beyond 2**50: a chunk's id is its path and position, with no range of its own."""
    d = _t(spark, sf, "documents").withColumn("doc_id", F.col("doc_id") + F.lit(1 << 50))
    return chunk_documents(d, size=CHUNK, add_time=0).select("chunk_id", "file_path", "pos", "text")


def q_e3_embed_chunks(spark, sf):
    c = _chunks(spark, sf)
    ex = F.posexplode_outer("embedding")
    x = c.select("chunk_id", ex.alias("dim", "value")).where(F.col("value") != 0)
    return x.groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("nnz"),
        F.round(F.sum(F.col("value").cast("double") * (F.col("dim") + 1)), 5).alias("weighted"),
        F.round(F.sum(F.abs(F.col("value").cast("double"))), 5).alias("l1"))


def _emb(spark, sf):
    return _t(spark, sf, "embeddings")


def q_r1_nearest(spark, sf):
    e = _emb(spark, sf)
    first = e.orderBy("vec_id").select("embedding").first()  # one vector: the query
    out = nearest(e, first["embedding"], k=K, max_distance=0.9, corpus_id="vec_id")
    return out.select("vec_id", F.round("distance", 6).alias("distance"))


def _self_topk(spark, sf, max_d):
    e = _emb(spark, sf)
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    h = top_k(q, e, k=K, max_distance=max_d, corpus_id="vec_id", payload=["label"], dim=64)
    return h.select("query_id", "vec_id", "label", F.col("rank").cast("int").alias("rank"),
                    F.round("distance", 6).alias("distance"))


def q_r2_topk_06(spark, sf):
    return _self_topk(spark, sf, 0.6)


def q_r2_topk_09(spark, sf):
    return _self_topk(spark, sf, 0.9)


def q_r2_grid(spark, sf):
    """R2 with both sides large: query blocks of 150 vectors by corpus splits, dealt by a shuffle."""
    e = _emb(spark, sf)
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    h = top_k(q, e, k=K, max_distance=0.6, corpus_id="vec_id", payload=["label"], dim=64, max_broadcast_bytes=150 * 64 * 8)
    return h.select("query_id", "vec_id", "label", F.col("rank").cast("int").alias("rank"), F.round("distance", 6).alias("distance"))


def q_r2_topk_query_blocks(spark, sf):
    """The beyond-the-bound plan: a broadcast budget of 100 query vectors makes a grid
    of query blocks and corpus splits."""
    e = _emb(spark, sf)
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    h = top_k(q, e, k=K, max_distance=0.9, corpus_id="vec_id", payload=["label"], dim=64,
              max_broadcast_bytes=100 * 64 * 8)
    return h.select("query_id", "vec_id", "label", F.col("rank").cast("int").alias("rank"),
                    F.round("distance", 6).alias("distance"))


def _questions(spark, sf):
    return _t(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id")


def q_r3_markdown(spark, sf):
    return answer_markdown(_questions(spark, sf), _chunks(spark, sf), k=K, max_distance=MAX_D)


def q_r2_hits(spark, sf):
    h = retrieve(_questions(spark, sf), _chunks(spark, sf), k=K, max_distance=MAX_D)
    return h.select("query_id", "chunk_id", "file_path", F.col("rank").cast("int").alias("rank"),
                    F.round("distance", 6).alias("distance"))


def q_r4_context_prompt(spark, sf):
    qs = _questions(spark, sf)
    h = retrieve(qs, _chunks(spark, sf), k=K, max_distance=MAX_D)
    p = prompts(qs, h, include_question=False)
    return p.select("query_id", "n_hits", F.coalesce("system_prompt", F.lit("")).alias("system_prompt"), "user_prompt")


def q_r5_no_context_prompt(spark, sf):
    # distance bound 0.2: most questions find nothing and fall back to the general prompt
    qs = _questions(spark, sf)
    h = retrieve(qs, _chunks(spark, sf), k=K, max_distance=0.2)
    p = prompts(qs, h, include_question=True)
    return p.select("query_id", "n_hits", F.coalesce("system_prompt", F.lit("")).alias("system_prompt"), "user_prompt")


# ---------------------------------------------------------------------------
# Registry / settings tables derived from the driver tables

def _ext():
    return (F.when(F.col("lang") == "en", "txt").when(F.col("lang") == "de", "md")
            .when(F.col("lang") == "fr", "docx").otherwise("pdf"))


def _paths(spark, sf):
    d = _t(spark, sf, "documents")
    files = d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), _ext()).alias("file_path"))
    dirs = d.select(F.col("source").alias("file_path")).distinct()
    return files.unionByName(dirs)


def _registry(spark, sf, now=NOW):
    return SC.registry_rows(_paths(spark, sf), now)


def _doc_path(d):
    return F.concat(d["source"], F.lit("/"), d["doc_id"].cast("string"), F.lit("."), _ext())


def _settings(spark, sf):
    lab = _t(spark, sf, "labels")
    return lab.select(F.col("doc_id").alias("id"),
                      F.concat(F.lit("https://api.example.org/v1/"), F.col("doc_id").cast("string")).alias("url"),
                      F.md5(F.col("doc_id").cast("string")).alias("token"),
                      (F.col("quality") == 1).alias("state"), F.lit(0).cast("long").alias("time"))


def q_p1_scan_registry(spark, sf):
    t = VersionedTable(spark, scratch_path(spark, "registry"), files_schema())
    t.append(_registry(spark, sf))
    return t.read()


def q_p2_first_n(spark, sf):
    return SC.first_n(_registry(spark, sf), 25, order_by=("file_path",))


def q_p3_pending(spark, sf):
    lab = _t(spark, sf, "labels").where("quality = 1")
    d = _t(spark, sf, "documents")
    done = d.join(lab, "doc_id").select(_doc_path(d).alias("file_path"), F.lit(100).alias("progress"))
    files = MU.update_progress(_registry(spark, sf), done, LATER)
    return SC.pending(files, 30)


def q_p4_lookup(spark, sf):
    st = _settings(spark, sf)
    key = st.agg(F.min("id")).first()[0]  # one literal key taken from the data
    return SC.lookup(st, "id", key)


def q_p5_available(spark, sf):
    return SC.available(_settings(spark, sf), 20)


def q_p6_without_vector(spark, sf):
    return SC.without_vector(_t(spark, sf, "embeddings"))


def q_p7_registry_rows(spark, sf):
    return _registry(spark, sf)


def q_p8_chunk_rows(spark, sf):
    e = HashingEmbedder()
    b = _t(spark, sf, "benchmark").select("text", e.embed("text").alias("embedding"))
    r = SC.chunk_rows(b, "benchmark.txt", NOW)
    return r.select("file_path", "text", F.size("embedding").alias("dim"), "add_time")


def q_p9_first_vector(spark, sf):
    e = _t(spark, sf, "embeddings")
    mv = e.select("vec_id", F.array(F.col("embedding"), F.transform("embedding", lambda x: x * 2)).alias("mv"))
    r = mv.select("vec_id", first_vector("mv").alias("v"))
    return r.select("vec_id", F.round(F.aggregate("v", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double")), 6).alias("s"),
                    F.size("v").alias("dim"))


def q_m1_delete(spark, sf):
    d = _t(spark, sf, "documents")
    tox = d.join(_t(spark, sf, "labels").where("toxic = 1"), "doc_id").select(_doc_path(d).alias("file_path"))
    return MU.delete_keys(_registry(spark, sf), tox, "file_path")


def q_m1_bucketed_table_delete(spark, sf):
    """S10 + S11 + M1 through storage: chunks appended to a table bucketed by
    file_path, the toxic documents' files deleted by a keyed rewrite (only their
    buckets are rewritten), the table read back."""
    from chunkwise.schemas import chunks_schema

    t = VersionedTable(spark, scratch_path(spark, "m1-bucketed"), chunks_schema(), dim=384,
                       bucket_col="file_path", n_buckets=16)
    t.append(_chunks(spark, sf))
    d = _t(spark, sf, "documents")
    gone = d.join(_t(spark, sf, "labels").where("toxic = 1"), "doc_id").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"))
    t.rewrite_keys(gone, lambda old: MU.delete_keys(old, gone, "file_path"))
    return t.read().select("chunk_id", "file_path", "pos", "text")


def q_m2_cascade_delete(spark, sf):
    d = _t(spark, sf, "documents")
    gone = d.join(_t(spark, sf, "labels").where("toxic = 1"), "doc_id").select(F.col("source").alias("file_path")).distinct()
    files, chunks = MU.cascade_delete(_registry(spark, sf), _chunks(spark, sf), gone)
    return (files.select(F.lit("files").alias("tbl"), F.col("file_path").alias("key"))
            .unionByName(chunks.select(F.lit("chunks").alias("tbl"), F.col("chunk_id").cast("string").alias("key"))))


def q_m3_update_progress(spark, sf):
    lab = _t(spark, sf, "labels").where("quality = 1")
    d = _t(spark, sf, "documents")
    done = d.join(lab, "doc_id").select(_doc_path(d).alias("file_path"), F.lit(100).alias("progress"))
    return MU.update_progress(_registry(spark, sf), done, LATER)


def _token_changes(spark, sf, cond):
    return _t(spark, sf, "documents").where(cond).select(
        F.col("doc_id").alias("id"), F.concat(F.lit("https://api.example.org/v2/"), "source").alias("url"),
        F.concat(F.lit("new_"), F.md5("text")).alias("token"))


def q_m4_update_token(spark, sf):
    return MU.update_token(_settings(spark, sf), _token_changes(spark, sf, "lang = 'fr'"), LATER)


def q_m5_upsert_token(spark, sf):
    return MU.upsert_token(_settings(spark, sf), _token_changes(spark, sf, "lang = 'de'"), LATER)


def q_m5_upsert_rows(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    old = d.where("lang IN ('en', 'de')")
    new = d.where("lang IN ('de', 'fr')").withColumn("source", F.concat(F.lit("moved/"), "source"))
    return MU.upsert(old, new, "doc_id")


def q_m6_set_state(spark, sf):
    ids = _t(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return MU.set_state(_settings(spark, sf), ids, False, LATER)


def q_s6_assemble_pages(spark, sf):
    c = _t(spark, sf, "conversations")
    return PG.assemble_pages(c, doc_col="conv_id", page_col="turn", text_col="text")


def _parts(spark, sf):
    c = _t(spark, sf, "conversations")
    gaps = _t(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("conv_id"), F.lit(2).cast("long").alias("turn"))
    return c.join(gaps, ["conv_id", "turn"], "left_anti")


def q_s9_reassemble_parts(spark, sf):
    return PG.reassemble_parts(_parts(spark, sf), id_col="conv_id", part_col="turn", body_col="text", first=0)


def q_s8_check_digests(spark, sf):
    d = _t(spark, sf, "documents")
    exp = (d.where("lang IN ('en', 'de')")
           .select("doc_id", F.when(F.col("lang") == "en", F.md5("text")).otherwise(F.md5(F.concat("text", F.lit("x"))))
                   .alias("expected_md5")))
    return PG.check_digests(d, exp, id_col="doc_id", content_col="text")


def q_x2_latest_status(spark, sf):
    ev = _t(spark, sf, "events")
    return ST.latest_status(ev, key="user_id", ts_col="ts", tie_col="event_id",
                            cols=["event_id", "event_type", "value", "ts"])


def _status_log(spark, sf):
    ev = _t(spark, sf, "events")
    d = _t(spark, sf, "documents")
    docs = d.select(F.col("doc_id").alias("user_id"), _doc_path(d).alias("file_path"))
    prog = (F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 50)
            .when(F.col("event_type") == "purchase", 100).when(F.col("event_type") == "error", -1).otherwise(0))
    return ev.join(docs, "user_id").select(
        "file_path", prog.cast("int").alias("progress"), "ts",
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"))


def q_x5_status_view(spark, sf):
    return ST.status_view(_registry(spark, sf), _status_log(spark, sf))


def q_x6_register(spark, sf):
    d = _t(spark, sf, "documents").where("lang = 'fr'")
    again = SC.registry_rows(d.select(_doc_path(d).alias("file_path")), LATER)
    return ST.register(_registry(spark, sf), again, dedupe=True)


# ---------------------------------------------------------------------------
# Semantic chunker operators (row form) and the whole chunker

def _pieces(spark, sf):
    p = _token_split(spark, sf, PIECE)
    return p.withColumn("embedding", HashingEmbedder().embed("text"))


# Statistics are taken per (document, batch of 64 pieces), as in the reference;
# driver documents have at most 64 pieces, so the SQL states them per document.
DOC_BATCH = ["doc_id", "batch"]


def _piece_scores(spark, sf):
    p = SE.with_batches(_pieces(spark, sf), "doc_id", "pos")
    return SE.context_similarity(p, DOC_BATCH, "pos", "embedding").drop("embedding", "text")


def _marked(spark, sf):
    sc = _piece_scores(spark, sf)
    b = SE.score_bounds(sc, DOC_BATCH).select(*DOC_BATCH, "median")
    return SE.split_points(sc.join(b, DOC_BATCH, "left"), F.col("median"))


def q_c1_context_similarity(spark, sf):
    e = SE.with_batches(_emb(spark, sf), "label", "vec_id")
    s = SE.context_similarity(e, ["label", "batch"], "vec_id", "embedding")
    return s.select("label", "vec_id", F.round("score", 6).alias("score"))


def q_c1_piece_similarity(spark, sf):
    return _piece_scores(spark, sf).select("doc_id", "pos", F.round("score", 6).alias("score"))


def q_c2_cumulative_tokens(spark, sf):
    p = _token_split(spark, sf, PIECE)
    return SE.cumulative_tokens(p, "doc_id", "pos", "n_tokens").select("doc_id", "pos", "n_tokens", "cum_tokens")


def q_c3_score_bounds(spark, sf):
    b = SE.score_bounds(_piece_scores(spark, sf), DOC_BATCH)
    return b.select("doc_id", *[F.round(c, 6).alias(c) for c in ("median", "sd", "low", "high")])


def q_c6_split_points(spark, sf):
    return _marked(spark, sf).select("doc_id", "pos", "split_before")


def q_c4_segment_median(spark, sf):
    return SE.segment_token_median(_marked(spark, sf), DOC_BATCH, "pos", "n_tokens").drop("batch")


def q_c7_assemble_keep(spark, sf):
    return SE.assemble_at(_marked(spark, sf), DOC_BATCH, "pos", "n_tokens",
                          o=SE.SemanticOptions(short_buffer="keep")).drop("batch")


def q_c7_assemble_drop(spark, sf):
    return SE.assemble_at(_marked(spark, sf), DOC_BATCH, "pos", "n_tokens",
                          o=SE.SemanticOptions(short_buffer="drop")).drop("batch")


def q_c5_threshold(spark, sf):
    sc = _piece_scores(spark, sf)
    t = SE.thresholds(sc, DOC_BATCH, "pos", "n_tokens")
    return t.select("doc_id", F.round("threshold", 9).alias("threshold"), "rounds")


def q_c8_semantic_chunks(spark, sf):
    c = chunk_documents(_t(spark, sf, "documents"), add_time=0, strategy="semantic")
    return c.select("chunk_id", "file_path", "pos", "text", TX.token_count("text").alias("n_tokens"))


def q_c8_rounds(spark, sf):
    """C8 over piece rows, a round for each batch of pieces."""
    from chunkwise.operators.semantic_rounds import chunk_pieces

    d = _t(spark, sf, "documents").select("doc_id", "source", TX.normalize_text(F.col("text")).alias("text"))
    pieces = SP.split_tokens(d, "text", size=PIECE, keep=["doc_id", "source"])
    c = chunk_pieces(pieces, HashingEmbedder(), ["doc_id", "source"])
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return c.select(F.concat(path, F.lit("#"), F.lpad(F.col("chunk_no").cast("string"), 10, "0")).alias("chunk_id"), path.alias("file_path"),
                    F.col("chunk_no").alias("pos"), "text", TX.token_count("text").alias("n_tokens"))


def q_c8_drop(spark, sf):
    """C8 that discards a short buffer on overflow, as the reference does."""
    c = chunk_documents(_t(spark, sf, "documents"), add_time=0, strategy="semantic", semantic_options=SE.SemanticOptions(short_buffer="drop"))
    return c.select("chunk_id", "file_path", "pos", "text", TX.token_count("text").alias("n_tokens"))


def q_c8_semantic_vectors(spark, sf):
    """Chunk vectors of the semantic chunker (summed piece counts) = embedding the chunk text."""
    c = chunk_documents(_t(spark, sf, "documents"), add_time=0, strategy="semantic")
    x = c.select("chunk_id", F.posexplode_outer("embedding").alias("dim", "value")).where(F.col("value") != 0)
    return x.groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("nnz"),
        F.round(F.sum(F.col("value").cast("double") * (F.col("dim") + 1)), 5).alias("weighted"),
        F.round(F.sum(F.abs(F.col("value").cast("double"))), 5).alias("l1"))


def q_c9_sentence_strategy(spark, sf):
    c = chunk_documents(_t(spark, sf, "documents"), add_time=0, strategy="sentence")
    return c.select("chunk_id", "root_path", "file_path", "pos", "text", "add_time")


def q_x1_stream_ingest(spark, sf):
    """The documents file replayed as a file stream (availableNow) through
    foreachBatch into a batch-partitioned chunk table; must equal the batch job."""
    from chunkwise.streaming.ingest import stream_documents

    chunks_path, status_path = scratch_path(spark, "x1-chunks"), scratch_path(spark, "x1-status")
    # a pattern, as the table is one file or a folder of files
    q = stream_documents(spark, os.path.join(sf, "documents.parque[t]"), chunks_path, status_path, trigger={"availableNow": True})
    q.awaitTermination()
    out = spark.read.parquet(chunks_path)
    return out.select("chunk_id", "root_path", "file_path", "pos", "text", F.lit(0).cast("long").alias("add_time"))


# ---------------------------------------------------------------------------
# Sources, tables and streams through storage

MD_PLAIN = r"[^\p{L}\p{N} .,\n]"


def _md_plain(c):
    return F.regexp_replace(c, MD_PLAIN, "")


def _as_files(spark, sf):
    """binaryFile rows that Spark derives from the documents: txt, decorated md, docx, csv by language."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    d = _t(spark, sf, "documents")
    ext = F.when(F.col("lang") == "en", "txt").when(F.col("lang") == "de", "MD").when(F.col("lang") == "fr", "docx").otherwise("csv")
    md = F.concat(F.lit("---\nkey: value\n---\n## "), F.replace(F.replace(F.replace(
        _md_plain(F.col("text")), F.lit(" die "), F.lit(" **die** ")), F.lit(" und "), F.lit(" [und](http://x/y) ")), F.lit(" der "), F.lit(" `der` ")))

    @F.arrow_udf("binary")
    def docx(texts: pa.Array) -> pa.Array:
        ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        out = []
        for t in texts.to_pylist():
            if t is None:
                out.append(None)
                continue
            body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in t.split("\n"))
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
            out.append(buf.getvalue())
        return pa.array(out, pa.binary())

    content = (F.when(F.col("lang") == "de", md.cast("binary"))
               .when(F.col("lang") == "fr", docx(F.when(F.col("lang") == "fr", F.col("text")))).otherwise(F.col("text").cast("binary")))
    rows = d.select(F.concat(F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"),
                    F.timestamp_seconds(F.lit(NOW) + F.col("doc_id")).alias("modificationTime"), content.alias("content"))
    return rows.withColumn("length", F.octet_length("content").cast("long"))


def q_s2_dispatch_files(spark, sf):
    """Txt, Markdown and DOCX contents, an unsupported kind, and file metadata."""
    from chunkwise.sources.files import extract_text

    out = extract_text(_as_files(spark, sf), docx_separator="\n")
    size = F.when(F.col("file_type") != "docx", F.col("size"))  # a zip's size is no part of the contract
    return out.select("file_path", "file_type", "text", "error", TX.epoch_seconds("modified_at").alias("modified"), size.alias("size"))


SQL_S2 = r"""WITH d AS (SELECT *, regexp_replace(text, '[^\p{L}\p{N} .,\n]', '', 'g') AS p FROM documents)
SELECT doc_id::VARCHAR || CASE lang WHEN 'en' THEN '.txt' WHEN 'de' THEN '.MD' WHEN 'fr' THEN '.docx' ELSE '.csv' END AS file_path,
       CASE lang WHEN 'en' THEN 'txt' WHEN 'de' THEN 'md' WHEN 'fr' THEN 'docx' ELSE 'csv' END AS file_type,
       CASE WHEN lang IN ('en', 'fr') THEN text WHEN lang = 'de' THEN p END AS text,
       CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'unsupported: csv' END AS error, (1700000000 + doc_id)::BIGINT AS modified,
       CASE WHEN lang = 'de' THEN strlen('---' || chr(10) || 'key: value' || chr(10) || '---' || chr(10) || '## ' || replace(replace(replace(
                 p, ' die ', ' **die** '), ' und ', ' [und](http://x/y) '), ' der ', ' `der` '))
            WHEN lang <> 'fr' THEN strlen(text) END::BIGINT AS size FROM d"""


def q_s6_stream_chunks(spark, sf):
    """Every conversation as a document whose pages are its turns, chunked page by page."""
    from chunkwise.plans.ingest import chunk_pages

    c = chunk_pages(_t(spark, sf, "conversations"), doc_col="conv_id", page_col="turn", size=64, add_time=0)
    return c.select("chunk_id", "pos", "text")


def q_s9_merged_text(spark, sf):
    return PG.merge_parts(_parts(spark, sf), id_col="conv_id", part_col="turn", body_col="text", first=0)


def q_t8_epoch_seconds(spark, sf):
    return _t(spark, sf, "events").select("event_id", TX.epoch_seconds("ts").alias("seconds"))


def letter_counts(texts):
    """A model stated in SQL: counts of five letters and the length."""
    import numpy as np

    rows = [[t.count(c) for c in "aeiou"] + [len(t)] for t in texts.to_pylist()]
    return np.array(rows, np.float32).reshape(len(rows), 6)


def q_e1_batched_embed(spark, sf):
    """A pluggable embedder called with at most 32 texts at a time."""
    from chunkwise.operators.embed import ArrowEmbedder

    e = ArrowEmbedder(letter_counts, 6)
    x = _t(spark, sf, "documents").select("doc_id", F.posexplode(e.embed(F.col("text"))).alias("dim", "value"))
    return x.select("doc_id", "dim", F.round(F.col("value").cast("double"), 4).alias("value"))


def q_e1_reuse(spark, sf):
    """English documents are embedded first, then all, whose texts hold copies: only new texts meet the model."""
    from chunkwise.operators.embed import ArrowEmbedder
    from chunkwise.operators.vector_store import VectorStore

    d = _t(spark, sf, "documents").select("doc_id", "text", "lang")
    store, model = VectorStore(spark, scratch_path(spark, "e1-store"), "letters-1"), ArrowEmbedder(letter_counts, 6)
    store.embed(d.where("lang = 'en'"), model)
    done = store.embed(d, model).select("doc_id", F.posexplode("embedding").alias("dim", "value"))
    stored = store.table.read().agg(F.count("*").alias("n_embedded"))
    return done.select("doc_id", "dim", F.round(F.col("value").cast("double"), 4).alias("value")).join(F.broadcast(stored))


def q_e5_options(spark, sf):
    from chunkwise.operators.embed import EmbedOptions

    c = chunk_documents(_t(spark, sf, "documents"), options=EmbedOptions(chunk_size=128, strategy="sentence"), add_time=0)
    return c.select("chunk_id", "pos", "text")


def call_sizes(texts):
    """A model that tells how many texts it got."""
    import numpy as np

    return np.full((len(texts), 2), float(len(texts)))


def q_e5_batch(spark, sf):
    """E5: the model sees as many texts at a time as the options say, and no more."""
    from chunkwise.operators.embed import ArrowEmbedder, EmbedOptions

    c = chunk_documents(_t(spark, sf, "documents"), options=EmbedOptions(chunk_size=CHUNK, batch_size=7, strategy="sentence"),
                        embedder=ArrowEmbedder(call_sizes, 2), add_time=0)
    return c.agg(F.count("*").alias("n_chunks"), F.max(F.get("embedding", 0)).cast("int").alias("largest_call"))


def _chunk_table(spark, name, **options):
    from chunkwise.schemas import chunks_schema

    return VersionedTable(spark, scratch_path(spark, name), chunks_schema(), dim=384, **options)


def q_s12_compact(spark, sf):
    """One append per language to a bucketed table, maintenance, read back."""
    from chunkwise.sources.tables import maintain

    t = _chunk_table(spark, "s12", bucket_col="file_path", n_buckets=8)
    d = _t(spark, sf, "documents")
    for lang in ("en", "de", "fr", "es"):
        t.append(chunk_documents(d.where(F.col("lang") == lang), size=CHUNK, add_time=0))
    maintain([t], target_files=2, keep=1)
    return t.read().select("chunk_id", "file_path", "pos", "text")


def q_m2_table_delete(spark, sf):
    """M2 through storage: sources with a toxic document leave registry and chunk table by key lists."""
    from chunkwise.plans.sync import remove_paths

    d = _t(spark, sf, "documents")
    reg = VersionedTable(spark, scratch_path(spark, "m2-files"), files_schema())
    reg.append(_registry(spark, sf))
    ch = _chunk_table(spark, "m2-chunks")
    ch.append(_chunks(spark, sf))
    gone = d.join(_t(spark, sf, "labels").where("toxic = 1"), "doc_id").select(F.col("source").alias("file_path")).distinct()
    remove_paths(reg, ch, gone)
    return (reg.read().select(F.lit("files").alias("tbl"), F.col("file_path").alias("key"))
            .unionByName(ch.read().select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("key"))))


def q_m3_duplicate_updates(spark, sf):
    """M3 with several updates of a path: the last by its order column wins."""
    d = _t(spark, sf, "documents")
    one = d.select(_doc_path(d).alias("file_path"), F.lit(50).alias("progress"), F.lit(2).alias("step"))
    two = d.where("lang = 'en'").select(_doc_path(d).alias("file_path"), F.lit(100).alias("progress"), F.lit(3).alias("step"))
    old = d.select(_doc_path(d).alias("file_path"), F.lit(-1).alias("progress"), F.lit(1).alias("step"))
    return MU.update_progress(_registry(spark, sf), old.union(two).union(one), LATER, order_by="step").select("file_path", "progress", "sync_time")


def _stream(spark, src, **options):
    from chunkwise.streaming.ingest import stream_documents

    out = {"chunks": scratch_path(spark, "st-chunks"), "status": scratch_path(spark, "st-status")}
    out |= options.pop("paths", {})
    stream_documents(spark, src, out["chunks"], out["status"], max_files_per_trigger=1, trigger={"availableNow": True}, **options).awaitTermination()
    return out


CHUNK_COLUMNS = ["chunk_id", "root_path", "file_path", "pos", "text"]


def q_x1_stream_restart(spark, sf):
    """Documents in several files, two starts, several micro-batches, one without a chunk."""
    src = scratch_path(spark, "st-src")
    d = _t(spark, sf, "documents")
    _in_files(d.where("lang = 'en'"), 2).write.parquet(src)
    paths = _stream(spark, src)
    _in_files(d.withColumn("text", F.lit(" \n")), 1).write.mode("append").parquet(src)
    _in_files(d.where("lang <> 'en'"), 2).write.mode("append").parquet(src)
    _stream(spark, src, paths=paths)
    return spark.read.parquet(paths["chunks"]).select(*CHUNK_COLUMNS, F.lit(0).cast("long").alias("add_time"))


def q_s13_callback_rows(spark, sf):
    """The rows a callback gets, written by it to a table of its own."""
    t = _chunk_table(spark, "s13")
    src = scratch_path(spark, "s13-src")
    _in_files(_t(spark, sf, "documents"), 3).write.parquet(src)
    _stream(spark, src, on_batch=lambda rows, batch: t.append(rows))
    return t.read().select(*CHUNK_COLUMNS, F.lit(0).cast("long").alias("add_time"))


def q_x2_stage_log(spark, sf):
    """Stages 1, 50, 100 of every file; files without text end at -1."""
    src = scratch_path(spark, "x2-src")
    _in_files(_t(spark, sf, "documents").withColumn("text", F.when(F.col("lang") == "es", F.lit("")).otherwise(F.col("text"))), 2).write.parquet(src)
    return spark.read.parquet(_stream(spark, src)["status"]).select("file_path", "progress", "error")


def _tables(spark, name, *kinds):
    from chunkwise.schemas import status_log_schema

    made = {"files": lambda at: VersionedTable(spark, at, files_schema()), "log": lambda at: VersionedTable(spark, at, status_log_schema())}
    return [_chunk_table(spark, name) if k == "chunks" else made[k](scratch_path(spark, f"{name}-{k}")) for k in kinds]


def q_x3_stream_table_replace(spark, sf):
    """Documents stream into the chunk table, come again with other texts (Spanish ones
    empty) after a restart, and the files of toxic documents are removed."""
    from chunkwise.streaming.table_sink import stream_documents_into

    chunks, log = _tables(spark, "x3", "chunks", "log")
    src, checkpoint = scratch_path(spark, "x3-src"), scratch_path(spark, "x3-checkpoint")
    d = _t(spark, sf, "documents")

    def run():
        stream_documents_into(chunks, src, checkpoint, status_log=log, max_files_per_trigger=2, trigger={"availableNow": True}).awaitTermination()

    def arrive(texts):
        with shuffles_removed(spark):
            _in_files(d.withColumn("text", texts), 3).write.mode("append").parquet(src, compression="zstd")
        run()

    arrive(F.concat(F.lit("An older text. "), F.col("text")))
    arrive(F.when(F.col("lang") == "es", F.lit(" \n")).otherwise(F.col("text")))
    toxic = d.join(_t(spark, sf, "labels").where("toxic = 1"), "doc_id")
    chunks.change(toxic.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path")), "file_path")
    return chunks.read().select("chunk_id", "file_path", "pos", "text")


def _language_folders(spark, sf, name):
    """A folder per language with a file per document; Spanish ones are of an unsupported kind."""
    root = scratch_path(spark, name)
    d = _t(spark, sf, "documents").select("doc_id", "text", "lang")
    for lang in ("en", "de", "fr", "es"):
        rows = _file_each(d.where(F.col("lang") == lang).select("doc_id", "text"))
        rows.csv(f"{root}/{lang}") if lang == "es" else rows.text(f"{root}/{lang}")
    return root


def _register(spark, registry, paths, now):
    registry.append(SC.registry_rows(spark.createDataFrame([(p,) for p in paths], "file_path string"), now))


def _doc_of(path="file_path"):
    return F.regexp_extract(path, r"doc_id=(\d+)", 1).try_cast("long").alias("doc_id")


def q_x1_registry_stream(spark, sf):
    """The registry is the stream's source: folders registered before the first start, late ones, and one
    that fails (it does not exist yet) and is retried."""
    from chunkwise.plans.sync import retry_failed
    from chunkwise.streaming.table_sink import stream_registry

    registry, chunks, log = _tables(spark, "x1", "files", "chunks", "log")
    root, checkpoint = _language_folders(spark, sf, "x1-tree"), scratch_path(spark, "x1-checkpoint")
    clock = iter(range(NOW + 10, LATER))

    def run():
        stream_registry(registry, chunks, checkpoint, lambda: next(clock), status_log=log, limit=2, size=CHUNK, trigger={"availableNow": True}).awaitTermination()

    _register(spark, registry, [f"{root}/en", f"{root}/de", f"{root}/again"], NOW)
    run()
    _register(spark, registry, [f"{root}/fr"], NOW + 1)
    again = _t(spark, sf, "documents").where("lang = 'es'").select("doc_id", "text")
    _file_each(again).text(f"{root}/again")
    retry_failed(registry, NOW + 2)
    run()
    state = registry.read().select(F.col("file_path").alias("root_path"), "progress")
    return chunks.read().join(state, "root_path").select(_doc_of(), "pos", "text", "progress")


def q_x2_failed_file(spark, sf):
    """The last stage of every file and registered path; all rows of the step have the same second."""
    from chunkwise.plans.sync import sync_pending

    registry, chunks, log = _tables(spark, "x2", "files", "chunks", "log")
    root = _language_folders(spark, sf, "x2-tree")
    _register(spark, registry, [f"{root}/{x}" for x in ("en", "de", "fr", "es", "none")], NOW)
    sync_pending(spark, registry, chunks, LATER, status_log=log, size=CHUNK)
    return ST.latest_status(log.read()).select(
        F.coalesce(_doc_of().cast("string"), F.element_at(F.split("file_path", "/"), -1)).alias("what"), "progress",
        F.regexp_replace("error", r"^\d+ of \d+ files failed: ", "files failed: ").alias("error"))


def q_m2_many_changes(spark, sf):
    """32 keyed changes of the registry, read by one join: files are updated in 32 steps by number, those of
    toxic documents removed at the end, and the first step's come again."""
    registry, = _tables(spark, "m2n", "files")
    rows = _registry(spark, sf)
    registry.append(rows)
    step = F.pmod(F.coalesce(F.regexp_extract("file_path", r"/(\d+)\.", 1).try_cast("long"), F.lit(0)), F.lit(31))
    at = scratch_path(spark, "m2n-steps")  # a folder per step, so a step reads its own files only
    rows.withColumn("_step", step).write.partitionBy("_step").parquet(at)
    rows = spark.read.schema(T.StructType([*files_schema(), T.StructField("_step", T.IntegerType())])).parquet(at)
    step = F.col("_step")
    for k in range(31):
        mine = rows.where(step == k).drop("_step")
        registry.change(mine.select("file_path"), "file_path", mine.withColumn("progress", F.lit(100)).withColumn("sync_time", F.lit(NOW + k).cast("long")))
    toxic = _t(spark, sf, "documents").join(_t(spark, sf, "labels").where("toxic = 1"), "doc_id")
    registry.change(toxic.select(_doc_path(toxic).alias("file_path")), "file_path")
    registry.append(rows.where(step == 0).drop("_step").withColumn("progress", F.lit(50)))
    return registry.read().select("file_path", "progress", "sync_time")


def q_x5_incremental(spark, sf):
    """X5 from a table of latest rows that a stream keeps while the log grows (by event type, so out of order)."""
    from chunkwise.streaming.table_sink import stream_status

    log, latest = _tables(spark, "x5", "log", "log")
    checkpoint = scratch_path(spark, "x5-checkpoint")
    rows = _status_log(spark, sf).withColumn("seq", F.lit(None).cast("long"))
    for some in ("progress = 100", "progress IN (0, 50)", "progress IN (-1, 1)"):
        log.append(rows.where(some))
        stream_status(log, latest, checkpoint, commits_per_trigger=1, trigger={"availableNow": True}).awaitTermination()
    return ST.status_view(_registry(spark, sf), latest.read())


def q_x4_maintenance(spark, sf):
    """Hourly maintenance of both tables after removals and changes: one version, one set of folders, the same rows."""
    from chunkwise.plans.sync import remove_paths
    from chunkwise.sources.tables import maintain

    registry, chunks = _tables(spark, "x4", "files", "chunks")
    registry.append(_registry(spark, sf))
    chunks.append(_chunks(spark, sf))
    d = _t(spark, sf, "documents")
    gone = d.join(_t(spark, sf, "labels").where("toxic = 1"), "doc_id").select(F.col("source").alias("file_path")).distinct()
    remove_paths(registry, chunks, gone)
    maintain([registry, chunks], target_files=4, keep=1)
    one = lambda t, key: t.read().select(F.col(key).alias("key"), F.lit(len(t.versions())).alias("n_versions"),
                                         F.lit(len(t._manifest()["deletes"])).alias("n_deletes"))
    return one(registry, "file_path").withColumn("tbl", F.lit("files")).unionByName(one(chunks, "chunk_id").withColumn("tbl", F.lit("chunks")))


# ---------------------------------------------------------------------------
# Answer routing with a stub generator (stands in for the user's model call)

def stub_generator(system, prompt, url, token):
    """Deterministic stand-in: fails when the prompt length is a multiple of 3."""
    if len(prompt) % 3 == 0:
        raise RuntimeError("stub generator failure")
    return f"answer:{len(prompt)}:{'general' if system else 'context'}:{url[-2:]}"


def _answer_questions_input(spark, sf):
    """Benchmark questions; the toxic-labelled ids get an empty question (hint path)."""
    b = _t(spark, sf, "benchmark")
    tox = _t(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("item_id"), F.lit(True).alias("_t"))
    return (b.join(tox, "item_id", "left")
            .select(F.col("item_id").alias("query_id"), F.when(F.col("_t"), F.lit("")).otherwise(F.col("text")).alias("text")))


def _one_setting(spark, state):
    return spark.createDataFrame([(1, "https://api.example.org/v1", "token1", state, NOW)],
                                 "id long, url string, token string, state boolean, time long")


def q_r6_answer_generator(spark, sf):
    a = answer_questions(_answer_questions_input(spark, sf), _chunks(spark, sf), _one_setting(spark, True), stub_generator)
    return a.select("query_id", "answer", "source", "n_hits", "generator_failed")


def q_r7_answer_disabled(spark, sf):
    a = answer_questions(_answer_questions_input(spark, sf), _chunks(spark, sf), _one_setting(spark, False), stub_generator)
    return a.select("query_id", "answer", "source", "n_hits", "generator_failed")


# ---------------------------------------------------------------------------
# Oracle SQL

def _sql_md(k=K, max_d=MAX_D) -> str:
    return f"""WITH {s_chunks_cte(CHUNK)},{CHX_CTE},
{s_embed_cte('chx', 'chunk_id', 'text', 'c')},
{s_embed_cte('benchmark', 'item_id', 'text', 'q')},
{s_hits_cte(k, max_d)},
pf AS (SELECT query_id, file_path, min(rnk) AS best,
       '### File: ' || file_path || chr(10) || chr(10) || string_agg('- ' || text || chr(10), '' ORDER BY rnk)
       || chr(10) || '---' || chr(10) || chr(10) AS blk FROM hits GROUP BY query_id, file_path),
md AS (SELECT query_id, string_agg(blk, '' ORDER BY best, file_path) AS markdown FROM pf GROUP BY ALL),
nh AS (SELECT query_id, count(*)::INTEGER AS n_hits FROM hits GROUP BY ALL)
SELECT b.item_id AS query_id, coalesce(nh.n_hits, 0)::INTEGER AS n_hits, coalesce(md.markdown, '') AS markdown
FROM benchmark b LEFT JOIN nh ON nh.query_id = b.item_id LEFT JOIN md ON md.query_id = b.item_id"""


def _sql_prompts(max_d, include_question) -> str:
    from chunkwise.operators.render import CONTEXT_PREAMBLE, QUESTION_HEADING, REMOTE_PREAMBLE

    def lit(s):
        return "'" + s.replace("'", "''") + "'"
    ctx = f"{lit(CONTEXT_PREAMBLE)} || c.context"
    if include_question:
        ctx += f" || {lit(QUESTION_HEADING)} || b.text"
    return f"""WITH {s_chunks_cte(CHUNK)},{CHX_CTE},
{s_embed_cte('chx', 'chunk_id', 'text', 'c')},
{s_embed_cte('benchmark', 'item_id', 'text', 'q')},
{s_hits_cte(K, max_d)},
cx AS (SELECT query_id, string_agg(text, chr(10) ORDER BY rnk) AS context, count(*)::INTEGER AS n_hits FROM hits GROUP BY ALL)
SELECT b.item_id AS query_id, coalesce(c.n_hits, 0)::INTEGER AS n_hits,
       CASE WHEN coalesce(c.n_hits, 0) > 0 THEN '' ELSE {lit(REMOTE_PREAMBLE)} END AS system_prompt,
       CASE WHEN coalesce(c.n_hits, 0) > 0 THEN {ctx} ELSE b.text END AS user_prompt
FROM benchmark b LEFT JOIN cx c ON c.query_id = b.item_id"""


def _sql_self_topk(max_d) -> str:
    return f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id, c.label,
      round(greatest(1 - list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))), 0), 9) AS d
      FROM e q, e c)
SELECT query_id, vec_id, label, rnk::INTEGER AS rank, round(d, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rnk FROM p WHERE d >= 0 AND d < {max_d})
WHERE rnk <= {K}"""


def _sql_tokens(size: int) -> str:
    return f"""WITH {s_chunks_cte(size)}
SELECT doc_id, pos, text, ({s_ntok('text')} + 2)::INTEGER AS n_tokens FROM ch"""


SQL_T6 = f"""WITH s AS (
  SELECT doc_id, text,
    list_reduce(string_split_regex(regexp_replace(text, '[.;]\\z', ''), '[.;]'),
      lambda st, x: CASE WHEN len(list_concat(st.cur, list_filter(regexp_split_to_array(x || '.', '\\s+'), lambda w: w <> ''))) >= {T6_WORDS}
        THEN {{'out': list_append(st.out, array_to_string(list_concat(st.cur, list_filter(regexp_split_to_array(x || '.', '\\s+'), lambda w: w <> '')), ' ')), 'cur': []::VARCHAR[]}}
        ELSE {{'out': st.out, 'cur': list_concat(st.cur, list_filter(regexp_split_to_array(x || '.', '\\s+'), lambda w: w <> ''))}} END,
      {{'out': []::VARCHAR[], 'cur': []::VARCHAR[]}}) AS r
  FROM documents),
c AS (SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN []::VARCHAR[]
                          WHEN octet_length(encode(text)) < {T6_WORDS} THEN [text]
                          WHEN len(r.cur) > 0 THEN list_append(r.out, array_to_string(r.cur, ' '))
                          ELSE r.out END AS cs FROM s)
SELECT doc_id, unnest(range(len(cs)))::INTEGER AS pos, unnest(cs) AS text FROM c"""


EXT_SQL = "CASE lang WHEN 'en' THEN 'txt' WHEN 'de' THEN 'md' WHEN 'fr' THEN 'docx' ELSE 'pdf' END"
DOC_PATH_SQL = f"source || '/' || doc_id::VARCHAR || '.' || {EXT_SQL}"
REGISTRY_SQL = f"""registry AS (
  SELECT regexp_extract(p, '[^/]+$') AS name, p AS file_path,
         CASE WHEN regexp_matches(regexp_extract(p, '[^/]+$'), '^.+\\.[^.]*$')
              THEN nullif(regexp_extract(regexp_extract(p, '[^/]+$'), '^.+\\.([^.]*)$', 1), '') END AS file_type,
         {NOW}::BIGINT AS add_time, 0::BIGINT AS sync_time, 0::INTEGER AS progress
  FROM (SELECT {DOC_PATH_SQL} AS p FROM documents UNION ALL SELECT DISTINCT source FROM documents))"""
SETTINGS_SQL = """settings AS (
  SELECT doc_id AS id, 'https://api.example.org/v1/' || doc_id::VARCHAR AS url, md5(doc_id::VARCHAR) AS token,
         quality = 1 AS state, 0::BIGINT AS time FROM labels)"""
UPDATED_SQL = f"""done AS (SELECT {DOC_PATH_SQL} AS file_path FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
updated AS (SELECT r.name, r.file_path, r.file_type, r.add_time,
  CASE WHEN d.file_path IS NOT NULL THEN {LATER} ELSE r.sync_time END::BIGINT AS sync_time,
  CASE WHEN d.file_path IS NOT NULL THEN 100 ELSE r.progress END::INTEGER AS progress
  FROM registry r LEFT JOIN (SELECT DISTINCT file_path FROM done) d USING (file_path))"""


def _sql_token_changes(cond):
    return f"""ch AS (SELECT doc_id AS id, 'https://api.example.org/v2/' || source AS url, 'new_' || md5(text) AS token
       FROM documents WHERE {cond})"""


def _sql_p_m_x() -> dict[str, str]:
    return {
        "p1_scan_registry": f"WITH {REGISTRY_SQL} SELECT * FROM registry",
        "p2_first_n": f"WITH {REGISTRY_SQL} SELECT * FROM registry ORDER BY file_path LIMIT 25",
        "p3_pending": f"WITH {REGISTRY_SQL}, {UPDATED_SQL} SELECT * FROM updated WHERE progress = 0 ORDER BY add_time, file_path LIMIT 30",
        "p4_lookup": f"WITH {SETTINGS_SQL} SELECT * FROM settings WHERE id = (SELECT min(id) FROM settings) LIMIT 1",
        "p5_available": f"WITH {SETTINGS_SQL} SELECT * FROM settings WHERE state ORDER BY id LIMIT 20",
        "p6_without_vector": "SELECT vec_id, label FROM embeddings",
        "p7_registry_rows": f"WITH {REGISTRY_SQL} SELECT * FROM registry",
        "p8_chunk_rows": f"""WITH {s_embed_cte('benchmark', 'item_id', 'text', 'q')}
SELECT 'benchmark.txt' AS file_path, b.text, 384 AS dim, {NOW}::BIGINT AS add_time
FROM benchmark b WHERE b.text IS NOT NULL AND b.item_id IN (SELECT id FROM qn)""",
        "p9_first_vector": """SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 6) AS s, len(embedding)::INTEGER AS dim FROM embeddings""",
        "m1_delete": f"""WITH {REGISTRY_SQL}
SELECT * FROM registry WHERE file_path NOT IN (
  SELECT {DOC_PATH_SQL} FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)""",
        "m2_cascade_delete": f"""WITH {REGISTRY_SQL}, {s_chunks_cte(CHUNK)},{CHX_CTE},
gone AS (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT 'files' AS tbl, file_path AS key FROM registry WHERE file_path NOT IN (SELECT source FROM gone)
UNION ALL
SELECT 'chunks' AS tbl, source || '/' || doc_id::VARCHAR || '.txt#' || lpad(pos::VARCHAR, 10, '0') AS key FROM ch WHERE source NOT IN (SELECT source FROM gone)""",
        "m3_update_progress": f"WITH {REGISTRY_SQL}, {UPDATED_SQL} SELECT * FROM updated",
        "m4_update_token": f"""WITH {SETTINGS_SQL}, {_sql_token_changes("lang = 'fr'")}
SELECT s.id, coalesce(c.url, s.url) AS url, coalesce(c.token, s.token) AS token,
       CASE WHEN c.id IS NOT NULL THEN true ELSE s.state END AS state,
       CASE WHEN c.id IS NOT NULL THEN {LATER} ELSE s.time END::BIGINT AS time
FROM settings s LEFT JOIN ch c ON c.id = s.id""",
        "m5_upsert_token": f"""WITH {SETTINGS_SQL}, {_sql_token_changes("lang = 'de'")}
SELECT * FROM settings WHERE id NOT IN (SELECT id FROM ch)
UNION ALL SELECT id, url, token, true AS state, {LATER}::BIGINT AS time FROM ch""",
        "m5_upsert_rows": """WITH d AS (SELECT doc_id, lang, source, n_chars FROM documents)
SELECT * FROM d WHERE lang IN ('en', 'de') AND doc_id NOT IN (SELECT doc_id FROM d WHERE lang IN ('de', 'fr'))
UNION ALL SELECT doc_id, lang, 'moved/' || source AS source, n_chars FROM d WHERE lang IN ('de', 'fr')""",
        "m6_set_state": f"""WITH {SETTINGS_SQL}
SELECT id, url, token, CASE WHEN id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN false ELSE state END AS state,
       CASE WHEN id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN {LATER} ELSE time END::BIGINT AS time
FROM settings""",
        "s6_assemble_pages": r"""WITH p AS (
  SELECT conv_id, turn, array_to_string(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '\s+$', '')), '') AS pt
  FROM conversations)
SELECT conv_id, string_agg(pt, '' ORDER BY turn) AS text, count(*)::INTEGER AS n_pages FROM p GROUP BY conv_id""",
        "s9_reassemble_parts": """WITH parts AS (
  SELECT * FROM conversations c WHERE NOT EXISTS (
    SELECT 1 FROM labels l WHERE l.toxic = 1 AND l.doc_id = c.conv_id AND c.turn = 2)),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM parts) WHERE turn + 1 = rn),
w AS (SELECT conv_id, count(*)::INTEGER AS n_parts, string_agg(text, '' ORDER BY turn) AS whole FROM k GROUP BY conv_id)
SELECT conv_id, n_parts, md5(whole) AS md5, length(whole)::BIGINT AS n_chars FROM w""",
        "s8_check_digests": """WITH e AS (SELECT doc_id, CASE WHEN lang = 'en' THEN md5(text) ELSE md5(text || 'x') END AS expected_md5
           FROM documents WHERE lang IN ('en', 'de'))
SELECT d.doc_id, md5(d.text) AS md5,
       CASE WHEN e.expected_md5 IS NULL THEN 'missing' WHEN e.expected_md5 = md5(d.text) THEN 'ok' ELSE 'changed' END AS status
FROM documents d LEFT JOIN e USING (doc_id)""",
        "x2_latest_status": """SELECT user_id, event_id, event_type, value, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
        "x5_status_view": f"""WITH {REGISTRY_SQL},
log AS (SELECT {DOC_PATH_SQL} AS file_path,
          CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 50 WHEN 'purchase' THEN 100 WHEN 'error' THEN -1 ELSE 0 END AS progress,
          ts, CASE WHEN event_type = 'error' THEN props END AS error
        FROM events e JOIN documents d ON d.doc_id = e.user_id),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY ts DESC, progress DESC) AS rn FROM log) WHERE rn = 1)
SELECT r.name, r.file_path, r.file_type, to_timestamp(r.add_time)::TIMESTAMP AS added_at,
       CASE WHEN l.ts IS NOT NULL THEN l.ts WHEN r.sync_time > 0 THEN to_timestamp(r.sync_time)::TIMESTAMP END AS synced_at,
       coalesce(l.progress, r.progress)::INTEGER AS progress,
       CASE WHEN coalesce(l.progress, r.progress) = 100 THEN l.ts END AS completed_at,
       l.error AS error
FROM registry r LEFT JOIN last l USING (file_path)""",
        "x6_register": f"""WITH {REGISTRY_SQL},
again AS (SELECT name, file_path, file_type, {LATER}::BIGINT AS add_time, sync_time, progress FROM registry
          WHERE file_path IN (SELECT {DOC_PATH_SQL} FROM documents WHERE lang = 'fr'))
SELECT * FROM again UNION ALL SELECT * FROM registry WHERE file_path NOT IN (SELECT file_path FROM again)""",
    }


def _sql_pieces() -> str:
    """CTEs: pieces ``pp(doc_id, pos, id, n_tokens)``, their vectors ``pv/pn`` and
    C1 scores ``sc(doc_id, pos, n_tokens, score)``."""
    return f"""{s_chunks_cte(PIECE)},
pp AS (SELECT doc_id, pos, doc_id * 1048576 + pos AS id, text, ({s_ntok('text')} + 2)::INTEGER AS n_tokens FROM ch),
{s_embed_cte('pp', 'id', 'text', 'p')},
cx AS (SELECT a.doc_id, a.pos, v.b, sum(v.w::DOUBLE) AS s
       FROM pp a JOIN pp q ON q.doc_id = a.doc_id AND q.pos >= a.pos - 5 AND q.pos < a.pos
       JOIN pv v ON v.id = q.id GROUP BY ALL),
cnm AS (SELECT doc_id, pos, sqrt(sum(s * s)) AS n FROM cx GROUP BY ALL),
dq AS (SELECT c.doc_id, c.pos, sum(c.s * v.w::DOUBLE) AS d FROM cx c
       JOIN pv v ON v.id = c.doc_id * 1048576 + c.pos AND v.b = c.b GROUP BY ALL),
sc AS (SELECT a.doc_id, a.pos, a.n_tokens,
         CASE WHEN a.pos = 0 THEN NULL ELSE round(coalesce(coalesce(dq.d, 0) / nullif(pn.nv * m.n, 0), 0), 9) END AS score
       FROM pp a LEFT JOIN dq USING (doc_id, pos) LEFT JOIN cnm m USING (doc_id, pos) LEFT JOIN pn ON pn.id = a.id)"""


SQL_BOUNDS = """bd AS (SELECT doc_id, median(score) AS median,
         CASE WHEN count(score) > 1 THEN stddev_samp(score) ELSE 0 END AS sd FROM sc WHERE score IS NOT NULL GROUP BY ALL),
mk AS (SELECT s.doc_id, s.pos, s.n_tokens, coalesce(s.score < b.median, false) AS split_before
       FROM sc s LEFT JOIN bd b USING (doc_id))"""


def _sql_c7(keep: bool) -> str:
    k = "true" if keep else "false"
    return f"""WITH {_sql_pieces()}, {SQL_BOUNDS},
m2 AS (SELECT *, coalesce(lead(split_before) OVER (PARTITION BY doc_id ORDER BY pos), false) AS split_after FROM mk),
pl AS (SELECT doc_id, list({{'o': pos::BIGINT, 't': n_tokens, 's': split_after}} ORDER BY pos) AS ps FROM m2 GROUP BY doc_id),
r AS (SELECT doc_id, list_reduce(ps, lambda st, p:
        CASE WHEN p.s AND st.c + p.t >= 100 AND st.c + p.t <= 512
             THEN {{'out': list_append(st.out, list_append(st.cur, p.o)), 'cur': []::BIGINT[], 'c': 0}}
             WHEN st.c + p.t > 512
             THEN {{'out': CASE WHEN len(st.cur) > 0 AND (st.c >= 100 OR {k}) THEN list_append(st.out, st.cur) ELSE st.out END,
                   'cur': [p.o], 'c': p.t}}
             ELSE {{'out': st.out, 'cur': list_append(st.cur, p.o), 'c': st.c + p.t}} END,
        {{'out': []::BIGINT[][], 'cur': []::BIGINT[], 'c': 0}}) AS st FROM pl),
fin AS (SELECT doc_id, CASE WHEN len(st.cur) > 0 THEN list_append(st.out, st.cur) ELSE st.out END AS chunks FROM r)
SELECT doc_id, unnest(range(len(chunks)))::INTEGER AS chunk_no, unnest(list_transform(chunks, lambda m: m[1])) AS first,
       unnest(list_transform(chunks, lambda m: m[-1])) AS last, unnest(list_transform(chunks, lambda m: len(m)))::INTEGER AS n_pieces
FROM fin"""


def _sql_c() -> dict[str, str]:
    return {
        "c1_context_similarity": """WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
x AS (SELECT a.label, a.vec_id, list_reduce(list(b.v), lambda p, q: list_transform(list_zip(p, q), lambda z: z[1] + z[2])) AS s
      FROM e a JOIN (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM e) b ON b.label = a.label
      JOIN (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM e) ar
        ON ar.label = a.label AND ar.vec_id = a.vec_id AND b.r >= ar.r - 5 AND b.r < ar.r
        AND (b.r - 1) // 64 = (ar.r - 1) // 64
      GROUP BY a.label, a.vec_id)
SELECT e.label, e.vec_id,
  CASE WHEN x.s IS NULL THEN NULL ELSE
  round(round(coalesce(list_dot_product(e.v, x.s) / nullif(sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(x.s, x.s)), 0), 0), 9), 6) END AS score
FROM e LEFT JOIN x USING (label, vec_id)""",
        "c1_piece_similarity": f"WITH {_sql_pieces()} SELECT doc_id, pos, round(score, 6) AS score FROM sc",
        "c2_cumulative_tokens": f"""WITH {s_chunks_cte(PIECE)}
SELECT doc_id, pos, ({s_ntok('text')} + 2)::INTEGER AS n_tokens,
       (sum(({s_ntok('text')} + 2)::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS cum_tokens
FROM ch""",
        "c3_score_bounds": f"""WITH {_sql_pieces()}, {SQL_BOUNDS}
SELECT doc_id, round(median, 6) AS median, round(sd, 6) AS sd, round(greatest(0, median - sd), 6) AS low,
       round(least(1, median + sd), 6) AS high FROM bd""",
        "c6_split_points": f"WITH {_sql_pieces()}, {SQL_BOUNDS} SELECT doc_id, pos, split_before FROM mk",
        "c4_segment_median": f"""WITH {_sql_pieces()}, {SQL_BOUNDS},
sg AS (SELECT doc_id, sum(split_before::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g,
       n_tokens FROM mk),
sz AS (SELECT doc_id, g, sum(n_tokens) AS n FROM sg GROUP BY ALL),
ls AS (SELECT doc_id, list_sort(list(n)) AS s FROM sz GROUP BY doc_id)
SELECT doc_id, len(s)::INTEGER AS n_segments,
  (CASE WHEN len(s) % 2 = 1 THEN s[len(s) // 2 + 1] ELSE (s[len(s) // 2] + s[len(s) // 2 + 1]) // 2 END)::BIGINT AS median_tokens
FROM ls""",
        "c7_assemble_keep": _sql_c7(True),
        "c7_assemble_drop": _sql_c7(False),
        "c9_sentence_strategy": f"""WITH {s_chunks_cte(CHUNK)}
SELECT source || '/' || doc_id::VARCHAR || '.txt#' || lpad(pos::VARCHAR, 10, '0') AS chunk_id, source AS root_path, source || '/' || doc_id::VARCHAR || '.txt' AS file_path,
       pos, text, 0::BIGINT AS add_time FROM ch""",
    }


def _sql_answers(enabled: bool) -> str:
    from chunkwise.operators.render import CONTEXT_PREAMBLE, EMPTY_QUERY_HINT, QUESTION_HEADING, REMOTE_PREAMBLE

    def lit(x):
        return "'" + x.replace("'", "''") + "'"
    qsrc = """(SELECT b.item_id, CASE WHEN l.doc_id IS NOT NULL THEN '' ELSE b.text END AS text
              FROM benchmark b LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l ON l.doc_id = b.item_id)"""
    gen = ("CASE WHEN length(a.user_prompt) % 3 = 0 THEN NULL ELSE 'answer:' || length(a.user_prompt)::VARCHAR || ':' "
           "|| CASE WHEN a.system_prompt IS NULL THEN 'context' ELSE 'general' END || ':v1' END")
    run = "a.has_vec" if enabled else "false"
    return f"""WITH {s_chunks_cte(CHUNK)},{CHX_CTE},
qs AS {qsrc},
{s_embed_cte('chx', 'chunk_id', 'text', 'c')},
{s_embed_cte('qs', 'item_id', 'text', 'q')},
{s_hits_cte(K, MAX_D)},
pf AS (SELECT query_id, file_path, min(rnk) AS best,
       '### File: ' || file_path || chr(10) || chr(10) || string_agg('- ' || text || chr(10), '' ORDER BY rnk)
       || chr(10) || '---' || chr(10) || chr(10) AS blk FROM hits GROUP BY query_id, file_path),
md AS (SELECT query_id, string_agg(blk, '' ORDER BY best, file_path) AS markdown FROM pf GROUP BY ALL),
cx AS (SELECT query_id, string_agg(text, chr(10) ORDER BY rnk) AS context, count(*)::INTEGER AS n_hits FROM hits GROUP BY ALL),
a AS (SELECT q.item_id AS query_id, q.item_id IN (SELECT id FROM qn) AS has_vec, coalesce(c.n_hits, 0)::INTEGER AS n_hits,
        coalesce(m.markdown, '') AS markdown,
        CASE WHEN coalesce(c.n_hits, 0) > 0 THEN NULL ELSE {lit(REMOTE_PREAMBLE)} END AS system_prompt,
        CASE WHEN coalesce(c.n_hits, 0) > 0 THEN {lit(CONTEXT_PREAMBLE)} || c.context || {lit(QUESTION_HEADING)} || q.text
             ELSE q.text END AS user_prompt
      FROM qs q LEFT JOIN cx c ON c.query_id = q.item_id LEFT JOIN md m ON m.query_id = q.item_id),
g AS (SELECT a.*, CASE WHEN {run} THEN {gen} END AS gen FROM a a)
SELECT query_id,
  CASE WHEN NOT has_vec THEN {lit(EMPTY_QUERY_HINT)} WHEN {run.replace('a.', '')} AND gen IS NOT NULL THEN gen ELSE markdown END AS answer,
  CASE WHEN NOT has_vec THEN 'hint' WHEN {run.replace('a.', '')} AND gen IS NOT NULL THEN 'generator' ELSE 'markdown' END AS source,
  n_hits, ({run.replace('a.', '')} AND gen IS NULL) AS generator_failed
FROM g"""


def s_grid(x: str) -> str:
    """The chunker's 1e-9 grid with halves rounded up (see semantic.on_grid)."""
    return f"(floor(({x}) * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE)"


def _sql_bisect() -> str:
    """CTE ``th(doc_id, n, thr, rounds)``: C3 bounds and the C5 bisection per document
    (one batch), over ``sc`` from :func:`_sql_pieces`."""
    mt = ("list_transform([list_sort(list_transform(range(1, len(list_concat([0], list_filter(range(1, n), lambda j: S[j] < thr), [n]))), "
          "lambda k: C[list_concat([0], list_filter(range(1, n), lambda j: S[j] < thr), [n])[k + 1] + 1] "
          "- C[list_concat([0], list_filter(range(1, n), lambda j: S[j] < thr), [n])[k] + 1]))], "
          "lambda ss: CASE WHEN len(ss) % 2 = 1 THEN ss[len(ss) // 2 + 1] ELSE (ss[len(ss) // 2] + ss[len(ss) // 2 + 1]) // 2 END)[1]")
    step = (f"CASE WHEN st.done OR st.lo > st.hi THEN st ELSE list_transform([{s_grid('(st.lo + st.hi) / 2')}], lambda thr: "
            f"list_transform([{mt}], lambda mt: "
            f"CASE WHEN mt >= 90 AND mt <= 522 THEN {{'lo': st.lo, 'hi': st.hi, 'thr': thr, 'done': true, 'r': st.r + 1}} "
            f"WHEN mt < 100 THEN {{'lo': st.lo, 'hi': thr - 0.01, 'thr': thr, 'done': false, 'r': st.r + 1}} "
            f"ELSE {{'lo': thr + 0.01, 'hi': st.hi, 'thr': thr, 'done': false, 'r': st.r + 1}} END)[1])[1] END")
    return f"""dl AS (SELECT doc_id, count(*)::INTEGER AS n,
         list(score ORDER BY pos) FILTER (WHERE pos > 0) AS S,
         list(n_tokens::BIGINT ORDER BY pos) AS T,
         list_sort(list(score) FILTER (WHERE score IS NOT NULL)) AS SS,
         CASE WHEN count(score) > 1 THEN {s_grid('stddev_samp(score)')} ELSE 0 END AS sd
       FROM sc GROUP BY doc_id),
dm AS (SELECT *, CASE WHEN len(SS) = 0 THEN NULL
                      ELSE {s_grid("CASE WHEN len(SS) % 2 = 1 THEN SS[len(SS) // 2 + 1] ELSE (SS[len(SS) // 2] + SS[len(SS) // 2 + 1]) / 2 END")}
                 END AS med FROM dl),
dc AS (SELECT *, list_transform(range(0, n + 1), lambda k: coalesce(list_sum(T[1:k]), 0)) AS C FROM dm),
th AS (SELECT doc_id, n,
         CASE WHEN n > 1 THEN list_reduce(range(0, 40), lambda st, i: {step},
              {{'lo': greatest(0, med - sd), 'hi': least(1, med + sd), 'thr': 0.0::DOUBLE, 'done': false, 'r': 0}})
         END AS bs
       FROM dc)"""


def _sql_semantic(keep: bool = True) -> str:
    short = "len(st.cur) > 0" if keep else "len(st.cur) > 0 AND st.c >= 100"
    return f"""WITH {_sql_pieces()}, {_sql_bisect()},
mk AS (SELECT s.doc_id, s.pos, s.n_tokens, p.text,
         CASE WHEN t.n > 64 THEN error('more than one batch: carry-over is stated in the tests, not in SQL') ELSE
         coalesce(s.pos > 0 AND s.score < t.bs.thr, false) END AS split_before
       FROM sc s JOIN th t USING (doc_id) JOIN pp p USING (doc_id, pos)),
m2 AS (SELECT *, coalesce(lead(split_before) OVER (PARTITION BY doc_id ORDER BY pos), false) AS split_after FROM mk),
pl AS (SELECT doc_id, list({{'o': pos::BIGINT, 't': n_tokens, 's': split_after}} ORDER BY pos) AS ps,
              list(text ORDER BY pos) AS ptexts FROM m2 GROUP BY doc_id),
r AS (SELECT doc_id, ptexts, list_reduce(ps, lambda st, pc:
        CASE WHEN pc.s AND st.c + pc.t >= 100 AND st.c + pc.t <= 512
             THEN {{'out': list_append(st.out, list_append(st.cur, pc.o)), 'cur': []::BIGINT[], 'c': 0}}
             WHEN st.c + pc.t > 512
             THEN {{'out': CASE WHEN {short} THEN list_append(st.out, st.cur) ELSE st.out END,
                   'cur': [pc.o], 'c': pc.t}}
             ELSE {{'out': st.out, 'cur': list_append(st.cur, pc.o), 'c': st.c + pc.t}} END,
        {{'out': []::BIGINT[][], 'cur': []::BIGINT[], 'c': 0}}) AS st FROM pl),
fin AS (SELECT doc_id, list_transform(CASE WHEN len(st.cur) > 0 THEN list_append(st.out, st.cur) ELSE st.out END,
          lambda m: array_to_string(list_transform(m, lambda q: ptexts[q + 1]), chr(10))) AS chunks FROM r),
x AS (SELECT doc_id, unnest(range(len(chunks)))::INTEGER AS pos, unnest(chunks) AS text FROM fin)
SELECT d.source || '/' || x.doc_id::VARCHAR || '.txt#' || lpad(x.pos::VARCHAR, 10, '0') AS chunk_id, d.source || '/' || x.doc_id::VARCHAR || '.txt' AS file_path, x.pos, x.text,
       ({s_ntok('x.text')} + 2)::INTEGER AS n_tokens
FROM x JOIN documents d USING (doc_id)"""


def _utc(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Timestamps are compared in UTC on both sides."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        _prep(spark)
        return fn(spark, sf)
    run.__name__ = fn.__name__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _utc(v) for k, v in _queries().items()}


def _queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "t1_clean": q_t1_clean,
        "s1_file_tree_ingest": q_s1_file_tree_ingest,
        "t2_fold_newlines": q_t2_fold_newlines,
        "t3_token_count": q_t3_token_count,
        "t4_token_pieces": q_t4_token_pieces,
        "t5_token_chunks": q_t5_token_chunks,
        "t2_control_chars": q_t2_control_chars,
        "t5_cjk": q_t5_cjk,
        "t5_overlap": q_t5_overlap,
        "e3_large_doc_ids": q_e3_large_doc_ids,
        "t6_sentence_pack": q_t6_sentence_pack,
        "e2_hash_embed": q_e2_hash_embed,
        "e3_embed_chunks": q_e3_embed_chunks,
        "r1_nearest": q_r1_nearest,
        "r2_topk_06": q_r2_topk_06,
        "r2_topk_09": q_r2_topk_09,
        "r2_topk_query_blocks": q_r2_topk_query_blocks,
        "r2_grid": q_r2_grid,
        "r2_hits": q_r2_hits,
        "r3_markdown": q_r3_markdown,
        "r4_context_prompt": q_r4_context_prompt,
        "r5_no_context_prompt": q_r5_no_context_prompt,
        "p1_scan_registry": q_p1_scan_registry,
        "p2_first_n": q_p2_first_n,
        "p3_pending": q_p3_pending,
        "p4_lookup": q_p4_lookup,
        "p5_available": q_p5_available,
        "p6_without_vector": q_p6_without_vector,
        "p7_registry_rows": q_p7_registry_rows,
        "p8_chunk_rows": q_p8_chunk_rows,
        "p9_first_vector": q_p9_first_vector,
        "m1_delete": q_m1_delete,
        "m1_bucketed_table_delete": q_m1_bucketed_table_delete,
        "m2_cascade_delete": q_m2_cascade_delete,
        "m3_update_progress": q_m3_update_progress,
        "m4_update_token": q_m4_update_token,
        "m5_upsert_token": q_m5_upsert_token,
        "m5_upsert_rows": q_m5_upsert_rows,
        "m6_set_state": q_m6_set_state,
        "s6_assemble_pages": q_s6_assemble_pages,
        "s8_check_digests": q_s8_check_digests,
        "s9_reassemble_parts": q_s9_reassemble_parts,
        "x2_latest_status": q_x2_latest_status,
        "x5_status_view": q_x5_status_view,
        "x6_register": q_x6_register,
        "c1_context_similarity": q_c1_context_similarity,
        "c1_piece_similarity": q_c1_piece_similarity,
        "c2_cumulative_tokens": q_c2_cumulative_tokens,
        "c3_score_bounds": q_c3_score_bounds,
        "c4_segment_median": q_c4_segment_median,
        "c6_split_points": q_c6_split_points,
        "c7_assemble_keep": q_c7_assemble_keep,
        "c7_assemble_drop": q_c7_assemble_drop,
        "c5_threshold": q_c5_threshold,
        "c8_semantic_chunks": q_c8_semantic_chunks,
        "c8_drop": q_c8_drop,
        "c8_rounds": q_c8_rounds,
        "c8_semantic_vectors": q_c8_semantic_vectors,
        "c9_sentence_strategy": q_c9_sentence_strategy,
        "x1_stream_ingest": q_x1_stream_ingest,
        "x1_stream_restart": q_x1_stream_restart,
        "x2_stage_log": q_x2_stage_log,
        "x1_registry_stream": q_x1_registry_stream,
        "x2_failed_file": q_x2_failed_file,
        "x3_stream_table_replace": q_x3_stream_table_replace,
        "x4_maintenance": q_x4_maintenance,
        "m2_many_changes": q_m2_many_changes,
        "s2_dispatch_files": q_s2_dispatch_files,
        "s9_merged_text": q_s9_merged_text,
        "s6_stream_chunks": q_s6_stream_chunks,
        "s12_compact": q_s12_compact,
        "s13_callback_rows": q_s13_callback_rows,
        "t8_epoch_seconds": q_t8_epoch_seconds,
        "e1_batched_embed": q_e1_batched_embed,
        "e5_options": q_e5_options,
        "e5_batch": q_e5_batch,
        "e1_reuse": q_e1_reuse,
        "x5_incremental": q_x5_incremental,
        "e4_pdf_pages": q_e4_pdf_pages,
        "t3_custom_counter": q_t3_custom_counter,
        "t5_custom_counter": q_t5_custom_counter,
        "m2_table_delete": q_m2_table_delete,
        "m3_duplicate_updates": q_m3_duplicate_updates,
        "r6_answer_generator": q_r6_answer_generator,
        "r7_answer_disabled": q_r7_answer_disabled,
        **(LQ.queries() if LQ else {}),
        **({"pipeline": CP.run} if CP else {}),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "t1_clean": f"SELECT doc_id, {s_clean(DIRTY_SQL)} AS text FROM documents",
        "t2_fold_newlines": f"SELECT doc_id, {s_fold(RUNS_SQL)} AS text FROM documents",
        "t2_control_chars": f"SELECT doc_id, {s_fold(CONTROL_SQL)} AS text FROM documents",
        "t5_cjk": f"WITH cjk AS (SELECT doc_id, source, {CJK_SQL} AS text FROM documents), {s_chunks_cte(CHUNK, 'cjk')} SELECT doc_id, pos, text FROM ch",
        "t5_overlap": f"WITH {s_chunks_cte(CHUNK, overlap=OVERLAP)} SELECT doc_id, pos, text FROM ch",
        "e3_large_doc_ids": f"""WITH big AS (SELECT doc_id + 1125899906842624 AS doc_id, source, text FROM documents), {s_chunks_cte(CHUNK, 'big')}
SELECT source || '/' || doc_id::VARCHAR || '.txt#' || lpad(pos::VARCHAR, 10, '0') AS chunk_id,
       source || '/' || doc_id::VARCHAR || '.txt' AS file_path, pos, text FROM ch""",
        "t3_token_count": f"SELECT doc_id, ({s_ntok('text')} + 2)::INTEGER AS n_tokens FROM documents",
        "t4_token_pieces": _sql_tokens(PIECE),
        "t5_token_chunks": _sql_tokens(CHUNK),
        "s1_file_tree_ingest": _sql_tokens(CHUNK),
        "t6_sentence_pack": SQL_T6,
        "e2_hash_embed": f"""WITH {s_embed_cte('benchmark', 'item_id', 'text', 'q')}
SELECT id AS item_id, b AS dim, round(w::DOUBLE, 6) AS value FROM qv WHERE w <> 0""",
        "e3_embed_chunks": f"""WITH {s_chunks_cte(CHUNK)},{CHX_CTE},
{s_embed_cte('chx', 'chunk_id', 'text', 'c')}
SELECT id AS chunk_id, count(*) AS nnz, round(sum(w::DOUBLE * (b + 1)), 5) AS weighted,
       round(sum(abs(w::DOUBLE)), 5) AS l1 FROM cv WHERE w <> 0 GROUP BY ALL""",
        "r1_nearest": f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
q AS (SELECT v FROM e ORDER BY vec_id LIMIT 1),
p AS (SELECT e.vec_id, round(greatest(1 - list_dot_product(e.v, q.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v))), 0), 9) AS d FROM e, q)
SELECT vec_id, round(d, 6) AS distance FROM p WHERE d >= 0 AND d < 0.9 ORDER BY d, vec_id LIMIT {K}""",
        "r2_topk_06": _sql_self_topk(0.6),
        "r2_topk_09": _sql_self_topk(0.9),
        "r2_topk_query_blocks": _sql_self_topk(0.9),
        "r2_grid": _sql_self_topk(0.6),
        "r2_hits": f"""WITH {s_chunks_cte(CHUNK)},{CHX_CTE},
{s_embed_cte('chx', 'chunk_id', 'text', 'c')},
{s_embed_cte('benchmark', 'item_id', 'text', 'q')},
{s_hits_cte(K, MAX_D)}
SELECT query_id, chunk_id, file_path, rnk::INTEGER AS rank, round(distance, 6) AS distance FROM hits""",
        "r3_markdown": _sql_md(),
        "r4_context_prompt": _sql_prompts(MAX_D, False),
        "r5_no_context_prompt": _sql_prompts(0.2, True),
        **_sql_p_m_x(),
        **_sql_c(),
        "x1_stream_ingest": _sql_c()["c9_sentence_strategy"],
        "x1_stream_restart": _sql_c()["c9_sentence_strategy"],
        "s13_callback_rows": _sql_c()["c9_sentence_strategy"],
        "x2_stage_log": """WITH f AS (SELECT source || '/' || doc_id::VARCHAR || '.txt' AS file_path, lang FROM documents)
SELECT file_path, unnest(CASE WHEN lang = 'es' THEN [1, -1] ELSE [1, 50, 100] END)::INTEGER AS progress,
       unnest(CASE WHEN lang = 'es' THEN [NULL, 'no text'] ELSE [NULL, NULL, NULL]::VARCHAR[] END) AS error FROM f""",
        "e1_reuse": """WITH v AS (SELECT doc_id, list_append(list_transform(['a', 'e', 'i', 'o', 'u'],
  lambda c: (length(text) - length(replace(text, c, '')))::DOUBLE), length(text)::DOUBLE) AS v FROM documents)
SELECT doc_id, unnest(range(6))::INTEGER AS dim, round(unnest(v), 4) AS value, (SELECT count(DISTINCT text) FROM documents) AS n_embedded FROM v""",
        "x5_incremental": _sql_p_m_x()["x5_status_view"],
        "e5_batch": f"WITH {s_chunks_cte(CHUNK)} SELECT count(*) AS n_chunks, 7::INTEGER AS largest_call FROM ch",
        "e4_pdf_pages": f"""WITH src AS (SELECT doc_id, source, CASE WHEN lang = 'en' THEN text ELSE
    array_to_string(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '\\s+$', '')), '') END AS text FROM documents WHERE lang <> 'es'),
{s_chunks_cte(CHUNK, 'src')}
SELECT ch.source || '/' || doc_id::VARCHAR || CASE WHEN lang = 'en' THEN '.txt' ELSE '.pdf' END AS file_path, pos, ch.text, NULL::VARCHAR AS error
FROM ch JOIN documents USING (doc_id)
UNION ALL SELECT source || '/' || doc_id::VARCHAR || '.pdf', NULL, NULL, 'pdf: no page text supplied' FROM documents WHERE lang = 'es'""",
        "t3_custom_counter": "SELECT doc_id, ((strlen(text) + 3) // 4 + 3)::INTEGER AS n_tokens FROM documents",
        "t5_custom_counter": f"""WITH {s_chunks_cte(CHUNK, cap=CHUNK - 3, ntok=lambda x: f"((strlen({x}) + 3) // 4)")}
SELECT source || '/' || doc_id::VARCHAR || '.txt#' || lpad(pos::VARCHAR, 10, '0') AS chunk_id, pos, text FROM ch""",
        "x1_registry_stream": f"WITH {s_chunks_cte(CHUNK)} SELECT doc_id, pos, text, 100::INTEGER AS progress FROM ch",
        "x2_failed_file": """SELECT doc_id::VARCHAR AS what, CASE WHEN lang = 'es' THEN -1 ELSE 100 END::INTEGER AS progress,
       CASE WHEN lang = 'es' THEN 'unsupported: csv' END AS error FROM documents
UNION ALL SELECT l, 100, NULL FROM unnest(['en', 'de', 'fr']) AS t(l)
UNION ALL VALUES ('es', -1, 'files failed: unsupported: csv'), ('none', -1, 'missing path')""",
        "x3_stream_table_replace": f"""WITH {s_chunks_cte(CHUNK)}
SELECT source || '/' || doc_id::VARCHAR || '.txt#' || lpad(pos::VARCHAR, 10, '0') AS chunk_id, source || '/' || doc_id::VARCHAR || '.txt' AS file_path, pos, text
FROM ch WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'es')""",
        "x4_maintenance": f"SELECT tbl, key, 1::INTEGER AS n_versions, 0::INTEGER AS n_deletes FROM ({_sql_p_m_x()['m2_cascade_delete']})",
        "m2_many_changes": f"""WITH {REGISTRY_SQL},
s AS (SELECT file_path, coalesce(try_cast(regexp_extract(file_path, '/([0-9]+)\\.', 1) AS BIGINT), 0) % 31 AS k FROM registry)
SELECT file_path, 100::INTEGER AS progress, ({NOW} + k)::BIGINT AS sync_time FROM s
WHERE file_path NOT IN (SELECT {DOC_PATH_SQL} FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
UNION ALL SELECT file_path, 50, 0 FROM s WHERE k = 0""",
        "s6_stream_chunks": f"""WITH src AS (SELECT conv_id AS doc_id, '' AS source, text FROM ({_sql_p_m_x()['s6_assemble_pages']})),
{s_chunks_cte(64, 'src')} SELECT doc_id::VARCHAR || '#' || lpad(pos::VARCHAR, 10, '0') AS chunk_id, pos, text FROM ch""",
        "s2_dispatch_files": SQL_S2,
        "s9_merged_text": """WITH parts AS (
  SELECT * FROM conversations c WHERE NOT EXISTS (
    SELECT 1 FROM labels l WHERE l.toxic = 1 AND l.doc_id = c.conv_id AND c.turn = 2)),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM parts) WHERE turn + 1 = rn)
SELECT conv_id, count(*)::INTEGER AS n_parts, string_agg(text, '' ORDER BY turn) AS text FROM k GROUP BY conv_id""",
        "s12_compact": f"""WITH {s_chunks_cte(CHUNK)}
SELECT source || '/' || doc_id::VARCHAR || '.txt#' || lpad(pos::VARCHAR, 10, '0') AS chunk_id, source || '/' || doc_id::VARCHAR || '.txt' AS file_path, pos, text
FROM ch""",
        "t8_epoch_seconds": "SELECT event_id, floor(epoch(ts))::BIGINT AS seconds FROM events",
        "e1_batched_embed": """WITH v AS (SELECT doc_id, list_append(list_transform(['a', 'e', 'i', 'o', 'u'],
  lambda c: (length(text) - length(replace(text, c, '')))::DOUBLE), length(text)::DOUBLE) AS v FROM documents)
SELECT doc_id, unnest(range(6))::INTEGER AS dim, round(unnest(v), 4) AS value FROM v""",
        "e5_options": f"""WITH {s_chunks_cte(128)}
SELECT source || '/' || doc_id::VARCHAR || '.txt#' || lpad(pos::VARCHAR, 10, '0') AS chunk_id, pos, text FROM ch""",
        "m2_table_delete": _sql_p_m_x()["m2_cascade_delete"],
        "m3_duplicate_updates": f"""WITH {REGISTRY_SQL}
SELECT r.file_path, CASE WHEN r.file_path LIKE '%.txt' THEN 100 WHEN d.f IS NOT NULL THEN 50 ELSE r.progress END::INTEGER AS progress,
       CASE WHEN d.f IS NOT NULL THEN {LATER} ELSE r.sync_time END::BIGINT AS sync_time
FROM registry r LEFT JOIN (SELECT {DOC_PATH_SQL} AS f FROM documents) d ON d.f = r.file_path""",
        "m1_bucketed_table_delete": f"""WITH {s_chunks_cte(CHUNK)}
SELECT source || '/' || doc_id::VARCHAR || '.txt#' || lpad(pos::VARCHAR, 10, '0') AS chunk_id, source || '/' || doc_id::VARCHAR || '.txt' AS file_path, pos, text
FROM ch WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
        "c5_threshold": f"""WITH {_sql_pieces()}, {_sql_bisect()}
SELECT doc_id, CASE WHEN n > 1 THEN round(bs.thr, 9) ELSE 0.0 END AS threshold,
       CASE WHEN n > 1 THEN bs.r ELSE 0 END::INTEGER AS rounds FROM th""",
        "c8_semantic_chunks": _sql_semantic(),
        "c8_drop": _sql_semantic(keep=False),
        "c8_rounds": _sql_semantic(),
        "c8_semantic_vectors": f"""WITH sem AS ({_sql_semantic()}),
{s_embed_cte('sem', 'chunk_id', 'text', 'c')}
SELECT id AS chunk_id, count(*) AS nnz, round(sum(w::DOUBLE * (b + 1)), 5) AS weighted,
       round(sum(abs(w::DOUBLE)), 5) AS l1 FROM cv WHERE w <> 0 GROUP BY ALL""",
        "r6_answer_generator": _sql_answers(True),
        "r7_answer_disabled": _sql_answers(False),
        **(LQ.oracle_sql() if LQ else {}),
        **({"pipeline": CP.ORACLE_SQL} if CP and CP.ORACLE_SQL else {}),
    }


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: documents -> clean -> 256-token chunks -> hashing embedder ->
    exact top-5 for every benchmark question -> Markdown answer per question."""
    _prep(spark)
    return q_r3_markdown(spark, SF_SMOKE)
