"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fill_middle, html_text, language, line_dedup, lz_fingerprint, near_dup, packing, pieces, prefix_trie, quality, suffix_dedup, token_counts
from .common import shared_path, table

BPE_FILE = "byte_bpe_50k.json"
PIECE_FILE = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out():
    """Rows that language identification never learns from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def op1_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    done = pieces.round_trip(table(spark, sf, "documents"), tokenizer_path(PIECE_FILE))
    return done.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded_equal")


def op2_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf, "documents"), tokenizer_path(BPE_FILE))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    told = "</s>[INST] ok [/INST]"
    rows = chat.turn_rows(table(spark, sf, "conversations"))
    extra = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(told).alias("text"))
        for k, r in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    done = chat.format_rows(rows.union(extra))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (done.withColumn("turns", chat.read_back(F.col("formatted")))
            .withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                    F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                    F.char_length("formatted").cast("long").alias("formatted_chars")))


def op4_lz_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return lz_fingerprint.neighbours(table(spark, sf, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    done = suffix_dedup.dedup(table(spark, sf, "documents"), with_text=False)
    return done.select("_rest.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op6_html_extract(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op7_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf, "documents")).select("doc_id", "class_id")


def op8_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(table(spark, sf, "documents"), with_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    samples = language.sample(docs, ~held_out())
    return (language.identify(docs, samples).withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
            .select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected"))


#: Session setting that names the folder of the token cache; unset, each call of the query starts with an empty one, so
#: that what is measured is counting, not reading the counts of an earlier run.
TOKEN_CACHE = "spark.chunkwise.tokenCache"


def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    cache = spark.conf.get(TOKEN_CACHE, None) or shared_path(spark, "token-cache")
    counts = token_counts.count_tokens(table(spark, sf, "documents"), tokenizer_path(PIECE_FILE), cache)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op11_fill_middle(spark: SparkSession, sf: str) -> DataFrame:
    done = fill_middle.restore(fill_middle.transform(table(spark, sf, "documents")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    index = line_dedup.LineIndex.create(spark, shared_path(spark, "line-index")).insert(docs)
    return index.clean(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf, "conversations")).drop("a", "b")


def queries() -> dict:
    return {f.__name__: f for f in (op1_sentencepiece, op2_best_fit_packing, op3_chat_format, op4_lz_fingerprint, op5_suffix_dedup, op6_html_extract,
                                    op7_minhash_near_dedup, op8_quality_rules, op9_language_id, op10_token_counts, op11_fill_middle, op12_line_dedup, op13_prefix_trie)}


SQL_OP3 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + length(regexp_replace(text, '[^<\[\\]', '', 'g')) AS tl,
             length(role) + length(regexp_replace(role, '[^<\[\]\\]', '', 'g')) AS rl FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(4 + rl + 2 + tl + 5)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


_PHRASES = " OR ".join(f"contains(lower(line), '{p}')" for p in quality.BOILERPLATE)
SQL_OP8 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
f AS (SELECT doc_id, line, length(array_to_string(lw, '')) AS chars,
        100 * len(list_filter(lw, lambda x: x IN ('|', '»', '›', '•'))) >= {quality.NAV_PCT} * len(lw)
        OR 100 * len(regexp_extract_all(line, '[#*$%&|<>]')) >= {quality.SYMBOL_PCT} * len(lw)
        OR len(lw) >= {quality.STUTTER_WORDS} AND 3 * len(list_distinct(lw)) < len(lw)
        OR len(lw) >= {quality.PLAIN_WORDS} AND NOT regexp_matches(line, '[{quality.PUNCTUATION}]')
        OR len(lw) >= {quality.SHOUT_WORDS} AND NOT regexp_matches(line, '\p{{Ll}}') AND regexp_matches(line, '\p{{Lu}}')
        OR len(lw) <= {quality.BOILERPLATE_WORDS} AND ({_PHRASES}) AS fails
      FROM l WHERE len(lw) > 0),
x AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, sum(CASE WHEN fails THEN chars ELSE 0 END) AS lost FROM f GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(array_to_string(w, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(x.dup, 0)::BIGINT AS n_dup_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(x.lost, 0) AS lost
      FROM w LEFT JOIN r USING (doc_id) LEFT JOIN x USING (doc_id)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PCT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND lost <= {quality.MAX_LOSS} * word_chars AS kept FROM b"""


SQL_OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2,
             ('0x' || h[17:24])::UBIGINT % 100 AS h3, ('0x' || h[25:32])::UBIGINT % 100 AS h4 FROM d),
c AS (SELECT doc_id, t, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1))::BIGINT AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1))::BIGINT AS b,
             CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p"""


SQL_OP12 = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY r"""


SQL_OP13 = r"""
WITH t AS (SELECT conv_id, turn, sha256(sha256(coalesce(role, '')) || sha256(coalesce(text, ''))) AS g, strlen(coalesce(text, '')) AS w
           FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS pos, g, w FROM t),
crc AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS tab),
i AS (SELECT DISTINCT conv_id FROM t),
h AS (SELECT conv_id, conv_id - conv_id % 5 AS base,
             xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 9 AS h
      FROM i, crc),
c AS (SELECT h.*, (SELECT count(*) FROM o WHERE o.conv_id = h.base AND o.pos <= h.h) AS k FROM h),
rb AS (SELECT c.conv_id, o.pos AS depth, g, w FROM c JOIN o ON o.conv_id = c.base WHERE o.pos <= c.h
       UNION ALL SELECT c.conv_id, o.pos - c.h + c.k, g, w FROM c JOIN o USING (conv_id) WHERE o.pos > c.h),
p AS MATERIALIZED (SELECT conv_id, depth, w, sha256(string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM rb
       UNION ALL SELECT conv_id, 0, 0, sha256('') FROM c),
n AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w FROM p GROUP BY ALL),
e AS (SELECT n.*, u.conv_id AS parent_conv_id, u.node AS parent FROM n LEFT JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN n u ON u.node = p.node),
kids AS (SELECT parent AS node, count(*) AS n_children FROM e WHERE parent IS NOT NULL GROUP BY 1),
sub AS (SELECT a.node, sum((e.n_convs - 1) * e.w)::BIGINT AS saved, count(*) FILTER (WHERE kids.node IS NULL) AS n_leaves
        FROM e LEFT JOIN kids USING (node) JOIN p a ON a.conv_id = e.conv_id AND a.depth <= e.depth GROUP BY 1),
ends AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(node, depth) AS node FROM p GROUP BY 1) GROUP BY 1)
SELECT e.conv_id, e.depth, e.parent_conv_id, e.n_convs, coalesce(kids.n_children, 0) AS n_children, sub.n_leaves, sub.saved AS saved_tokens,
       sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM e JOIN sub USING (node) LEFT JOIN kids USING (node) LEFT JOIN ends USING (node)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": SQL_OP3, "op8_quality_rules": SQL_OP8, "op11_fill_middle": SQL_OP11,
            "op12_line_dedup": SQL_OP12, "op13_prefix_trie": SQL_OP13}
