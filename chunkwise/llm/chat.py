"""Chat formatting by schema fingerprints, in DataFrame functions only.

A layout is known by the fingerprint of its nested field paths: of a table's
schema (:func:`fingerprint`) or of each JSON record (:func:`record_fingerprint`,
from the record's variant schema).  The fingerprint selects a declarative
mapping that gives canonical turns ``array<struct<role, text>>``.  A template
marks the turns; control strings cannot occur in texts, because ``<`` and
``[`` (and the escape sign) are escaped reversibly; :func:`read_back` returns
the turns.  Loss spans are the character ranges of assistant texts.

Defined results: null roles and texts are empty; turns are ordered by turn,
then role, then text (so ties and repeated rows have one order, null turns
first); a record without a known layout has null turns and shows its
fingerprint; a known layout without messages has no turns; an empty table
gives an empty table; extra fields make another fingerprint unless they are
named in ``IGNORED``; extra columns of row layouts are left out.  A
conversation is one value of the output, so it must fit one row.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

TURNS = "array<struct<role:string,text:string>>"
#: Top-level fields that say nothing about the layout.
IGNORED = ("id", "conv_id", "source", "meta", "metadata", "lang")

#: Layouts: the field paths that make the fingerprint, the type to read them
#: with, and the turns: a list field with role and text, or one field per turn.
MAPPINGS = {
    "messages": {"type": "messages array<struct<role:string,content:string>>", "list": ("messages", "role", "content")},
    "conversations": {"type": "conversations array<struct<from:string,value:string>>", "list": ("conversations", "from", "value")},
    "dialog": {"type": "dialog array<struct<speaker:string,text:string>>", "list": ("dialog", "speaker", "text")},
    "prompt": {"type": "prompt string, completion string", "turns": (("user", ("prompt",)), ("assistant", ("completion",)))},
    "prompt-response": {"type": "prompt string, response string", "turns": (("user", ("prompt",)), ("assistant", ("response",)))},
    "system-prompt-response": {"type": "system string, prompt string, response string",
                               "turns": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))},
    "question": {"type": "question string, answer string", "turns": (("user", ("question",)), ("assistant", ("answer",)))},
    "instruction": {"type": "instruction string, output string",
                    "turns": (("user", ("instruction",)), ("assistant", ("output",)))},
    "instruction-input": {"type": "instruction string, input string, output string",
                          "turns": (("user", ("instruction", "input")), ("assistant", ("output",)))},
}
#: Layouts of one row a turn: the conversation, order, role and text columns, and
#: whether role names are brought to the canonical ones (those of "rows" already are).
ROW_MAPPINGS = {
    "rows": {"type": "conv_id long, turn long, role string, text string", "columns": ("conv_id", "turn", "role", "text"), "roles": False},
    "content-rows": {"type": "conversation_id long, turn long, role string, content string",
                     "columns": ("conversation_id", "turn", "role", "content"), "roles": True},
    "from-rows": {"type": "conv_id long, turn long, from string, value string", "columns": ("conv_id", "turn", "from", "value"), "roles": True},
    "speaker-rows": {"type": "dialog_id long, turn long, speaker string, text string",
                     "columns": ("dialog_id", "turn", "speaker", "text"), "roles": True},
}
#: Role names of other layouts, by canonical role.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def paths(dt: DataType, at: str = "") -> list[str]:
    """Nested field paths, ``[]`` for list elements, sorted, without types."""
    if isinstance(dt, StructType):
        return sorted(p for f in dt.fields if at or f.name not in IGNORED for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(dt, ArrayType):
        return paths(dt.elementType, at + "[]")
    return [at]


def fingerprint(schema: StructType) -> str:
    """Hash of a schema's nested field paths."""
    return hashlib.sha256("\n".join(paths(schema)).encode()).hexdigest()


def _ddl(text: str) -> StructType:
    return StructType.fromDDL(text)


def by_fingerprint() -> dict[str, str]:
    return {fingerprint(_ddl(m["type"])): name for name, m in MAPPINGS.items()}


def _role(c: Column) -> Column:
    role = F.lower(F.coalesce(c, F.lit("")))
    out = role
    for other, name in ROLES.items():
        out = F.when(role == other, F.lit(name)).otherwise(out)
    return out


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def turns_of(name: str, record: Column) -> Column:
    """Canonical turns of a record (a struct column) in the layout ``name``."""
    m = MAPPINGS[name]
    if "list" in m:
        field, role, text = m["list"]
        return F.coalesce(F.transform(record[field], lambda x: _turn(_role(x[role]), x[text])), F.array().cast(TURNS))
    join = lambda fields: F.concat_ws("\n\n", *[F.when(record[f] != "", record[f]) for f in fields])
    return F.array(*[_turn(F.lit(role), join(fields)) for role, fields in m["turns"]])


def table_turns(df: DataFrame) -> DataFrame:
    """A table whose schema has a known fingerprint, with its turns as column ``turns``."""
    name = by_fingerprint().get(fingerprint(df.schema))
    if name is None:
        raise ValueError("no mapping for the field paths " + ", ".join(paths(df.schema)))
    return df.withColumn("turns", turns_of(name, F.struct(*[F.col(f"`{c}`") for c in _ddl(MAPPINGS[name]["type"]).names])))


def turn_rows(df: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of a turn table whose schema has a known fingerprint;
    columns that no row layout names are left out."""
    named = {c for m in ROW_MAPPINGS.values() for c in m["columns"]}
    schema = StructType([f for f in df.schema.fields if f.name in named])
    known = {fingerprint(_ddl(m["type"])): m for m in ROW_MAPPINGS.values()}
    m = known.get(fingerprint(schema))
    if m is None or not set(m["columns"]) <= set(df.columns):
        raise ValueError("no row mapping for the field paths " + ", ".join(paths(df.schema)))
    conv, turn, role, text = (F.col(f"`{c}`") for c in m["columns"])
    return df.select(conv.alias("conv_id"), turn.alias("turn"), (_role(role) if m["roles"] else role).alias("role"), text.alias("text"))


def record_shape(json: Column) -> Column:
    """The variant schema of a JSON record without scalar types and ignored fields."""
    shape = F.schema_of_variant(F.try_parse_json(json))
    shape = F.regexp_replace(shape, r"DECIMAL\(\d+,\d+\)|\b(STRING|VOID|BIGINT|DOUBLE|FLOAT|BOOLEAN|VARIANT|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY)\b", "?")
    shape = F.regexp_replace(shape, r"(?<=^OBJECT<|, )(" + "|".join(IGNORED) + r"): (\?|OBJECT<[^<>]*>)(?=, |>)", "-")
    return F.regexp_replace(F.regexp_replace(shape, r"-, |, -", ""), r"<->", "<>")


def _shape(dt: DataType) -> str:
    if isinstance(dt, StructType):
        return "OBJECT<" + ", ".join(f"{f.name}: {_shape(f.dataType)}" for f in sorted(dt.fields, key=lambda f: f.name)) + ">"
    return f"ARRAY<{_shape(dt.elementType)}>" if isinstance(dt, ArrayType) else "?"


def record_fingerprint(json: Column) -> Column:
    return F.sha2(record_shape(json), 256)


def record_turns(df: DataFrame, json_col: str) -> DataFrame:
    """JSON records of mixed layouts with ``layout`` (fingerprint), ``mapping`` and ``turns``."""
    out = df.withColumn("layout", record_fingerprint(F.col(json_col)))
    mapping, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for name, m in MAPPINGS.items():
        dt = _ddl(m["type"])
        known = [_shape(dt)]
        if "list" in m:  # a list without elements shows no inner paths
            known.append(f"OBJECT<{m['list'][0]}: ARRAY<?>>")
        hit = F.col("layout").isin([hashlib.sha256(k.encode()).hexdigest() for k in known])
        mapping = F.when(hit, F.lit(name)).otherwise(mapping)
        turns = F.when(hit, turns_of(name, F.from_json(F.col(json_col), dt))).otherwise(turns)
    return out.withColumn("mapping", mapping).withColumn("turns", turns)


# -- template -----------------------------------------------------------------

#: Fixed signs of the template: a turn is OPEN role HEAD text CLOSE.
OPEN, HEAD, CLOSE = "<s>[", "]\n", "</s>\n"
_TEXT = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))
_NAME = (*_TEXT, ("]", "\\c"))


def escape(c: Column, signs: tuple = _TEXT) -> Column:
    for plain, code in signs:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column, signs: tuple = _TEXT) -> Column:
    for plain, code in reversed(signs):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def piece(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role, _NAME), F.lit(HEAD), escape(text), F.lit(CLOSE))


def format_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """One row per conversation of a turn table: ``conv_id``, ``formatted`` and
    ``loss_spans`` (start, length in characters of ``formatted``).

    Texts are escaped in their own rows; one shuffle by conversation serves the
    running offset and the concatenation."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    role = F.coalesce(F.col(role_col), F.lit(""))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    made = (rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
            .withColumn("piece", piece(F.col("role"), F.col("text")))
            .withColumn("chars", F.char_length("piece").cast("long"))
            .withColumn("n", F.row_number().over(w))
            .withColumn("end", F.sum("chars").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("span", F.when(F.col("role") == trained, F.struct(
                (F.col("end") - len(CLOSE) - F.char_length(escape(F.col("text")))).alias("start"),
                F.char_length(escape(F.col("text"))).cast("long").alias("length")))))
    whole = made.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "piece", "span"))).alias("p"))
    return whole.select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"),
                        F.filter(F.transform("p", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"))


def format_turns(turns: Column, trained: str = "assistant") -> Column:
    """A ``turns`` column formatted; its loss spans follow from :func:`read_back`."""
    return F.array_join(F.transform(turns, lambda t: piece(t["role"], t["text"])), "")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, in order."""
    parts = F.slice(F.split(formatted, CLOSE, -1), 1, F.size(F.split(formatted, CLOSE, -1)) - 1)

    def one(p: Column) -> Column:
        head = F.instr(p, "]")
        return F.struct(unescape(F.substring(p, F.lit(len(OPEN) + 1), head - len(OPEN) - 1), _NAME).alias("role"),
                        unescape(F.substring(p, head + len(HEAD), F.char_length(p))).alias("text"))
    return F.transform(parts, one)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")
