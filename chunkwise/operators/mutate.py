"""Row changes as table-to-table transforms (M1-M6).

Parquet has no MERGE, so each change is a pure ``DataFrame -> DataFrame``
function; :class:`chunkwise.sources.tables.VersionedTable` writes the result
as a new version (never over the files being read).

Plans: the change set is broadcast only after a check of its counted rows
against ``max_broadcast_rows`` and of its measured bytes against a budget; then
neither delete nor update shuffles the big table.  Past the bound the join is a shuffle join, where AQE splits a hot key
(a path holding a large share of the chunks) into several tasks.  Keys are
matched by joins and literals, never by formatted predicate strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 2_000_000
MAX_BROADCAST_BYTES = 256 << 20


def _row_bytes(f) -> Column:
    """Bytes of a column's value: measured for strings, binaries and arrays, 8 otherwise."""
    from pyspark.sql import types as T

    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 16
    if isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, (T.NumericType, T.BooleanType)):
        return F.octet_length(F.to_json(F.struct(c))).cast("long") * 4 + 16
    if isinstance(f.dataType, T.ArrayType):
        return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long") * 8 + 16
    if isinstance(f.dataType, (T.MapType, T.StructType)):
        return F.octet_length(F.to_json(F.struct(c))).cast("long") * 4 + 16
    return F.lit(8).cast("long")


def _maybe_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast only when the counted rows and their measured bytes stay under both
    bounds (one partial aggregate: every partition sends two numbers)."""
    size = F.lit(0).cast("long")
    for f in df.schema.fields:
        size = size + _row_bytes(f)
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and total <= MAX_BROADCAST_BYTES else df


def _keys(on) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def latest_per_key(changes: DataFrame, on, order_by=None) -> DataFrame:
    """One change per key: the last by ``order_by`` (a column or several), ties and
    the default by all other columns in order, so the winner does not depend on
    the order of rows.  A partial aggregate: a key with many changes is combined
    before the shuffle."""
    keys = _keys(on)
    others = [c for c in changes.columns if c not in keys]
    if not others:
        return changes.distinct()
    first = [] if order_by is None else _keys(order_by)
    order = F.struct(*[F.col(c) for c in first + [c for c in others if c not in first]])
    best = changes.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_w"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_w.`{c}`").alias(c) for c in changes.columns])


def delete_keys(df: DataFrame, keys: DataFrame, on="file_path",
                max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """M1: drop the rows whose key is in ``keys`` (left anti join)."""
    k = _keys(on)
    return df.join(_maybe_broadcast(keys.select(*k).distinct(), max_broadcast_rows), k, "left_anti")


def cascade_delete(files: DataFrame, chunks: DataFrame, paths: DataFrame, path_col: str = "file_path",
                   chunk_key: str = "root_path") -> tuple[DataFrame, DataFrame]:
    """M2: the same path set removed from the registry and from the chunk table
    (chunks carry the registered path in ``root_path``)."""
    p = paths.select(F.col(path_col).alias("_p")).distinct()
    return (delete_keys(files, p.withColumnRenamed("_p", "file_path"), "file_path"),
            delete_keys(chunks, p.withColumnRenamed("_p", chunk_key), chunk_key))


def update_where(df: DataFrame, updates: DataFrame, on, assignments: dict[str, Column], order_by=None,
                 max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """M3/M4/M6: rows whose key is in ``updates`` get ``assignments``.

    ``assignments`` maps a column of ``df`` to an expression over the columns
    of ``updates`` (renamed ``_u_<name>``) and of ``df``; other rows are unchanged.
    Of several updates of a key the last by ``order_by`` wins (:func:`latest_per_key`).
    """
    k = _keys(on)
    u = latest_per_key(updates, k, order_by)
    ucols = [c for c in u.columns if c not in k]
    u = u.select(*k, *[F.col(c).alias(f"_u_{c}") for c in ucols], F.lit(True).alias("_hit"))
    j = df.join(_maybe_broadcast(u, max_broadcast_rows), k, "left")
    hit = F.col("_hit").isNotNull()
    out = []
    for c in df.columns:
        out.append((F.when(hit, assignments[c]).otherwise(F.col(c)) if c in assignments else F.col(c)).alias(c))
    return j.select(*out)


def upsert(df: DataFrame, changes: DataFrame, on, order_by: str | None = None,
           max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """M5: whole-row upsert — rows of ``changes`` replace rows with the same key,
    keys absent from ``df`` are inserted (anti join + union; latest change wins).

    ``changes`` is read twice (key side and union side); persist it first
    when it is expensive to compute (e.g. freshly chunked and embedded rows).
    """
    k = _keys(on)
    c = latest_per_key(changes, k, order_by).select(*df.columns)
    kept = df.join(_maybe_broadcast(c.select(*k), max_broadcast_rows), k, "left_anti")
    return kept.unionByName(c)


# ---------------------------------------------------------------------------
# Reference-level operations on the registry and settings tables

def update_progress(files: DataFrame, updates: DataFrame, now, order_by: str | None = None) -> DataFrame:
    """M3: ``updates(file_path, progress)`` -> progress and sync_time set on matching rows;
    of several for one path the last by ``order_by``, else the furthest."""
    now_c = now if isinstance(now, Column) else F.lit(now).cast("long")
    cols = ["file_path", "progress", *([order_by] if order_by and order_by != "progress" else [])]
    return update_where(files, updates.select(*cols), "file_path",
                        {"progress": F.col("_u_progress").cast("int"), "sync_time": now_c}, order_by)


def update_token(settings: DataFrame, changes: DataFrame, now, order_by: str | None = None) -> DataFrame:
    """M4: ``changes(id, url, token)``: url and token replaced, state reset to true, time stamped."""
    now_c = now if isinstance(now, Column) else F.lit(now).cast("long")
    return update_where(settings, changes.select("id", "url", "token", *([order_by] if order_by else [])), "id",
                        {"url": F.col("_u_url"), "token": F.col("_u_token"),
                         "state": F.lit(True), "time": now_c}, order_by)


def upsert_token(settings: DataFrame, changes: DataFrame, now, order_by: str | None = None) -> DataFrame:
    """M5: insert settings rows whose id is absent, update (M4) the others."""
    now_c = now if isinstance(now, Column) else F.lit(now).cast("long")
    last = latest_per_key(changes.select("id", "url", "token", *([order_by] if order_by else [])), "id", order_by)
    rows = last.select("id", "url", "token", F.lit(True).alias("state"), now_c.alias("time"))
    return upsert(settings, rows, "id")


def set_state(settings: DataFrame, ids: DataFrame, state: bool, now) -> DataFrame:
    """M6: flip ``state`` of the given ids and stamp ``time``."""
    now_c = now if isinstance(now, Column) else F.lit(now).cast("long")
    return update_where(settings, ids.select("id"), "id", {"state": F.lit(state), "time": now_c})
