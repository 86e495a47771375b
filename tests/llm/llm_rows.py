"""Tables with the awkward cases that every operator has to take."""

from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                     StructField("source", StringType()), StructField("n_chars", LongType()),
                     # names that an operator might use itself
                     StructField("length", LongType()), StructField("digest", StringType()), StructField("_rest", StringType()),
                     StructField("kept", StringType()), StructField("key", StringType()), StructField("blk", StringType())])


def frame(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None if r[1] is None else len(r[1]), 7, "d", "r", "k", "y", "b") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


PROSE = ("The river runs past the old mill, and the miller counts his sacks before the market opens at noon. "
         "Nobody hurries here; the carts arrive when they arrive, and the bread is baked when the flour is dry. "
         "In winter the wheel stands still, so the family mends nets and tells long stories by the stove.")

AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, PROSE), (4, PROSE), (5, PROSE), (6, PROSE + " x"), (None, "no id here"),
           (7, "a\0b ▁ <s> é 日本 😀"), (8, "word " * 30000), (9, "Z" * 100_000), (10, PROSE[::-1])]
