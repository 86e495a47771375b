"""chunkwise — document retrieval on Spark.

Corpora are read from tables or file trees, cleaned, split into chunks by
token budget or by semantic similarity, embedded, stored in explicit-schema
tables and searched with exact cosine top-k for whole tables of questions.
Public functions take and return DataFrames.

Main entry points:

* ``plans.ingest.chunk_documents`` / ``plans.files.chunk_files`` — chunk rows
  from a document table or a file tree (strategy "sentence" or "semantic");
* ``operators.retrieve.top_k`` and ``plans.rag.answer_markdown`` /
  ``operators.answer.answer_questions`` — retrieval and answers;
* ``sources.tables.VersionedTable`` with ``operators.mutate`` — storage and
  row changes; ``plans.sync`` — the register / sync / remove lifecycle;
* ``streaming.ingest`` — incremental ingest with Structured Streaming.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value so Python workers need not
    import it (no --py-files needed for the Arrow helpers)."""
    import sys

    try:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # pragma: no cover - older cloudpickle
        pass


_ship_by_value()
