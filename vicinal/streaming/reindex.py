"""Keeping indexes up to date with a stream of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.catalog import VectorCatalog


def reindex(stream: DataFrame, catalog: VectorCatalog, checkpoint: str, **trigger) -> StreamingQuery:
    """Adds each micro-batch's texts (doc_id, text_id, text, vector) to the catalog and indexes the documents they belong to.

    A batch that is repeated after a failure adds none of its texts twice: those whose ids are
    there already are left out.
    """

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.dropDuplicates(["doc_id", "text_id"]).persist()
        try:
            touched = [r[0] for r in rows.select("doc_id").distinct().collect()]  # the documents of one micro-batch
            if touched:
                known = catalog.texts_of(touched).select("doc_id", "text_id")
                catalog.add_texts(rows.join(known, ["doc_id", "text_id"], "left_anti"))
                catalog.index_documents(touched)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
