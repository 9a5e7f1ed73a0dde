"""Documents, their texts and their indexes as tables on disk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.tree_build import PATH, build_index
from ..operators.tree_search import search
from ..sources.files import json_vectors
from .schemas import DOCUMENT, NODE, TEXT
from .storage import delete_path, materialize, path_exists, scratch

#: Nodes, and of leaves also the path, so that one table, replaced at once, has all of an index.
INDEX = T.StructType([*NODE.fields, T.StructField("path", PATH)])
BUCKETS = 64


class VectorCatalog:
    """Tables document, text and text_index below a folder.

    Each is dealt to a fixed number of buckets by a hash of doc_id, however many documents there
    are; within a bucket rows are dealt to files by ranges of document and key, so that a large
    document has several and a search reads its own. To replace or delete documents rewrites their
    buckets. A folder has one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, mode: str = "sql", buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.mode, self.buckets = spark, path.rstrip("/"), mode, buckets

    def _bucket(self, doc_id: Column) -> Column:
        return F.pmod(F.xxhash64(doc_id.cast("long")), F.lit(self.buckets)).cast("int")

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        where = f"{self.path}/{name}"
        if not path_exists(self.spark, where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(where)

    def _of(self, rows: DataFrame, doc_ids: Sequence[int]) -> DataFrame:
        """The rows of these documents, read from their buckets alone."""
        if "bucket" in rows.columns:
            rows = rows.where(F.col("bucket").isin(self._buckets(doc_ids)))
        return rows.where(F.col("doc_id").isin([int(d) for d in doc_ids]))

    def _buckets(self, doc_ids: Sequence[int]) -> list[int]:
        rows = self.spark.createDataFrame([(int(d),) for d in doc_ids], "doc_id long").select(self._bucket(F.col("doc_id")).alias("b")).distinct()
        return [r["b"] for r in rows.collect()]  # at most the number of buckets

    def _write(self, rows: DataFrame, name: str, key: str, mode: str) -> None:
        """Overwriting replaces the buckets that rows has, and leaves the others."""
        dealt = rows.withColumn("bucket", self._bucket(F.col("doc_id"))).repartitionByRange("bucket", "doc_id", key).sortWithinPartitions("bucket", "doc_id", key)
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def _replace(self, name: str, schema: T.StructType, key: str, doc_ids: Sequence[int], rows: DataFrame | None) -> None:
        """Puts rows (none: nothing) in the place of these documents' rows."""
        if not doc_ids or (rows is None and not path_exists(self.spark, f"{self.path}/{name}")):
            return
        old = self._table(name, schema)
        buckets = self._buckets(doc_ids)
        kept = old.where(F.col("bucket").isin(buckets)) if "bucket" in old.columns else old
        kept = kept.where(~F.col("doc_id").isin([int(d) for d in doc_ids])).select(*schema.names)
        made = materialize(kept if rows is None else kept.unionByName(rows.select(*schema.names)), f"catalog-{name}")
        left = {r["b"] for r in made.select(self._bucket(F.col("doc_id")).alias("b")).distinct().collect()}
        self._write(made, name, key, "overwrite")
        for bucket in set(buckets) - left:
            delete_path(self.spark, f"{self.path}/{name}/bucket={bucket}")

    def documents(self) -> DataFrame:
        return self._table("document", DOCUMENT).select(*DOCUMENT.names)

    def texts(self) -> DataFrame:
        return self._table("text", TEXT).select(*TEXT.names)

    def texts_of(self, doc_ids: Sequence[int]) -> DataFrame:
        return self._of(self._table("text", TEXT), doc_ids).select(*TEXT.names)

    def index(self) -> DataFrame:
        return self._table("text_index", INDEX).select(*NODE.names)

    def paths(self) -> DataFrame:
        return self._table("text_index", INDEX).where("id is not null").select("doc_id", "id", "range_id", "path")

    def add_documents(self, rows: DataFrame) -> None:
        """Adds documents (doc_id, name), or replaces those that are there under the same id."""
        rows = rows.select(*DOCUMENT.names)
        with scratch(self.spark):
            ids = [r[0] for r in rows.select("doc_id").distinct().collect()]  # those that the caller names
            self._replace("document", DOCUMENT, "doc_id", ids, rows.dropDuplicates(["doc_id"]))

    def add_texts(self, texts: DataFrame) -> None:
        """Appends texts (doc_id, text_id, text, vector as JSON). They are found once their documents are indexed."""
        self._write(texts.select(*TEXT.names), "text", "text_id", "append")

    def next_ids(self, n_known: str = "text_id") -> int:
        """The first id after those in use."""
        return (self.texts().agg(F.max(n_known)).first()[0] or 0) + 1

    def index_documents(self, doc_ids: Sequence[int] | None = None) -> None:
        """Builds and replaces the indexes of these documents, or all. A document whose texts are gone loses its index."""
        with scratch(self.spark):
            texts = self._table("text", TEXT)
            if doc_ids is not None:
                nodes = build_index(json_vectors(self._of(texts, doc_ids)), self.mode, with_paths=True)
                self._replace("text_index", INDEX, "range_id", list(doc_ids), nodes)
                return
            nodes = materialize(build_index(json_vectors(texts), self.mode, with_paths=True), "catalog-nodes")
            left = {r["b"] for r in nodes.select(self._bucket(F.col("doc_id")).alias("b")).distinct().collect()}
            self._write(nodes.select(*INDEX.names), "text_index", "range_id", "overwrite")
            for bucket in set(range(self.buckets)) - left:
                delete_path(self.spark, f"{self.path}/text_index/bucket={bucket}")

    def index_document(self, doc_id: int) -> None:
        self.index_documents([doc_id])

    def delete_document(self, doc_id: int) -> None:
        """Deletes a document, its texts and its index."""
        with scratch(self.spark):
            for name, schema, key in (("text_index", INDEX, "range_id"), ("text", TEXT, "text_id"), ("document", DOCUMENT, "doc_id")):
                self._replace(name, schema, key, [doc_id], None)

    def search(self, point: str | Sequence[float], domain: float | None, doc_id: int | None = None) -> DataFrame:
        paths = self._table("text_index", INDEX).where("id is not null")
        return search(paths if doc_id is None else self._of(paths, [doc_id]), point, domain)
