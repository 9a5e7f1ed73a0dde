"""An index on disk, laid out so that a search reads little.

A table `tops` has a row for each subtree of about `top_points` points: its path to the root and
its number of points. A table `leaves` has the points with their vectors and their paths below the
top, in the order of (doc_id, top), so that the files' and row groups' least and greatest values
tell which of them a search needs. A search tests the paths of the tops, reads the leaves of those
it reaches, and tests the rest of their paths; an exact range search measures distances at once,
for the vectors are there. What is read follows what the box reaches, not the size of the index.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import l2, level, linf, parse_point
from ..plans.storage import materialize
from .tree_build import build_index
from .tree_search import corners, in_reach

#: Reached tops up to which they are sent to the scan as values; more are joined.
MOST_VALUES = 2_000


class StoredIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.tops = spark.read.parquet(f"{self.path}/tops")
        self.leaves = spark.read.parquet(f"{self.path}/leaves")

    @classmethod
    def write(cls, points: DataFrame, path: str, mode: str = "sql", top_points: int = 4_096, row_group: int = 8 << 20, **options) -> StoredIndex:
        """Builds the trees of points (doc_id, id, vector) and writes them; row_group: bytes of a row group, the least that is read."""
        spark = points.sparkSession
        nodes = materialize(build_index(points, mode, with_paths=True, statistics=True, **options), "stored-nodes")
        most = nodes.where("range_id = 0").agg(F.max("points")).first()[0] or 1
        depth = max(0, math.ceil(math.log2(max(1, most / top_points))))
        up = F.greatest(level(F.col("range_id")) - depth, F.lit(0))
        leaves = nodes.where("id is not null").withColumn("up", up).withColumn("top", (F.call_function("shiftright", F.col("range_id") + 1, F.col("up")) - 1).cast("long"))
        low = leaves.select("doc_id", "id", "range_id", "top", F.slice("path", F.lit(1), F.col("up")).alias("path"))
        tops = leaves.groupBy("doc_id", "top").agg(F.count("*").alias("points"), F.any_value(F.expr("slice(path, up + 1, size(path))")).alias("path"))
        tops.write.mode("overwrite").parquet(f"{path.rstrip('/')}/tops")
        vectors = points.select(F.col("doc_id").alias("d"), F.col("id").alias("i"), "vector")
        rows = low.join(vectors, (F.col("doc_id") == F.col("d")) & (F.col("id") == F.col("i"))).drop("d", "i")
        rows.repartitionByRange("doc_id", "top", "range_id").sortWithinPartitions("doc_id", "top", "range_id").write.mode("overwrite").option("parquet.block.size", row_group).parquet(f"{path.rstrip('/')}/leaves")
        return cls(spark, path)

    def reached(self, point: str | Sequence[float], domain: float | None, doc_id: int | None = None) -> DataFrame:
        """doc_id, top and points of the subtrees that the box reaches."""
        tops = self.tops if doc_id is None else self.tops.where(F.col("doc_id") == doc_id)
        return tops.where(in_reach(F.col("path"), *corners(parse_point(point), domain))).select("doc_id", "top", "points")

    def _read(self, point: str | Sequence[float], domain: float | None, doc_id: int | None) -> DataFrame:
        """The leaves of the tops that the box reaches."""
        found = self.reached(point, domain, doc_id)
        some = found.limit(MOST_VALUES + 1).collect()
        leaves = self.leaves if doc_id is None else self.leaves.where(F.col("doc_id") == doc_id)
        if len(some) > MOST_VALUES:
            wide = found.select(F.col("doc_id").alias("d"), F.col("top").alias("t"))
            return leaves.join(wide, (F.col("doc_id") == F.col("d")) & (F.col("top") == F.col("t")), "left_semi")
        by: dict[int, list[int]] = {}
        for r in some:
            by.setdefault(r["doc_id"], []).append(r["top"])
        if not by:
            return leaves.where(F.lit(False))
        wanted: Column = F.lit(False)
        if len(by) <= 64:
            for doc, tops in by.items():
                wanted = wanted | ((F.col("doc_id") == doc) & F.col("top").isin(tops))
            return leaves.where(wanted)
        pairs = F.broadcast(found.select(F.col("doc_id").alias("d"), F.col("top").alias("t")))  # MOST_VALUES rows at most
        every = leaves.where(F.col("doc_id").isin(list(by)) & F.col("top").isin(sorted({t for x in by.values() for t in x})))
        return every.join(pairs, (F.col("doc_id") == F.col("d")) & (F.col("top") == F.col("t")), "left_semi")

    def search(self, point: str | Sequence[float], domain: float | None, doc_id: int | None = None) -> DataFrame:
        """doc_id and text_id of the candidates, the same as search over all leaf paths."""
        rows = self._read(point, domain, doc_id)
        return rows.where(in_reach(F.col("path"), *corners(parse_point(point), domain))).select("doc_id", F.col("id").alias("text_id"))

    def range_search(self, point: str | Sequence[float], radius: float, metric: str = "l2", doc_id: int | None = None) -> DataFrame:
        """doc_id, text_id and distance of exactly the points within the radius."""
        q = parse_point(point)
        wide = float(radius) * (1 + 1e-6) + 1e-6
        rows = self._read(q, wide, doc_id).where(in_reach(F.col("path"), *corners(q, wide)))
        measured = rows.select("doc_id", F.col("id").alias("text_id"), {"l2": l2, "linf": linf}[metric]("vector", q).alias("distance"))
        return measured.where(F.col("distance") <= float(radius))
