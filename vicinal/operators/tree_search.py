"""Searching trees: candidates of the box around a point, and exact ranges.

From a node the search goes low if its split lies at or above the box's lower bound in the split
dimension, high if at or below the upper bound, and both ways where the node has no dimension.
It returns the points of all leaves it reaches: every point of the box, and others. A query
without the split dimension, or with a null domain, goes nowhere there.

Four plans give the same rows:

* `StoredIndex` (stored_index.py) reads only the parts of an index on disk that the box reaches,
* `search` tests the path of every leaf (`leaf_paths`, made once for an index) by one filter,
* `search_batch` follows the frontier of many queries level by level, by joins on node numbers,
  so that its cost follows the nodes visited, not queries x leaves,
* `search_sql` is a recursive SQL query over the edges that the box leaves open.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import Vector, l2, level, linf, parse_point, vector_column
from ..plans.schemas import SEARCH
from ..plans.storage import MOST_BROADCAST, materialize
from .tree_build import paths_of


def leaf_paths(index: DataFrame) -> DataFrame:
    """doc_id, id, range_id and path of each leaf point: the splits from its parent up to the root, and the side taken. An index built with paths has them already."""
    leaves = index.where("id is not null")
    if "path" in index.columns:
        return leaves.select("doc_id", "id", "range_id", "path")
    return paths_of(leaves.select("doc_id", "id", "range_id"), index.where("id is null"), "id").select("doc_id", "id", "range_id", "path")


def in_reach(path: Column, low: Column, high: Column) -> Column:
    """Whether a box with these corners reaches the end of a path."""
    return F.forall(path, lambda c: c["dimension"].isNull() | F.when(c["is_high"], c["mid"] <= F.get(high, c["dimension"])).otherwise(c["mid"] >= F.get(low, c["dimension"])))


def corners(point: Vector, domain: float | None | Column) -> tuple[Column, Column]:
    """The least and greatest corner of the box around a point."""
    half = (domain if isinstance(domain, Column) else F.lit(domain)).cast("float")
    v = vector_column(point)
    return F.transform(v, lambda x: x - half), F.transform(v, lambda x: x + half)


def search(paths: DataFrame, point: str | Sequence[float], domain: float | None, doc_id: int | None = None) -> DataFrame:
    """doc_id and text_id of the candidates; paths is leaf_paths of an index, point numbers or a JSON array."""
    rows = paths if doc_id is None else paths.where(F.col("doc_id") == doc_id)
    return rows.where(in_reach(F.col("path"), *corners(parse_point(point), domain))).select("doc_id", F.col("id").alias("text_id"))


def search_batch(index: DataFrame, queries: DataFrame, with_visits: bool = False) -> DataFrame:
    """query_id, doc_id and text_id of the candidates of queries (query_id, vector, domain, doc_id; a null doc_id is all documents). with_visits: all nodes visited, as query_id, doc_id, range_id, text_id."""
    nodes = materialize(index.select("doc_id", "range_id", "dimension", "mid", "low_range_id", "high_range_id", "id", level(F.col("range_id")).alias("level")), "search-nodes")
    sizes = {r["level"]: r["count"] for r in nodes.groupBy("level").count().collect()}  # 62 rows at most
    asked = queries.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in SEARCH)).withColumnRenamed("doc_id", "only")
    low, high = corners(F.col("vector"), F.col("domain"))
    asked = asked.select("query_id", "only", low.alias("low"), high.alias("high"))
    at = lambda k: nodes.where(F.col("level") == k).drop("level")
    small = lambda df, k: F.broadcast(df) if sizes.get(k, 0) <= MOST_BROADCAST else df
    # the roots: one for each document, and a query meets the one it asks for or all
    roots = at(0)
    everywhere = asked.where("only is null").join(small(roots, 0), F.lit(True)) if sizes.get(0, 0) <= MOST_BROADCAST else asked.where("only is null").crossJoin(roots)
    frontier = everywhere.unionByName(asked.where("only is not null").join(small(roots, 0), F.col("only") == F.col("doc_id"))).drop("only")
    out = None
    for k in range(max(sizes, default=0) + 1):
        seen = frontier.select("query_id", "doc_id", "range_id", F.col("id").alias("text_id"))
        out = seen if out is None else out.unionByName(seen)
        if sizes.get(k + 1, 0) == 0:
            break
        free = F.col("dimension").isNull()
        goes_low = F.when(F.col("low_range_id").isNotNull() & (free | (F.col("mid") >= F.get("low", "dimension"))), F.col("low_range_id"))
        goes_high = F.when(F.col("high_range_id").isNotNull() & (free | (F.col("mid") <= F.get("high", "dimension"))), F.col("high_range_id"))
        steps = frontier.select("query_id", "low", "high", F.col("doc_id").alias("d"), F.explode(F.array_compact(F.array(goes_low, goes_high))).alias("r"))
        below = at(k + 1)
        frontier = steps.join(small(below, k + 1), (F.col("d") == F.col("doc_id")) & (F.col("r") == F.col("range_id"))).drop("d", "r")
        if k % 6 == 5:
            frontier = materialize(frontier, "search-frontier")
    return out if with_visits else out.where("text_id is not null").select("query_id", "doc_id", "text_id")


RECURSION = """
with recursive reach(doc_id, range_id) as (
  select doc_id, range_id from {nodes} where range_id = 0 {only}
  union all
  select e.doc_id, e.child_id from reach r join {edges} e on e.doc_id = r.doc_id and e.parent_id = r.range_id
)
select n.doc_id, n.id as text_id from reach r join {nodes} n on n.doc_id = r.doc_id and n.range_id = r.range_id
where n.id is not null
"""


def edges(index: DataFrame) -> DataFrame:
    """doc_id, parent_id, child_id, dimension, mid and is_high of each edge of the trees."""
    both = F.array(F.struct(F.col("low_range_id").alias("child_id"), F.lit(False).alias("is_high")), F.struct(F.col("high_range_id").alias("child_id"), F.lit(True).alias("is_high")))
    return index.where("low_range_id is not null").select("doc_id", F.col("range_id").alias("parent_id"), "dimension", "mid", F.explode(both).alias("e")).select("doc_id", "parent_id", "e.child_id", "dimension", "mid", "e.is_high")


def search_sql(spark: SparkSession, index: DataFrame, point: str | Sequence[float], domain: float | None, doc_id: int | None = None, row_limit: int = 100_000_000) -> DataFrame:
    """The candidates by a recursive query; only the edges that the box leaves open are recursed into. Sets the session's limit of rows of a recursion to row_limit, for the result is evaluated later."""
    low, high = corners(parse_point(point), domain)
    open_ = F.col("dimension").isNull() | F.when(F.col("is_high"), F.col("mid") <= F.get(high, F.col("dimension"))).otherwise(F.col("mid") >= F.get(low, F.col("dimension")))
    spark.conf.set("spark.sql.cteRecursionRowLimit", str(row_limit))
    name = f"vicinal_{abs(hash((str(point), domain, doc_id))) % 10**12}"
    index.createOrReplaceTempView(f"{name}_nodes")
    edges(index).where(open_).createOrReplaceTempView(f"{name}_edges")
    return spark.sql(RECURSION.format(nodes=f"{name}_nodes", edges=f"{name}_edges", only="" if doc_id is None else f"and doc_id = {int(doc_id)}"))


def register_search(spark: SparkSession, paths: DataFrame, name: str = "vicinity_search") -> None:
    """Makes the search a table function of SQL: name(point JSON, domain, doc_id or null) -> (doc_id, text_id)."""
    paths.createOrReplaceTempView(f"{name}_paths")
    spark.sql(
        f"""create or replace temporary function {name}(point string, domain float, doc bigint) returns table (doc_id bigint, text_id bigint)
        return select p.doc_id, p.id from {name}_paths p
        where ({name}.doc is null or p.doc_id = {name}.doc)
          and forall(p.path, c -> c.dimension is null or if(c.is_high,
              c.mid <= get(from_json({name}.point, 'array<float>'), c.dimension) + {name}.domain,
              c.mid >= get(from_json({name}.point, 'array<float>'), c.dimension) - {name}.domain))"""
    )


def _wider(radius: Column) -> Column:
    """The radius with room for the rounding of single precision."""
    return radius.cast("double") * (1 + 1e-6) + 1e-6


def range_search(paths: DataFrame, points: DataFrame, point: str | Sequence[float], radius: float, metric: str = "l2", doc_id: int | None = None) -> DataFrame:
    """doc_id, text_id and distance of exactly the points within the radius: candidates of the box, then their vectors' distances."""
    q = parse_point(point)
    found = search(paths, q, float(radius) * (1 + 1e-6) + 1e-6, doc_id)
    near = points.select(F.col("doc_id").alias("d"), F.col("id").alias("i"), {"l2": l2, "linf": linf}[metric]("vector", q).alias("distance"))
    return found.join(near, (F.col("doc_id") == F.col("d")) & (F.col("text_id") == F.col("i"))).where(F.col("distance") <= float(radius)).select("doc_id", "text_id", "distance")


def range_search_batch(index: DataFrame, points: DataFrame, queries: DataFrame, metric: str = "l2") -> DataFrame:
    """query_id, doc_id, text_id and distance of the points within each query's radius: column domain in double precision, so give doubles; only the box is in single precision, and wider."""
    asked = queries.select("query_id", F.col("vector").alias("q"), F.col("domain").cast("double").alias("radius"))
    found = search_batch(index, queries.withColumn("domain", _wider(F.col("domain"))))
    near = points.select(F.col("doc_id").alias("d"), F.col("id").alias("i"), "vector")
    joined = found.join(asked.withColumnRenamed("query_id", "qid"), F.col("query_id") == F.col("qid")).join(near, (F.col("doc_id") == F.col("d")) & (F.col("text_id") == F.col("i")))
    measured = joined.withColumn("distance", {"l2": l2, "linf": linf}[metric]("vector", "q"))
    return measured.where(F.col("distance") <= F.col("radius")).select("query_id", "doc_id", "text_id", "distance")
