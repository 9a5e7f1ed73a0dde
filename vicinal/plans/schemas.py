"""Schemas of the tables, and the checks that stand in for keys and constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType(), False), T.StructField("name", T.StringType())])

TEXT = T.StructType(
    [
        T.StructField("doc_id", T.LongType(), False),
        T.StructField("text_id", T.LongType(), False),
        T.StructField("text", T.StringType()),
        T.StructField("vector", T.StringType()),  # a JSON array of numbers
    ]
)

POINT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("id", T.LongType(), False), T.StructField("vector", T.ArrayType(T.FloatType()), False)])

#: One row for each component of a point.
COMPONENT = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("idx", T.IntegerType(), False), T.StructField("value", T.FloatType())])

NODE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("range_id", T.LongType(), False),
        T.StructField("dimension", T.IntegerType()),
        T.StructField("mid", T.FloatType()),
        T.StructField("low_range_id", T.LongType()),
        T.StructField("high_range_id", T.LongType()),
        T.StructField("id", T.LongType()),
    ]
)

#: What the split of a node was chosen from, for those who want to see it.
STATISTICS = T.StructType([*NODE.fields, T.StructField("points", T.LongType()), T.StructField("stdev", T.DoubleType()), T.StructField("mean_id", T.LongType())])

SEARCH = T.StructType([T.StructField("query_id", T.LongType(), False), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("domain", T.FloatType()), T.StructField("doc_id", T.LongType())])


def as_points(df: DataFrame, id: str = "id", vector: str = "vector", doc_id: str | None = None) -> DataFrame:
    """doc_id, id and vector of any table; without a document column all points belong to document 0. Null vectors are left out."""
    doc = F.col(doc_id).cast("long") if doc_id else F.lit(0).cast("long")
    columns = {"doc_id": doc, "id": F.col(id), "vector": F.col(vector)}
    return df.where(F.col(vector).isNotNull()).select(*(columns[f.name].cast(f.dataType).alias(f.name) for f in POINT))


def check_points(points: DataFrame, unique: bool = True) -> int:
    """Raises ValueError for vectors that are empty, of different lengths, or hold null or NaN, and for ids that repeat within a document. Returns the number of dimensions (0 without points)."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x))
    row = points.agg(F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most"), F.coalesce(F.max(bad.cast("int")), F.lit(0)).alias("bad"), F.coalesce(F.max(F.col("id").isNull().cast("int")), F.lit(0)).alias("no_id")).first()
    if row["least"] is None:
        return 0
    if row["least"] == 0:
        raise ValueError("a vector is empty")
    if row["least"] != row["most"]:
        raise ValueError(f"vectors have from {row['least']} to {row['most']} components")
    if row["bad"] or row["no_id"]:
        raise ValueError("a vector holds null or NaN" if row["bad"] else "a point has no id")
    if unique and not points.groupBy("doc_id", "id").count().where("count > 1").isEmpty():
        raise ValueError("an id repeats within a document")
    return row["most"]
