"""Reading and writing vectors and indexes as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import from_json_array, vector_text


def json_vectors(texts: DataFrame, vector: str = "vector") -> DataFrame:
    """doc_id, id and vector of texts (doc_id, text_id, vector as a JSON array); rows without a vector are left out."""
    return texts.where(F.col(vector).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text_id").cast("long").alias("id"), from_json_array(F.col(vector)).alias("vector"))


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """id, tag and vector of an ARFF file of numeric columns and a last column with the class. Ids count the data rows, file by file, in order."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    data = lines.where("trim(value) <> '' and not startswith(ltrim(value), '@') and not startswith(ltrim(value), '%')")
    cells = F.transform(F.split("value", ","), lambda x: F.trim(x))  # a second parameter would be what to trim
    numbers = F.slice(cells, F.lit(1), F.size(cells) - 1).cast("array<float>")
    rows = data.select("file", "block", "at", F.element_at(cells, -1).alias("tag"), numbers.alias("vector"))
    # counts by block, then places within a block: no row meets all others
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("file").alias("f"), F.col("block").alias("b"), before.alias("start"))
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    numbered = rows.withColumn("place", place)
    return numbered.join(starts, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).select((F.col("start") + F.col("place")).cast("long").alias("id"), "tag", "vector")


def vector_lines(points: DataFrame) -> DataFrame:
    """ID and Vector: the id, and the components joined by commas."""
    return points.select(F.col("id").alias("ID"), vector_text("vector").alias("Vector"))


def write_vectors(points: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Lines ID|v1,v2,... below a header."""
    vector_lines(points).write.mode(mode).option("sep", "|").option("header", True).option("quote", "").csv(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("sep", "|").option("header", True).schema("ID long, Vector string").csv(path)
    return rows.select(F.lit(0).cast("long").alias("doc_id"), F.col("ID").alias("id"), F.split("Vector", ",").cast("array<float>").alias("vector"))


def write_range_values(values: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The node values of an index as CSV: RangeID,Dimension,Mid,ID. A dimension beyond 16 bits is an error (ANSI casts check)."""
    values.select(F.col("range_id").alias("RangeID"), F.col("dimension").cast("short").alias("Dimension"), F.col("mid").alias("Mid"), F.col("id").alias("ID")).write.mode(mode).option("header", True).csv(path)
