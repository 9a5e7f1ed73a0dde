"""Generated points: the same on every evaluation, made where they are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _points(df: DataFrame, vector: Column) -> DataFrame:
    return df.select(F.lit(0).cast("long").alias("doc_id"), F.col("id"), vector.cast("array<float>").alias("vector"))


#: A prime below 2 ** 31, so that products of two residues fit a long.
_PRIME = 2_147_483_647


def random_uniform(spark: SparkSession, count: int, dims: int, seed: int = 1) -> DataFrame:
    """Components uniform in [-1, 1), from seed, id and dimension by whole-number arithmetic that any engine can repeat."""

    def unit(i: Column) -> Column:
        h = (F.col("id") * 48_271 + i.cast("long") * 69_621 + F.lit(seed * 16_807 % _PRIME)) % _PRIME
        for c in (1_234_567, 7_654_321, 31_415_926):
            h = (h * h + h * 40_692 % _PRIME + c) % _PRIME
        return (h % (1 << 24)).cast("double") / (1 << 23) - 1

    return _points(spark.range(count), F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), unit))


def one_hot(spark: SparkSession, dims: int) -> DataFrame:
    """The unit vectors of a space."""
    return _points(spark.range(dims), F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (i == F.col("id")).cast("float")))


def lattice(spark: SparkSession, n: int, offset: float, scale: float) -> DataFrame:
    """n x n records (id, tag, vector): ((i - offset) / scale, (j - offset) / scale), j running faster, tag "i,j"."""
    i, j = F.floor(F.col("id") / n), F.col("id") % n
    place = lambda x: ((x - F.lit(float(offset))) / F.lit(float(scale))).cast("float")
    return spark.range(n * n).select("id", F.concat_ws(",", i, j).alias("tag"), F.array(place(i), place(j)).alias("vector"))
