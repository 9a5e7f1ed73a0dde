"""Column expressions over vectors (arrays of float), all evaluated in the JVM."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.schemas import COMPONENT

Vector = Column | str | Sequence[float]


def vector_column(v: Vector) -> Column:
    """A vector from a column, its name, or numbers."""
    if isinstance(v, Column):
        return v
    if isinstance(v, str):
        return F.col(v)
    return F.array(*(F.lit(float(x)) for x in v)).cast("array<float>")


def from_json_array(text: Column) -> Column:
    """A vector from a JSON array of numbers, or null for other text."""
    return F.from_json(text, "array<float>")


def parse_point(point: str | Sequence[float]) -> list[float]:
    return [float(x) for x in (json.loads(point) if isinstance(point, str) else point)]


def component(v: Vector, at: Column | int) -> Column:
    """A component by its place from 0, null where the vector is shorter."""
    return F.get(vector_column(v), at if isinstance(at, Column) else F.lit(at))


def _differences(a: Vector, b: Vector) -> Column:
    return F.zip_with(vector_column(a), vector_column(b), lambda x, y: x.cast("double") - y.cast("double"))


def l2(a: Vector, b: Vector) -> Column:
    """Euclidean distance, in double precision; null for vectors of different lengths."""
    return F.sqrt(F.aggregate(_differences(a, b), F.lit(0.0), lambda s, x: s + x * x))


def linf(a: Vector, b: Vector) -> Column:
    """The largest difference of components."""
    return F.array_max(F.transform(_differences(a, b), F.abs))


def box(v: Vector, domain: Column | float) -> tuple[Column, Column]:
    """The least and greatest corner of the box around a point, in single precision."""
    half = (domain if isinstance(domain, Column) else F.lit(domain)).cast("float")
    return F.transform(vector_column(v), lambda x: x - half), F.transform(vector_column(v), lambda x: x + half)


def vector_text(v: Vector, separator: str = ",") -> Column:
    return F.concat_ws(separator, F.transform(vector_column(v), lambda x: x.cast("string")))


def level(range_id: Column) -> Column:
    """The depth of a node in the binary numbering 0; 1, 2; 3, 4, 5, 6; ..."""
    return (F.length(F.bin(range_id + 1)) - 1).cast("int")


def explode_components(points: DataFrame) -> DataFrame:
    """doc_id, and id, idx and value of COMPONENT: one row for each component."""
    return points.select("doc_id", "id", F.posexplode("vector").alias("idx", "value")).select("doc_id", *(F.col(f.name).cast(f.dataType).alias(f.name) for f in COMPONENT))


def extent(df: DataFrame, vector: str = "vector") -> tuple[list[float], list[float]]:
    """The least and the greatest value in each dimension."""
    dims = df.agg(F.max(F.size(vector))).first()[0] or 0
    if not dims:
        return [], []
    row = df.agg(*(f(F.get(vector, F.lit(i))).alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    return [float(row[f"lo{i}"]) for i in range(dims)], [float(row[f"hi{i}"]) for i in range(dims)]


def normalization(low: Sequence[float], high: Sequence[float]) -> tuple[list[float], float]:
    """Offsets and a scale that bring the extent into [-1, 1]: nothing if it lies there, only a shift if no span exceeds 2, else both."""
    if not low or (min(low) >= -1 and max(high) <= 1):
        return [0.0] * len(low), 1.0
    offsets = [(a + b) / 2 for a, b in zip(low, high, strict=True)]
    span = max(b - a for a, b in zip(low, high, strict=True))
    return offsets, 1.0 if span <= 2 else span / 2


def normalize(v: Vector, offsets: Sequence[float], scale: float) -> Column:
    return F.zip_with(vector_column(v), F.array(*(F.lit(float(x)) for x in offsets)), lambda x, o: ((x.cast("double") - o) / F.lit(float(scale))).cast("float"))


def denormalize(v: Vector, offsets: Sequence[float], scale: float) -> Column:
    return F.zip_with(vector_column(v), F.array(*(F.lit(float(x)) for x in offsets)), lambda x, o: (x.cast("double") * F.lit(float(scale)) + o).cast("float"))
