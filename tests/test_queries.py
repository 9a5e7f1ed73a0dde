"""Every engine query against its SQL on the test tables."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.conftest import DATA, as_rows
from vicinal import queries as engine

ORACLE = engine.oracle_sql()


def test_every_query_has_sql():
    assert set(ORACLE) == set(engine.queries())


@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_query(spark, duck, name):
    got = engine.queries()[name](spark, f"{DATA}/sf0.001").toPandas()
    want = duck(ORACLE[name], "sf0.001")
    assert sorted(got.columns) == sorted(want.columns)
    assert as_rows(got) == as_rows(want)


def test_batch_radius_is_in_double_precision(spark, duck, tmp_path):
    """A distance between the radius in single precision, which is less, and the radius is within it."""
    vectors = [[0.0, 0.0], [1.3, 0.0002], [0.5, 1.2], [1.0, 0.0]]
    distance = float(np.linalg.norm(np.float32(vectors[1]).astype(np.float64)))
    assert float(np.float32(engine.RADIUS)) < distance <= engine.RADIUS
    rows = {"vec_id": pa.array(range(4), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * 4, pa.int32())}
    pq.write_table(pa.table(rows), tmp_path / "embeddings.parquet")
    got = engine.l2_range_batch(spark, str(tmp_path)).toPandas()
    assert sorted(got["text_id"]) == [0, 1, 3]
    assert as_rows(got) == as_rows(duck(ORACLE["l2_range_batch"], os.path.relpath(tmp_path, DATA)))
