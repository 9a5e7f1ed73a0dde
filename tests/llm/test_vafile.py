import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA, as_rows
from vicinal.llm import vafile
from vicinal.llm.queries import OP4_SQL, op4_va_file_top5

SCHEMA = "vec_id long, embedding array<double>, score string, v string"


def brute(rows, every, k=5):
    whole = lambda x: int(x) * 256 if abs(x) >= 2**53 else math.floor(x * 256)
    good = [(i, [whole(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % every == 0:
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j) for j, v in good if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def search(spark, rows, every, **options):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in vafile.top_k(df, F.col("vec_id") % every == 0, **options).collect())


def test_against_sql(spark, duck):
    assert as_rows(op4_va_file_top5(spark, f"{DATA}/sf0.1").toPandas()) == as_rows(duck(OP4_SQL, "sf0.1"))


@pytest.mark.parametrize("bits, block", [(1, 200), (6, 1 << 25), (8, 500)])
def test_cells_and_blocks_of_any_size(spark, bits, block):
    rows = [(i, [math.sin(i * (d + 1)) for d in range(7)]) for i in range(120)]
    assert search(spark, rows, 10, bits=bits, query_bytes=block) == brute(rows, 10)


def test_queries_that_all_vectors_are_equal_for(spark):
    """All scores of a zero vector are ties."""
    rows = [(i, [0.0] * 4 if i % 100 == 0 else [math.sin(i), math.cos(i), 0.1, i / 500]) for i in range(500)]
    assert search(spark, rows, 50) == brute(rows, 50)


def test_packed_cells():
    rng = np.random.default_rng(1)
    for bits in range(1, 9):
        cells = rng.integers(0, 1 << bits, (9, 13))
        packed = vafile.pack(cells, bits)
        assert len(packed[0]) == -(-13 * bits // 8) and (vafile.unpack(packed, 13, bits) == cells).all()


def test_few_exact_vectors_are_read(spark):
    """Bounds hold for every pair, come from the cells alone, and leave a small part of the pairs open."""
    rng = np.random.default_rng(6)
    x = rng.normal(0, 0.125, (3000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    base = vafile.materialize(vafile.entries(vafile.finite(df), 5, 256), "test-entries")
    limits = vafile._limits(base)
    cells = vafile.approximations(base, limits, 8)
    assert "v" not in cells.columns and cells.agg(F.max(F.octet_length("cells"))).first()[0] == 64
    of = {r["only"]: r["row"] for r in base.collect()}
    v = np.floor(x * 256)
    ids = np.arange(0, 3000, 50)
    got = vafile._scan(cells, [(ids, ids, v[ids])], limits, 5, 8).collect()
    assert len(got) < 0.02 * len(ids) * 3000
    back = {r: i for i, r in of.items()}
    seen = {}
    for r in got:
        exact = v[r["q"]] @ v[back[r["row"]]]
        assert r["lower"] <= exact <= r["upper"]
        seen.setdefault(r["q"], set()).add(back[r["row"]])
    for q in ids:
        scores = v @ v[q]
        scores[q] = -np.inf
        assert set(np.argsort(-scores)[:5].tolist()) <= seen[q]


def test_many_equal_vectors(spark):
    """A third of the rows are one vector; it is one entry, and ties go to the least ids."""
    rows = [(i, [0.5, 0.25, -0.125] if i % 3 == 0 else [math.sin(i), math.cos(i), 0.1]) for i in range(900)]
    assert search(spark, rows, 50) == brute(rows, 50)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert vafile.entries(vafile.finite(df), 5, 256).agg(F.max(F.size("ids"))).first()[0] == 6


def test_ties_repeated_vectors_and_ids(spark):
    rows = [(i, [1.0, float(i % 2)]) for i in range(400)] + [(3, [1.0, 1.0]), (50, [1.0, 0.0])]
    assert search(spark, rows, 50) == brute(rows, 50)


def test_odd_vectors(spark):
    rows = [(0, [0.5, 0.25]), (50, None), (1, [None, 1.0]), (2, [math.nan, 1.0]), (3, [math.inf, 0.0]), (4, []), (100, []), (5, [1e300, -1e300]), (6, [1e9, 1e9]), (150, [1e9, -1.0]), (None, [1.0, 1.0]), (7, [1.0]), (8, [-0.001, 0.3])]
    assert search(spark, rows, 50) == brute(rows, 50)


def test_few_and_none(spark):
    assert search(spark, [(0, [1.0]), (1, [2.0])], 50) == [(0, 1, 1, 256 * 512)]
    assert search(spark, [(0, [1.0])], 50) == [] and search(spark, [], 50) == []
