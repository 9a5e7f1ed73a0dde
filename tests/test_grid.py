import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from vicinal.functions.vectors import l2
from vicinal.operators.grid import GridIndex
from vicinal.sources.generators import lattice
from vicinal.streaming.live_grid import LiveGrid

CASES = [(3, 1, 1, (0.5, 0.9), 0.6, 2), (10, 4.5, 5, (0.3, 0.3), 0.3, 9), (100, 49.5, 50, (0.3, 0.3), 0.1, 80), (100, 1, 1, (0.3, 0.3), 0.3, 0), (100, 1, 1, (0.3, 0.3), 0.5, 1)]


@pytest.mark.parametrize("n, offset, scale, q, distance, matches", CASES)
def test_find_against_brute_force(spark, n, offset, scale, q, distance, matches):
    rows = lattice(spark, n, offset, scale)
    grid = GridIndex(rows)
    assert grid.count == n * n
    near = l2("vector", q) <= distance
    got = {r["id"] for r in grid.find(q, distance, near).collect()}
    want = {r["id"] for r in rows.where(near).collect()}
    assert got == want and len(got) == matches
    assert grid.candidates(q, distance).count() < n * n or n < 10


def test_a_million_records(spark):
    grid = GridIndex(lattice(spark, 1000, 499.5, 500))
    q, near = (0.3, 0.3), l2("vector", (0.3, 0.3)) <= 0.05
    assert grid.find(q, 0.05, near).count() == 1976
    assert grid.candidates(q, 0.05).count() < 5000


@pytest.mark.parametrize("n, offset, scale, cells", [(10, 4.5, 5, 12), (100, 49.5, 50, 1264)])
def test_cells(spark, n, offset, scale, cells):
    found = GridIndex(lattice(spark, n, offset, scale)).cells("id").persist()
    leaves = found.where("records is not null")
    assert leaves.count() == cells
    assert leaves.agg(F.sum("records"), F.max("records"), F.sum(F.size("ids"))).first()[:] == (n * n, leaves.agg(F.max("records")).first()[0], n * n)
    assert leaves.agg(F.max("records")).first()[0] <= 10
    parents = {r["cell"] for r in found.collect()}
    assert all(r["parent"] in parents for r in found.collect() if r["cell"])
    assert {tuple(r["center"]) for r in found.where("cell = ''").collect()} == {(0.0, 0.0)}


def test_remove_add_clear(spark):
    rows = lattice(spark, 10, 4.5, 5)
    q, near = (0.3, 0.3), l2("vector", (0.3, 0.3)) <= 0.3
    grid = GridIndex(rows)
    less = grid.remove(q, 0.3, near)
    assert less.count == 91 and less.find(q, 0.3, near).count() == 0 and grid.count == 100
    again = less.add(rows.where(near))
    assert again.count == 100 and {r["id"] for r in again.records().collect()} == set(range(100))
    assert {tuple(r) for r in again.cells().select("cell", "records").collect()} == {tuple(r) for r in grid.cells().select("cell", "records").collect()}
    empty = again.clear()
    assert empty.count == 0 and empty.find(q, 0.3, near).count() == 0
    assert empty.add(rows).count == 100


def same_cells(a, b):
    one, two = (sorted((r["cell"], r["records"], r["ids"]) for r in x.cells("id").where("records is not null").collect()) for x in (a, b))
    return one == two


def test_changes_make_the_grid_of_the_records_there_are(spark):
    """Adds and removes in many steps, against building anew; some vectors are equal."""
    dims, equal = 3, True
    rng = np.random.default_rng(dims)
    x = rng.uniform(-1, 1, (400, dims)) * rng.choice([1, 0.01], (400, 1))
    if equal:
        x[100:140] = x[0]
    every = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>").persist()
    grid, there = GridIndex(every.where("id < 5")), set(range(5))
    for step, (low, high) in enumerate([(5, 150), (150, 400)]):
        grid = grid.add(every.where(f"id >= {low} and id < {high}"))
        there |= set(range(low, high))
        assert grid.count == len(there) and same_cells(grid, GridIndex(every.where(F.col("id").isin(list(there)))))
        q = x[step * 50].tolist()
        for distance in (0.02, 0.4)[step % 2 :]:
            near = l2("vector", q) <= distance
            gone = {r["id"] for r in grid.find(q, distance, near).collect()}
            grid, there = grid.remove(q, distance, near), there - gone
            assert grid.count == len(there) and {r["id"] for r in grid.records().collect()} == there
        assert same_cells(grid, GridIndex(every.where(F.col("id").isin([-1, *there]))))
    grid = grid.remove([0.0] * dims, 9.0, F.lit(True))
    assert grid.count == 0 and grid.add(every).count == 400


def test_other_cells_are_not_written_again(spark, monkeypatch):
    from vicinal.operators import grid as module

    written, write = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, label: written.append(label) or write(df, label))
    grid = GridIndex(lattice(spark, 100, 49.5, 50))
    written.clear()
    more = grid.add(spark.createDataFrame([(100_000, "new", [0.3, 0.3])], "id long, tag string, vector array<float>"))
    assert "grid-records" not in written and more.count == 10_001
    assert [r["id"] for r in more.find((0.3, 0.3), 0.001, F.col("tag") == "new").collect()] == [100_000]
    less = more.remove((0.3, 0.3), 0.001, F.col("tag") == "new")
    assert "grid-records" not in written and less.count == 10_000 and same_cells(less, grid)


def test_a_grid_that_follows_a_stream(spark, tmp_path):
    rows = lattice(spark, 30, 14.5, 15)
    live = LiveGrid(GridIndex(rows.where("id < 500")))
    before = live.index
    for name, part in (("a", "id >= 500 and id < 890"), ("b", "id = 890")):
        rows.where(part).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        live.follow(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in/*")), str(tmp_path / "at")).awaitTermination()
    assert before.count == 500 and live.index.count == 891
    assert same_cells(live.index, GridIndex(rows.where("id < 891")))


def test_predicates(spark):
    @pandas_udf("boolean")
    def close(v):
        return v.map(lambda x: float(np.hypot(x[0] - 0.3, x[1] - 0.3)) <= 0.3)

    grid = GridIndex(lattice(spark, 10, 4.5, 5))
    assert grid.find((0.3, 0.3), 0.3, close("vector")).count() == 9
    assert grid.find((0.3, 0.3), 0.3, lambda df: df.where(l2("vector", (0.3, 0.3)) <= 0.3)).count() == 9
    # a negative distance counts as its absolute value
    assert grid.find((0.3, 0.3), -0.3, l2("vector", (0.3, 0.3)) <= 0.3).count() == 9


def test_many_equal_vectors_share_a_cell(spark):
    rows = spark.range(30).select("id", F.array(F.lit(0.1), F.lit(-0.7)).cast("array<float>").alias("vector"))
    grid = GridIndex(rows)
    assert [r["records"] for r in grid.cells().where("records is not null").collect()] == [30]
    assert grid.find((0.1, -0.7), 0.01, F.lit(True)).count() == 30


def test_bad_arguments(spark):
    rows = lattice(spark, 3, 1, 1)
    with pytest.raises(ValueError):
        GridIndex(rows, list_threshold=0)
    with pytest.raises(ValueError):
        GridIndex(rows.unionByName(spark.createDataFrame([(99, "x", [1.0])], "id long, tag string, vector array<float>")))
    with pytest.raises(ValueError):
        GridIndex(rows).find((1.0,), 1.0, F.lit(True))
    with pytest.raises(ValueError):
        GridIndex(rows).add(spark.createDataFrame([(99, "x", [1.0])], "id long, tag string, vector array<float>"))
