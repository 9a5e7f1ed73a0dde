import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.functions.vectors import level
from vicinal.operators.stored_index import StoredIndex
from vicinal.operators.tree_build import build_index, range_values, split_levels
from vicinal.operators.tree_search import leaf_paths, range_search, register_search, search, search_batch, search_sql
from vicinal.sources.generators import one_hot, random_uniform


def points(spark, rows):
    return spark.createDataFrame([(d, i, list(map(float, v))) for d, i, v in rows], "doc_id long, id long, vector array<float>")


def by_id(nodes):
    return {(r["doc_id"], r["range_id"]): r for r in nodes.collect()}


@pytest.mark.parametrize("mode", ["sql", "alternate"])
@pytest.mark.parametrize("cutoff", [20_000, 20])
def test_invariants(spark, mode, cutoff):
    given = random_uniform(spark, 200, 16)
    nodes = build_index(given, mode, cutoff=cutoff).persist()
    found = by_id(nodes)
    assert len(found) == 2 * 200 - 1
    leaves = [r for r in found.values() if r["id"] is not None]
    assert sorted(r["id"] for r in leaves) == list(range(200))
    vectors = {r["id"]: r["vector"] for r in given.collect()}
    for r in leaves:
        at = r["range_id"]
        while at:
            up = found[0, (at - 1) // 2]
            value = vectors[r["id"]][up["dimension"]]
            assert value <= up["mid"] if at % 2 else value >= up["mid"]
            at = (at - 1) // 2


@pytest.mark.parametrize("mode", ["sql", "alternate"])
def test_levels_in_spark_make_the_same_tree(spark, mode):
    given = random_uniform(spark, 300, 8, seed=3)
    assert by_id(build_index(given, mode)) == by_id(build_index(given, mode, cutoff=10))


def test_candidates_hold_the_box_and_three_plans_agree(spark):
    given = random_uniform(spark, 300, 4, seed=5).persist()
    nodes = build_index(given).persist()
    paths = leaf_paths(nodes).persist()
    x = np.array([r["vector"] for r in given.orderBy("id").collect()])
    queries = [(k, [float(c) for c in x[k] + 0.01], 0.2 + 0.1 * k) for k in range(3)]
    batch = search_batch(nodes, spark.createDataFrame([(k, q, d, None) for k, q, d in queries], "query_id long, vector array<float>, domain float, doc_id long"))
    together = {(r["query_id"], r["text_id"]) for r in batch.collect()}
    for k, q, d in queries:
        one = {r["text_id"] for r in search(paths, q, d).collect()}
        assert one == {r["text_id"] for r in search_sql(spark, nodes, q, d).collect()} == {i for n, i in together if n == k}
        assert {int(i) for i in np.flatnonzero(np.abs(x - np.array(q, np.float32)).max(1) <= d - 1e-5)} <= one


@pytest.mark.parametrize("mode", ["sql", "alternate"])
@pytest.mark.parametrize("cutoff", [1000, 7])
def test_paths_made_with_the_tree(spark, mode, cutoff):
    given = random_uniform(spark, 150, 5, seed=9).unionByName(random_uniform(spark, 40, 5, seed=2).withColumn("doc_id", F.lit(1).cast("long")))
    given = given.unionByName(spark.range(5).select(F.lit(2).cast("long").alias("doc_id"), "id", F.lit([0.5] * 5).cast("array<float>").alias("vector")))
    made = build_index(given, mode, cutoff=cutoff, with_paths=True).persist()
    rows = lambda df: sorted(map(str, df.select("doc_id", "id", "range_id", "path").collect()))
    assert rows(leaf_paths(made)) == rows(leaf_paths(made.drop("path")))


def test_stored_index_reads_a_part_of_it(spark, tmp_path):
    given = random_uniform(spark, 4000, 3, seed=4).unionByName(random_uniform(spark, 300, 3, seed=5).withColumn("doc_id", F.lit(7).cast("long"))).persist()
    paths = leaf_paths(build_index(given)).persist()
    stored = StoredIndex.write(given, str(tmp_path / "i"), top_points=50)
    ids = lambda df: sorted((r["doc_id"], r["text_id"]) for r in df.collect())
    for q, domain, doc in (([0.1, 0.2, 0.3], 0.05, None), ([0.1, 0.2, 0.3], 0.05, 7), ([0.9, -0.9, 0.0], 0.3, 0), ([0.0, 0.0, 0.0], 5.0, None), ([0.0, 0.0, 0.0], None, None)):
        assert ids(stored.search(q, domain, doc)) == ids(search(paths, q, domain, doc))
    got = stored.range_search([0.1, 0.2, 0.3], 0.2)
    assert sorted(map(str, got.collect())) == sorted(map(str, range_search(paths, given, [0.1, 0.2, 0.3], 0.2).collect()))
    assert stored.reached([0.1, 0.2, 0.3], 0.05).agg(F.sum("points")).first()[0] < 1000
    assert "PushedFilters: [" in got._jdf.queryExecution().executedPlan().toString() and "top" in got._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1][:300]
    # more tops than values
    from vicinal.operators import stored_index

    many, stored_index.MOST_VALUES = stored_index.MOST_VALUES, 3
    try:
        assert ids(stored.search([0.0, 0.0, 0.0], 0.5)) == ids(search(paths, [0.0, 0.0, 0.0], 0.5))
    finally:
        stored_index.MOST_VALUES = many


def test_sums_are_merged_in_rounds(spark, monkeypatch):
    """Rows of sums are merged a few at a time; the tree stays the same."""
    from vicinal.operators import tree_build

    given = random_uniform(spark, 600, 4, seed=11).repartition(12).persist()
    want = by_id(build_index(given, cutoff=100))
    monkeypatch.setattr(tree_build, "MOST_SUMS", 3)
    assert by_id(build_index(given, cutoff=100)) == want


def test_first_levels_alone(spark):
    given = random_uniform(spark, 200, 4, seed=12)
    nodes = build_index(given, statistics=True).where(level(F.col("range_id")) < 3)
    rows = lambda df: sorted(map(str, df.withColumn("stdev", F.round("stdev", 9)).collect()))
    assert rows(split_levels(given, "sql", 3)) == rows(nodes)


def test_exact_range(spark):
    given = random_uniform(spark, 300, 4, seed=6)
    x = np.array([r["vector"] for r in given.orderBy("id").collect()])
    paths = leaf_paths(build_index(given))
    for metric, d in (("l2", np.sqrt(((x - x[7]) ** 2).sum(1))), ("linf", np.abs(x - x[7]).max(1))):
        got = {r["text_id"]: r["distance"] for r in range_search(paths, given, x[7].tolist(), 0.7, metric).collect()}
        assert set(got) == {int(i) for i in np.flatnonzero(d <= 0.7)}
        assert got[7] == 0


def test_table_function(spark):
    given = random_uniform(spark, 50, 3, seed=8)
    paths = leaf_paths(build_index(given)).persist()
    register_search(spark, paths)
    want = {r["text_id"] for r in search(paths, "[0.1, 0.2, 0.3]", 0.4).collect()}
    assert want == {r["text_id"] for r in spark.sql("select * from vicinity_search('[0.1, 0.2, 0.3]', 0.4f, null)").collect()}


def test_no_point_and_one_point(spark):
    assert build_index(points(spark, [])).count() == 0
    nodes = build_index(points(spark, [(4, 9, [1, 2])]))
    assert [tuple(r) for r in nodes.collect()] == [(4, 0, None, None, None, None, 9)]
    assert [tuple(r) for r in search(leaf_paths(nodes), [50.0, 50.0], 0.1).collect()] == [(4, 9)]


def test_equal_vectors_split_by_id(spark):
    nodes = build_index(points(spark, [(0, i, [0.3, 0.1]) for i in range(100)]))
    found = by_id(nodes)
    assert len(found) == 199 and found[0, 0]["dimension"] is None and found[0, 0]["mid"] is None
    # nothing is pruned
    assert search(leaf_paths(nodes), [9.0, 9.0], 0.0).count() == 100
    other = by_id(build_index(points(spark, [(0, i, [0.3, 0.1]) for i in range(4)]), "alternate"))
    assert other[0, 0]["dimension"] == 0 and abs(other[0, 0]["mid"] - 0.3) < 1e-6


def test_ties_with_the_mean(spark):
    rows = [(0, 1, [0.0]), (0, 2, [1.0]), (0, 3, [2.0])]
    # the root of mode sql sends the mean high, that of mode alternate by id
    assert by_id(build_index(points(spark, rows)))[0, 1]["id"] == 1
    alternate = by_id(build_index(points(spark, rows), "alternate"))
    assert alternate[0, 2]["id"] == 3 and alternate[0, 1]["id"] is None


def test_one_hot_ties_go_to_the_lowest_dimension(spark):
    nodes = by_id(build_index(one_hot(spark, 32)))
    assert nodes[0, 0]["dimension"] == 0 and len(nodes) == 63


def test_depth_guard(spark):
    chain = points(spark, [(0, i, [float(4**i)]) for i in range(12)])
    nodes = build_index(chain, max_depth=3).persist()
    assert nodes.where("id is not null").count() == 12
    assert nodes.agg(F.max(level(F.col("range_id")))).first()[0] == 3
    assert search(leaf_paths(nodes), [1.0], 0.0).count() >= 1
    with pytest.raises(Exception, match="left together"):
        build_index(chain, max_depth=3, overflow="raise").collect()


@pytest.mark.parametrize(
    "rows, why",
    [([(0, 1, [1, 2]), (0, 2, [1])], "components"), ([(0, 1, [])], "empty"), ([(0, 1, [1]), (0, 1, [2])], "repeats"), ([(0, 1, [float("nan")])], "NaN")],
)
def test_bad_points(spark, rows, why):
    with pytest.raises(ValueError, match=why):
        build_index(points(spark, rows))


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        build_index(points(spark, []), "other")
    with pytest.raises(ValueError):
        build_index(points(spark, []), max_depth=99)


def test_queries_without_domain_or_dimension(spark):
    given = random_uniform(spark, 40, 3, seed=2)
    paths = leaf_paths(build_index(given)).persist()
    assert search(paths, [0.0, 0.0, 0.0], None).count() == 0
    assert search(paths, [], 9.0).count() == 0
    assert search(paths, [0.0, 0.0, 0.0], 9.0).count() == 40


def test_mean_ids_are_cut_toward_zero(spark):
    values = range_values(build_index(points(spark, [(0, -3, [1.0]), (0, -4, [2.0])]), "alternate", statistics=True))
    assert {r["range_id"]: r["id"] for r in values.collect()}[0] == -3
