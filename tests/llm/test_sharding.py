import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from vicinal.llm import sharding


def check(rows, texts, shards):
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        by.setdefault(r["shard"], []).append(r)
    for x in by.values():
        assert sorted(r["slot"] for r in x) == list(range(len(x)))
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    assert want == sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows)
    return {k: sum(r["size"] for r in x) for k, x in by.items()}


def torn(rows, most):
    """Groups of equal texts in several shards, of at most `most` bytes."""
    groups = {}
    for r in rows:
        groups.setdefault((r["text_crc32"], r["size"]), []).append(r["shard"])
    return [g for g, x in groups.items() if len(set(x)) > 1 and g[1] * len(x) <= most]


@pytest.mark.parametrize("sf, most", [("sf0.01", 1.12), ("sf0.1", 1.03)])
def test_shards_of_documents(spark, sf, most):
    docs = spark.read.parquet(f"{DATA}/{sf}/documents.parquet")
    rows = sharding.shard(docs, 40).collect()
    sizes = check(rows, [tuple(r) for r in docs.select("doc_id", "text").collect()], 40)
    mean = sum(sizes.values()) / 40
    assert len(sizes) == 40 and max(sizes.values()) < most * mean and min(sizes.values()) > (2 - most) * mean
    assert not torn(rows, mean)
    assert sorted(map(str, rows)) == sorted(map(str, sharding.shard(docs.repartition(5), 40).collect()))


def plain_tree(points, room):
    """The shard of each point (weight, (size, source, lang), tie), by sorting every node."""
    spans = [max(1, max(p[1][d] for p in points) - min(p[1][d] for p in points)) for d in range(3)]
    out = {}

    def down(own, first, last):
        if last - first == 1 or not own:
            out.update((i, first) for i in own)
            return
        widths = [(max(points[i][1][d] for i in own) - min(points[i][1][d] for i in own)) / spans[d] for d in range(3)]
        dim = widths.index(max(widths))
        middle = first + (last - first) // 2
        goal = sum(points[i][0] for i in own) * sum(room[first:middle]) / sum(room[first:last])
        run, left, right = 0, [], []
        for i in sorted(own, key=lambda i: (points[i][1][dim], points[i][2])):
            (left if run + points[i][0] / 2 < goal else right).append(i)
            run += points[i][0]
        down(left, first, middle)
        down(right, middle, last)

    down(list(range(len(points))), 0, len(room))
    return out


@pytest.mark.parametrize("most_nodes", [4096, 3, 0])
@pytest.mark.parametrize("shards", [2, 13])
def test_tree_against_a_plain_one(spark, most_nodes, shards):
    rng = random.Random(shards)
    points = [(rng.randint(1, 300), (rng.randint(0, 5000), rng.choice([0, 7, 1 << 27]), rng.choice([3, 90_000, 100_000])), t) for t in rng.sample(range(1 << 35), 500)]
    room = [rng.choice([1.0, 2.0, 0.25]) for _ in range(shards)]
    units = spark.createDataFrame([(i, w, *d, t) for i, (w, d, t) in enumerate(points)], "key long, weight long, d_size long, d_source long, d_lang long, tie long")
    got = {r["key"]: r["shard"] for r in sharding.split(units, room, tolerance=0, most_nodes=most_nodes).collect()}
    assert got == plain_tree(points, room)


def test_target_bytes(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    assert 20 <= sharding.shard(docs, target_bytes=100_000).select("shard").distinct().count() <= 30


def test_as_many_shards_as_wanted(spark):
    """More shards than rows; no number is refused."""
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").where("doc_id < 60")
    check(sharding.shard(docs, 30_000, most_nodes=16).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()], 30_000)


@pytest.mark.parametrize("same_id", [False, True, None])
def test_equal_texts_of_more_than_a_shard_are_split(spark, same_id):
    rows = [(None if same_id is None else 5 if same_id else i, "same text", "en", "a", 9) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sizes = check(sharding.shard(docs, 7).collect(), [(r[0], r[1]) for r in rows], 7)
    assert max(sizes.values()) - min(sizes.values()) <= 0.05 * sum(sizes.values()) / 7


def test_groups_of_all_sizes(spark):
    """Sizes are near equal though groups of up to a shard stay whole, whatever their sources."""
    rng = random.Random(2)
    rows = []
    for g in range(300):
        n = rng.choice([1, 2, 3, 40, 150]) if g else 2000
        rows += [(len(rows) + k, f"text {g} " * 20, rng.choice("abc"), rng.choice(["web", "books", None]), 1) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sharding.shard(docs, 12).collect()
    sizes = check(got, [(r[0], r[1]) for r in rows], 12)
    mean = sum(sizes.values()) / 12
    assert not torn(got, mean) and max(sizes.values()) < 1.06 * mean and min(sizes.values()) > 0.94 * mean


def test_names_in_order(spark):
    names = ["src_a", "src_b", "src_ba", "src_é", "src_z", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert sharding._shared_bytes("src_a", "src_z") == 4 and sharding._shared_bytes(None, None) == 0
    got = [r[0] for r in df.select(sharding._ordered(F.col("name"), 4)).collect()]
    assert got[:3] == sorted(got[:3]) and got[2] < got[4] < got[3] < got[5] == 1 << 27


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_odd_documents(spark, odd, shards):
    check(sharding.shard(odd, shards).collect(), [tuple(r) for r in odd.select("doc_id", "text").collect()], shards)


def test_nothing(none):
    assert sharding.shard(none, 40).count() == 0


def test_no_python_in_the_plan(spark):
    df = sharding.shard(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet"), 4)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
