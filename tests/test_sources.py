import pytest
from pyspark.sql import functions as F

from vicinal.functions.vectors import denormalize, extent, normalization, normalize
from vicinal.operators.tree_build import build_index, range_values
from vicinal.plans.catalog import VectorCatalog
from vicinal.plans.schemas import TEXT, as_points
from vicinal.sources.files import json_vectors, read_arff, read_vectors, write_range_values, write_vectors
from vicinal.sources.generators import one_hot, random_uniform
from vicinal.streaming.reindex import reindex


def test_generators_repeat(spark):
    a, b = random_uniform(spark, 50, 8, 4), random_uniform(spark, 50, 8, 4).repartition(3)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    low, high = extent(a)
    assert min(low) >= -1 and max(high) < 1 and min(low) < -0.8 and max(high) > 0.8
    assert [r["vector"].index(1.0) for r in one_hot(spark, 5).orderBy("id").collect()] == list(range(5))


def test_normalization(spark):
    assert normalization([-0.5], [0.5]) == ([0.0], 1.0)
    assert normalization([3.0, 0.0], [4.0, 1.0]) == ([3.5, 0.5], 1.0)
    offsets, scale = normalization([0.0, 10.0], [8.0, 12.0])
    assert (offsets, scale) == ([4.0, 11.0], 4.0)
    df = spark.createDataFrame([([0.0, 10.0],), ([8.0, 12.0],)], "v array<float>")
    made = [r[0] for r in df.select(normalize("v", offsets, scale)).collect()]
    assert made == [[-1.0, -0.25], [1.0, 0.25]]
    assert [r[0] for r in df.select(denormalize(normalize("v", offsets, scale), offsets, scale)).collect()] == [[0.0, 10.0], [8.0, 12.0]]


def test_json_vectors(spark):
    rows = [(1, 1, None, "[1, 2.5]"), (1, 2, "x", None)]
    got = json_vectors(spark.createDataFrame(rows, TEXT)).collect()
    assert [tuple(r) for r in got] == [(1, 1, [1.0, 2.5])]


def test_vector_files(spark, tmp_path):
    given = random_uniform(spark, 20, 3)
    write_vectors(given, str(tmp_path / "v"))
    back = read_vectors(spark, str(tmp_path / "v"))
    assert sorted(map(str, back.collect())) == sorted(map(str, given.collect()))
    values = range_values(build_index(given, "alternate", statistics=True))
    write_range_values(values.coalesce(1), str(tmp_path / "r"))
    lines = "".join(p.read_text() for p in (tmp_path / "r").glob("*.csv")).splitlines()
    assert lines[0] == "RangeID,Dimension,Mid,ID" and len(lines) == 40


def test_wide_dimensions_are_an_error(spark, tmp_path):
    values = spark.createDataFrame([(0, 40_000, 0.5, 1)], "range_id long, dimension int, mid float, id long")
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        write_range_values(values, str(tmp_path / "r"))


def test_arff(spark, tmp_path):
    (tmp_path / "a.arff").write_text("% about\n@relation r\n@attribute x numeric\n@attribute y numeric\n@attribute class {a,b}\n\n@data\n1,2,a\n3.5, 4,b\n10, 11.1 ,a\n")
    got = [tuple(r) for r in read_arff(spark, str(tmp_path / "a.arff")).orderBy("id").collect()]
    assert got[:2] == [(0, "a", [1.0, 2.0]), (1, "b", [3.5, 4.0])] and got[2][:2] == (2, "a") and abs(got[2][2][1] - 11.1) < 1e-5 and got[2][2][0] == 10


def test_hdf5_needs_its_library():
    from vicinal.sources.hdf5 import Hdf5Vectors, dataset_size

    assert Hdf5Vectors.name() == "hdf5_vectors"
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError):
            dataset_size("x.hdf5", "train")


FAKE = """
import numpy as np


class Dataset:
    def __init__(self, rows):
        self.rows, self.shape = rows, rows.shape

    def __getitem__(self, at):
        return self.rows[at]


class File:
    def __init__(self, path, mode="r"):
        self.made = np.load(path)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass

    def __getitem__(self, name):
        return Dataset(self.made[name])
"""


def test_hdf5_slabs(spark, tmp_path):
    """Slabs, ids and the rank error, with a module in the place of h5py that reads the same from .npz files; on the workers too."""
    import numpy as np

    from vicinal.sources.hdf5 import Hdf5Vectors, dataset_size

    (tmp_path / "h5py.py").write_text(FAKE)
    rows = np.random.default_rng(1).uniform(-1, 1, (2503, 7))
    np.savez(tmp_path / "a.npz", train=rows, flat=rows[:, 0], none=rows[:0])
    path = str(tmp_path / "a.npz")
    code = f"""
import sys
sys.path.insert(0, {str(tmp_path)!r})
import h5py
from vicinal.sources.hdf5 import BATCH, Hdf5Vectors, dataset_size
from pyspark.sql import types as T
assert dataset_size({path!r}, "train") == (2503, 7) and dataset_size({path!r}, "none") == (0, 7)
try:
    dataset_size({path!r}, "flat")
    raise SystemExit("no error")
except ValueError:
    pass
reader = Hdf5Vectors({{"path": {path!r}, "slab": "1000"}}).reader(None)
parts = reader.partitions()
assert [(p.start, p.stop) for p in parts] == [(0, 1000), (1000, 2000), (2000, 2503)]
made = [b for p in parts for b in reader.read(p)]
ids = [i for b in made for i in b.column("id").to_pylist()]
vectors = [v for b in made for v in b.column("vector").to_pylist()]
import numpy as np
assert ids == list(range(2503)) and np.allclose(vectors, np.load({path!r})["train"])
"""
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", code], check=True)
    with_module = spark.sparkContext
    with_module.addPyFile(str(tmp_path / "h5py.py"))
    spark.dataSource.register(Hdf5Vectors)
    got = spark.read.format("hdf5_vectors").option("slab", 1000).load(path)
    assert got.count() == 2503 and got.rdd.getNumPartitions() == 3
    (one,) = got.where("id = 2001").collect()
    assert one["doc_id"] == 0 and np.allclose(one["vector"], rows[2001], atol=1e-6)
    assert dataset_size(path, "train") == (2503, 7)


def texts(spark, rows):
    return spark.createDataFrame([(d, i, None, v) for d, i, v in rows], TEXT)


def test_catalog(spark, tmp_path):
    catalog = VectorCatalog(spark, str(tmp_path / "c"))
    assert catalog.texts().count() == 0 and catalog.search([0.0], 1.0).count() == 0
    catalog.add_texts(texts(spark, [(1, i, f"[{i / 10}, 0.5]") for i in range(10)] + [(2, 100, "[0.2, 0.5]"), (2, 101, None)]))
    catalog.index_documents()
    assert {tuple(r) for r in catalog.search([0.2, 0.5], 0.01).collect()} >= {(1, 2), (2, 100)}
    assert catalog.next_ids() == 102
    catalog.add_texts(texts(spark, [(2, 102, "[0.9, 0.9]")]))
    assert catalog.index().where("doc_id = 2 and id = 102").count() == 0
    catalog.index_document(2)
    assert catalog.index().where("doc_id = 2").count() == 3 and catalog.index().where("doc_id = 1").count() == 19
    catalog.delete_document(1)
    assert catalog.index().select("doc_id").distinct().collect()[0][0] == 2 and catalog.texts().where("doc_id = 1").count() == 0


def test_stream(spark, tmp_path):
    catalog = VectorCatalog(spark, str(tmp_path / "c"))
    texts(spark, [(1, 1, "[0.1, 0.1]"), (1, 2, "[0.2, 0.1]"), (2, 3, "[0.3, 0.3]")]).write.parquet(str(tmp_path / "in/a"))
    stream = spark.readStream.schema(TEXT).parquet(str(tmp_path / "in/*"))
    reindex(stream, catalog, str(tmp_path / "at")).awaitTermination()
    assert catalog.index().where("id is not null").count() == 3
    texts(spark, [(2, 4, "[0.4, 0.3]"), (2, 3, "[0.3, 0.3]")]).write.parquet(str(tmp_path / "in/b"))
    reindex(stream, catalog, str(tmp_path / "at")).awaitTermination()
    assert {r["id"] for r in catalog.index().where("id is not null and doc_id = 2").collect()} == {3, 4}
    assert catalog.texts().count() == 4


def test_catalog_replaces_whole_indexes(spark, tmp_path):
    """Stale indexes go, documents that share a bucket stay, large documents have several files."""
    catalog = VectorCatalog(spark, str(tmp_path / "c"), buckets=2)
    catalog.add_texts(texts(spark, [(d, 100 * d + i, f"[{i / 50}, {d / 10}]") for d in range(6) for i in range(20)]))
    catalog.add_documents(spark.createDataFrame([(d, f"d{d}") for d in range(6)], "doc_id long, name string"))
    catalog.index_documents()
    leaves = lambda: {(r["doc_id"], r["count"]) for r in catalog.index().where("id is not null").groupBy("doc_id").count().collect()}
    assert leaves() == {(d, 20) for d in range(6)} and {p.name for p in (tmp_path / "c/text_index").glob("bucket=*")} <= {"bucket=0", "bucket=1"}
    catalog.delete_document(4)
    assert leaves() == {(d, 20) for d in range(6) if d != 4} and catalog.documents().count() == 5
    # texts that went by another way
    catalog._replace("text", TEXT, "text_id", [0, 1, 2, 3], None)
    catalog.index_documents()
    assert leaves() == {(5, 20)}
    catalog._replace("text", TEXT, "text_id", [5], None)
    catalog.index_documents([5])
    assert leaves() == set() and catalog.search([0.1, 0.1], 1.0).count() == 0


def test_scratch_tables_are_deleted(spark, tmp_path):
    from vicinal.plans.storage import materialize, path_exists, release, scratch

    before = len(getattr(spark, "_vicinal_tables", []))
    kept = materialize(spark.range(3).toDF("id"), "test")
    with scratch(spark):
        materialize(spark.range(5).toDF("id"), "test")
        inner = spark._vicinal_tables[-1]
        assert path_exists(spark, inner)
    assert not path_exists(spark, inner) and kept.count() == 3
    path = spark._vicinal_tables[-1]
    assert release(spark, before) == 1 and not path_exists(spark, path)


def test_points_of_any_table(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, None, "b")], "k int, v array<double>, doc string")
    assert [tuple(r) for r in as_points(df, "k", "v").collect()] == [(0, 1, [1.0, 2.0])]
    assert as_points(df.withColumn("d", F.lit(7)), "k", "v", "d").first()["doc_id"] == 7
