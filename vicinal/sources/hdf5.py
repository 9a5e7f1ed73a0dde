"""Two-dimensional HDF5 datasets as a Spark data source, where the h5py library is installed.

spark.dataSource.register(Hdf5Vectors)
spark.read.format("hdf5_vectors").option("dataset", "train").load(path)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of a partition, and of a batch within it.
SLAB, BATCH = 100_000, 10_000


def dataset_size(path: str, dataset: str) -> tuple[int, int]:
    """Rows and columns of a dataset; ValueError unless it has two dimensions."""
    import h5py

    with h5py.File(path, "r") as file:
        shape = file[dataset].shape
    if len(shape) != 2:
        raise ValueError(f"{dataset} has {len(shape)} dimensions, not 2")
    return shape[0], shape[1]


class _Slab(InputPartition):
    def __init__(self, start: int, stop: int) -> None:
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    def __init__(self, path: str, dataset: str, slab: int) -> None:
        self.path, self.dataset, self.slab = path, dataset, slab

    def partitions(self) -> list[InputPartition]:
        n, _ = dataset_size(self.path, self.dataset)
        return [_Slab(i, min(n, i + self.slab)) for i in range(0, n, self.slab)]

    def read(self, partition: _Slab):
        import h5py

        with h5py.File(self.path, "r") as file:
            rows = np.ascontiguousarray(file[self.dataset][partition.start : partition.stop], dtype=np.float32)
        n, dims = rows.shape
        for i in range(0, n, BATCH):
            part = rows[i : i + BATCH]
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * dims), pa.array(part.ravel()))
            ids = pa.array(np.arange(partition.start + i, partition.start + i + len(part)))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(part), np.int64)), ids, vectors], ["doc_id", "id", "vector"])


class Hdf5Vectors(DataSource):
    """doc_id 0, the row's number as id, and its values as vector; one partition for each slab of rows."""

    @classmethod
    def name(cls) -> str:
        return "hdf5_vectors"

    def schema(self) -> str:
        return "doc_id long, id long, vector array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("dataset", "train"), int(self.options.get("slab", SLAB)))
