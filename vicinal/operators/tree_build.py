"""Building binary space-partition trees over the points of many documents at once.

Every node splits its points at the mean of one dimension. Two ways to choose it:

* mode "sql": the dimension with the largest deviation, but the smallest for the two nodes below
  the root. At the root, values equal to the mean go high; below, they go by id.
* mode "alternate": the largest on even levels, the smallest on odd ones; values equal to the
  mean go by id everywhere.

Points whose values are all equal are split by id at the mean id. Deviations are compared to
seven decimals, the lowest dimension first, so that a tree doesn't depend on the order of sums.
Nodes are numbered 0; 1, 2; 3, 4, 5, 6; ... - children of r are 2r + 1 (low) and 2r + 2 (high).

Ranges with more than `cutoff` points are split level by level: one pass over the points makes a
row of sums for each range and task; rows of a range are merged a few hundred at a time, until one
merge makes its split. The splits are a small table that the points of the next pass are joined
with. No vector moves for that. Once all ranges are small, points are shuffled a single time, by
range, and each range's subtree is finished in its task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.vectors import level
from ..plans.schemas import NODE, STATISTICS, check_points
from ..plans.storage import MOST_BROADCAST, materialize

MODES = ("sql", "alternate")
#: The deepest level whose children still have numbers in a long.
MAX_DEPTH = 61
#: Vectors of a range that a task splits by itself, unless a number of points is given.
SUBTREE_BYTES = 32 << 20
#: Rows of sums of a range that one task merges.
MOST_SUMS = 256
#: Bytes of sums that a task holds before it gives them away.
SUM_BYTES = 64 << 20
#: The splits from a leaf's parent up to the root, and the side taken.
PATH = T.ArrayType(T.StructType([T.StructField("dimension", T.IntegerType()), T.StructField("mid", T.FloatType()), T.StructField("is_high", T.BooleanType())]))


def _mean_id(total: int, n: int) -> int:
    """The mean of ids, cut toward zero."""
    return total // n if total >= 0 else -(-total // n)


def _depth(range_id: int) -> int:
    return (range_id + 1).bit_length() - 1


def _widest(mode: str, depth: int) -> bool:
    return depth != 1 if mode == "sql" else depth % 2 == 0


def _choose(mode: str, range_id: int, n: int, id_sum: int, mean: np.ndarray, squares: np.ndarray) -> tuple[int, np.float32, float, int]:
    """Dimension, mean, deviation and mean id of a node's split; squares: sums of squared differences from the mean."""
    deviation = np.sqrt(np.maximum(squares, 0) / (n - 1)) if n > 1 else np.zeros(len(mean))
    rounded = np.round(deviation, 7)
    at = int(rounded.argmax() if _widest(mode, _depth(range_id)) else rounded.argmin())
    # sums of equal values leave a rounding error
    same = deviation[at] <= 1e-12 * max(1.0, abs(float(mean[at])))
    return at, np.float32(mean[at]), 0.0 if same else float(deviation[at]), _mean_id(id_sum, n)


def _subtree(mode: str, root: int, ids: np.ndarray, vectors: np.ndarray, max_depth: int, overflow: str, with_paths: bool = False) -> pa.Table:
    """All nodes below and with a range, without doc_id: every level's ranges are split together. with_paths: adds the leaves' paths up to the range."""
    x = vectors.astype(np.float64)
    rows, starts = np.argsort(ids, kind="stable"), np.zeros(1, np.int64)
    ranges, depth = np.array([root]), _depth(root)
    parts: list[dict] = []
    # by level: points, dimension (-1: none), mid and side; and the points of the leaves as they come
    steps: list[tuple[np.ndarray, ...]] = []
    points: list[np.ndarray] = []

    def emit(points_of: np.ndarray | None = None, **columns) -> None:
        n = len(columns["range_id"])
        points.append(np.full(n, -1) if points_of is None else points_of)
        parts.append({name: columns.get(name, np.ma.masked_all(n)) for name in STATISTICS.names[1:]})

    while len(ranges):
        counts = np.diff(np.append(starts, len(rows)))
        single = counts == 1
        if single.any():
            own = ids[rows[starts[single]]]
            emit(rows[starts[single]], range_id=ranges[single], id=own, points=counts[single], stdev=np.zeros(len(own)), mean_id=own)
            rows, ranges, counts = rows[np.repeat(~single, counts)], ranges[~single], counts[~single]
            starts = np.cumsum(counts) - counts
        if not len(ranges):
            break
        if depth >= max_depth:
            if overflow == "raise":
                raise OverflowError(f"{counts.max()} points are left together at depth {max_depth}")
            emit(rows, range_id=np.repeat(ranges, counts), id=ids[rows], points=np.repeat(counts, counts))
            break
        of = np.repeat(np.arange(len(ranges)), counts)
        here = x[rows]
        mean = np.add.reduceat(here, starts, axis=0) / counts[:, None]
        here -= mean[of]
        here *= here
        deviation = np.sqrt(np.add.reduceat(here, starts, axis=0) / (counts - 1)[:, None])
        rounded = np.round(deviation, 7)
        dim = rounded.argmax(1) if _widest(mode, depth) else rounded.argmin(1)
        each = np.arange(len(ranges))
        mid, spread = mean[each, dim].astype(np.float32), deviation[each, dim]
        spread[spread <= 1e-12 * np.maximum(1.0, np.abs(mean[each, dim]))] = 0
        mean_id = _mean_ids(ids[rows], starts, counts)
        hidden = (spread == 0) & (mode == "sql")
        emit(
            range_id=ranges, dimension=np.ma.masked_array(dim, hidden), mid=np.ma.masked_array(mid, hidden), low_range_id=2 * ranges + 1, high_range_id=2 * ranges + 2, points=counts, stdev=spread, mean_id=mean_id,
        )
        later = ids[rows] > mean_id[of]
        value = vectors[rows, dim[of]]
        if mode == "sql" and depth == 0:
            high = value >= mid[of]
        else:
            high = (value > mid[of]) | ((value == mid[of]) & later)
        high = np.where((spread == 0)[of], later, high)
        if with_paths:
            steps.append((rows, np.where(hidden, -1, dim)[of].astype(np.int32), mid[of], high))
        # low before high within each range, ranges in order
        order = np.argsort(2 * of + high, kind="stable")
        rows, child = rows[order], (2 * of + high)[order]
        starts = np.flatnonzero(np.diff(child, prepend=-1))
        ranges = 2 * ranges[child[starts] // 2] + 1 + child[starts] % 2
        depth += 1
    kinds = (pa.int64(), pa.int32(), pa.float32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
    columns = []
    for name, kind in zip(STATISTICS.names[1:], kinds, strict=True):
        columns.append(pa.chunked_array([pa.array(np.ma.getdata(p[name]), mask=np.ma.getmaskarray(p[name]), from_pandas=False).cast(kind, safe=False) for p in parts], kind))
    made = pa.table(columns, names=STATISTICS.names[1:])
    return made.append_column("path", _paths(steps, np.concatenate(points))) if with_paths else made


def _paths(steps: list[tuple[np.ndarray, ...]], points: np.ndarray) -> pa.Array:
    """For each row its point's steps, the last one first; null where it has no point (-1)."""
    none = pa.array(points < 0)
    if not steps:
        offsets = np.zeros(len(points) + 1, np.int32)
        point = dim = mid = high = np.zeros(0, np.int32)
    else:
        point, dim, mid, high = (np.concatenate([x[i] for x in reversed(steps)]) for i in range(4))
        order = np.argsort(point, kind="stable")
        point, dim, mid, high = point[order], dim[order], mid[order], high[order]
        first, last = np.searchsorted(point, points), np.searchsorted(point, points, "right")
        sizes = np.where(points < 0, 0, last - first)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        at = np.repeat(first - offsets[:-1], sizes) + np.arange(int(sizes.sum()))
        dim, mid, high = dim[at], mid[at], high[at]
    structs = pa.StructArray.from_arrays([pa.array(dim.astype(np.int32), mask=dim < 0), pa.array(mid.astype(np.float32), mask=dim < 0), pa.array(high.astype(bool))], ["dimension", "mid", "is_high"])
    return pa.ListArray.from_arrays(pa.array(offsets), structs, mask=none)


def _mean_ids(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The mean id of each range, cut toward zero; sums don't overflow."""
    whole, rest = np.divmod(ids, np.repeat(counts, counts))
    total, left = np.add.reduceat(whole, starts), np.add.reduceat(rest, starts)
    carry, left = np.divmod(left, counts)
    floor = total + carry
    return floor + ((floor < 0) & (left > 0))


def _matrix(table: pa.Table) -> np.ndarray:
    lists = table.column("vector").combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


SUMS = "doc_id long, range_id long, n long, id_sum string, total array<double>, squares array<double>"


def _joined(n: np.ndarray, total: np.ndarray, squares: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, sums, and sums of squared differences from the mean of runs of rows of these."""
    count, whole = np.add.reduceat(n, starts), np.add.reduceat(total, starts, axis=0)
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(n))))
    gap = total / n[:, None] - (whole / count[:, None])[of]
    return count, whole, np.add.reduceat(squares + n[:, None] * gap * gap, starts, axis=0)


def _sums_batch(keys: np.ndarray, n: np.ndarray, ids: list[int], total: np.ndarray, squares: np.ndarray) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (total, squares)]
    return pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1]), pa.array(n), pa.array([str(x) for x in ids], pa.string()), *lists], ["doc_id", "range_id", "n", "id_sum", "total", "squares"])


def _partial_sums(points: DataFrame) -> DataFrame:
    """For each range and task (or SUM_BYTES of it): number, sum of ids, sums, and sums of squared differences from the means."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def merged() -> tuple:
            keys, n, ids, total, squares = (np.concatenate([x[i] for x in held], axis=1 if i == 0 else 0) if i != 2 else [y for x in held for y in x[2]] for i in range(5))
            order = np.lexsort(keys)
            keys = keys[:, order]
            starts = np.flatnonzero(np.append(True, (np.diff(keys) != 0).any(0)))
            sums = _joined(n[order], total[order], squares[order], starts)
            ends = np.append(starts[1:], len(order))
            return keys[:, starts], sums[0], [sum(ids[i] for i in order[s:e]) for s, e in zip(starts, ends, strict=True)], sums[1], sums[2]

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            x = _matrix(table).astype(np.float64)
            keys = np.stack([table.column(c).to_numpy() for c in ("doc_id", "range_id")])
            ids = table.column("id").to_numpy()
            order = np.lexsort(keys)
            if (order != np.arange(len(order))).any():
                x, keys, ids = x[order], keys[:, order], ids[order]
            starts = np.flatnonzero(np.append(True, (np.diff(keys) != 0).any(0)))
            n = np.diff(np.append(starts, len(ids)))
            total = np.add.reduceat(x, starts, axis=0)
            x -= np.repeat(total / n[:, None], n, axis=0)
            x *= x
            held.append((keys[:, starts], n, [sum(part) for part in np.split(ids.astype(object), starts[1:])], total, np.add.reduceat(x, starts, axis=0)))
            size += 2 * total.nbytes
            if size > SUM_BYTES:
                held = [merged()]
                size = 2 * held[0][3].nbytes
                if size > SUM_BYTES // 2:
                    yield _sums_batch(*held[0])
                    held, size = [], 0
        if held:
            yield _sums_batch(*merged())

    return points.mapInArrow(run, SUMS)


def _all_sums(table: pa.Table) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Number, sum of ids, sums and squares of all rows of sums of a range."""
    n = table.column("n").to_numpy()
    total, squares = (table.column(c).combine_chunks().flatten().to_numpy().reshape(len(n), -1) for c in ("total", "squares"))
    count, whole, spread = _joined(n, total, squares, np.zeros(1, np.int64))
    return int(count[0]), sum(map(int, table.column("id_sum").to_pylist())), whole[0], spread[0]


def _splits(points: DataFrame, mode: str) -> DataFrame:
    """doc_id, range_id, points, dimension, mid, stdev, mean_id of each range."""

    def merge(table: pa.Table) -> pa.Table:
        n, ids, total, squares = _all_sums(table)
        keys = np.array([[table.column(c)[0].as_py()] for c in ("doc_id", "range_id")])
        return pa.Table.from_batches([_sums_batch(keys, np.array([n]), [ids], total[None], squares[None])])

    def choose(table: pa.Table) -> pa.Table:
        n, ids, total, squares = _all_sums(table)
        doc, r = table.column("doc_id")[0].as_py(), table.column("range_id")[0].as_py()
        dim, mid, deviation, mean_id = _choose(mode, r, n, ids, total / n, squares)
        return pa.table({"doc_id": pa.array([doc], pa.int64()), "range_id": pa.array([r], pa.int64()), "points": pa.array([n], pa.int64()), "dimension": pa.array([dim], pa.int32()), "mid": pa.array([mid], pa.float32()), "stdev": pa.array([deviation], pa.float64()), "mean_id": pa.array([mean_id], pa.int64())})

    sums = materialize(_partial_sums(points), "tree-sums")
    while (sums.groupBy("doc_id", "range_id").count().agg(F.max("count")).first()[0] or 0) > MOST_SUMS:
        slot = F.pmod(F.monotonically_increasing_id(), F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy("doc_id", "range_id")) / MOST_SUMS)))
        sums = materialize(sums.withColumn("slot", slot).groupBy("doc_id", "range_id", "slot").applyInArrow(merge, SUMS), "tree-sums")
    return sums.groupBy("doc_id", "range_id").applyInArrow(choose, "doc_id long, range_id long, points long, dimension int, mid float, stdev double, mean_id long")


def _upper(points: DataFrame, mode: str, cutoff: int, max_depth: int) -> tuple[DataFrame, list[DataFrame]]:
    """points with the ranges of at most cutoff points (or at max_depth) they fall into, and the splits above, by level."""
    points = points.select("doc_id", "id", "vector").withColumn("range_id", F.lit(0).cast("long"))
    upper: list[DataFrame] = []
    large = points.groupBy("doc_id").count().where(F.col("count") > cutoff).select("doc_id")
    if large.isEmpty():
        return points, upper
    points = materialize(points, "tree-points")
    active, steps = points.join(large, "doc_id", "left_semi"), 0
    while True:
        split = materialize(_splits(active, mode).where((F.col("points") > cutoff) & (level(F.col("range_id")) < max_depth)), "tree-splits")
        n = split.count()
        if not n:
            return points, upper
        upper.append(split)
        cut = split.select(F.col("doc_id").alias("d"), F.col("range_id").alias("r"), "dimension", "mid", "stdev", "mean_id")
        same = (F.col("doc_id") == F.col("d")) & (F.col("range_id") == F.col("r"))
        value, later = F.get("vector", "dimension"), F.col("id") > F.col("mean_id")
        high = F.when(F.col("stdev") == 0, later)
        if mode == "sql":
            high = high.when(F.col("range_id") == 0, value >= F.col("mid"))
        high = high.otherwise((value > F.col("mid")) | ((value == F.col("mid")) & later))
        moved = F.when(F.col("r").isNull(), F.col("range_id")).otherwise(F.col("range_id") * 2 + 1 + high.cast("long"))
        points = points.join(F.broadcast(cut) if n <= MOST_BROADCAST else cut, same, "left").select("doc_id", "id", "vector", moved.alias("range_id"))
        steps += 1
        if steps % 8 == 0:
            points = materialize(points, "tree-points")
        parents = split.select(F.col("doc_id").alias("d"), F.explode(F.array(F.col("range_id") * 2 + 1, F.col("range_id") * 2 + 2)).alias("r"))
        active = points.join(F.broadcast(parents) if n <= MOST_BROADCAST else parents, same, "left_semi")


def _inner(split: DataFrame, mode: str) -> DataFrame:
    """The nodes of splits. Mode sql shows no dimension where all values are equal."""
    hidden = (F.col("stdev") == 0) & F.lit(mode == "sql")
    return split.select(
        "doc_id", "range_id", F.when(~hidden, F.col("dimension")).alias("dimension"), F.when(~hidden, F.col("mid")).alias("mid"),
        (F.col("range_id") * 2 + 1).alias("low_range_id"), (F.col("range_id") * 2 + 2).alias("high_range_id"), F.lit(None).cast("long").alias("id"), "points", "stdev", "mean_id",
    )


def _checked_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")


def split_levels(points: DataFrame, mode: str = "sql", levels: int = 1) -> DataFrame:
    """The inner nodes of the first levels of the trees, with statistics; nothing below them is built."""
    _checked_mode(mode)
    _, upper = _upper(points, mode, 1, levels)
    if not upper:
        return points.sparkSession.createDataFrame([], STATISTICS)
    made = _inner(upper[0], mode)
    for split in upper[1:]:
        made = made.unionByName(_inner(split, mode))
    return made


def build_index(points: DataFrame, mode: str = "sql", max_depth: int = MAX_DEPTH, overflow: str = "leaf", cutoff: int | None = None, checked: bool = True, statistics: bool = False, with_paths: bool = False) -> DataFrame:
    """The nodes of the trees of points (doc_id, id, vector), one tree for each document.

    overflow: what to do with points that are together at max_depth, "leaf" (a leaf of several
    ids, a row for each) or "raise". statistics: adds the number of points, the deviation and the
    mean id of each node. with_paths: adds each leaf's path to the root, as leaf_paths has it, made
    where the leaf is. cutoff: points up to which a range is finished in one task, by default as
    many as SUBTREE_BYTES hold. checked=False leaves out the checks of ids and vectors.
    """
    _checked_mode(mode)
    if overflow not in ("leaf", "raise"):
        raise ValueError("overflow is leaf or raise")
    if not 0 < max_depth <= MAX_DEPTH or (cutoff is not None and cutoff < 1):
        raise ValueError(f"max_depth lies between 1 and {MAX_DEPTH}, cutoff is positive")
    dims = check_points(points) if checked else points.agg(F.max(F.size("vector"))).first()[0]
    cutoff = cutoff or max(1_000, SUBTREE_BYTES // (4 * max(1, dims or 1)))
    points, upper = _upper(points, mode, cutoff, max_depth)
    schema = T.StructType([*STATISTICS.fields, *([T.StructField("path", PATH), T.StructField("top", T.LongType())] if with_paths else [])])

    def finish(table: pa.Table) -> pa.Table:
        doc, r = table.column("doc_id")[0].as_py(), table.column("range_id")[0].as_py()
        made = _subtree(mode, r, table.column("id").to_numpy(), _matrix(table), max_depth, overflow, with_paths)
        made = made.add_column(0, "doc_id", pa.array(np.full(made.num_rows, doc, np.int64)))
        return made.append_column("top", pa.array(np.full(made.num_rows, r, np.int64))) if with_paths else made

    nodes = points.groupBy("doc_id", "range_id").applyInArrow(finish, schema)
    inner = None
    for split in upper:
        inner = _inner(split, mode) if inner is None else inner.unionByName(_inner(split, mode))
    if with_paths:
        if inner is not None:
            above = paths_of(inner.select("doc_id", F.explode(F.array("low_range_id", "high_range_id")).alias("range_id")), inner)
            above = materialize(above.select(F.col("doc_id").alias("d"), F.col("range_id").alias("r"), F.col("path").alias("above")), "tree-above")
            few = above.count() <= MOST_BROADCAST
            nodes = nodes.join(F.broadcast(above) if few else above, (F.col("doc_id") == F.col("d")) & (F.col("top") == F.col("r")), "left")
            nodes = nodes.withColumn("path", F.when(F.col("above").isNull(), F.col("path")).otherwise(F.concat("path", "above")))
        nodes = nodes.select(*STATISTICS.names, "path")
    if inner is not None:
        nodes = nodes.unionByName(inner, allowMissingColumns=True)
    columns = [*(STATISTICS if statistics else NODE).names, *(["path"] if with_paths else [])]
    return nodes.select(*columns)


def paths_of(ranges: DataFrame, inner: DataFrame, *carried: str) -> DataFrame:
    """ranges (doc_id, range_id, carried columns) with path: the splits of inner from the parent up to the root, and the side taken."""
    depth = level(F.col("range_id"))
    child = lambda k: F.call_function("shiftright", F.col("range_id") + 1, k.cast("int")) - 1  # noqa: E731  # the ancestor k levels up
    steps = F.when(depth > 0, F.transform(F.sequence(F.lit(0), F.greatest(depth - 1, F.lit(0))), lambda k: F.struct(k.alias("step"), child(k).alias("child"))))
    walked = ranges.withColumn("at", F.explode_outer(steps)).select("doc_id", *carried, "range_id", "at.step", F.col("at.child").alias("child"))
    walked = walked.withColumn("parent", F.expr("(child - 1) div 2"))
    split = inner.select(F.col("doc_id").alias("d"), F.col("range_id").alias("r"), "dimension", "mid")
    joined = walked.join(split, (F.col("doc_id") == F.col("d")) & (F.col("parent") == F.col("r")), "left")
    one = F.when(F.col("child").isNotNull(), F.struct("step", F.col("dimension"), F.col("mid"), (F.col("child") % 2 == 0).alias("is_high")))
    grouped = joined.groupBy("doc_id", *carried, "range_id").agg(F.sort_array(F.collect_list(one)).alias("steps"))
    return grouped.select("doc_id", *carried, "range_id", F.transform("steps", lambda s: F.struct(s["dimension"].alias("dimension"), s["mid"].alias("mid"), s["is_high"].alias("is_high"))).alias("path"))


def range_values(nodes: DataFrame) -> DataFrame:
    """range_id, dimension, mid and id as a stream of node values has them: leaves have dimension -1 and their point's id, others the mean id that broke ties. Needs statistics."""
    leaf = F.col("low_range_id").isNull()
    return nodes.select(
        "doc_id", "range_id", F.when(leaf, -1).otherwise(F.col("dimension")).cast("int").alias("dimension"), F.when(leaf, F.lit(0.0)).otherwise(F.col("mid")).cast("float").alias("mid"),
        F.when(leaf, F.col("id")).otherwise(F.col("mean_id")).alias("id"),
    )
