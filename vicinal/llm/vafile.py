"""Exact top-k by inner product with vector-approximation files.

Components become integers, floor(scale x component). Equal vectors are one entry with their
k + 1 least ids, which is all that any query can need of them.

The file of approximations is a table of its own: every dimension is cut into 2 ** bits cells of
equal width between its least and greatest value, and an entry is its packed cell numbers and the
length of what they leave out. For a block of queries one scan reads only that table: the product
with the cells' centres, and what can be missing from it (half a cell in every dimension, or the
lengths of the query and of what is left out, whichever is less), bound the exact product from
both sides. The kth greatest lower bound of a query rules out all entries whose upper bound lies
below it. Exact vectors are read for the others only, by a join on the entry's number, in the
order of their upper bounds: the first 2 k of a query, and then those whose upper bound still
reaches the kth exact score so far. No later one can be among the results; equal scores are read
on, so ties go to the smaller id exactly.

Queries come in blocks of at most `query_bytes` (a broadcast of that bounded size, given up after
the block's scan). Each scan's task keeps the candidates that its own bounds leave open.

Rows without an id, and vectors that are null or hold a null or non-finite component, take no
part. A query is compared with the vectors of its own length under other ids. Vectors with
components so large that sums of products may not be exact in floating point stay out of the
file and are compared with whole numbers of any size; scores beyond a long are returned as its
limits, and count as equal there. Repeated rows of an id are queries of their own with equal
results; an empty table, or one without queries, gives an empty result. Columns other than
vec_id and embedding serve is_query alone, whatever their names. Vectors of any length do.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import map_batches, materialize

ROWS = 8192
#: Queries up to which their bounds are broadcast.
MOST_BROADCAST = 1 << 16
MOST, LEAST = (1 << 63) - 1, -(1 << 63)


def finite(vectors: DataFrame) -> DataFrame:
    """The rows that take part: vec_id as long, embedding as doubles."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where("vec_id is not null and embedding is not null").where(good).withColumns({"vec_id": F.col("vec_id").cast("long"), "embedding": F.col("embedding").cast("array<double>")})


def entries(vectors: DataFrame, k: int, scale: int) -> DataFrame:
    """row (a number), v (components x scale, rounded down; beyond double precision the component itself), large, ids (vec_id, n) and only (the id, where there is one): one entry for equal vectors."""
    # a double of this size is whole already, and times the scale it might overflow
    whole = F.transform("embedding", lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x * scale).cast("double")).otherwise(x))
    # -0.0 and 0.0 are one
    whole = F.transform(whole, lambda x: x + F.lit(0.0))
    counted = vectors.select("vec_id", whole.alias("v")).groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).alias("n"))
    least = counted.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    # sums of products of components up to this are whole numbers below 2 ** 52
    limit = F.sqrt(F.lit(float(1 << 52)) / F.greatest(F.size("v"), F.lit(1)))
    large = F.exists("v", lambda x: F.abs(x) > limit)
    ids = F.sort_array(F.collect_list(F.struct("vec_id", "n")))
    made = least.groupBy("v").agg(ids.alias("ids")).select("v", large.alias("large"), "ids", F.when(F.size("ids") == 1, F.col("ids")[0]["vec_id"]).alias("only"))
    return made.withColumn("row", F.monotonically_increasing_id())


def _matrices(batch: pa.RecordBatch, column: str, *others: str):
    """(matrix, other columns) for each length of vector in the batch, in pieces of at most ROWS rows."""
    lists = batch.column(column)
    offsets = lists.offsets.to_numpy()
    flat, sizes = lists.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        for i in range(0, len(rows), ROWS):
            part = rows[i : i + ROWS]
            yield flat[offsets[part][:, None] + np.arange(d)[None, :]].reshape(len(part), d), *(batch.column(c).take(pa.array(part)) for c in others)


def _limits(small: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Least and greatest value of each dimension, by length of vector."""

    def run(batches):
        low, high = {}, {}
        for batch in batches:
            for (x,) in _matrices(batch, "v"):
                d = x.shape[1]
                low[d] = np.minimum(low.get(d, x[0]), x.min(0))
                high[d] = np.maximum(high.get(d, x[0]), x.max(0))
        for d in low:
            if d:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d), pa.int32()), pa.array(np.arange(d), pa.int32()), pa.array(low[d]), pa.array(high[d])], ["d", "i", "low", "high"])

    got = map_batches(small.select("v"), run, "d int, i int, low double, high double").groupBy("d", "i").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d", "i").toArrow()  # a row for each dimension
    d, low, high = (got.column(c).to_numpy() for c in ("d", "low", "high"))
    return {int(x): (low[d == x], high[d == x]) for x in np.unique(d)}


def pack(cells: np.ndarray, bits: int) -> list[bytes]:
    """Rows of cell numbers with `bits` bits each, end to end."""
    each = np.unpackbits(cells.astype(np.uint8)[:, :, None], axis=2)[:, :, 8 - bits :]
    return [x.tobytes() for x in np.packbits(each.reshape(len(cells), -1), axis=1)]


def unpack(packed: list[bytes], d: int, bits: int) -> np.ndarray:
    rows = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
    each = np.zeros((len(packed), d, 8), np.uint8)
    each[:, :, 8 - bits :] = np.unpackbits(rows, axis=1)[:, : d * bits].reshape(len(packed), d, bits)
    return np.packbits(each, axis=2)[:, :, 0]


def _centres(cells: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int) -> np.ndarray:
    return low + (cells + 0.5) * ((high - low + 1) / (1 << bits))


def approximations(small: DataFrame, limits: dict[int, tuple[np.ndarray, np.ndarray]], bits: int) -> DataFrame:
    """row, only, d, cells and left (the length of what the cells leave out) of each entry: the file that is scanned."""

    def run(batches):
        for batch in batches:
            for x, row, only in _matrices(batch, "v", "row", "only"):
                d = x.shape[1]
                if d:
                    low, high = limits[d]
                    cells = np.minimum((x - low) / ((high - low + 1) / (1 << bits)), (1 << bits) - 1).astype(np.int64)
                    left = np.sqrt(((x - _centres(cells, low, high, bits)) ** 2).sum(1))
                    packed = pack(cells, bits)
                else:
                    left, packed = np.zeros(len(x)), [b""] * len(x)
                yield pa.RecordBatch.from_arrays([row, only, pa.array(np.full(len(x), d), pa.int32()), pa.array(packed, pa.binary()), pa.array(left * (1 + 1e-9) + 1e-9)], ["row", "only", "d", "cells", "left"])

    return map_batches(small.select("row", "only", "v"), run, "row long, only long, d int, cells binary, left double")


class _Open:
    """The candidates of a block of queries that bounds leave open so far."""

    def __init__(self, n: int, k: int):
        self.k, self.lower = k, np.full((n, k), -np.inf)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, which: np.ndarray, rows: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Bounds of all queries `which` against all rows."""
        best = lower if lower.shape[1] <= self.k else -np.partition(-lower, self.k - 1, axis=1)[:, : self.k]
        self.lower[which] = -np.sort(-np.concatenate([self.lower[which], best], axis=1), axis=1)[:, : self.k]
        q, r = np.nonzero((upper >= self.lower[which, -1][:, None]) & (upper > -np.inf))
        self.held.append((which[q], rows[r], upper[q, r], lower[q, r]))
        self.size += len(q)
        if self.size > 1 << 20:
            before, self.held = self.size, [self.left()]
            self.size = len(self.held[0][0])
            if self.size > before // 2:
                self.size = 0  # they stay open; look again after as many more

    def left(self) -> tuple[np.ndarray, ...]:
        q, rows, upper, lower = (np.concatenate([x[i] for x in self.held]) for i in range(4))
        keep = upper >= self.lower[q, -1]
        return q[keep], rows[keep], upper[keep], lower[keep]


def _scan(cells: DataFrame, queries: list[tuple[np.ndarray, np.ndarray, np.ndarray]], limits, k: int, bits: int) -> DataFrame:
    """q, row, upper and lower of the entries that the approximations leave open, for queries (numbers, ids, matrix) by length."""
    shared = cells.sparkSession.sparkContext.broadcast(queries)
    total = sum(len(x[0]) for x in queries)
    every = np.concatenate([x[0] for x in queries])

    def run(batches):
        groups, start = {}, 0
        for _, ids, q in shared.value:
            half = (limits[q.shape[1]][1] - limits[q.shape[1]][0] + 1) / (1 << bits) / 2 if q.shape[1] in limits else np.zeros(0)
            groups[q.shape[1]] = (np.arange(start, start + len(ids)), ids, q, np.abs(q) @ half if q.shape[1] else np.zeros(len(q)), np.sqrt((q * q).sum(1)))
            start += len(ids)
        open_ = _Open(total, k)
        for batch in batches:
            lengths = batch.column("d").to_numpy()
            for d in np.unique(lengths):
                if d not in groups:
                    continue
                which, ids, q, cell, size = groups[d]
                at = np.flatnonzero(lengths == d)
                for i in range(0, len(at), ROWS):
                    part = batch.take(pa.array(at[i : i + ROWS]))
                    rows, left = part.column("row").to_numpy(), part.column("left").to_numpy()
                    own = part.column("only").fill_null(-1).to_numpy(zero_copy_only=False)
                    no_only = part.column("only").is_null().to_numpy(zero_copy_only=False)
                    if d:
                        low, high = limits[d]
                        x = _centres(unpack(part.column("cells").to_pylist(), d, bits), low, high, bits)
                    else:
                        x = np.zeros((len(rows), 0))
                    for j in range(0, len(ids), 512):
                        s = slice(j, j + 512)
                        product = q[s] @ x.T
                        spread = np.minimum(cell[s][:, None], size[s][:, None] * left[None, :])
                        spread += 1e-6 + 1e-9 * np.abs(product) + 1e-11 * size[s][:, None] * np.sqrt((x * x).sum(1))[None, :]
                        barred = (ids[s][:, None] == own[None, :]) & ~no_only[None, :]
                        upper, lower = product + spread, product - spread
                        upper[barred] = lower[barred] = -np.inf
                        open_.add(which[s], rows, upper, lower)
        if open_.held:
            q, rows, upper, lower = open_.left()
            for i in range(0, len(q), 1 << 16):
                s = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(every[q[s]]), pa.array(rows[s]), pa.array(upper[s]), pa.array(lower[s])], ["q", "row", "upper", "lower"])

    out = materialize(map_batches(cells, run, "q long, row long, upper double, lower double"), "va-open")
    shared.destroy()
    return out


def whole_number(x: float, scale: int) -> int:
    return int(x) * scale if abs(x) >= 1 << 53 else int(x)


def _whole(rows: DataFrame, queries: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, scale: int) -> DataFrame:
    """q, vec_id, n and score of each task's best entries of rows, by whole numbers of any size."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        asked = {x[2].shape[1]: x for x in shared.value}
        exact = {d: [[whole_number(y, scale) for y in row] for row in x[2].tolist()] for d, x in asked.items()}
        best: dict[int, list] = {}
        for batch in batches:
            for x, ids in _matrices(batch, "v", "ids"):
                if x.shape[1] not in asked:
                    continue
                numbers, own, _ = asked[x.shape[1]]
                these = [[whole_number(y, scale) for y in row] for row in x.tolist()]
                pairs = ids.to_pylist()
                for number, mine, q in zip(numbers.tolist(), own.tolist(), exact[x.shape[1]], strict=True):
                    found = best.get(number, [])
                    for row, known in zip(these, pairs, strict=True):
                        score = sum(a * b for a, b in zip(q, row, strict=True))
                        if len(found) < k or -score <= found[-1][0]:
                            found = found + [(-score, p["vec_id"]) for p in known if p["vec_id"] != mine for _ in range(p["n"])]
                            found = sorted(found)[:k]
                    best[number] = found
        flat = [(q, i, max(LEAST, min(MOST, -s))) for q, found in best.items() for s, i in found]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in flat], pa.int64()) for j in range(3)], ["q", "vec_id", "score"])

    out = materialize(map_batches(rows.select("v", "ids"), run, "q long, vec_id long, score long"), "va-whole")
    shared.destroy()
    return out


def _asked(rows: DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers, ids, matrix) of a block of queries (q, query_id, v), for each length."""
    table = rows.toArrow().combine_chunks()
    by: dict[int, list] = {}
    for batch in table.to_batches():
        for x, q, ids in _matrices(batch, "v", "q", "query_id"):
            by.setdefault(x.shape[1], []).append((q.to_numpy(), ids.to_numpy(), x))
    return [tuple(np.concatenate(part) for part in zip(*parts, strict=True)) for parts in by.values()]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, bits: int = 8, query_bytes: int = 1 << 25) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k best others of every row of vectors (vec_id, embedding) for which is_query holds."""
    some = finite(vectors)
    base = materialize(entries(some.select("vec_id", "embedding"), k, scale), "va-entries")
    whole = F.transform("embedding", lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x * scale).cast("double")).otherwise(x) + F.lit(0.0))
    asked = some.where(is_query).select(F.monotonically_increasing_id().alias("q"), F.col("vec_id").alias("query_id"), whole.alias("v"))
    limit = F.sqrt(F.lit(float(1 << 52)) / F.greatest(F.size("v"), F.lit(1)))
    asked = materialize(asked.withColumn("large", F.exists("v", lambda x: F.abs(x) > limit)), "va-queries")
    small, large = base.where("not large"), base.where("large")
    limits = _limits(small)
    cells = materialize(approximations(small, limits, bits), "va-cells")
    sums = asked.agg(F.coalesce(F.sum(F.size("v") * 8 + 16), F.lit(0)).alias("bytes"), F.max("large").alias("large")).first()
    n_blocks = max(1, math.ceil(sums["bytes"] / query_bytes))
    any_large = not large.isEmpty()
    open_, found = [], []
    for block in range(n_blocks):
        own = asked.where(F.pmod(F.xxhash64("q"), F.lit(n_blocks)) == block)
        queries = _asked(own.where("not large").select("q", "query_id", "v"))
        if queries:
            open_.append(_scan(cells, queries, limits, k, bits))
        if any_large and queries:
            found.append(_whole(large, queries, k, scale))
        if sums["large"]:
            queries = _asked(own.where("large").select("q", "query_id", "v"))
            if queries:
                found += [_whole(base, queries, k, scale)]
    made = None
    if open_:
        left = open_[0]
        for more in open_[1:]:
            left = left.unionByName(more)
        made = _refined(left, small, asked, k)
    for part in found:
        made = part if made is None else made.unionByName(part)
    if made is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # every task of _whole gives its own best, so ranks are made over all
    named = made.join(asked.select(F.col("q").alias("n"), "query_id"), F.col("q") == F.col("n"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return named.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scored(pairs: DataFrame, small: DataFrame, asked: DataFrame) -> DataFrame:
    """q, row, score and the ids other than the query's own, with exact vectors read for these pairs (q, row) only."""
    mine = asked.select(F.col("q").alias("qn"), "query_id", F.col("v").alias("qv"))
    exact = small.select(F.col("row").alias("r"), "v", "ids")
    joined = pairs.select("q", "row").join(mine, F.col("q") == F.col("qn")).join(exact, F.col("row") == F.col("r"))
    score = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x).cast("long")
    return joined.select("q", "row", score.alias("score"), F.filter("ids", lambda x: x["vec_id"] != F.col("query_id")).alias("ids"))


def _by_query(rows: DataFrame, bounds: DataFrame, column: str) -> DataFrame:
    """rows with the column of bounds (qn, column) for their q, 0 to 1 for each; a query may have any share of the rows."""
    bounds = materialize(bounds, "va-bounds")
    return rows.join(F.broadcast(bounds) if bounds.count() <= MOST_BROADCAST else bounds, F.col("q") == F.col("qn"), "left").select("q", "row", "upper", column)


def _refined(left: DataFrame, small: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """q, vec_id and score: exact scores of the candidates (q, row, upper, lower), in order of their upper bounds until the kth is certain."""
    by = Window.partitionBy("q")
    lowest = left.withColumn("place", F.row_number().over(by.orderBy(F.desc("lower"), "row"))).where(F.col("place") <= k)
    known = lowest.groupBy(F.col("q").alias("qn")).agg(F.when(F.count("*") == k, F.min("lower")).otherwise(float("-inf")).alias("least"))
    left = materialize(_by_query(left, known, "least").where(F.col("upper") >= F.col("least")).select("q", "row", "upper"), "va-left")
    first = left.withColumn("place", F.row_number().over(by.orderBy(F.desc("upper"), "row"))).where(F.col("place") <= 2 * k)
    first = materialize(_scored(first, small, asked), "va-first")
    best = first.where(F.size("ids") > 0).withColumn("place", F.row_number().over(by.orderBy(F.desc("score"), "row"))).where(F.col("place") <= k)
    known = best.groupBy(F.col("q").alias("qn")).agg(F.when(F.count("*") == k, F.min("score").cast("double")).otherwise(float("-inf")).alias("least"))
    rest = _by_query(left, known, "least").where(F.col("least").isNull() | (F.col("upper") >= F.col("least")))
    seen = first.select(F.col("q").alias("sq"), F.col("row").alias("sr"))
    rest = rest.join(seen, (F.col("q") == F.col("sq")) & (F.col("row") == F.col("sr")), "left_anti")
    every = first.unionByName(_scored(rest, small, asked))
    copies = every.select("q", "score", F.explode("ids").alias("x")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("x.n"))))
    return copies.select("q", F.col("x.vec_id").alias("vec_id"), "score")
