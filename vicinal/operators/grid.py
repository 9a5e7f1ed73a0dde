"""An adaptive bisection grid over vectors, meant for components within [-1, 1].

Space is halved at fixed midpoints, one dimension after the other, 24 times each. A record's cell
is the shortest run of halvings that at most `list_threshold` records share (or all of them); it
is written as a string of 0 (below the midpoint) and 1. Components outside [-1, 1] belong to the
outermost cells, which have no outer bound.

Cells are found for all records at once: a chunk of halvings is computed for each record of a
cell with too many, counts by the run of halvings decide where each cell ends, and the records
still together go on to the next chunk. A search keeps the cells that the ball around its point
touches and tests the caller's predicate on their records; like any candidate search it may call
it for records that are further away, never leaves out one that is within the distance.

Handles are immutable: add, remove and clear return a new index. To add finds the cell that each
new record falls into, and halves anew only cells that get too many; to remove merges only cells
whose parents come to hold few enough. Records of other cells are neither read nor written again,
but every COMPACT changes, when all are written as one table.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import vector_column
from ..plans.storage import MOST_BROADCAST, materialize

DEPTH = 24
COMPACT = 8


def _halvings(vector: Column, dims: int, start: int, n: int) -> Column:
    """Halvings start to start + n - 1 of a vector, as a string."""
    place = lambda i: F.greatest(F.lit(0), F.least(F.lit((1 << DEPTH) - 1), F.floor((F.get(vector, F.lit(i)).cast("double") + 1) * (1 << (DEPTH - 1))).cast("long")))
    bits = [F.call_function("shiftright", place(p % dims), F.lit(DEPTH - 1 - p // dims)).bitwiseAND(F.lit(1)).cast("string") for p in range(start, min(start + n, DEPTH * dims))]
    return F.concat(*bits)


def _chunk(most: int, threshold: int) -> int:
    """About as many halvings as bring the fullest cell below the threshold."""
    return max(4, (most // threshold).bit_length() + 3)


def assign_cells(records: DataFrame, vector: Column, dims: int, threshold: int, start: int = 0) -> DataFrame:
    """records with the column cell. With a start, they have cells of that length, all with too many records, which are halved further."""
    # NaN compares greater than any number, as the grid wants it: always the upper half
    active = records if start else records.withColumn("cell", F.lit(""))
    records = records.drop("cell")
    done = None
    most = active.groupBy("cell").count().agg(F.max("count")).first()[0] or 0
    if most <= threshold or not dims or start >= DEPTH * dims:
        return active.select(*records.columns, "cell")
    chunk = _chunk(most, threshold)
    while True:
        active = active.withColumn("__bits", _halvings(vector, dims, start, chunk))
        active = materialize(active, "grid-active")
        counts = active.groupBy("cell", "__bits").agg(F.count("*").alias("n"))
        runs = counts.select("cell", "n", F.explode(F.transform(F.sequence(F.lit(0), F.length("__bits")), lambda k: F.substring(F.col("__bits"), F.lit(1), k))).alias("run"))
        by_run = runs.groupBy(F.col("cell").alias("c"), "run").agg(F.sum("n").alias("n"))
        # a cell ends where its run is the first with few enough records
        small = by_run.where(F.col("n") <= threshold)
        ends = small.join(by_run.select(F.col("c").alias("c2"), F.col("run").alias("up"), F.col("n").alias("n_up")), (F.col("c") == F.col("c2")) & (F.expr("substring(run, 1, length(run) - 1)") == F.col("up")) & (F.length("run") > 0)).where(F.col("n_up") > threshold).select("c", "run")
        ends = materialize(ends, "grid-ends")
        lengths = counts.select(F.col("cell").alias("lc"), F.col("__bits").alias("lb"), F.explode(F.sequence(F.lit(1), F.length("__bits"))).alias("k"))
        found = lengths.join(ends, (F.col("lc") == F.col("c")) & (F.expr("substring(lb, 1, k)") == F.col("run"))).groupBy("lc", "lb").agg(F.min("run").alias("run"))
        found = materialize(found, "grid-found")
        few = found.count() <= MOST_BROADCAST
        settled = active.join(F.broadcast(found) if few else found, (F.col("cell") == F.col("lc")) & (F.col("__bits") == F.col("lb")), "left")
        part = settled.where("run is not null").withColumn("cell", F.concat("cell", "run")).select(*records.columns, "cell")
        done = part if done is None else done.unionByName(part)
        left = settled.where("run is null").withColumn("cell", F.concat("cell", "__bits")).drop("__bits", "lc", "lb", "run")
        start += chunk
        if start >= DEPTH * dims:
            return done.unionByName(left.select(*records.columns, "cell"))
        before, most = most, left.groupBy("cell").count().agg(F.max("count")).first()[0]
        if most is None:
            return done
        # equal vectors stay together: look further at once
        active, chunk = left, min(2 * chunk, 256) if most == before else _chunk(most, threshold)


def cell_bounds(cell: Column, dims: int) -> tuple[Column, Column]:
    """The lower and upper bounds of a cell in each dimension; outermost ones are infinite."""
    halvings = lambda i: F.floor((F.length(cell) + (dims - 1) - i) / dims).cast("int")

    def place(i: Column, n: Column) -> Column:
        """Which of the 2 ** n slices of a dimension the cell lies in."""
        digit = lambda k: F.substring(cell, k * dims + i + 1, F.lit(1)).cast("long")
        return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0).cast("long"), lambda s, k: s * 2 + digit(k))).otherwise(F.lit(0).cast("long"))

    slices = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.struct(place(i, halvings(i)).alias("at"), F.pow(F.lit(2.0), halvings(i).cast("double")).alias("of")))
    low = F.transform(slices, lambda x: F.when(x["at"] == 0, F.lit(float("-inf"))).otherwise(x["at"] * 2 / x["of"] - 1))
    high = F.transform(slices, lambda x: F.when(x["at"] + 1 >= x["of"], F.lit(float("inf"))).otherwise((x["at"] + 1) * 2 / x["of"] - 1))
    return low, high


def _prefixes(cells: DataFrame, column: str, whole: bool) -> DataFrame:
    """cells with prefix: a row for every prefix of the column, itself only if whole."""
    last = F.length(column) if whole else F.length(column) - 1
    return cells.where(last >= 0).withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(F.col(column), F.lit(1), k))))


class GridIndex:
    """Records of any schema, with a vector given by a column, a name, or an expression over the record."""

    def __init__(self, records: DataFrame, vector: Column | str = "vector", list_threshold: int = 10, dims: int | None = None) -> None:
        if list_threshold <= 0:
            raise ValueError("list_threshold must be positive")
        self.vector = vector_column(vector)
        self.list_threshold = list_threshold
        self._n, found = self._checked(records, dims)
        self.dims = found or dims
        self._columns = records.columns
        self._changes = 0
        self._records = materialize(assign_cells(records, self.vector, self.dims or 0, list_threshold), "grid-records")
        self._sizes: DataFrame | None = None

    def _checked(self, records: DataFrame, dims: int | None) -> tuple[int, int | None]:
        """The number of records and of their vectors' components, which must be dims if that is given."""
        size = F.size(self.vector)
        row = records.agg(F.count("*").alias("n"), F.min(size).alias("least"), F.max(size).alias("most"), F.max(self.vector.isNull().cast("int")).alias("none")).first()
        if row["n"] and (row["none"] or row["least"] != row["most"] or not row["most"] or (dims and row["most"] != dims)):
            raise ValueError("vectors must not be null or empty, and of one length")
        return row["n"], row["most"] if row["n"] else None

    def _leaves(self) -> DataFrame:
        """cell and n of every cell with records."""
        if self._sizes is None:
            self._sizes = materialize(self._records.groupBy("cell").agg(F.count("*").alias("n")), "grid-leaves")
        return self._sizes

    def _with(self, untouched: DataFrame, changed: DataFrame, n: int) -> GridIndex:
        """An index of other records, of which those in changed are written."""
        new = copy.copy(self)
        changed = materialize(changed.select(*self._records.columns), "grid-changed")
        new._records = untouched.select(*self._records.columns).unionByName(changed)
        new._n, new._sizes, new._changes = n, None, self._changes + 1
        if new._changes % COMPACT == 0:
            new._records = materialize(new._records, "grid-records")
        return new

    @property
    def count(self) -> int:
        return self._n

    def records(self) -> DataFrame:
        return self._records.select(*self._columns)

    def add(self, records: DataFrame) -> GridIndex:
        n, _ = self._checked(records, self.dims)
        records = records.select(*self._columns)
        if not self._n:
            return GridIndex(records, self.vector, self.list_threshold, self.dims)
        if not n:
            return self
        leaves = self._leaves()
        most = leaves.agg(F.max(F.length("cell"))).first()[0]
        key = _halvings(self.vector, self.dims, 0, min(most + 1, DEPTH * self.dims))
        rows = materialize(records.withColumn("__key", key), "grid-new")
        # a record falls into its shortest prefix that isn't an inner node
        inner = _prefixes(leaves, "cell", False).select(F.col("prefix").alias("inner")).distinct()
        ways = _prefixes(rows.select("__key").distinct(), "__key", False)
        deepest = ways.join(inner, F.col("prefix") == F.col("inner")).groupBy(F.col("__key").alias("k")).agg(F.max(F.length("prefix")).alias("deep"))
        rows = rows.join(deepest, F.col("__key") == F.col("k"), "left").withColumn("cell", F.when(F.col("deep").isNull(), F.lit("")).otherwise(F.expr("substring(__key, 1, deep + 1)")))
        rows = materialize(rows.select(*self._columns, "cell"), "grid-homes")
        counts = rows.groupBy("cell").agg(F.count("*").alias("more")).join(leaves.withColumnRenamed("cell", "c"), F.col("cell") == F.col("c"), "left")
        full = materialize(counts.where((F.col("more") + F.coalesce("n", F.lit(0)) > self.list_threshold) & (F.length("cell") < DEPTH * self.dims)).select(F.col("cell").alias("full")), "grid-full")
        few = full.count() <= MOST_BROADCAST
        same = F.col("cell") == F.col("full")
        full_ = F.broadcast(full) if few else full
        crowded = materialize(self._records.join(full_, same, "left_semi").unionByName(rows.join(full_, same, "left_semi")), "grid-crowded")
        changed = rows.join(full_, same, "left_anti")
        for r in full.select(F.length("full").alias("size")).distinct().collect():  # at most 24 x dims lengths
            changed = changed.unionByName(assign_cells(crowded.where(F.length("cell") == r["size"]), self.vector, self.dims, self.list_threshold, r["size"]) if r["size"] else assign_cells(crowded.where("cell = ''").drop("cell"), self.vector, self.dims, self.list_threshold))
        return self._with(self._records.join(full_, same, "left_anti"), changed, self._n + n)

    def clear(self) -> GridIndex:
        return GridIndex(self.records().limit(0), self.vector, self.list_threshold)

    def _reached(self, vector: Sequence[float], distance: float) -> DataFrame:
        if self._n and len(vector) != self.dims:
            raise ValueError(f"the vector has {len(vector)} components, the records' have {self.dims}")
        cells = self._records.select("cell").distinct()
        low, high = cell_bounds(F.col("cell"), self.dims or 1)
        q = F.array(*(F.lit(float(x)) for x in vector))
        gap = F.zip_with(F.zip_with(low, q, lambda a, b: F.greatest(a - b, F.lit(0.0))), F.zip_with(high, q, lambda a, b: F.greatest(b - a, F.lit(0.0))), lambda a, b: F.greatest(a, b))
        budget = float(distance) ** 2 * (1 + 1e-6) + 1e-12
        return cells.where(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x) <= budget).select(F.col("cell").alias("reached"))

    def candidates(self, vector: Sequence[float], distance: float) -> DataFrame:
        """The records in cells that the ball around vector touches."""
        return self._records.join(self._reached(vector, distance), F.col("cell") == F.col("reached"), "left_semi").select(*self._columns)

    def find(self, vector: Sequence[float], distance: float, predicate: Column | Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The candidates for which predicate holds: a boolean column (built-in functions or a pandas UDF), or a function that filters a DataFrame."""
        rows = self.candidates(vector, distance)
        return predicate(rows) if callable(predicate) and not isinstance(predicate, Column) else rows.where(predicate)

    def remove(self, vector: Sequence[float], distance: float, predicate: Column) -> GridIndex:
        """An index without the records that find returns."""
        reached = self._reached(vector, distance)
        leaves = self._leaves()
        near = self._records.join(reached, F.col("cell") == F.col("reached"), "left_semi")
        kept = materialize(near.where(~F.coalesce(predicate, F.lit(False))), "grid-kept")
        left = leaves.join(reached, F.col("cell") == F.col("reached"), "left_semi").join(kept.groupBy(F.col("cell").alias("c")).agg(F.count("*").alias("left")), F.col("cell") == F.col("c"), "left")
        left = materialize(left.select("cell", "n", F.coalesce("left", F.lit(0)).alias("left")).where("left < n"), "grid-touched")
        gone = left.agg(F.sum(F.col("n") - F.col("left"))).first()[0]
        if not gone:
            return self
        # what the cells above the touched ones hold now; the highest with few enough records is a cell
        now = leaves.join(left.select(F.col("cell").alias("t"), "left"), F.col("cell") == F.col("t"), "left").select("cell", F.coalesce("left", "n").alias("n"))
        now = materialize(now, "grid-now")
        above = _prefixes(left.select("cell"), "cell", True).select(F.col("prefix").alias("p")).distinct()
        every = _prefixes(now, "cell", True).join(above, F.col("prefix") == F.col("p"), "left_semi")
        small = every.groupBy("prefix").agg(F.sum("n").alias("held")).where(F.col("held") <= self.list_threshold).select(F.col("prefix").alias("small"))
        to = _prefixes(now.select("cell"), "cell", True).join(small, F.col("prefix") == F.col("small")).groupBy("cell").agg(F.min(F.struct(F.length("prefix"), "prefix")).alias("x")).select(F.col("cell").alias("old"), F.col("x.prefix").alias("new"))
        to = to.unionByName(left.select(F.col("cell").alias("old"), F.col("cell").alias("new")).join(to.select(F.col("old").alias("o")), F.col("old") == F.col("o"), "left_anti"))
        to = materialize(to, "grid-merged")
        few = to.count() <= MOST_BROADCAST
        to_ = F.broadcast(to) if few else to
        same = F.col("cell") == F.col("old")
        touched = left.select(F.col("cell").alias("t"))
        beside = self._records.join(to_, same).join(touched, F.col("cell") == F.col("t"), "left_anti")
        changed = beside.unionByName(kept.join(touched, F.col("cell") == F.col("t"), "left_semi").join(to_, same)).withColumn("cell", F.col("new"))
        return self._with(self._records.join(to_, same, "left_anti"), changed, self._n - gone)

    def cells(self, id: str | None = None) -> DataFrame:
        """cell, parent (null at the root), center, records, and ids if named, of every node of the grid's hierarchy: inner nodes have no records."""
        leaves = self._records.groupBy("cell").agg(F.count("*").alias("records"), *([F.sort_array(F.collect_list(id)).alias("ids")] if id else []))
        inner = leaves.where(F.length("cell") > 0).select(F.explode(F.transform(F.sequence(F.lit(0), F.length("cell") - 1), lambda k: F.substring(F.col("cell"), F.lit(1), k))).alias("cell")).distinct()
        nodes = leaves.unionByName(inner, allowMissingColumns=True)
        low, high = cell_bounds(F.col("cell"), self.dims or 1)
        centre = F.zip_with(low, high, lambda a, b: (F.greatest(a, F.lit(-1.0)) + F.least(b, F.lit(1.0))) / 2)
        return nodes.select("cell", F.when(F.length("cell") > 0, F.expr("substring(cell, 1, length(cell) - 1)")).alias("parent"), centre.alias("center"), "records", *(["ids"] if id else []))

