"""K-d tree sharding, with DataFrame functions only.

Equal texts are one point of their metadata: size, least source and least language (null last, by
the bytes that follow what all names begin with). From a root that holds all points, each level
splits every node that stands for more than one shard along its widest dimension (range over the
range of all points) at a distributed weighted quantile: the weighted median where both halves
get as many shards. The number of shards comes from a target size or is given. Ties in a
dimension are broken by a hash of the text.

Equal texts stay together unless they hold more than a shard. Those that do are cut by a hash of
the id, and rows that share text and id by their number. Groups of more than 1 / HEAVY of a shard
can't be cut, so they are dealt first, the largest first, each to the emptiest shard, and the
tree gives every shard what it still has room for.

A quantile is found by histograms: each pass sums bytes by node and bin over the interval that
still holds the cut (of a 62-bit number, first the dimension and then the tie-break), with partial
sums before the shuffle, until the bin at the cut holds less than `tolerance` of a shard's bytes,
or one value; the next interval is what the bin's points take up, so two passes mostly do. What comes to the driver are at most MOST_BINS counts a pass. Levels with more than
`most_nodes` nodes are split by running sums instead: points are dealt once by the nodes there are
then, and all further levels sort them within their tasks. No number of shards is too large.

Slots are gapless within a shard: rows are counted by (shard, chunk of a hash), and a row's slot is
its place in its chunk after the chunks before it. Law `bytes`: shard sizes are near equal. A null
text weighs 16 bytes, has CRC 0 and is equal to an empty one; null sources and languages are a
value of their own, the last; rows that repeat get slots of their own; an empty table gives an
empty result. Columns other than doc_id, text, source and lang are not read, whatever their
names. Texts of any length are read once, by built-in functions.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize

OVERHEAD = 16
DIMENSIONS = ("size", "source", "lang")
#: A place has 27 bits of the dimension, then 15 of a hash of the text and 20 of a hash of the id, or 35 of the text.
VALUE_BITS, TEXT_BITS, ID_BITS = 27, 15, 20
TIE_BITS = TEXT_BITS + ID_BITS
MOST_BINS = 200_000
#: Groups above this part of a shard are dealt by themselves; MOST_HEAVY of them at most, the largest.
HEAVY, MOST_HEAVY = 16, 100_000
#: Parts of a shard into which rows that share text and id are cut where their text holds more than a shard.
PARTS = 64


def _top(x: Column, bits: int) -> Column:
    return F.shiftrightunsigned(x, 64 - bits)


def _ordered(name: Column, shared: int) -> Column:
    """A number of VALUE_BITS bits in the order of the names' bytes, from those after the `shared` first ones; null is the greatest."""
    part = F.rpad(F.hex(F.substring(F.encode(name, "utf-8"), shared + 1, 4)), 8, "0")
    return F.coalesce(F.shiftright(F.conv(part, 16, 10).cast("long"), 32 - VALUE_BITS), F.lit(1 << VALUE_BITS)).cast("long")


def _shared_bytes(low: str | None, high: str | None) -> int:
    a, b = (low or "").encode(), (high or "").encode()
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def bundles(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, key (a hash of the text), d_source, d_lang and n: rows that share text and id, counted. The only pass over texts."""
    names = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    ends = names.agg(*(f(c).alias(f"{c}_{w}") for c in ("source", "lang") for f, w in ((F.min, "lo"), (F.max, "hi")))).first()
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD
    text = F.coalesce(F.encode("text", "utf-8"), F.lit("").cast("binary"))
    rows = docs.select(
        "doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"),
        *(_ordered(F.col(c).cast("string"), _shared_bytes(ends[f"{c}_lo"], ends[f"{c}_hi"])).alias(f"d_{c}") for c in ("source", "lang")),
    )
    return rows.groupBy("doc_id", "size", "text_crc32", "key").agg(F.count("*").alias("n"), F.min("d_source").alias("d_source"), F.min("d_lang").alias("d_lang"))


def _table(spark, columns: str, rows: list[tuple]) -> DataFrame:
    """A table of numbers that the driver has, made by the JVM."""
    names = columns.split(", ")
    kinds = ["double" if any(isinstance(r[i], float) for r in rows) else "bigint" for i in range(len(names))]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{','.join(f'{n}:{k}' for n, k in zip(names, kinds, strict=True))}>>"))))


def _place(dim: Column) -> Column:
    value = F.lit(None).cast("long")
    for k, name in enumerate(DIMENSIONS):
        value = F.when(dim == k, F.col(f"d_{name}")).otherwise(value)
    return F.shiftleft(value, TIE_BITS) + F.col("tie")


def split(units: DataFrame, room: Sequence[float], tolerance: float = 0.002, most_nodes: int = 4_096) -> DataFrame:
    """units (weight, d_size, d_source, d_lang, tie, ...) with the column shard, 0 to len(room) - 1; room: the weight that each shard should get, in proportion."""
    spark, shards = units.sparkSession, len(room)
    before = [0.0]  # room of the shards before each
    for x in room:
        before.append(before[-1] + x)
    per_shard = before[-1] / shards
    rows = units if "shard" in units.columns else units.withColumn("shard", F.lit(0).cast("long"))
    nodes, spans, level = {0: shards}, None, 0
    ends = [f(f"d_{n}").alias(f"{n}_{w}") for n in DIMENSIONS for f, w in ((F.min, "lo"), (F.max, "hi"))]
    while any(last - node > 1 for node, last in nodes.items()) and len(nodes) <= most_nodes:
        got = {r["shard"]: r for r in rows.groupBy("shard").agg(F.sum("weight").alias("bytes"), *ends).collect()}  # a row for each node
        if not got:
            break
        spans = spans or {n: max(1, got[0][f"{n}_hi"] - got[0][f"{n}_lo"]) for n in DIMENSIONS}
        # node -> dimension, interval, bytes wanted below the cut, bytes below the interval
        open_, cuts, middle = {}, {}, {node: node + (last - node) // 2 for node, last in nodes.items()}
        for node, last in nodes.items():
            if last - node > 1 and node in got:
                r = got[node]
                dim = max(range(len(DIMENSIONS)), key=lambda d: ((r[f"{DIMENSIONS[d]}_hi"] - r[f"{DIMENSIONS[d]}_lo"]) / spans[DIMENSIONS[d]], -d))
                low, high = (r[f"{DIMENSIONS[dim]}_{w}"] for w in ("lo", "hi"))
                goal = r["bytes"] * (before[middle[node]] - before[node]) / max(before[last] - before[node], 1e-9)
                open_[node] = (dim, low << TIE_BITS, (high + 1 - low) << TIE_BITS, goal, 0)
        while open_:
            bins = max(16, min(1 << 16, MOST_BINS // len(open_)))
            asked = {n: (dim, low, -(-width // bins)) for n, (dim, low, width, _, _) in open_.items()}
            at = rows.join(_table(spark, "node, dim, low, step", [(n, *x) for n, x in asked.items()]), F.col("shard") == F.col("node"))
            at = at.withColumn("offset", _place(F.col("dim")) - F.col("low")).where((F.col("offset") >= 0) & (F.col("offset") < F.col("step") * bins))
            counted: dict[int, list] = {n: [] for n in open_}
            for r in at.groupBy("node", F.expr("offset div step").alias("bin")).agg(F.sum("weight").alias("bytes"), F.min("offset").alias("lo"), F.max("offset").alias("hi")).collect():
                counted[r["node"]].append((r["bin"], r["bytes"], r["lo"], r["hi"]))
            still = {}
            for n, (dim, low, _, goal, below) in open_.items():
                step, inside = asked[n][2], below
                for _, x, first, last in sorted(counted[n]):
                    if inside + x >= goal:
                        break
                    inside += x
                if x > tolerance * per_shard and first < last:
                    still[n] = (dim, low + first, last + 1 - first, goal, inside)
                else:  # the nearer edge of the bin
                    cuts[n] = (dim, low + (last + 1 if inside + x - goal < goal - inside else first))
            open_ = still
        if cuts:
            to = _table(spark, "node, dim, cut, right", [(n, *x, middle[n]) for n, x in cuts.items()])
            rows = rows.join(to, F.col("shard") == F.col("node"), "left")
            rows = rows.withColumn("shard", F.when(_place(F.col("dim")) >= F.col("cut"), F.col("right")).otherwise(F.col("shard")).cast("long")).drop("node", "dim", "cut", "right")
        nodes = {a: b for n, last in nodes.items() for a, b in ([(n, middle[n]), (middle[n], last)] if last - n > 1 else [(n, last)])}
        level += 1
        if level % 3 == 0:
            rows = materialize(rows, "shard-level")
    if any(last - node > 1 for node, last in nodes.items()):
        rows = _by_running_sums(rows, nodes, before, spans)
    return rows.withColumn("shard", F.col("shard").cast("int"))


def _by_running_sums(rows: DataFrame, nodes: dict[int, int], before: list[float], spans: dict[str, int] | None) -> DataFrame:
    """The levels below nodes (first shard -> last), all of whose points meet in a task."""
    spark = rows.sparkSession
    if spans is None:
        r = rows.agg(*(f(f"d_{n}").alias(f"{n}_{w}") for n in DIMENSIONS for f, w in ((F.min, "lo"), (F.max, "hi")))).first()
        spans = {n: max(1, (r[f"{n}_hi"] or 0) - (r[f"{n}_lo"] or 0)) for n in DIMENSIONS}
    columns = [c for c in rows.columns if c != "shard"]
    rows = rows.join(_table(spark, "node, last", list(nodes.items())), F.col("shard") == F.col("node"))
    room = _table(spark, "i, before", list(enumerate(before)))  # a row for each shard
    room = {w: room.select(F.col("i").alias(f"i_{w}"), F.col("before").alias(f"at_{w}")) for w in ("node", "middle", "last")}
    most = max(last - node for node, last in nodes.items())
    # node stays what the points are dealt by, shard and last go down the levels
    while most > 1:
        rows = rows.withColumn("middle", (F.col("shard") + F.floor((F.col("last") - F.col("shard")) / 2)).cast("long"))
        for w, c in (("node", "shard"), ("middle", "middle"), ("last", "last")):
            rows = rows.join(F.broadcast(room[w]), F.col(c) == F.col(f"i_{w}"))
        own = Window.partitionBy("node", "shard")
        widths = [((F.max(f"d_{n}").over(own) - F.min(f"d_{n}").over(own)) / spans[n]).alias(n) for n in DIMENSIONS]
        rows = rows.select("*", F.array(*widths).alias("widths"), F.sum("weight").over(own).alias("bytes"))
        rows = rows.withColumn("place", _place((F.array_position("widths", F.array_max("widths")) - 1).cast("int")))
        run = F.sum("weight").over(own.orderBy("place", *[c for c in ("key", "doc_id", "part") if c in columns]).rowsBetween(Window.unboundedPreceding, 0))
        goal = F.col("bytes") * (F.col("at_middle") - F.col("at_node")) / F.greatest(F.col("at_last") - F.col("at_node"), F.lit(1e-9))
        # the nearer edge: left if its middle lies below the goal
        right = (F.col("last") - F.col("shard") > 1) & (run - F.col("weight") / 2 >= goal)
        rows = rows.withColumn("right", right)
        shard = F.when(F.col("right"), F.col("middle")).otherwise(F.col("shard"))
        last = F.when(F.col("right") | (F.col("last") - F.col("shard") <= 1), F.col("last")).otherwise(F.col("middle"))
        rows = rows.select(*columns, "node", shard.alias("shard"), last.alias("last"))
        most -= most // 2
    return rows.select(*columns, "shard")


def _dealt_first(heavy: list[tuple[int, int]], shards: int, per_shard: float) -> tuple[dict[int, int], list[float]]:
    """A shard for each heavy group (key, bytes), and the room that every shard has left."""
    import heapq

    emptiest = [(0, s) for s in range(shards)]
    to = {}
    for key, size in sorted(heavy, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(emptiest)
        to[key] = s
        heapq.heappush(emptiest, (load + size, s))
    room = [0.0] * shards
    for load, s in emptiest:
        room[s] = max(0.0, per_shard - load)
    return to, room if any(room) else [1.0] * shards


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, chunk_rows: int = 20_000, **options) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for each row of docs; the number of shards, or the bytes each should hold. Options are those of split."""
    rows = materialize(bundles(docs), "shard-rows")
    sums = [F.sum(F.col("n") * F.col("size")).alias("weight"), F.min("size").alias("d_size"), F.min("d_source").alias("d_source"), F.min("d_lang").alias("d_lang")]
    groups = materialize(rows.groupBy("key").agg(*sums), "shard-groups")
    total = groups.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("bytes")).first()["bytes"]
    n_rows = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if shards is None:
        shards = max(1, -(-total // (target_bytes or 1 << 30)))
    if shards < 1:
        raise ValueError("one shard at least")
    per_shard = total / shards
    # at most 1 + shards groups are larger than a shard, and MOST_HEAVY groups heavy
    least = max(per_shard / HEAVY, total / MOST_HEAVY)
    known = {r["key"]: r["weight"] for r in groups.where(F.col("weight") > least).select("key", "weight").collect()} if shards > 1 else {}
    to, room = _dealt_first([x for x in known.items() if x[1] <= per_shard], shards, per_shard or 1.0)
    large = [(k,) for k, x in known.items() if x > per_shard]
    bits = lambda x: F.least(x, F.lit((1 << VALUE_BITS) - 1))
    dims = [bits(F.col("d_size")).alias("d_size"), "d_source", "d_lang"]
    light = groups if not known else groups.where(F.col("weight") <= least)
    units = light.select("key", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(0).cast("long").alias("part"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("text_crc32"), "weight", *dims, _top(F.xxhash64("key"), TIE_BITS).alias("tie"))
    if large:
        own = groups.where(F.col("weight") > per_shard).select(F.col("key").alias("k"), F.col("d_size"), F.col("d_source").alias("s"), F.col("d_lang").alias("l"))
        cut = rows.join(F.broadcast(own), F.col("key") == F.col("k"))  # at most 1 + shards rows
        parts = F.greatest(F.lit(1), F.least(F.col("n"), F.ceil(F.col("n") * F.col("size") * PARTS / F.lit(per_shard)))).cast("long")
        cut = cut.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        cut = cut.withColumn("n", F.expr("n div parts") + (F.col("part") < F.col("n") % F.col("parts")).cast("long"))
        tie = F.shiftleft(_top(F.xxhash64("key"), TEXT_BITS), ID_BITS) + _top(F.xxhash64("doc_id", "part"), ID_BITS)
        units = units.unionByName(cut.select("key", "doc_id", "part", "n", "size", "text_crc32", (F.col("n") * F.col("size")).alias("weight"), bits(F.col("d_size")).alias("d_size"), F.col("s").alias("d_source"), F.col("l").alias("d_lang"), tie.alias("tie")))
    units = materialize(split(materialize(units.withColumn("shard", F.lit(0).cast("long")), "shard-units"), room, **options), "shard-placed")
    columns = ["doc_id", "size", "text_crc32", "n", "shard"]
    whole = units.where("n is null").select(F.col("key").alias("k"), "shard")
    placed = rows.join(whole, F.col("key") == F.col("k")).select(*columns)
    if to:
        placed = placed.unionByName(rows.join(_table(docs.sparkSession, "k, shard", list(to.items())), F.col("key") == F.col("k")).select(*columns[:-1], F.col("shard").cast("int").alias("shard")))
    if large:
        placed = placed.unionByName(units.where("n is not null").select(*columns))
    return _slots(placed, max(16, n_rows // (shards * chunk_rows)))


def _slots(placed: DataFrame, chunks: int) -> DataFrame:
    """The result from rows (doc_id, size, text_crc32, n, shard), each standing for n rows."""
    placed = materialize(placed.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(chunks))), "shard-slots")
    counts = placed.groupBy("shard", "chunk").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("shard").alias("of"), F.col("chunk").alias("c"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.withColumn("first", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, (F.col("shard") == F.col("of")) & (F.col("chunk") == F.col("c")))
    return first.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("first") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
