"""Mixing sources to target weights, with DataFrame functions only.

Each document has a hash-random key: the MD5 of its id and a seed. The leading digits of the key
are a range of the random order within its source, so sums of sizes over (source, range) give,
after a prefix sum over the ranges, the one range in which the source's budget ends; only the
rows of that range are sorted and summed one by one. A source whose budget is above its size is
taken whole as often as it fits (epochs); the rest is cut in the random order. The cut is exact:
the document at it counts with the words that are still wanted.

A source may hold any share of the rows: it is spread over its ranges, and sums are combined
before they are shuffled. A null text has size 0 and takes nothing; null sources form one
source, the last; rows with a null id have a key of their text's digest instead of the id. Rows
that share a key are told apart by size, and rows that repeat are taken one after the other. An
empty table gives an empty result; columns other than doc_id, text and source pass through
mixed_documents, whatever their names, and aren't read by mix. Texts of any length are counted by
built-in functions. The table of sources has a row for each, and is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize

#: Runs of other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of the table of sources up to which it is broadcast; a larger one is joined.
MOST_BROADCAST = 16 << 20


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, text: Column, seed: str) -> Column:
    own = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))
    return F.md5(F.concat(own, F.lit(f":{seed}")).cast("binary"))


def targets(sizes: DataFrame, weights: Sequence[int], factor: float, most: float) -> DataFrame:
    """One row for each source (columns mix_source, source_size, ...): adds weight and target.

    Weights repeat over the sources in order of their code points, null last. The targets share
    factor x all sizes by weight, and stop at most x their source's size; the excess goes to the
    others by weight. Sources stop in order of size / weight, so one prefix sum finds them.
    """
    one = Window.orderBy(F.col("mix_source").asc_nulls_last())
    place = (F.row_number().over(one) - 1) % len(weights) + 1
    ranked = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(w) for w in weights)), place))
    # the exact product of integers orders the ratios; ties in the ratio stop together
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("mix_source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = (
        ranked.withColumn("__total", F.sum("source_size").over(everything))
        .withColumn("__left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("__stopped", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("__level", (F.col("__total") * F.lit(float(factor)) - F.col("__stopped") * F.lit(float(most))) / F.col("__left"))
        .withColumn("__above", F.col("__level") * F.col("weight") > F.col("source_size") * F.lit(float(most)))
    )
    # the first source that doesn't stop sets the level of all from there on
    level = F.min_by(F.when(~F.col("__above"), F.col("__level")), F.when(~F.col("__above"), F.struct(F.col("source_size") / F.col("weight"), F.col("mix_source").isNull(), F.coalesce("mix_source", F.lit("")))))
    return ranked.withColumn("__at", level.over(everything)).select(
        "mix_source", "source_size", "weight", "n_rows",
        F.when(F.col("__above") | F.col("__at").isNull(), F.col("source_size") * F.lit(float(most))).otherwise(F.col("__at") * F.col("weight")).alias("target"),
    )


def keyed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """docs with __source, __size (words) and __key (its place in the random order of its source)."""
    return docs.withColumns({"__source": F.col("source").cast("string"), "__size": words(F.col("text")), "__key": random_key(F.col("doc_id"), F.col("text"), seed)})


def plan_mix(rows: DataFrame, weights: Sequence[int], factor: float, most: float, range_rows: int) -> tuple[DataFrame, int]:
    """One row for each source: its target, its whole epochs, and the range of keys and the words within it at which the rest ends; and the number of leading digits that make a range."""
    n_rows = rows.count()
    digits = 1
    while digits < 6 and 16**digits * range_rows < n_rows:
        digits += 1
    ranges = materialize(rows.groupBy(F.col("__source").alias("mix_source"), F.substring("__key", 1, digits).alias("range")).agg(F.sum("__size").alias("range_size"), F.count("*").alias("range_n")), "mix-ranges")
    aims = targets(ranges.groupBy("mix_source").agg(F.sum("range_size").alias("source_size"), F.sum("range_n").alias("n_rows")), weights, factor, most)
    aims = aims.withColumn("budget", F.round("target").cast("long"))
    aims = aims.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long"))
    aims = aims.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    # prefix sums over the ranges of each source, at most 16 ** digits of them
    summed = ranges.select(F.col("mix_source").alias("of"), "range", "range_size", F.sum("range_size").over(Window.partitionBy("mix_source").orderBy("range")).alias("end"))
    cut = summed.join(aims, F.col("of").eqNullSafe(F.col("mix_source"))).where((F.col("end") > F.col("rest")) & (F.col("end") - F.col("range_size") <= F.col("rest")))
    cut = cut.groupBy("of").agg(F.min(F.struct("range", (F.col("rest") - F.col("end") + F.col("range_size")).alias("within"))).alias("cut"))
    plan = aims.join(cut, F.col("of").eqNullSafe(F.col("mix_source")), "left").select(
        F.col("mix_source").alias("__plan_source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("epochs").alias("__epochs"),
        F.col("rest").alias("__rest"), F.col("cut.range").alias("__cut"), F.coalesce("cut.within", F.lit(0)).alias("__within"),
    )
    return materialize(plan, "mix-plan"), digits


def take(rows: DataFrame, plan: DataFrame, digits: int) -> DataFrame:
    """rows (of keyed) with __source_size, __target and __taken, the words that the mix takes of each. Only rows in the range at a cut are shuffled."""
    size = plan.agg(F.sum(F.coalesce(F.octet_length("__plan_source"), F.lit(0)) + 96)).first()[0] or 0
    rows = rows.join(F.broadcast(plan) if size <= MOST_BROADCAST else plan, F.col("__source").eqNullSafe(F.col("__plan_source")))
    rows = rows.withColumn("__range", F.substring("__key", 1, digits))
    at_cut = F.coalesce((F.col("__rest") > 0) & (F.col("__range") == F.col("__cut")), F.lit(False))
    whole = F.when(F.coalesce((F.col("__rest") > 0) & (F.col("__range") < F.col("__cut")), F.lit(False)), F.col("__size")).otherwise(0)
    before = F.coalesce(F.sum("__size").over(Window.partitionBy("__source").orderBy("__key", "__size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(F.lit(0), F.least(F.col("__size"), F.col("__within") - before))
    epochs = F.col("__epochs") * F.col("__size")
    drop = ("__plan_source", "__epochs", "__rest", "__cut", "__within", "__range")
    return rows.where(~at_cut).withColumn("__taken", (epochs + whole).cast("long")).drop(*drop).unionByName(rows.where(at_cut).withColumn("__taken", (epochs + left).cast("long")).drop(*drop))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), factor: float = 1.5, most: float = 2.0, seed: str = "mix", range_rows: int = 512) -> DataFrame:
    """doc_id, mix_source, size, source_size, target and taken (words, repeats counted) for each row of docs; `range_rows` is about the number of rows of a range."""
    rows = materialize(keyed(docs.select("doc_id", "source", "text"), seed).select("doc_id", "__source", "__size", "__key"), "mix-rows")
    taken = take(rows, *plan_mix(rows, weights, factor, most, range_rows))
    return taken.select("doc_id", F.col("__source").alias("mix_source"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), factor: float = 1.5, most: float = 2.0, seed: str = "mix", range_rows: int = 512) -> DataFrame:
    """The rows of docs, all columns, as often as the mix takes them: texts stay whole, and the one at a cut stays if half of it or more is wanted."""
    light = materialize(keyed(docs.select("doc_id", "source", "text"), seed).select("__source", "__size", "__key"), "mix-rows")
    taken = take(keyed(docs, seed), *plan_mix(light, weights, factor, most, range_rows))
    copies = F.when(F.col("__size") > 0, F.round(F.col("__taken") / F.greatest("__size", F.lit(1)))).otherwise(0).cast("int")
    return taken.where(copies > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)
