"""What the operators of this subpackage share: scratch tables and reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.storage import materialize, scratch_dir

__all__ = ["BATCH_BYTES", "FILTER_WORDS", "filter_words", "held_out", "in_few", "map_batches", "materialize", "perhaps", "scratch_dir", "table", "with_sums"]

BATCH_BYTES = 2 << 20


def map_batches(df: DataFrame, run, schema: str | StructType) -> DataFrame:
    """mapInArrow with batches of about BATCH_BYTES at most (a larger row comes alone), so that memory doesn't follow the length of texts. Sets that limit of the session if it is higher."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    limit = df.sparkSession.conf.get(name).removesuffix("b")
    if not limit.isdigit() or not 0 < int(limit) <= BATCH_BYTES:
        df.sparkSession.conf.set(name, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def in_few(rows: DataFrame, n: int) -> DataFrame:
    """rows, of at most n, in no more partitions than they need, so that small tables aren't written as hundreds of files."""
    return rows.coalesce(max(8, n // 50_000))


#: Rows of a table of sums (a key and a few numbers each) up to which it is broadcast whole.
MOST_SUMS = 1 << 16


def with_sums(rows: DataFrame, key: str, sums: dict, n: int | None = None, where: str | None = None) -> DataFrame:
    """rows (n of them) with aggregates over the rows of equal key, null keys left out; where: a condition on `__rows`, their number, and the aggregates.

    While they are few, sums are broadcast. Else they are written, and the keys of more than a part
    of 1 / 10,000 of the rows, which can't be more than 10,000, get theirs by a broadcast, so that
    no task meets all rows of a hot key; the others are joined by the key.
    """
    n = rows.count() if n is None else n
    summed = rows.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__rows"), *(x.alias(name) for name, x in sums.items()))
    summed = summed if where is None else summed.where(where)
    if n > MOST_SUMS:
        summed = materialize(in_few(summed, n), "sums")
    if n <= MOST_SUMS or summed.count() <= MOST_SUMS:
        return rows.join(F.broadcast(summed), F.col(key) == F.col("__key")).drop("__key", "__rows")
    most = max(64, n // 10_000)
    heavy, few = summed.where(F.col("__rows") > most), summed.where(F.col("__rows") <= most)
    one = rows.join(F.broadcast(heavy), F.col(key) == F.col("__key"))
    rest = rows.join(F.broadcast(heavy.select("__key")), F.col(key) == F.col("__key"), "left_anti").join(few, F.col(key) == F.col("__key"))
    return one.unionByName(rest).drop("__key", "__rows")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id):
    """The rows that no model may learn from: crc32 of the id as text leaves 2 modulo 4. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


FILTER_WORDS = 1 << 20


def filter_words(rows: DataFrame, column: str) -> DataFrame:
    """A Bloom filter of a column of ids as a table of at most FILTER_WORDS words of 64 bits, whatever the number of ids."""
    h = F.xxhash64(F.col(column).cast("long"))
    words = rows.select(F.pmod(h, F.lit(FILTER_WORDS)).alias("__word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(cast({column} as long)), 32) & 63 as int))").alias("__bit"))
    return materialize(words.groupBy("__word").agg(F.bit_or("__bit").alias("__bits")), "filter")


def perhaps(rows: DataFrame, column: str, words: DataFrame, inside: bool) -> DataFrame:
    """The rows whose id may be in the filter (inside), or surely isn't. A null id isn't."""
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(cast({column} as long)), 32) & 63 as int))")
    same = (F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(FILTER_WORDS)) == F.col("__word")) & (F.col("__bits").bitwiseAND(bit) != 0) & F.col(column).isNotNull()
    return rows.join(F.broadcast(words), same, "left_semi" if inside else "left_anti")

