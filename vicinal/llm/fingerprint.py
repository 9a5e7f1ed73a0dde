"""One-permutation MinHash fingerprints of documents, and of their edited texts.

The hashes of five-word shingles fall into `BINS` bins by their leading bits, once; each bin keeps
its least hash. A bin without shingles takes the value of the first filled bin in a random order
of its own, the same for all texts (optimal densification). The low `BITS` bits of the values are
packed. Two fingerprints agree in a bin with chance J + (1 - J) / 2 ** BITS, which the likeness
corrects for. Texts of one to four words have one shingle; a text without a word (or null, which
counts as empty) has the fingerprint of zeros, like other such texts (1.0) and unlike others.

The next document is the one with the next smaller id; after the least comes the greatest, null
ids come last, and rows that share an id follow each other by a hash of the text, then the text.
Rows are dealt by ranges of ids, each range sorted, so that the next document follows in the
stream; ids that hold several ranges' rows, and null ids, are cut by the hash. The first row of
each range also goes to the end of the one before it. Texts are shuffled once. Rows that repeat an
id and a text stay in one range and get results of their own; an empty table gives an empty
result; columns other than doc_id and text are not read, whatever their names. Words of long texts
are hashed in pieces (see arrays), and a task holds about `block_chars` characters, or one text and
the next one.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U, mix, shingle_hashes, utf8, word_hashes
from .shared import map_batches

BINS, BITS = 512, 4
_NONE = U(0xFFFFFFFFFFFFFFFF)


@functools.cache
def _orders() -> tuple[np.ndarray, np.ndarray]:
    """Each bin's random order of bins, and each bin's place in it."""
    with np.errstate(over="ignore"):
        keys = mix((np.arange(BINS, dtype=U)[:, None] * U(BINS) + np.arange(BINS, dtype=U)[None, :]) * U(0x9E3779B97F4A7C15))
    order = np.argsort(keys, axis=1)
    return order, np.argsort(order, axis=1)


def sketch(texts: list[str], k: int = 5) -> np.ndarray:
    """The values (0 to 2 ** BITS - 1) of each text's bins."""
    data, at = utf8(pa.array(texts, pa.large_string()))
    shingles, counts = shingle_hashes(*word_hashes(data[at[0] : at[-1]], at - at[0], lower=False), k)
    n = len(texts)
    bins = np.full(n * BINS, _NONE, U)
    of = np.repeat(np.arange(n), counts)
    np.minimum.at(bins, of * BINS + (shingles >> U(64 - 9)).astype(np.int64), shingles & U((1 << 55) - 1))
    bins = bins.reshape(n, BINS)
    filled = bins != _NONE
    order, place = _orders()
    total = filled.sum(1)
    for r in np.flatnonzero((total > 0) & (total <= 48)):
        has = np.flatnonzero(filled[r])
        bins[r] = np.where(filled[r], bins[r], bins[r, has[place[:, has].argmin(1)]])
    rows, cols = np.nonzero(~filled & (total > 48)[:, None])
    step = 0
    while len(rows):
        source = order[cols, step]
        hit = filled[rows, source]
        bins[rows[hit], cols[hit]] = bins[rows[hit], source[hit]]
        rows, cols, step = rows[~hit], cols[~hit], step + 1
    # the bin's number goes into the bits, so that copies of one value don't agree or differ all at once
    values = (mix(bins + np.arange(BINS, dtype=U)[None, :] * U(0x9E3779B97F4A7C15)) & U((1 << BITS) - 1)).astype(np.uint8)
    values[total == 0] = 0
    return values


def pack(values: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in (values[:, 0::2] << BITS) | values[:, 1::2]]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimated share of common shingles, from the bins' values."""
    chance = 1 / (1 << BITS)
    same = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)
    empty_a, empty_b = ~a.any(1), ~b.any(1)
    return np.where(empty_a | empty_b, (empty_a & empty_b).astype(float), same)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class _Ranges:
    """Ranges in the order of documents, from quantiles of the ids (those that repeat are of hot ids) and the number of ranges for null ids."""

    def __init__(self, quantiles: list[int], null_parts: int):
        self.cuts, often = np.unique(np.array(quantiles, np.int64), return_counts=True)
        #: the groups, from the greatest ids on, are [cut, next cut); the least id of each may be cut by its hash
        parts = np.append(often[::-1], 1) if len(often) else np.ones(1, np.int64)
        self.parts = np.append(parts, max(1, null_parts))
        self.offsets = np.cumsum(self.parts) - self.parts

    def __call__(self, ids: pa.Array, h: np.ndarray) -> np.ndarray:
        none = ids.is_null().to_numpy(zero_copy_only=False)
        x = ids.fill_null(0).to_numpy(zero_copy_only=False)
        place = np.searchsorted(self.cuts, x, "right")
        group = np.where(none, len(self.cuts) + 1, len(self.cuts) - place)
        least = np.append(self.cuts, [0])[place - 1] if len(self.cuts) else np.zeros(len(x), np.int64)
        hot = none | ((place > 0) & (x == least))
        part = ((h.astype(U) ^ U(1 << 63)) >> U(32)) * self.parts[group].astype(U) >> U(32)
        return self.offsets[group] + np.where(hot, part.astype(np.int64), 0)


def fingerprints(docs: DataFrame, range_rows: int = 2_000, block_chars: int = 1 << 20) -> DataFrame:
    """One row for each row of docs (doc_id, text): SCHEMA."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    counted = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    total = counted["n"]
    if not total:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    n_ranges = max(1, min(100_000, total // range_rows))
    probs = [i / n_ranges for i in range(1, n_ranges)]
    ranges = _Ranges([int(x) for x in docs.approxQuantile("doc_id", probs, 0.2 / n_ranges)] if probs and counted["known"] else [], (total - counted["known"]) // max(1, total // n_ranges))

    def ordered(r: np.ndarray, ids: pa.Array, h: np.ndarray) -> np.ndarray:
        """Rows by range, then the greater id, then the lesser hash."""
        return np.lexsort((h, ~ids.fill_null(0).to_numpy(zero_copy_only=False), r))  # ~x falls as x rises, without overflow

    def heads(batches):
        held: tuple | None = None
        for batch in batches:
            h = batch.column(1).to_numpy()
            r, ids = ranges(batch.column(0), h), batch.column(0)
            if held is not None:
                r, h, ids = np.append(held[0], r), np.append(held[2], h), pa.concat_arrays([held[1], ids])
            order = ordered(r, ids, h)
            first = order[np.flatnonzero(np.diff(r[order], prepend=-1))]
            held = r[first], ids.take(pa.array(first)), h[first]
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int32()), held[1], pa.array(held[2])], ["r", "head", "h"])

    # one row for each range: the greatest id, and of its rows the least hash
    best = F.max(F.struct(F.coalesce("head", F.lit(0)).alias("id"), (-1 - F.col("h")).alias("h")))
    found = docs.select("doc_id", "h").mapInArrow(heads, "r int, head long, h long").groupBy("r").agg(best.alias("best")).select("r", "best.id", (-1 - F.col("best.h")).alias("h")).collect()
    filled = sorted(x["r"] for x in found)
    most = int(ranges.parts.sum())
    head_id, head_h = np.zeros(most, np.int64), np.zeros(most, np.int64)
    for x in found:
        head_id[x["r"]], head_h[x["r"]] = x["id"], x["h"]
    #: the range at whose end a range's first row is wanted too
    wanted = np.zeros(most, np.int64)
    wanted[filled] = [filled[i - 1] for i in range(len(filled))]

    def deal(batches):
        for batch in batches:
            h = batch.column(1).to_numpy()
            own, ids = ranges(batch.column(0), h), batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(np.zeros(len(own), bool)), *batch.columns], ["r", "again", "doc_id", "h", "text"])
            again = np.flatnonzero((ids == head_id[own]) & (h == head_h[own]))
            if len(again):
                yield pa.RecordBatch.from_arrays([pa.array(wanted[own[again]], pa.int32()), pa.array(np.ones(len(again), bool)), *(c.take(pa.array(again)) for c in batch.columns)], ["r", "again", "doc_id", "h", "text"])

    def finish(rows: list[tuple]) -> pa.RecordBatch:
        """All rows but the last one, and of each range's repeated rows only the first is a next one."""
        texts = [r[3] for r in rows]
        own = [i for i in range(len(rows) - 1) if not rows[i][1]]
        edited = []
        for i in own:
            n = len(texts[i])
            edited.append(texts[i][: n - n // 2] + texts[i + 1][: n // 2])
        values, changed = sketch(texts), sketch(edited)
        mine = values[own]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in own], pa.int64()), pa.array([len(texts[i]) for i in own], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                pa.array(pack(mine), pa.string()), pa.array(pack(changed), pa.string()), pa.array(likeness(mine, changed)), pa.array(likeness(mine, values[[i + 1 for i in own]])),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches):
        held: list[tuple] = []
        chars = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if row[1] and held and held[-1][1] and held[-1][0] == row[0]:
                    continue  # a further row that shares the id of the next range's first
                held.append(row)
                chars += len(row[3])
                if chars >= block_chars:
                    yield finish(held)
                    held, chars = held[-1:], len(row[3])
        if len(held) > 1:
            yield finish(held)

    dealt = map_batches(docs, deal, "r int, again boolean, doc_id long, h long, text string")
    return map_batches(dealt.repartition("r").sortWithinPartitions("r", "again", F.desc_nulls_last("doc_id"), "h", "text"), run, SCHEMA)
