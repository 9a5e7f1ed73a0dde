"""Near-duplicate classes by Order MinHash, verified by banded alignment.

1. Texts that are equal form one exact group; its least id stands for it.
2. Words are runs of other than ASCII white space, ASCII letters in lower case. A k-mer is a run
   of five words (a shorter text is one k-mer), labelled with how often it has occurred before in
   the text. For each of 40 hash functions the two labelled k-mers with the least hashes are
   taken, in text order: equal entries of two sketches hint at a small edit distance, not only at
   common content. Two entries make a band, 20 bands a text; texts of similarity 0.8 share no
   band with chance 3e-5.
3. Texts that share a band and have at least `least_equal` of 40 entries equal are candidates
   (chance 5e-5 to miss similarity 0.8). Within a band every text of a connected group of candidates
   is paired with the group's least id only. Bands are split into blocks of at most `band_rows` texts;
   some texts of every connected group of a block meet those of the others in a next round, until
   one block holds them; if their number doesn't fall, all pairs of blocks are compared. Of split
   bands, all texts outside the largest component so far are then compared with all texts.
4. Connected components of the candidates are clusters, which hold every link. A cluster's texts
   come together in blocks of bounded rows and bytes. Of a cluster of more than one block, a few
   texts of every linked group of a block meet those of the others in a next round, and so on;
   then all texts outside the cluster's largest group so far are compared with all its texts.
   Within a block the common labelled k-mers of all texts are
   counted exactly by an index of k-mers; where they suffice for similarity 0.8 and the texts
   aren't linked yet by way of others, a banded alignment decides: L, the longest common
   subsequence of both k-mer sequences within the band of offsets that the similarity allows, over
   all k-mers of both less L, is at least 0.8. That is the Jaccard index of the k-mers for texts
   whose parts keep their order. No band or cluster is capped, and no pairs are listed. What is
   linked already by way of others isn't aligned again, so the links found connect each class but
   aren't all that there are.
5. Connected components of the links, by repeated least-neighbour steps, are the classes.

Null texts belong to no group: each is its own class. Texts without a word are near only to equal
texts. Rows with a null id keep a null class. Classes are of texts: an id that occurs with several
texts has the class of each. Rows that repeat have equal results; an empty table gives an empty
result; columns other than doc_id and text are not read by classes and pass through
without_near_copies, whatever their names. Long texts are hashed in pieces (see arrays), and
aligned in time that follows their k-mers, but for texts that repeat the same k-mers over and over.
Hot groups are counted with partial sums, and what is known of a hot key reaches its rows by a
broadcast of at most 10,000 rows (with_sums); every round is written to the shared folder.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U, blocks, mix, shingle_hashes, word_hashes
from .shared import MOST_SUMS, filter_words, in_few, map_batches, materialize, perhaps, with_sums

ENTRIES, BAND, KMER_WORDS = 40, 2, 5
_SEEDS = mix(np.arange(1, ENTRIES + 1, dtype=U) * U(0xD1342543DE82EF95)) | U(1)
_MOST = U(0xFFFFFFFFFFFFFFFF)


def labelled(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The k-mers' hashes, each with the number of equal ones before it in its text."""
    if not len(shingles):
        return shingles
    text = np.repeat(np.arange(len(counts), dtype=U), counts)
    key = shingles ^ mix(text + U(1))
    order = np.argsort(key, kind="stable")
    run = key[order]
    fresh = np.ones(len(run), bool)
    fresh[1:] = run[1:] != run[:-1]
    starts = np.flatnonzero(fresh)
    seen = np.arange(len(run)) - np.repeat(starts, np.diff(np.append(starts, len(run))))
    times = np.empty(len(run), U)
    times[order] = seen.astype(U)
    return mix(shingles + times * U(0x9E3779B97F4A7C15))


def sketches(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """ENTRIES order-min-hashes of each text (every text has a k-mer): the two least labelled k-mers in text order."""
    names = labelled(shingles, counts)
    starts = np.cumsum(counts) - counts
    out = np.empty((len(counts), ENTRIES), U)
    pair = counts > 1
    for k in range(ENTRIES):
        v = names * _SEEDS[k]
        v ^= v >> U(29)
        first = np.minimum.reduceat(v, starts)
        at = np.flatnonzero(v == np.repeat(first, counts))
        at = at[np.unique(np.searchsorted(starts, at, "right"), return_index=True)[1]]
        v[at] = _MOST
        second = np.minimum.reduceat(v, starts)
        then = np.flatnonzero(v == np.repeat(second, counts))
        then = then[np.unique(np.searchsorted(starts, then, "right"), return_index=True)[1]]
        a, b = names[np.minimum(at, then)], names[np.maximum(at, then)]
        out[:, k] = mix(np.where(pair, a * U(3) + mix(b), names[at]))
    return out


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (null texts have one of their own), bytes, keys of the bands and sketch (16 bits of each entry; both null without a word) of each row of docs (doc_id, text). The one pass over all texts."""

    def run(batches):
        for batch in batches:
            ids, text = batch.column("doc_id"), batch.column("text")
            names = [hashlib.md5(x.as_buffer()).hexdigest() if x.is_valid else f"null:{i}" for x, i in zip(text, ids.to_pylist(), strict=True)]
            for i, j, data, at in blocks(text):
                shingles, counts = shingle_hashes(*word_hashes(data, at), KMER_WORDS)
                rows = np.flatnonzero(counts)
                n, n_bands = j - i, ENTRIES // BAND
                keys, small = np.zeros((n, n_bands), U), np.zeros((n, ENTRIES), "<u2")
                if len(rows):
                    made = sketches(shingles, counts[rows])
                    key = made[:, 0::BAND]
                    for k in range(1, BAND):
                        key = mix(key * U(5) + made[:, k::BAND])
                    keys[rows], small[rows] = mix(key + np.arange(n_bands, dtype=U)[None, :]), (made >> U(48)).astype("<u2")
                none = counts == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, n), pa.array(names[i:j], pa.string()), pa.array(np.diff(at)),
                        pa.array([None if x else y for x, y in zip(none, keys.view(np.int64), strict=True)], pa.list_(pa.int64())),
                        pa.array([None if x else y.tobytes() for x, y in zip(none, small, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "text_key", "bytes", "keys", "sketch"],
                )

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, text_key string, bytes long, keys array<long>, sketch binary")


def _connected(sk: np.ndarray, least: int) -> np.ndarray:
    """The connected group of each text, where texts with `least` equal entries are neighbours."""
    free, group = np.arange(1, len(sk)), np.zeros(len(sk), np.int64)
    todo, name = [0], 0
    while todo or len(free):
        if not todo:
            name += 1
            todo, free = [int(free[0])], free[1:]
            group[todo[0]] = name
        near = (sk[free] == sk[todo.pop()]).sum(1) >= least
        found = free[near]
        if len(found):
            group[found] = name
            todo += found.tolist()
            free = free[~near]
    return group


def _stars(ids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id of each group, next to every other id of it."""
    order = np.lexsort((ids, group))
    first = np.diff(group[order], prepend=-1) != 0
    hub = ids[order][np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))]
    return hub[~first], ids[order][~first]


def _blocks(rows: DataFrame, least: int, sent: int = 8) -> DataFrame:
    """Of rows (key, block, id, sketch): candidates as (a, b) and, of blocks numbered from 0, `sent` texts of each connected group as (key, a), told apart by `leads`."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def groups(table: pa.Table, last: bool):
            key, block = (table.column(c).to_numpy() for c in ("key", "block"))
            edge = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0)) + 1
            ends = np.concatenate([edge, [len(key)]])
            if not last:
                ends = ends[:-1]
            done = int(ends[-1]) if len(ends) else 0
            if done:
                ids = table.column("id").to_numpy()[:done]
                sk = np.frombuffer(b"".join(table.column("sketch").slice(0, done).to_pylist()), "<u2").reshape(done, ENTRIES)
                pa_, pb_, lk, li = [], [], [], []
                for s, e in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
                    if e - s == 2 and block[s] < 0:  # the usual case: two texts
                        if (sk[s] == sk[s + 1]).sum() >= least:
                            pa_.append(ids[s : s + 1])
                            pb_.append(ids[s + 1 : e])
                        continue
                    group = _connected(sk[s:e], least)
                    a, b = _stars(ids[s:e], group)
                    pa_.append(a)
                    pb_.append(b)
                    if block[s] >= 0:
                        order = np.argsort(group, kind="stable")
                        starts = np.flatnonzero(np.diff(group[order], prepend=-1))
                        place = np.arange(e - s) - np.repeat(starts, np.diff(np.append(starts, e - s)))
                        leaders = order[place < sent]
                        lk.append(np.full(len(leaders), key[s]))
                        li.append(s + leaders)
                if pa_:
                    x, y = np.concatenate(pa_), np.concatenate(pb_)
                    x, y = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
                    keep = x != y
                    x, y = x[keep], y[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(x), bool)), pa.nulls(len(x), pa.int64()), pa.array(x), pa.array(y)], ["leads", "key", "a", "b"])
                if lk:
                    at = np.concatenate(li)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), bool)), pa.array(np.concatenate(lk)), pa.array(ids[at]), pa.nulls(len(at), pa.int64())], ["leads", "key", "a", "b"])
            held[:] = table.slice(done).combine_chunks().to_batches()

        for batch in batches:
            held.append(batch)
            yield from groups(pa.Table.from_batches(held), False)
        if held:
            yield from groups(pa.Table.from_batches(held), True)

    return map_batches(rows.repartition("key", "block").sortWithinPartitions("key", "block"), run, "leads boolean, key long, a long, b long")


def candidates(groups: DataFrame, least_equal: int, band_rows: int) -> DataFrame:
    """Pairs of candidates that connect all candidates, from rows (id, keys, sketch)."""
    sketch = groups.select(F.col("id").alias("i"), "sketch")
    rows = groups.select(F.explode("keys").alias("key"), "id")
    pairs, before, every_pair, split, n = None, None, False, None, groups.count() * (ENTRIES // BAND)
    while True:
        dealt = with_sums(rows, "key", {"n": F.count("*")}, n, where="__rows > 1")
        dealt = _dealt(dealt.withColumn("parts", F.ceil(F.col("n") / band_rows)), every_pair, F.col("key"))
        dealt = dealt.select("key", "block", "id").join(sketch, F.col("id") == F.col("i"))
        out = materialize(_blocks(dealt.select("key", "block", "id", "sketch"), least_equal), "omh-pairs")
        part = out.where(~F.col("leads")).select("a", "b")
        pairs = part if pairs is None else pairs.unionByName(part)
        rows = out.where("leads").select("key", F.col("a").alias("id"))
        left = 0 if every_pair else rows.count()
        if left and split is None:
            split = rows.select(F.col("key").alias("k")).distinct()
        if not left:
            return pairs.distinct() if split is None else _with_rest(groups, pairs.distinct(), split, least_equal, band_rows)
        # while those sent on become fewer they meet in blocks again; else every pair of blocks is compared
        every_pair, before, n = before is not None and left > 0.8 * before, left, left


def _with_rest(groups: DataFrame, pairs: DataFrame, split: DataFrame, least_equal: int, band_rows: int) -> DataFrame:
    """Pairs that connect what pairs do, and all candidates of the bands in split (k): texts outside a band's largest component meet all its texts."""
    known = components(pairs)
    rows = groups.select(F.explode("keys").alias("key"), "id").join(split, F.col("key") == F.col("k"), "left_semi")
    rows = rows.join(known, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("root", "id").alias("of"))
    rows = materialize(rows, "omh-split")
    sizes = rows.groupBy("key", "of").agg(F.count("*").alias("n")).groupBy(F.col("key").alias("k")).agg(F.sum("n").alias("n"), F.max(F.struct("n", "of")).alias("top")).where("n > top.n")
    half = max(1, band_rows // 2)
    sizes = sizes.select("k", F.col("top.of").alias("top"), F.ceil((F.col("n") - F.col("top.n")) / half).alias("few"), F.ceil(F.col("n") / half).alias("all"))
    rows = rows.join(sizes, F.col("key") == F.col("k"))
    one = F.pmod(F.xxhash64("id", "key"), F.col("few"))
    other = F.pmod(F.xxhash64("id", "key"), F.col("all"))
    rest = rows.where("of <> top").withColumn("x", one).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1)))
    every = rows.withColumn("y", other).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("few") - 1)))
    dealt = rest.select("key", "id", "all", "x", "y").unionByName(every.select("key", "id", "all", "x", "y")).withColumn("block", -2 - (F.col("x") * F.col("all") + F.col("y")))
    dealt = dealt.join(groups.select(F.col("id").alias("i"), "sketch"), F.col("id") == F.col("i")).select("key", "block", "id", "sketch")
    more = materialize(_blocks(dealt, least_equal), "omh-rest").select("a", "b")
    return known.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more).distinct()


def _dealt(rows: DataFrame, every_pair: bool, *salt) -> DataFrame:
    """rows (id, parts, ...) with block: -1 where one holds all, else a number from 0, or below -1 for pairs of blocks."""
    rows = rows.withColumn("place", F.pmod(F.xxhash64("id", *salt), F.col("parts")))
    if not every_pair:
        return rows.withColumn("block", F.when(F.col("parts") > 1, F.col("place")).otherwise(-1))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    code = -2 - (F.greatest("place", "with") * F.col("parts") + F.least("place", "with"))
    return rows.withColumn("block", F.when(F.col("parts") > 1, code).otherwise(-1))


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """The banded-alignment similarity of two k-mer sequences, or 0 if it is known to be below least."""
    if np.array_equal(a, b):
        return 1.0
    n, m = len(a), len(b)
    needed = least * (n + m) / (1 + least)
    if min(n, m) < needed - 1e-9:
        return 0.0
    one = np.array([n]), np.array([m])
    if len(np.intersect1d(labelled(a, one[0]), labelled(b, one[1]), assume_unique=True)) < needed - 1e-9:
        return 0.0
    # equal ends are part of some best alignment
    short = min(n, m)
    differs = np.flatnonzero(a[:short] != b[:short])
    head = int(differs[0]) if len(differs) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    differs = np.flatnonzero(a[len(a) - short :][::-1] != b[len(b) - short :][::-1])
    tail = int(differs[0]) if len(differs) else short
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    band = int((n + m) - 2 * needed) + 1
    common = head + tail + _common(a, b, band)
    return common / (n + m - common)


#: Pairs of equal k-mers for each k-mer up to which they are gone through one by one.
FEW = 8


def _common(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The longest common subsequence of two sequences; matches further than the band off the diagonal don't count."""
    if not len(a) or not len(b):
        return 0
    order = np.argsort(a, kind="stable")
    run = a[order]
    first, last = np.searchsorted(run, b, "left"), np.searchsorted(run, b, "right")
    if int((last - first).sum()) > FEW * (len(a) + len(b)):
        return _common_by_bits(a, b, band)
    # the longest rising sequence of places in a: matches in the order of b, the later places in a first
    sizes = last - first
    j = np.repeat(np.arange(len(b)), sizes)
    i = order[np.repeat(last - 1 + np.cumsum(sizes) - sizes, sizes) - np.arange(len(j))]
    rising: list[int] = []
    for x in i[np.abs(i - j) <= band].tolist():
        at = bisect_left(rising, x)
        if at == len(rising):
            rising.append(x)
        else:
            rising[at] = x
    return len(rising)


def _common_by_bits(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The same by bits of a window that goes down the diagonal: a step costs the band's width."""
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a.tolist()):
        places.setdefault(x, []).append(i)
    # where each value's places in the window begin and end, and their bits, from place `low` on
    live: dict[int, list[int]] = {}
    width = 2 * band + 1
    full = (1 << width) - 1
    row, common, low = full, 0, -band
    for j, y in enumerate(b.tolist()):
        if j:
            common += (row & 1) ^ 1
            row = (row >> 1) | (1 << (width - 1))
            low += 1
        own = places.get(y)
        if own is None:
            continue
        bits, base, upto = live.get(y, [0, low, 0])
        bits >>= low - base
        while upto < len(own) and own[upto] < low + width:
            if own[upto] >= low:
                bits |= 1 << (own[upto] - low)
            upto += 1
        live[y] = [bits, low, upto]
        if bits:
            u = row & bits
            row = ((row + u) | (row - u)) & full
    return common + width - row.bit_count()


def _links(ids: np.ndarray, texts: pa.Array, least: float, of: np.ndarray | None = None) -> tuple[list[tuple[int, int, float]], np.ndarray]:
    """Links (two ids, similarity) that connect what all links between a block's texts connect, but for what is known to be (equal numbers `of`); and the group of each text."""
    made = [shingle_hashes(*word_hashes(data, at), KMER_WORDS) for _, _, data, at in blocks(texts)]
    counts = np.concatenate([c for _, c in made])
    shingles = np.concatenate([x for x, _ in made])
    starts = np.concatenate([[0], np.cumsum(counts)])
    m = len(ids)
    root = np.arange(m) if of is None else np.unique(of, return_inverse=True)[1].ravel()
    if m == 2:
        pairs = [(0, 1)]
    else:
        # the index: of each labelled k-mer of more than one text, those texts
        _, name, often = np.unique(labelled(shingles, counts), return_inverse=True, return_counts=True)
        of = np.repeat(np.arange(m), counts)
        posts = of[np.argsort(name, kind="stable")]
        first = np.cumsum(often) - often
        # the most typical texts first: they link most others
        typical = np.bincount(of, weights=often[name], minlength=m) / np.maximum(counts, 1)
        order = np.argsort(-typical, kind="stable")
        rank = np.empty(m, np.int64)
        rank[order] = np.arange(m)
        pairs = _near(order, rank, root, counts, starts, name, often, first, posts, least)
    found = []
    for i, j in pairs:
        if root[i] != root[j] and (s := similarity(shingles[starts[i] : starts[i + 1]], shingles[starts[j] : starts[j + 1]], least)) >= least:
            root[root == root[j]] = root[i]
            found.append((int(ids[i]), int(ids[j]), s))
    return found, root


def _near(order, rank, root, counts, starts, name, often, first, posts, least):
    """Pairs of places in different trees with enough common labelled k-mers; reads root as it grows."""
    for i in order:
        if (root == root[i]).all():
            return
        own = name[starts[i] : starts[i + 1]]
        own = own[often[own] > 1]
        if not len(own):
            continue
        sizes = often[own]
        at = np.repeat(first[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        common = np.bincount(posts[at], minlength=len(root))
        enough = (common >= least * (counts[i] + counts) / (1 + least) - 1e-9) & (rank > rank[i]) & (root != root[i])
        for j in np.flatnonzero(enough)[np.argsort(-common[enough], kind="stable")]:
            yield i, j


def _verify(rows: DataFrame, least: float, sent: int = 2) -> DataFrame:
    """Of rows (cluster, block, id, of, text): links as (a, b, similarity) and, of blocks numbered from 0, the first `sent` texts of each linked group as (cluster, a), told apart by `leads`. Texts with equal `of` are known to be linked."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def groups(last: bool):
            table = pa.Table.from_batches(held)
            key, block = (table.column(c).to_numpy() for c in ("cluster", "block"))
            ends = np.append(np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0)) + 1, len(key))
            if not last:
                ends = ends[:-1]
            links, leaders, s = [], [], 0
            for e in ends.tolist():
                ids = table.column("id").slice(s, e - s).to_numpy()
                keep = np.unique(ids, return_index=True)[1]
                group = np.arange(len(keep))
                if len(keep) > 1:
                    found, group = _links(ids[keep], table.column("text").slice(s, e - s).combine_chunks().take(pa.array(keep)), least, table.column("of").slice(s, e - s).to_numpy()[keep])
                    links += found
                if block[s] >= 0:
                    order = np.argsort(group, kind="stable")
                    starts = np.flatnonzero(np.diff(group[order], prepend=-1))
                    place = np.arange(len(keep)) - np.repeat(starts, np.diff(np.append(starts, len(keep))))
                    leaders += [(int(key[s]), int(i)) for i in ids[keep][order[place < sent]]]
                s = e
            held[:] = table.slice(s).to_batches()
            kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            flat = [(False, None, *x) for x in links] + [(True, c, i, None, None) for c, i in leaders]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in flat], kind) for k, kind in enumerate(kinds)], ["leads", "cluster", "a", "b", "similarity"])

        for batch in batches:
            held.append(batch)
            c, k = batch.column("cluster"), batch.column("block")
            if len(held) == 1 or c[0] != held[0].column("cluster")[0] or k[0] != held[0].column("block")[0] or c[-1] != c[0] or k[-1] != k[0]:
                yield groups(False)
        if held:
            yield groups(True)

    rows = rows.select("cluster", "block", "id", "of", "text")
    return map_batches(rows.repartition("cluster", "block").sortWithinPartitions("cluster", "block"), run, "leads boolean, cluster long, a long, b long, similarity double")


def verified(clusters: DataFrame, docs: DataFrame, least: float, block_rows: int, block_bytes: int) -> DataFrame:
    """Links (a, b, similarity) that connect all links, from clusters (id, cluster, bytes, exact_id, text_key) and docs (doc_id, text). Of docs, those outside any cluster are left where they are."""

    def parts(rows: DataFrame) -> DataFrame:
        sized = with_sums(rows, "cluster", {"n": F.count("*"), "all_bytes": F.sum("bytes")})
        return sized.withColumn("parts", F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("all_bytes") / block_bytes))).drop("n", "all_bytes")

    sized = materialize(parts(clusters), "omh-sized")
    texts = perhaps(docs, "doc_id", filter_words(clusters, "exact_id"), True).select("doc_id", "text", F.md5("text").alias("of_text"))

    def with_texts(rows: DataFrame) -> DataFrame:
        return rows.join(texts, (F.col("exact_id") == F.col("doc_id")) & (F.col("text_key") == F.col("of_text"))).withColumn("of", F.col("id")).select("cluster", "id", "bytes", "parts", "of", "text")

    links = ["a", "b", "similarity"]
    one = _verify(with_texts(sized.where("parts = 1")).withColumn("block", F.lit(-1).cast("long")), least).select(*links)
    if sized.where("parts > 1").isEmpty():
        return one
    return one.unionByName(_split_clusters(materialize(with_texts(sized.where("parts > 1")).dropDuplicates(["id"]), "omh-split-texts"), parts, least, links))


def _split_clusters(rows: DataFrame, parts, least: float, links: list[str]) -> DataFrame:
    """The same for clusters of several blocks, from rows (cluster, id, bytes, parts, of, text)."""
    now, before, found, turn = rows, rows.count(), None, 0
    while True:
        # texts of each linked group of a block meet those of the others, while they become fewer
        dealt = now.withColumn("block", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("id", F.lit(turn)), F.col("parts"))).otherwise(-1).cast("long"))
        out = materialize(_verify(dealt, least), "omh-verified")
        part = out.where(~F.col("leads")).select(*links)
        found = part if found is None else found.unionByName(part)
        led = out.where("leads").select(F.col("a").alias("i"))
        left = led.count()
        if not left or left > 0.8 * before:
            break
        now, before, turn = parts(rows.join(led, F.col("id") == F.col("i"), "left_semi").drop("parts")), left, turn + 1
    known = components(found.select("a", "b"))
    known = known.unionByName(known.select(F.col("root").alias("node"), "root").distinct())
    rows = rows.drop("of").join(known, F.col("id") == F.col("node"), "left").withColumn("of", F.coalesce("root", "id")).select("cluster", "id", "parts", "of", "text")
    groups = rows.groupBy("cluster", "of").agg(F.count("*").alias("m"))
    tops = groups.groupBy(F.col("cluster").alias("c")).agg(F.sum("m").alias("n"), F.max(F.struct("m", "of")).alias("top")).where("n > top.m")
    tops = materialize(tops.select("c", F.col("top.of").alias("top"), (F.col("n") - F.col("top.m")).alias("few"), "n"), "omh-tops")
    if tops.isEmpty():
        return found
    rows = rows.join(F.broadcast(tops), F.col("cluster") == F.col("c")) if tops.count() <= MOST_SUMS else rows.join(tops, F.col("cluster") == F.col("c"))
    # what lies outside the largest group (blocks x) meets all (blocks y), half a block of each
    x, y = F.ceil(2 * F.col("parts") * F.col("few") / F.col("n")), 2 * F.col("parts")
    rows = rows.withColumn("xs", x).withColumn("ys", y).withColumn("h", F.xxhash64("id", F.lit("rest")))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rest = rows.where("of <> top").withColumn("x", F.pmod("h", F.col("xs"))).withColumn("y", each("ys"))
    every = rows.withColumn("y", F.pmod("h", F.col("ys"))).withColumn("x", each("xs"))
    dealt = rest.unionByName(every).withColumn("block", (-2 - (F.col("x") * F.col("ys") + F.col("y"))).cast("long"))
    return found.unionByName(_verify(dealt, least).select(*links))


def components(links: DataFrame) -> DataFrame:
    """node and least node of its component for every node of links (a, b), by large-star and small-star steps."""

    def least_of(edges: DataFrame, by: str, other: str, n: int | None = None) -> DataFrame:
        return with_sums(edges, by, {"m": F.least(F.min(other), F.min(by))}, n).select(by, other, "m")

    def sign(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("x", "y"))).first())

    edges = materialize(links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x != y").distinct(), "omh-links")
    signed = sign(edges)
    while signed[0]:
        # large star: each node gives its greater neighbours its least one
        ways = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        large = least_of(ways, "x", "y", 2 * signed[0]).where("y > x and y != m").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        large = materialize(in_few(large, 2 * signed[0]), "omh-large") if signed[0] > MOST_SUMS else in_few(large, 2 * signed[0])
        # small star: each node gives its lesser neighbours, and itself, its least one
        small = least_of(large, "x", "y", 2 * signed[0])
        small = small.select(F.when(F.col("y") == F.col("m"), F.col("x")).otherwise(F.col("y")).alias("x"), F.col("m").alias("y")).unionByName(small.select("x", F.col("m").alias("y"))).where("x != y").distinct()
        edges = materialize(in_few(small, 2 * signed[0]), "omh-stars")
        before, signed = signed, sign(edges)
        if signed == before:
            break
    return edges.select(F.col("x").alias("node"), F.col("y").alias("root"))


def _judged(docs: DataFrame, least: float = 0.8, least_equal: int = 14, band_rows: int = 4_096, block_rows: int = 1_024, block_bytes: int = 1 << 23, with_links: bool = False) -> DataFrame:
    """doc_id, text_key, class_id, exact_id, leads (whether the text stands for its class), and near_id and similarity if with_links, for each row of docs (doc_id, text) with an id."""
    some = docs.where("doc_id is not null")
    light = materialize(sketched(some), "omh-sketches")
    # equal texts have equal sketches, so any one does
    groups = light.groupBy("text_key").agg(F.min("doc_id").alias("exact_id"), F.count("*").alias("n"), F.any_value("bytes").alias("bytes"), F.any_value("keys").alias("keys"), F.any_value("sketch").alias("sketch"))
    # numbers of their own, for an id may occur with several texts
    groups = materialize(groups.withColumn("id", F.monotonically_increasing_id()), "omh-groups")
    pairs = candidates(groups.where("keys is not null").select("id", "keys", "sketch"), least_equal, band_rows)
    clusters = components(pairs)
    clusters = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct())
    clusters = materialize(clusters.join(groups, F.col("node") == F.col("id")).select("id", F.col("root").alias("cluster"), "bytes", "exact_id", "text_key"), "omh-clusters")
    links = materialize(verified(clusters, some, least, block_rows, block_bytes), "omh-verified")
    roots = components(links.select("a", "b"))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    members = roots.join(clusters, F.col("node") == F.col("id")).select("node", "root", "exact_id", "text_key")
    near = ["near_id", "similarity"] if with_links else []
    if with_links:
        # the best link of each text, and what stands at its other end
        ends = links.select(F.col("a").alias("of"), F.col("b").alias("to"), "similarity").unionByName(links.select(F.col("b").alias("of"), F.col("a").alias("to"), "similarity"))
        ends = ends.groupBy("of").agg(F.max(F.struct("similarity", (-F.col("to")).alias("to"))).alias("link")).select("of", (-F.col("link.to")).alias("to"), "link.similarity")
        ends = ends.join(clusters.select(F.col("id").alias("i"), F.col("exact_id").alias("near_id")), F.col("to") == F.col("i")).select("of", *near)
        members = members.join(ends, F.col("node") == F.col("of"), "left")
    # the text with the least id stands for its class
    roots = with_sums(materialize(members.select("root", "exact_id", "text_key", *near), "omh-members"), "root", {"first": F.min(F.struct("exact_id", "text_key"))})
    roots = roots.select(F.col("text_key").alias("t"), "first", *near)
    named = groups.select("text_key", "exact_id", "n").join(roots, F.col("text_key") == F.col("t"), "left")
    named = named.select(F.col("text_key").alias("k"), "exact_id", "n", F.coalesce("first.exact_id", "exact_id").alias("class_id"), F.coalesce(F.col("first.text_key") == F.col("text_key"), F.lit(True)).alias("leads"), *near)
    named = materialize(named, "omh-named")
    # texts of more than a part of 1 / 10,000 of the rows, 10,000 at most, reach their rows by a broadcast
    hot = F.col("n") > max(64, light.count() // 10_000)
    rows = light.select("doc_id", "text_key")
    same = F.col("text_key") == F.col("k")
    one = rows.join(F.broadcast(named.where(hot)), same)
    rest = rows.join(F.broadcast(named.where(hot).select("k")), same, "left_anti").join(named.where(~hot), same)
    return one.unionByName(rest).select("doc_id", "text_key", "class_id", "exact_id", "leads", *near)


def classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (the least id of its class), exact_id (the least id with an equal text), near_id and near_similarity for each row of docs (doc_id, text). Options are those of _judged.

    near_id is the exact_id of the text that a verified link, the best one found, joins this text to,
    near_similarity the link's; for a text without links they are those of an equal text under a
    lesser id, or null.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    equal = F.col("exact_id") < F.col("doc_id")
    named = _judged(docs, **options, with_links=True).select(
        "doc_id", "class_id", "exact_id", F.coalesce("near_id", F.when(equal, F.col("exact_id"))).alias("near_id"), F.coalesce("similarity", F.when(equal, F.lit(1.0))).alias("near_similarity")
    )
    none = docs.where("doc_id is null").select("doc_id", *(F.lit(None).cast(kind).alias(c) for c, kind in (("class_id", "long"), ("exact_id", "long"), ("near_id", "long"), ("near_similarity", "double"))))
    return named.unionByName(none)


def without_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, one for each class: that with the class's id (and the text that stands for it, where the id has several). Rows without an id stay. Rows that surely stay aren't shuffled."""
    named = _judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), **options)
    named = materialize(named.select("doc_id", "text_key", (F.col("leads") & (F.col("doc_id") == F.col("exact_id"))).alias("stays")), "omh-classes")
    judged = named.groupBy("doc_id", "text_key").agg(F.any_value("stays").alias("__stays"), F.count("*").alias("n")).where("n > 1 or not __stays")
    judged = materialize(judged.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "__stays"), "omh-judged")
    words = filter_words(judged, "__id")
    doubtful = perhaps(docs, "doc_id", words, True).withColumn("__of_text", F.coalesce(F.md5("text"), F.concat(F.lit("null:"), F.col("doc_id").cast("long").cast("string"))))
    doubtful = doubtful.join(judged, (F.col("doc_id") == F.col("__id")) & (F.col("__of_text") == F.col("__key")), "left")
    settled = doubtful.where("__stays is null").select(*docs.columns).unionByName(doubtful.where("__stays").dropDuplicates(["__id", "__key"]).select(*docs.columns))
    return perhaps(docs, "doc_id", words, False).unionByName(settled)
