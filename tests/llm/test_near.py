import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm.conftest import documents
from vicinal.llm import order_minhash as omh
from vicinal.llm.arrays import blocks, shingle_hashes, word_hashes


def kmers(text, k=5):
    words = text.lower().split()
    return [tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def hashed(text):
    ((_, _, data, at),) = blocks(pa.array([text]))
    return shingle_hashes(*word_hashes(data, at))[0]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def brute(rows, least=0.8):
    """Class of each row by all pairs: equal texts, and texts whose aligned k-mers are similar."""
    names = {}
    for i, t in rows:
        if i is not None:
            names[t if t is not None else ("null", i)] = min(i, names.get(t if t is not None else ("null", i), i))
    ids = {i: t for t, i in names.items()}
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    made = {i: kmers(t) for i, t in ids.items() if isinstance(t, str)}
    order = sorted(i for i in made if made[i])
    counted = {i: collections.Counter(made[i]) for i in order}
    for n, i in enumerate(order):
        for j in order[:n]:
            a, b = made[i], made[j]
            needed = least * (len(a) + len(b)) / (1 + least) - 1e-9
            if min(len(a), len(b)) >= needed and not counted[i].keys().isdisjoint(counted[j]) and sum((counted[i] & counted[j]).values()) >= needed:
                common = lcs(a, b)
                if common / (len(a) + len(b) - common) >= least:
                    x, y = sorted((root(i), root(j)))
                    parent[y] = x
    return {i: root(names[t if t is not None else ("null", i)]) for i, t in rows if i is not None}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.6:
            words[at] = f"new{rng.randrange(10**6)}"
        elif kind < 0.8:
            words.insert(at, f"add{rng.randrange(10**6)}")
        else:
            del words[at]
    return words


def copies(seed=1, groups=6, size=25):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([8, 60, 150, 400]))]
        for _ in range(size):
            rows.append(" ".join(edited(rng, words, rng.randrange(0, max(2, len(words) // 30)))))
    rows += [" ".join(f"u{rng.randrange(5000)}" for _ in range(80)) for _ in range(60)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def all_pairs():
    rows = copies()
    return rows, brute(rows)


@pytest.mark.parametrize("options", [{}, {"band_rows": 8, "block_rows": 6}, {"block_bytes": 2000}])
def test_classes_against_all_pairs(spark, all_pairs, options):
    rows, want = all_pairs
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in omh.classes(docs, **options).collect()} == want


def test_chains_and_stars(spark):
    """A chain of versions is one class though its ends have little in common."""
    rng = random.Random(5)
    words, rows = [f"w{k}" for k in range(200)], []
    for i in range(30):
        rows.append((i, " ".join(words)))
        words = edited(rng, words, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in omh.classes(docs).collect()}
    assert got == brute(rows) and set(got.values()) == {0}


def test_order_counts(spark):
    """The same parts in another order aren't near for an alignment."""
    parts = [" ".join(f"p{k}w{j}" for j in range(60)) for k in range(6)]
    rows = [(1, " ".join(parts)), (2, " ".join(reversed(parts))), (3, " ".join(parts) + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in omh.classes(docs).collect()} == {1: 1, 2: 2, 3: 1} == brute(rows)


def test_similarity_against_a_plain_alignment():
    rng = random.Random(9)
    for n in (6, 20, 80):
        for _ in range(60):
            words = [f"w{rng.randrange(n)}" for _ in range(n)]
            a, b = " ".join(words), " ".join(edited(rng, words, rng.randrange(0, 1 + n // 10)))
            x, y = kmers(a), kmers(b)
            common = lcs(x, y)
            want = common / (len(x) + len(y) - common)
            got = omh.similarity(hashed(a), hashed(b), 0.8)
            assert got == want if want >= 0.8 else got < 0.8


@pytest.mark.parametrize("few", [0, 8])
def test_alignments_of_repeating_texts(monkeypatch, few):
    """Both ways of aligning, on texts whose k-mers repeat, with bands of any width."""
    monkeypatch.setattr(omh, "FEW", few)
    rng = random.Random(few)
    for _ in range(300):
        n, m, kinds, band = rng.randint(0, 40), rng.randint(0, 40), rng.choice([2, 5, 50]), rng.randint(0, 45)
        a, b = [rng.randrange(kinds) for _ in range(n)], [rng.randrange(kinds) for _ in range(m)]
        table = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(m):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] and abs(i - j) <= band else max(table[i][j + 1], table[i + 1][j])
        best = max(map(max, table))
        assert omh._common(np.array(a, np.uint64), np.array(b, np.uint64), band) == best


def test_long_texts_are_aligned_fast():
    import time

    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 60, 1_000_000).astype(np.uint64)
    b = np.delete(a, rng.integers(0, len(a), 20_000))
    start = time.perf_counter()
    assert omh.similarity(a, b, 0.8) > 0.97 and time.perf_counter() - start < 30


def test_sketches_against_plain_loops():
    texts = ["a b c d e f g h i j", "one two", "x " * 40, "a b c d e f g h i j k l m"]
    data = [hashed(t) for t in texts]
    counts = np.array([len(x) for x in data])
    names = omh.labelled(np.concatenate(data), counts)
    made = omh.sketches(np.concatenate(data), counts)
    at = 0
    for row, n in zip(made, counts):
        own = names[at : at + n]
        at += n
        assert len(set(own.tolist())) == n  # occurrences have labels
        for k in range(omh.ENTRIES):
            v = own * omh._SEEDS[k]
            v = v ^ (v >> np.uint64(29))
            two = sorted(np.argsort(v)[:2])
            one = own[two[:1]] if n == 1 else own[two[:1]] * np.uint64(3) + omh.mix(own[two[1:2]])
            assert row[k] == omh.mix(one)[0]


def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = {r["doc_id"]: r["class_id"] for r in omh.classes(docs).collect()}
    assert got == brute(rows)
    kept = omh.without_near_copies(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))


def test_odd_documents(spark, odd, none):
    rows = omh.classes(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r["class_id"] for r in rows}
    assert by[6] == by[1] == 1 and by[None] is None and all(by[i] == i for i in (2, 3, 4, 5, 7, 8, 9))
    kept = omh.without_near_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 7, 8, 9, None, None]))
    assert omh.classes(none).count() == 0 and omh.without_near_copies(none).count() == 0
    only_words = documents(spark, [(i, "x y", None, None, 3) for i in range(3)] + [(9, "x  y", None, None, 4)])
    assert {r["class_id"] for r in omh.classes(only_words).collect()} == {0}


def test_ids_with_several_texts(spark):
    """Each class keeps one row, whatever ids repeat."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(3, a), (7, a), (7, b), (8, b), (9, b + " more"), (20, c), (20, d), (20, d), (21, None), (21, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(omh.without_near_copies(docs).collect(), key=str)
    assert kept == sorted([(3, a), (7, b), (20, c), (20, d), (21, None), (21, "x")], key=str)
    assert sorted((r["doc_id"], r["class_id"]) for r in omh.classes(docs).collect()) == [(3, 3), (7, 3), (7, 7), (8, 7), (9, 7), (20, 20), (20, 20), (20, 20), (21, 21), (21, 21)]


def test_candidates_of_split_bands_are_whole(spark):
    """Texts whose only neighbour in another block isn't among those that a group sends on."""
    rng = np.random.default_rng(3)
    hub = rng.integers(0, 1 << 16, omh.ENTRIES)
    rows = [(i, [1], hub) for i in range(100)]
    for k in range(20):
        x, y = rng.integers(0, 1 << 16, (2, omh.ENTRIES))
        x[:14] = hub[:14]
        y[14:28] = x[14:28]
        rows += [(200 + k, [1], x), (300 + k, [1], y)]
    rows.append((400, [1], rng.integers(0, 1 << 16, omh.ENTRIES)))
    groups = spark.createDataFrame([(i, k, bytearray(s.astype("<u2").tobytes())) for i, k, s in rows], "id long, keys array<long>, sketch binary")
    for band_rows in (8, 32):
        got = {r["node"]: r["root"] for r in omh.components(omh.candidates(groups, 14, band_rows)).collect()}
        assert got == {i: 0 for i, _, _ in rows if i not in (0, 400)}, band_rows


@pytest.mark.parametrize("band_rows", [8, 64, 4096])
def test_bridged_groups_larger_than_a_block(spark, band_rows):
    """Groups of one band that a single text joins, or doesn't, against all pairs."""
    rng = np.random.default_rng(5)
    rows = []
    for g in range(6):
        base = rng.integers(0, 1 << 16, omh.ENTRIES)
        for _ in range(100):
            x = base.copy()
            x[rng.choice(omh.ENTRIES, 12, replace=False)] = rng.integers(0, 1 << 16, 12)
            rows.append(x)
        if g % 2:
            x = base.copy()
            x[16:] = rows[(g - 1) * 101 - (g - 1) // 2 - 1][16:] if g > 1 else rows[0][16:]
            rows.append(x)
    sk = np.array(rows)
    groups = spark.createDataFrame([(i, [1, 2 + i % 3], bytearray(s.astype("<u2").tobytes())) for i, s in enumerate(sk)], "id long, keys array<long>, sketch binary")
    group = omh._connected(sk, 14)
    want = {}
    for k in np.unique(group):
        own = np.flatnonzero(group == k)
        want.update({int(i): int(own.min()) for i in own[1:]})
    got = {r["node"]: r["root"] for r in omh.components(omh.candidates(groups, 14, band_rows)).collect()}
    assert got == want and 1 < len(set(group.tolist())) < 6


def test_large_clusters_meet_by_their_groups(spark):
    """A cluster of many blocks whose texts are all linked, and one with texts that link by a bridge only, against all pairs."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(120)]
    rows = [" ".join(edited(rng, words, rng.randrange(0, 3))) for _ in range(150)]
    one, two = words[:60] + [f"a{k}" for k in range(60)], [f"b{k}" for k in range(22)] + words[22:60] + [f"a{k}" for k in range(60)]
    rows += [" ".join(edited(rng, one, 1)) for _ in range(20)] + [" ".join(edited(rng, two, 1)) for _ in range(20)]
    rows += [" ".join([f"b{k}" for k in range(11)] + one[11:])]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for options in ({"block_rows": 7}, {"block_rows": 40}):
        assert {r["doc_id"]: r["class_id"] for r in omh.classes(docs, least_equal=6, **options).collect()} == want, options


def test_links_are_verified(spark):
    """The link of each text is one of similarity 0.8 or more to another of its class."""
    rows = copies(seed=3, groups=4, size=15)
    rows += [(1000 + i, t) for i, t in rows[:5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts, members = dict(rows), {}
    out = omh.classes(docs).collect()
    for r in out:
        members.setdefault(r["class_id"], []).append(r["doc_id"])
    linked = 0
    for r in out:
        if r["near_id"] is None:
            assert len(members[r["class_id"]]) == 1 or all(texts[i] == texts[r["doc_id"]] for i in members[r["class_id"]])
            continue
        a, b = kmers(texts[r["doc_id"]]), kmers(texts[r["near_id"]])
        common = lcs(a, b)
        assert r["near_id"] != r["doc_id"] and r["near_id"] in members[r["class_id"]]
        assert abs(common / (len(a) + len(b) - common) - r["near_similarity"]) < 1e-9 and r["near_similarity"] >= 0.8
        linked += 1
    assert linked > 40


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    from vicinal.llm import shared

    rows = spark.createDataFrame([(0 if i < 900 else i, i) for i in range(1500)] + [(None, 7)], "k long, v long")
    want = sorted((0 if i < 900 else i, i, 0 if i < 900 else i, 900 if i < 900 else 1) for i in range(1500))
    for most in (1 << 16, 10):
        monkeypatch.setattr(shared, "MOST_SUMS", most)
        got = shared.with_sums(rows, "k", {"m": F.min("v"), "c": F.count("*")})
        assert sorted(tuple(r) for r in got.collect()) == want
        assert shared.with_sums(rows, "k", {"c": F.count("*")}, where="__rows > 1").count() == 900
