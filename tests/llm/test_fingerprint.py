import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tests.conftest import DATA
from vicinal.llm import fingerprint as fp


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, given, error=0.15):
    """rows: results; given: (doc_id, text), whose hashes order rows of equal id."""
    spark = SparkSession.getActiveSession()
    texts = sorted({t or "" for _, t in given})
    hashes = dict(zip(texts, (r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(F.xxhash64("t")).collect()), strict=True))
    order = sorted(given, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1] or ""], r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t)
        changed = t[: n - n // 2] + after[: n // 2]
        want.append((i, n, hashlib.sha256(changed.encode()).hexdigest(), jaccard(t, changed), jaccard(t, after)))
    assert sorted(map(str, [w[:3] for w in want])) == sorted(str((r["doc_id"], r["n_chars"], r["edited_sha256"])) for r in rows)
    near = {(w[0], w[2]): w for w in want}
    for r in rows:
        _, _, _, a, b = near[r["doc_id"], r["edited_sha256"]]
        assert abs(r["near_edited"] - a) < error and abs(r["near_next"] - b) < error, r
        assert len(r["fingerprint"]) == len(r["edited_fingerprint"]) == fp.BINS * fp.BITS // 4


@pytest.mark.parametrize("range_rows", [7, 5000])
def test_documents(spark, range_rows):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text").limit(300).repartition(3)
    given = [tuple(r) for r in docs.collect()]
    rows = fp.fingerprints(spark.createDataFrame(given, "doc_id long, text string"), range_rows=range_rows, block_chars=5000).collect()
    check(rows, given)
    equal = {}
    for r in rows:
        equal.setdefault(dict(given)[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in equal.values())


def test_hot_ids_hold_several_ranges(spark):
    """A third of the rows have one id, a third none."""
    rng = np.random.default_rng(8)
    given = [([7, None, int(rng.integers(-50, 50))][i % 3], " ".join(f"w{x}" for x in rng.integers(0, 40, 30))) for i in range(600)]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(4)
    for rows in (10, 100, 5000):
        check(fp.fingerprints(docs, range_rows=rows, block_chars=2000).collect(), given, 0.2)
    ranges = fp._Ranges([7] * 5 + [9], 4)
    ids = pa.array([9, 8, *[7] * 4, 6, None, None], pa.int64())
    h = np.array([0, 0, -(2**63), -1, 0, 2**63 - 1, 0, -(2**63), 2**63 - 1])
    assert ranges(ids, h).tolist() == [0, 1, 1, 3, 3, 5, 6, 7, 10]


def test_likeness_has_no_bias():
    rng = np.random.default_rng(4)
    errors = []
    for share in np.linspace(0, 1, 60):
        n = 400
        common = int(share * n)
        a = [f"w{x}" for x in rng.integers(0, 10**9, n)]
        b = a[:common] + [f"v{x}" for x in rng.integers(0, 10**9, n - common)]
        x, y = fp.sketch([" ".join(a), " ".join(b)])
        errors.append(fp.likeness(x[None], y[None])[0] - jaccard(" ".join(a), " ".join(b)))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.04


def test_densification_of_short_texts():
    a, b, c = fp.sketch(["only two", "only two", "other two"])
    assert (a == b).all() and fp.likeness(a[None], c[None])[0] < 0.15 and a.any()


def test_odd_documents(odd, none):
    given = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    check(fp.fingerprints(odd).collect(), given)
    check(fp.fingerprints(odd, range_rows=1).collect(), given)
    assert fp.fingerprints(none).count() == 0
    one = odd.where("doc_id = 1")
    check(fp.fingerprints(one).collect(), [tuple(r) for r in one.select("doc_id", "text").collect()])
