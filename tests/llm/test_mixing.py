import hashlib
import re

import pytest

from tests.conftest import DATA, as_rows
from vicinal.llm import mixing
from vicinal.llm.queries import OP3_SQL, op3_mix_sources


def own_key(row):
    return row[0] if row[0] is not None else "null:" + hashlib.md5((row[1] or "").encode()).hexdigest()


def brute(rows, weights=(3, 1, 2), factor=1.5, most=2.0):
    """Taken words by row: water filling and cuts in plain loops."""
    sizes = [len(re.findall(mixing.WORD, t or "")) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(sizes, rows) if r[2] == s) for s in names}
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), factor * sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * total[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: most * total[s] for s in full}
        left -= sum(most * total[s] for s in full)
        open_ -= full
    taken = [0] * len(rows)
    for s in names:
        own = sorted((hashlib.md5(f"{own_key(r)}:mix".encode()).hexdigest(), n, i) for i, (n, r) in enumerate(zip(sizes, rows)) if r[2] == s)
        want = int(target[s] + 0.5)
        while want and total[s]:
            for _, n, i in own:
                x = min(n, want)
                taken[i] += x
                want -= x
    return sizes, total, target, taken


def test_against_sql(spark, duck):
    got = op3_mix_sources(spark, f"{DATA}/sf0.01").toPandas()
    assert as_rows(got) == as_rows(duck(OP3_SQL))


@pytest.mark.parametrize("range_rows", [1, 512])
def test_against_plain_loops(spark, range_rows):
    rows = [(i, "w " * ((i * 7) % 23), ["a", "b", None, "", "d"][i % 5 if i % 3 else 0]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix(docs, range_rows=range_rows).collect()}
    sizes, total, target, taken = brute(rows)
    for (i, _, s), n, t in zip(rows, sizes, taken):
        assert (got[i]["size"], got[i]["source_size"], got[i]["taken"]) == (n, total[s], t)
        assert abs(got[i]["target"] - target[s]) < 1e-6 and t <= 2 * n


def test_copies(spark):
    rows = [(i, "some words in a text", "en", ["a", "b"][i > 20], 20) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mixed_documents(docs)
    counts = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert out.columns == docs.columns and counts["a"] == 42 and abs(counts["b"] - (300 - 42)) <= 1
    assert out.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2


def test_odd_documents(spark, odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    assert {r["size"] for r in rows if r["doc_id"] in (2, 3, 4)} == {0} and all(r["taken"] <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["mix_source"], []).append(r)
    for x in by.values():
        assert abs(sum(r["taken"] for r in x) - x[0]["target"]) <= 1
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_nothing(none):
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_no_python_in_the_plan(spark):
    plan = mixing.mix(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
