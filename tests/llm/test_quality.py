import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import DATA
from vicinal.llm import quality_cnn as cnn
from vicinal.llm.arrays import blocks
from vicinal.llm.queries import op7_byte_cnn


def network(seed=0):
    rng = np.random.default_rng(seed)
    return cnn.Network(rng.normal(0, 1, (cnn.WIDTH // 2, 65536, cnn.FILTERS)).astype(np.float32), rng.normal(0, 0.5, cnn.FILTERS), rng.normal(0, 1, cnn.FILTERS), 0.3, rng.normal(0, 1, 5))


def brute(text, net):
    """Convolution, pooling and summary of one text in plain loops."""
    data = text.encode()
    padded = data + bytes(cnn.WIDTH)
    places = range(max(1, len(data) - cnn.WIDTH + 1))
    conv = {p: sum(net.pairs[t][padded[p + 2 * t] * 256 + padded[p + 2 * t + 1]] for t in range(cnn.WIDTH // 2)) for p in places}
    n = max(1, -(-len(data) // cnn.STRIDE) - 1)
    logits = []
    for c in range(n):
        own = [conv[p] for p in places if c * cnn.STRIDE <= p < (c + 2) * cnn.STRIDE]
        logits.append(float(np.maximum(np.max(own, axis=0) + net.bias, 0).astype(np.float64) @ net.out + net.shift))
    return [np.mean(logits), min(logits), max(logits), max(0, 1 - len(data) / (2 * cnn.STRIDE)), 1]


def test_whole_texts_against_plain_loops():
    net = network()
    rng = np.random.default_rng(3)
    texts = ["", "a", "abcdef", "x" * 256, "yz" * 256, "ä" * 700, *("".join(map(chr, rng.integers(32, 127, n))) for n in (255, 257, 511, 512, 513, 1024, 3000))]
    for most in (1, 600, 1 << 20):  # whatever stands beside it in a batch
        got = np.concatenate([cnn.summaries(data, at, net) for _, _, data, at in blocks(pa.array(texts), most)])
        assert np.allclose(got, [brute(t, net) for t in texts], atol=1e-3)


def test_slices_don_t_change_results(monkeypatch):
    net, texts = network(1), ["abc " * 4000, "def " * 900]
    ((_, _, data, at),) = blocks(pa.array(texts))
    want = cnn.summaries(data, at, net)
    monkeypatch.setattr(cnn, "SLICE", 3)
    assert np.allclose(cnn.summaries(data, at, net), want)


def test_long_texts_in_runs(monkeypatch):
    net, rng = network(2), np.random.default_rng(5)
    for n in (5 * 512, 5 * 512 + 3, 5 * 512 + 300, 4 * 512 + 259, 513):
        data = rng.integers(32, 127, n).astype(np.uint8)
        want = cnn.summaries(data, np.array([0, n]), net)
        with monkeypatch.context() as m:
            m.setattr(cnn, "LONG", 512)
            assert np.allclose(cnn.summaries(data, np.array([0, n]), net), want), n


def test_the_sample_is_of_rows_that_count(spark):
    """Labels of held-out, missing, null and too long documents don't use up the sample."""
    docs = spark.createDataFrame([(i, f"text {i}" if i % 3 else None) for i in range(60)] + [(100, "x" * 500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 1000)] + [(100, 1)], "doc_id long, quality int")
    for n in (1, 10, 40, 100):
        rows = cnn.sample(docs, labels, n, 100, 1 << 20)
        assert len(rows) == min(n, 40) and all(q == int(t.split()[1]) % 2 for t, q in rows)
    assert sum(len(t) for t, _ in cnn.sample(docs, labels, 100, 100, 50)) <= 50


def test_gradients(monkeypatch):
    """Training lowers the loss of its texts to nearly nothing, and knows unseen texts of the same kinds."""
    rng = np.random.default_rng(1)
    make = lambda q: bytes(rng.choice(list(b"abc de" if q else b"ab#$% "), 300).tolist())
    y = np.arange(60) % 2
    net = cnn.fit_network([make(q) for q in y], y, epochs=8)
    unseen = np.arange(40) % 2
    for q in unseen:
        x = np.frombuffer(make(q), np.uint8)
        p = 1 / (1 + np.exp(-(cnn.summaries(x, np.array([0, len(x)]), net) @ net.head)))[0]
        assert (p > 0.5) == bool(q)


def test_held_out_accuracy(spark):
    got = op7_byte_cnn(spark, f"{DATA}/sf0.1").toPandas()
    assert len(got) == 10_000 and got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    rows = got.merge(spark.read.parquet(f"{DATA}/sf0.1/labels.parquet").toPandas(), on="doc_id")
    away = rows[rows.held_out]
    good, bad = away[away.quality == 1], away[away.quality == 0]
    assert (good.predicted == 1).mean() > 0.97 and (bad.predicted == 0).mean() > 0.93


@pytest.fixture(scope="module")
def small():
    texts = [b"plain words of a text that reads well enough " * 9, b"### $$$ *** ### %%% &&& *** " * 9] * 12
    return cnn.fit_network(texts, np.array([1, 0] * 12), epochs=3)


def test_odd_documents(spark, odd, none, small):
    rows = cnn.score(odd, small, keep=("doc_id", "text", "n")).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 6)}) == 1
    assert len({r["score"] for r in rows if not r["text"]}) == 1
    assert cnn.score(none, small).count() == 0


def test_without_labels(spark, odd):
    labels = spark.createDataFrame([(1, None), (None, 1), (5, 1)], "doc_id long, quality int")
    assert {r["score"] for r in cnn.score(odd, cnn.fit(odd, labels)).collect()} == {0.5}
    assert {r["score"] for r in cnn.score(odd, cnn.fit(odd, labels.limit(0))).collect()} == {0.5}
