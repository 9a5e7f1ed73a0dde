import numpy as np

from tests.conftest import DATA
from tests.llm.conftest import documents
from vicinal.llm import language
from vicinal.llm.arrays import blocks
from vicinal.llm.queries import op2_language_mixture


def test_held_out_accuracy(spark):
    got = op2_language_mixture(spark, f"{DATA}/sf0.01").toPandas()
    truth = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    rows = got.merge(truth, on="doc_id")
    assert len(rows) == len(truth)
    away = rows[rows.held_out]
    assert 150 < len(away) < 350 and (away.lang_pred == away.lang).mean() > 0.97
    assert rows.score.between(0, 1).all()


def test_proportions_of_mixed_texts(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    model = language.fit(docs)
    text = {r["lang"]: r["text"] for r in docs.where("lang in ('de', 'fr') and n_chars between 3000 and 9000 and doc_id % 7 = 0").collect()}
    de, fr = " ".join(text["de"].split()[:150]), " ".join(text["fr"].split()[:50])
    row = language.predict(documents(spark, [(1, f"{de}\n{fr}", None, None, 0), (2, de, None, None, 0)]), model).orderBy("doc_id").collect()
    assert row[0]["lang_pred"] == "de" and 0.65 < row[0]["score"] < 0.85 and row[0]["languages"].split(",")[1].startswith("fr:0.2")
    assert row[1]["languages"] == "de:1.0000"


def test_grams_against_a_plain_loop():
    import pyarrow as pa

    texts = ["Ab c, Dé!", "", "12", "éé"]
    ((_, _, data, at),) = blocks(pa.array(texts))
    made, starts, words = language.grams(data, at)
    assert words.tolist() == [3, 0, 0, 1] and made.shape[1] == 2 + 1 + 2 + 2 and starts.tolist() == [0, 2, 3, 5]
    # case doesn't matter, and equal n-grams share buckets
    assert made[0, 5] == made[0, 6] == made[0, 4]


def test_mixture_against_a_plain_loop():
    rng = np.random.default_rng(1)
    ll = rng.normal(0, 1, (3, 12)).astype(np.float32)
    words = np.array([5, 7])
    share, value = language._mixtures(ll, words, 50)
    times = np.arange(12) % 3 + 1
    weighted = language._mixtures(ll, words, 50, times.astype(np.float32))
    spread = language._mixtures(np.repeat(ll, times, axis=1), np.array([times[:5].sum(), times[5:].sum()]), 50)
    assert np.allclose(weighted[0], spread[0], atol=1e-5) and np.allclose(weighted[1], spread[1], atol=1e-3)
    for d, (s, e) in enumerate(((0, 5), (5, 12))):
        part = np.exp(ll[:, s:e].astype(float))
        log_likelihood = np.log((part * share[:, d][:, None]).sum(0)).sum()
        assert abs(log_likelihood - (share[:, d] > 0).sum() * 0.5 * np.log(words[d] + 1) - value[d]) < 1e-3
        singles = np.log(part).sum(1).max() - 0.5 * np.log(words[d] + 1)
        assert value[d] >= singles - 1e-6


def test_odd_documents(spark, odd):
    model = language.fit(odd)
    assert model.langs == ("de", "en", "fr")
    rows = language.predict(odd, model, keep=("doc_id", "text", "score"), names=("l", "s", "sets")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["l"] == "und") == (not letters) and (r["s"] == 0) == (not letters)
    kept = language.reject(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r["l"] != "und" and r["s"] >= 0.34 for r in rows)


def test_nothing(spark, odd, none):
    model = language.fit(none)
    assert language.predict(none, model).count() == 0
    assert {r["lang_pred"] for r in language.predict(odd, model).collect()} == {"und"}


def test_sets_of_many_languages():
    """Ten languages with clear words of their own are all found, and stopping early changes nothing."""
    ll = np.full((12, 1000), -20, np.float32)
    ll[np.arange(1000) % 10, np.arange(1000)] = -1
    share, _ = language._mixtures(ll, np.array([1000]), 8)
    assert np.allclose(share[:10, 0], 0.1, atol=0.01) and (share[10:, 0] == 0).all()
    rng = np.random.default_rng(4)
    ll, words = rng.normal(0, 3, (12, 300)).astype(np.float32), np.array([100, 200])
    share, value = language._mixtures(ll, words, 8)
    for d, (s, e) in enumerate(((0, 100), (100, 300))):
        one, v = language._mixtures(ll[:, s:e], words[d : d + 1], 8)
        assert np.allclose(one[:, 0], share[:, d], atol=1e-5) and abs(v[0] - value[d]) < 1e-2


def test_clear_texts_need_no_mixture(monkeypatch):
    """Where the bound rules all mixtures out, none is fitted, and the result is that of fitting them all."""
    rng = np.random.default_rng(7)
    ll = rng.normal(-3, 1, (4, 500)).astype(np.float32)
    ll[1] += 3
    words = np.array([200, 300])
    called = []
    fitted = language._em
    monkeypatch.setattr(language, "_em", lambda *a: called.append(1) or fitted(*a))
    share, value = language._mixtures(ll, words, 8)
    assert not called and (share.argmax(0) == 1).all()
    for d, (s, e) in enumerate(((0, 200), (200, 500))):
        part = np.exp(ll[:, s:e].astype(float))
        for other in (0, 2, 3):
            for p in np.linspace(0.01, 0.99, 50):
                assert np.log(p * part[1] + (1 - p) * part[other]).sum() - np.log(words[d] + 1) < value[d]


def test_long_texts_in_pieces(spark):
    model = language.fit(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet"))
    columns = [np.ascontiguousarray(model.table[:, k]) for k in range(len(model.langs))]
    text = "the words of this one and der die das und ñandú, ça va! " * 50 + "x" * 500 + " end ü" * 30
    data = np.frombuffer(text.encode(), np.uint8)
    ll, words = language._words(data, np.array([0, len(data)]), columns)
    few, times = language._long(data, columns, 600)
    assert times.sum() == words[0] and few.shape[1] < 40
    for a, b in zip(language._mixtures(ll, words, 20), language._mixtures(few, np.array([few.shape[1]]), 20, times)):
        assert np.allclose(a, b, atol=1e-2)


def test_every_language_is_learned(spark):
    """One of many rows, one of a single long text, and hundreds of small ones."""
    rows = [(i, "many words here " * 20, "aa", None, 1) for i in range(400)] + [(1000, "seltene worte " * 5000, "bb", None, 1)] + [(2000 + i, chr(0x4E00 + i) * 5, f"l{i:03}", None, 1) for i in range(300)]
    docs = documents(spark, rows)
    model = language.fit(docs, train_chars=1000)
    assert len(model.langs) == 302
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs.where("doc_id >= 1000"), model).collect()}
    assert got[1000] == "bb" and sum(got[2000 + i] == f"l{i:03}" for i in range(300)) > 290
