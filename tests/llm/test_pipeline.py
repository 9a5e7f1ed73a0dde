import hashlib

import numpy as np
import pytest

import corpus_pipeline
from tests.conftest import DATA
from tests.llm.conftest import documents
from tests.llm.test_bpe import whole
from tests.llm.test_mixing import brute as mixed
from tests.llm.test_near import brute as near
from tests.llm.test_pii import brute as private
from vicinal.llm import language, pii_crf
from vicinal.llm.shared import materialize


def plain(spark, docs):
    """The rows that the pipeline should make of documents, stage by stage, with the language model and the field as they are."""
    rows = docs.collect()
    model = language.fit(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"))
    judged = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    rows = [r for r in rows if judged[r["doc_id"]]["lang_pred"] != "und" and judged[r["doc_id"]]["score"] >= 0.34]
    classes = near([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if classes[r["doc_id"]] == r["doc_id"]]
    clean = []
    for r in rows:
        spans = private(r["text"])
        clean.append((r["doc_id"], pii_crf.masked(r["text"], spans + pii_crf.added_spans([r["text"]], [spans])[0]), r["source"]))
    sizes, _, _, taken = mixed(clean)
    out = []
    for (i, text, source), n, t in zip(clean, sizes, taken):
        ids = whole(text)
        out += [(i, source, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())] * int(t / n + 0.5 if n else 0)
    return sorted(out)


def test_run_against_plain_loops(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    got = corpus_pipeline.run(spark, f"{DATA}/sf0.001")
    assert sorted((r["doc_id"], r["source"], r["n_tokens"], r["ids_sha256"]) for r in got.collect()) == plain(spark, docs)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.count(), materialize(stage(spark, docs, f"{DATA}/sf0.001"), name)
        assert docs.columns == list(corpus_pipeline.COLUMNS) and docs.count() > 0.4 * before


@pytest.mark.parametrize("empty", [False, True])
def test_odd_documents(spark, odd, none, empty):
    docs = none if empty else odd
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""), "odd")
    assert (docs.count() == 0) == empty


def test_repeated_words_of_one_text(spark):
    rows = [(i, f"a text of seven words number {i % 2}", "en", "s", 9) for i in range(6)]
    docs = documents(spark, rows)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""), "few")
    assert {r["doc_id"] for r in docs.collect()} <= {0, 1}
