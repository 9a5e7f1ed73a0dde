import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import DATA
from vicinal.llm import bpe
from vicinal.llm.queries import TOKENIZER, op10_byte_bpe

PATH, PATTERN = public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN


def whole(text):
    return bpe.encoding(PATH, PATTERN).encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sAß文 \n\t\x1c\x85   1２.,!-_😀é\r"), max_size=60))
def test_pieces_encode_like_the_whole(text):
    ids = bpe.encode(text, PATH, PATTERN, piece_chars=3)
    assert ids.tolist() == whole(text)
    assert bpe.decode(ids, PATH, PATTERN, 2) == text.encode()


def test_long_texts():
    rng = random.Random(3)
    for text in (" ".join("".join(rng.choices("abcdé", k=rng.randint(1, 9))) for _ in range(60_000)), "word " * 100_000, "a1" * 60_000, " " * 200_000, "\n" * 9999 + "x"):
        assert bpe.encode(text, PATH, PATTERN).tolist() == whole(text)


def test_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    rows = op10_byte_bpe(spark, f"{DATA}/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = whole(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


@pytest.mark.parametrize("with_ids", [False, True])
def test_odd_documents(odd, none, with_ids):
    rows = bpe.tokenize(odd, PATH, PATTERN, keep=("doc_id", "text", "id"), with_ids=with_ids).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
        assert not with_ids or len(r["ids"]) == r["n_tokens"]
    assert bpe.tokenize(none, PATH, PATTERN, with_ids=with_ids).count() == 0
