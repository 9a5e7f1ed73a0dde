import numpy as np
import pyarrow as pa

from vicinal.llm import arrays


def test_words_of_long_texts(monkeypatch):
    """Pieces of any size give the hashes of the whole, and words as long as a piece one of their own."""
    texts = ["alpha beta  gamma " * 30, "", "One\ntwo " * 50, " ", "x" * 150 + " y", "é ü " * 40]
    data, at = arrays.utf8(pa.array(texts))
    want = arrays._word_hashes(data, at, True)
    for piece in (200, 333, 1024):
        monkeypatch.setattr(arrays, "PIECE", piece)
        got = arrays.word_hashes(data, at)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    monkeypatch.setattr(arrays, "PIECE", 64)
    one, two = (arrays.word_hashes(*arrays.utf8(pa.array([t]))) for t in ("a b " + "x" * 150 + " y " + "w " * 50, "X" * 150 + " " + "c " * 90))
    assert one[1].tolist() == [54] and two[1].tolist() == [91] and one[0][2] == two[0][0]


def test_cuts_cover_the_text():
    rng = np.random.default_rng(1)
    for _ in range(200):
        data = rng.choice(np.frombuffer(b"abc \n", np.uint8), rng.integers(0, 200))
        parts = list(arrays.cuts(data, 16))
        assert b"".join(data[s:e].tobytes() for s, e in parts) == data.tobytes()
        # no word is cut
        assert all(arrays.spaces(data[e - 1 : e + 1]).any() for s, e in parts[:-1])


def test_ten_megabytes_in_little_memory():
    """A text of several pieces, between short ones; memory doesn't follow its length."""
    import tracemalloc

    long = "alpha Beta  gamma\n" * 600_000
    data, at = arrays.utf8(pa.array(["one two", long, "three"]))
    tracemalloc.start()
    h, counts = arrays.word_hashes(data, at)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    few, _ = arrays.word_hashes(*arrays.utf8(pa.array(["one two alpha beta gamma three"])))
    assert counts.tolist() == [2, 1_800_000, 1] and (h[:5] == few[:5]).all() and h[-1] == few[-1] and (h[2:-1].reshape(-1, 3) == few[2:5]).all()
    assert peak < 500e6
