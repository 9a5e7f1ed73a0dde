"""Whole batches of texts as flat numpy arrays: word and shingle hashes without a Python loop over words."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes that are worked on at once; memory is some dozens of times that.
PIECE = 1 << 22
_PRIME = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_PRIME), -1, 1 << 64))
_WEIGHTS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=U)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_PRIME, _INVERSE)):
            x = np.full(max(n, 1 << 20), base, U)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0][:n], _powers[1][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes end to end and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def blocks(column: pa.Array, most: int = 1 << 19):
    """Runs of rows of about `most` bytes (a longer text stands alone): (first row, last row + 1, bytes, offsets from 0)."""
    data, at = utf8(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def _word_hashes(data: np.ndarray, at: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(at) - 1, np.int64)
    word = ~spaces(data)
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edge = at[(at > 0) & (at < n)]
    begins[edge] = word[edge]
    ends[edge - 1] = word[edge - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    plain = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data) if lower else data
    up, down = powers(n)
    sums = np.zeros(n + 1, U)
    np.cumsum((plain.astype(U) + U(1)) * up, out=sums[1:])
    h = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U) * U(0x632BE59BD9B4E019))
    return h, np.diff(np.searchsorted(s, at))


def spaces(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def cuts(data: np.ndarray, most: int):
    """A text's bytes in pieces of at most `most`, each but the last ending in white space; a run of `most` bytes or more without any stands alone, whole."""
    s, n = 0, len(data)
    while s < n:
        e = min(n, s + most)
        if e - s == most:
            found = np.flatnonzero(spaces(data[s:e]))
            if len(found):
                e = s + int(found[-1]) + 1
            else:
                while e < n and not (found := np.flatnonzero(spaces(data[e : e + most]))).size:
                    e = min(n, e + most)
                e = e + int(found[0]) if found.size else n
        yield s, e
        s = e


def word_hashes(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every run of other than ASCII white space, in order, and the number of such words of each text. Long texts go through in pieces of PIECE bytes."""
    if len(data) < PIECE:
        return _word_hashes(data, at, lower)
    made, counts = [], []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        text, n = data[s:e], 0
        for x, y in cuts(text, PIECE):
            if y - x >= PIECE and not spaces(text[x : x + PIECE]).any():  # a word of that length
                own = text[x:y]
                own = np.where((own >= 65) & (own <= 90), own + np.uint8(32), own) if lower else own
                h = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), U)
            else:
                h, _ = _word_hashes(text[x:y], np.array([0, y - x]), lower)
            made.append(h)
            n += len(h)
        counts.append(n)
    return np.concatenate(made) if made else np.zeros(0, U), np.array(counts, np.int64)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every k following words of a text (a text with fewer, but some, has one of them all), in order, and their number in each text."""
    n = len(words)
    of = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    if not n:
        return np.zeros(0, U), of
    first = np.cumsum(counts) - counts
    end = np.repeat(first + counts, of)
    start = np.repeat(first - (np.cumsum(of) - of), of) + np.arange(int(of.sum()))
    total = np.zeros(len(start), U)
    for t in range(k):
        at = start + t
        total += np.where(at < end, words[np.minimum(at, n - 1)] * _WEIGHTS[t % 5] * U(2 * (t // 5) + 1), U(0))
    return mix(total), of
