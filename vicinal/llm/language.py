"""Language identification by a mixture over languages, fitted to each document.

Training counts hashed character n-grams (1 to 3, within words, lower case) for each language in
the labelled rows. Of every language about `train_chars` characters are learned from, in whole
texts picked by a hash of the id, and one text at least; that bound is a parameter of the fit, and
prediction reads all rows. Every language that a row is labelled with is learned, each with 256 KB
of the model.

Prediction takes the words of a whole text as draws from a mixture of languages. A word's
likelihood under a language is the product of those of its n-grams (tempered by 1 / n-grams of a
character, which overlap). Expectation-maximisation finds the proportions. The set of languages
is chosen by penalised likelihood: sets of the 1, 2, ... most probable languages are fitted, up to
all that were learned, and the one with the greatest log-likelihood less half of (its size x
log(words + 1)) is kept. The log-likelihood is concave, so its gradient at a point bounds what any
proportions reach: where that can't make up for the penalty at the best single language, no others
are fitted for the text, and later sizes end by the same bound.

Results: `lang_pred` is the language with the largest proportion (the first by name among
equals), `score` that proportion, `languages` the set with its proportions. A text that is null,
empty or without a letter is `und` with score 0, and so is every text if nothing was labelled.
Repeated rows give repeated results, an empty table an empty one; other columns are not read, and
may have any name. Long texts are read in pieces of PIECE bytes, cut at white space, and of their
words only the different ones are kept, with counts.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import PIECE, blocks, cuts
from .shared import map_batches

BUCKETS = 1 << 16


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    #: log-probabilities by bucket and language
    table: np.ndarray


@functools.cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point, whether it is a letter, and its lower case (itself if that is more than one)."""
    lower = np.arange(0x110000, dtype=np.uint32)
    letter = np.zeros(0x110000, bool)
    for c in range(0x323B0):  # no letters stand beyond this point
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        if x.isalpha():
            letter[c] = True
            if len(y := x.lower()) == 1:
                lower[c] = ord(y)
    return letter, lower


def grams(data: np.ndarray, at: np.ndarray):
    """Of each run of letters: its n-grams' buckets (three rows: 1, 2 and 3 characters; -1 where the run hasn't begun so long), the runs' starts, and the number of runs of each text."""
    letter, lower = _characters()
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars_at = lead[at]
    is_letter = letter[codes]
    fresh = np.zeros(len(codes), bool)
    fresh[chars_at[:-1][chars_at[:-1] < len(codes)]] = True
    kept = np.flatnonzero(is_letter)
    if not len(kept):
        return np.zeros((3, 0), np.int64), np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64)
    begins = np.ones(len(kept), bool)
    begins[1:] = (np.diff(kept) > 1) | fresh[kept[1:]]
    c = lower[codes[kept]]
    starts = np.flatnonzero(begins)
    place = np.arange(len(kept)) - np.repeat(starts, np.diff(np.append(starts, len(kept))))
    p1, p2 = np.concatenate([[0], c[:-1]]).astype(np.uint32), np.concatenate([[0, 0], c[:-2]])[: len(c)].astype(np.uint32)
    p1, p2 = np.where(place >= 1, p1, np.uint32(1)), np.where(place >= 2, p2, np.where(place == 1, np.uint32(1), np.uint32(2)))

    def bucket(x, salt):
        x = (x ^ np.uint32(salt)) * np.uint32(0x85EBCA6B)
        x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return ((x ^ (x >> np.uint32(16))) & np.uint32(BUCKETS - 1)).astype(np.int64)

    two = p1 * np.uint32(0x9E3779B1) + c
    three = (p2 * np.uint32(0x85EBCA77) + p1) * np.uint32(0x9E3779B1) + c
    out = np.stack([bucket(c, 0x3C6EF372), bucket(two, 0x1B873593), bucket(three, 0x52DCE729)])
    return out, starts, np.diff(np.searchsorted(kept[starts], chars_at))


def fit(docs: DataFrame, train_chars: int = 4_000_000) -> LanguageModel:
    """Learns from the rows of docs with a lang: columns doc_id, text, lang."""
    rows = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    # a row for each language
    sizes = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n"), F.min(part).alias("least")).collect()
    langs = tuple(sorted(r["lang"] for r in sizes))
    if not langs:
        return LanguageModel((), np.zeros((BUCKETS, 0), np.float32))
    # the text with the least hash is always learned from, so that no language goes without
    below = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], max(r["least"] + 1, int(min(1.0, train_chars / max(1, r["n"])) * (1 << 20))))))
    rows = rows.where(part < F.element_at(below, F.col("lang")))
    number = {lang: i for i, lang in enumerate(langs)}

    def count(batches):
        total = np.zeros((len(langs), BUCKETS), np.int64)
        for batch in batches:
            of = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for i, j, data, at in blocks(batch.column("text")):
                pieces = [(s, min(len(data), s + PIECE)) for s in range(0, len(data), PIECE)] if len(data) > PIECE else [(0, len(data))]
                for s, e in pieces:  # a long text stands alone
                    made, starts, words = grams(data[s:e], at if len(pieces) == 1 else np.array([0, e - s]))
                    runs = np.diff(np.append(starts, made.shape[1]))
                    lang = np.repeat(np.repeat(of[i:j], words), runs)
                    for row in made:
                        total += np.bincount(lang * BUCKETS + row, minlength=total.size).reshape(total.shape)
        if total.any():
            which, bucket = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[which, bucket], pa.int64())], ["l", "b", "n"])

    counted = map_batches(rows.select("text", "lang"), count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n"))
    got = counted.toArrow()  # at most languages x BUCKETS rows
    counts = np.full((BUCKETS, len(langs)), 0.5)
    counts[got["b"].to_numpy(), got["l"].to_numpy()] += got["n"].to_numpy()
    return LanguageModel(langs, np.log(counts / counts.sum(0)).astype(np.float32))


def _em(like: np.ndarray, times: np.ndarray, columns: np.ndarray, total: np.ndarray, allowed: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after some rounds from share, and the log-likelihood they reach above that of each word's best language."""
    starts, of = np.cumsum(columns) - columns, np.repeat(np.arange(len(columns)), columns)
    share = share * allowed
    share = share / np.maximum(share.sum(0), 1e-30)
    for _ in range(rounds):
        weighted = like * share[:, of]
        weighted *= times / np.maximum(weighted.sum(0), 1e-30)
        share = np.add.reduceat(weighted, starts, axis=1) / total
    mixed = np.maximum((like * share[:, of]).sum(0), 1e-30)
    return share, np.add.reduceat(np.log(mixed, dtype=np.float64) * times, starts)


def _mixtures(ll: np.ndarray, columns: np.ndarray, rounds: int, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and penalised log-likelihood of the chosen set of each text; ll: log-likelihoods by language and word, columns: the number of each text's, times: how often each occurs (once)."""
    n_lang, of = ll.shape[0], np.repeat(np.arange(len(columns)), columns)
    times = np.ones(ll.shape[1], np.float32) if times is None else times
    starts = np.cumsum(columns) - columns
    total = np.add.reduceat(times, starts, dtype=np.float64)
    top = ll.max(0)
    base = np.add.reduceat(top.astype(np.float64) * times, starts)
    single = np.add.reduceat(ll.astype(np.float64) * times, starts, axis=1)
    penalty = 0.5 * np.log(total + 1.0)
    first = single.argmax(0)
    best = np.zeros((n_lang, len(columns)))
    best[first, np.arange(len(columns))] = 1
    value = single.max(0) - penalty
    if n_lang == 1:
        return best, value
    # by concavity no proportions exceed the best language by more than this (but for rounding)
    own = ll[first[of], np.arange(len(of))]
    gain = np.add.reduceat(np.exp(np.minimum(ll - own, 60), dtype=np.float32) * times, starts, axis=1, dtype=np.float64).max(0) - total
    open_ = np.flatnonzero(gain + 1e-4 * total > penalty)
    if not len(open_):
        return best, value
    at = np.isin(of, open_)
    columns, total, base, penalty, times = columns[open_], total[open_], base[open_], penalty[open_], times[at]
    like = np.exp(ll[:, at] - top[at])
    starts, of = np.cumsum(columns) - columns, np.repeat(np.arange(len(columns)), columns)
    full, reached = _em(like, times, columns, total, np.ones((n_lang, len(columns))), np.full((n_lang, len(columns)), 1 / n_lang), rounds)
    # the same bound from the proportions of all languages
    gain = np.add.reduceat(like * (times / np.maximum((like * full[:, of]).sum(0), 1e-30)), starts, axis=1).max(0) / total
    most = base + reached + total * (np.log(np.maximum(gain, 1)) + 1e-4)
    order = np.argsort(np.argsort(-full, axis=0, kind="stable"), axis=0)
    for k in range(2, n_lang + 1):
        if not (most - k * penalty > value[open_]).any():
            break
        share, reached = _em(like, times, columns, total, (order < k).astype(np.float32), np.maximum(full, 1e-3), rounds)
        made = base + reached - k * penalty
        better = made > value[open_]
        best[:, open_[better]] = share[:, better]
        value[open_[better]] = made[better]
    return best, value


def _words(data: np.ndarray, at: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The log-likelihoods of every word by language, and the number of words of each text; columns: the model's, by language."""
    made, starts, words = grams(data, at)
    ll = np.empty((len(columns), len(starts)), np.float32)
    if len(starts):
        for k, column in enumerate(columns):
            ll[k] = np.add.reduceat((column[made[0]] + column[made[1]] + column[made[2]]) / np.float32(3), starts)
    return ll, words


def _long(data: np.ndarray, columns: list[np.ndarray], piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a long text read in pieces: the different log-likelihoods of its words, and how often each occurs. A run without white space is cut between characters."""
    ll, times = np.zeros((len(columns), 0), np.float32), np.zeros(0, np.int64)
    for s, e in cuts(data, piece):
        while s < e:
            x = min(e, s + piece)
            while x < e and data[x] & 0xC0 == 0x80:
                x += 1
            more, _ = _words(data[s:x], np.array([0, x - s]), columns)
            ll, at = np.unique(np.concatenate([ll, more], axis=1), axis=1, return_inverse=True)
            times = np.bincount(at.ravel(), weights=np.concatenate([times, np.ones(more.shape[1])]), minlength=ll.shape[1])
            s = x
    return ll, times.astype(np.float32)


def predict(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",), rounds: int = 8, names: tuple[str, str, str] = ("lang_pred", "score", "languages")) -> DataFrame:
    """keep columns, lang_pred, score and languages (the chosen set, largest first, as lang:proportion), or other names, for each row of docs."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema[c] for c in keep)), f"`{names[0]}` string, `{names[1]}` double, `{names[2]}` string"])
    langs = model.langs
    # the text goes to the workers once, be it kept or not
    text = "text" if "text" in keep else "__text"
    shared = docs.sparkSession.sparkContext.broadcast(model.table)  # BUCKETS x languages

    def run(batches):
        columns = [np.ascontiguousarray(shared.value[:, k]) for k in range(len(langs))]
        for batch in batches:
            n = batch.num_rows
            name, score, sets = ["und"] * n, np.zeros(n), [""] * n
            for i, j, data, at in blocks(batch.column(text)):
                if not langs:
                    break
                if len(data) > PIECE:
                    ll, times = _long(data, columns, PIECE)
                    words = np.array([ll.shape[1]])
                else:
                    (ll, words), times = _words(data, at, columns), None
                rows = np.flatnonzero(words)
                if not len(rows):
                    continue
                share, _ = _mixtures(ll, words[rows], rounds, times)
                for r, s in zip(rows + i, np.round(share.T, 6), strict=True):
                    order = sorted((x for x in range(len(langs)) if s[x] > 0), key=lambda x: (-s[x], langs[x]))
                    name[r], score[r], sets[r] = langs[order[0]], min(1.0, s[order[0]]), ",".join(f"{langs[x]}:{s[x]:.4f}" for x in order)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string())], [*keep, *names])

    return map_batches(docs.select(*keep, *([] if text in keep else [F.col("text").alias(text)])), run, schema)


def reject(docs: DataFrame, model: LanguageModel, least: float = 0.34) -> DataFrame:
    """The rows of docs whose language is known with a proportion of `least` or more, all columns unchanged."""
    own = ("__lang_pred", "__score", "__languages")
    judged = predict(docs, model, keep=tuple(docs.columns), names=own)
    return judged.where((F.col(own[0]) != "und") & (F.col(own[1]) >= least)).drop(*own)
