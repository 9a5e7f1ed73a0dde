"""Quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded, and learned filters of WIDTH bytes run over the whole text.
Their rectified outputs are max-pooled over chunks of 2 x STRIDE bytes which overlap by half and
cover the text to its end; a linear layer makes each chunk's logit. The mean, least and greatest
logit of all chunks and the bytes missing to a full chunk, combined by a logistic layer, give one
probability. For scoring, the
filters' taps are tables of byte pairs, so the convolution is three look-ups a byte, and long
texts go through in slices of bounded size.

It is trained on a bounded sample of the labelled rows: of the documents that have a label and a
text of at most `train_bytes` bytes, the first `train_docs` by a hash of the id, as far as
`total_bytes` bytes of them reach, and up to `train_chunks` chunks of each, spread evenly. Scoring
reads every text whole, in slices. Null and empty texts are one chunk without
a byte and get its probability; without labels every score is 0.5. Rows whose label is null are
not learned from; rows that repeat get equal scores, an empty table gives an empty result; other
columns are not read, and may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import blocks
from .shared import map_batches

WIDTH, STRIDE, FILTERS, EMBEDDED = 6, 256, 32, 8
#: Strides of a slice: bounds the memory of a convolution.
SLICE = 256
#: Bytes of a text that go through at once.
LONG = 1 << 22


@dataclass
class Network:
    #: taps of byte pairs: WIDTH / 2 tables of 65,536 x FILTERS
    pairs: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float
    #: weights of mean, least and greatest logit, of shortness, and the constant
    head: np.ndarray
    blank: bool = False


def _maxima(data: np.ndarray, at: np.ndarray, net: Network) -> tuple[np.ndarray, np.ndarray]:
    """The greatest output of each filter in every stride of each text, and the number of strides of each."""
    sizes = np.diff(at)
    strides = np.maximum(1, -(-sizes // STRIDE))
    first = np.cumsum(strides) - strides
    total = int(strides.sum())
    flat = np.zeros(total * STRIDE + WIDTH, np.uint8)
    live = np.zeros(total * STRIDE, bool)
    place = np.repeat(first * STRIDE - at[:-1], sizes) + np.arange(at[0], at[-1])
    flat[place] = data
    # windows inside their text; a text of fewer bytes than a window has one, filled with zeros
    live[place[np.arange(at[0], at[-1]) <= np.repeat(at[1:] - WIDTH, sizes)]] = True
    live[first * STRIDE] = True
    most = np.zeros((total, FILTERS), np.float32)
    for s in range(0, total, SLICE):
        e = min(total, s + SLICE)
        low, high = s * STRIDE, e * STRIDE
        pair = flat[low : high + WIDTH - 1].astype(np.uint16) * np.uint16(256) + flat[low + 1 : high + WIDTH]
        n = high - low
        made = net.pairs[0][pair[:n]]
        for t in range(1, WIDTH // 2):
            made += net.pairs[t][pair[2 * t : 2 * t + n]]
        made[~live[low:high]] = -np.inf
        most[s:e] = made.reshape(e - s, STRIDE, FILTERS).max(1)
    return np.maximum(most + net.bias, 0), strides


def summaries(data: np.ndarray, at: np.ndarray, net: Network) -> np.ndarray:
    """Mean, least and greatest chunk logit, how much is missing to a full chunk, and 1, of each text."""
    if len(at) == 2 and at[1] - at[0] > LONG:
        # a long text in runs of strides, each with the bytes of the next one that its last windows reach
        n, parts = len(data), []
        for s in range(0, n, LONG):
            e = min(n, s + LONG)
            most, strides = _maxima(data[s : min(n, e + WIDTH - 1)], np.array([0, min(n, e + WIDTH - 1) - s]), net)
            parts.append(most[: -(-(e - s) // STRIDE)])
        if n % LONG and n % LONG < WIDTH:  # too short for a window of its own
            parts[-1][:] = 0
        most, strides = np.concatenate(parts), np.array([-(-n // STRIDE)])
    else:
        most, strides = _maxima(data, at, net)
    first = np.cumsum(strides) - strides
    chunks = np.maximum(1, strides - 1)
    start = np.repeat(first - (np.cumsum(chunks) - chunks), chunks) + np.arange(int(chunks.sum()))
    second = np.minimum(start + 1, np.repeat(first + strides - 1, chunks))
    made = np.maximum(most[start], most[second])
    logits = made.astype(np.float64) @ net.out + net.shift
    starts = np.cumsum(chunks) - chunks
    return np.stack([np.add.reduceat(logits, starts) / chunks, np.minimum.reduceat(logits, starts), np.maximum.reduceat(logits, starts), np.maximum(0, 1 - np.diff(at) / (2 * STRIDE)), np.ones(len(chunks))], axis=1)


def fit_network(texts: list[bytes], labels: np.ndarray, epochs: int = 6, batch: int = 128, train_chunks: int = 12, seed: int = 7) -> Network:
    """Adam on the log loss of chunks, where classes weigh alike, then Newton steps on that of whole texts, which gives probabilities as frequent as the labels are."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.5, (256, EMBEDDED)).astype(np.float32)
    taps = rng.normal(0, 1 / np.sqrt(WIDTH * EMBEDDED), (WIDTH, EMBEDDED, FILTERS)).astype(np.float32)
    params = {"embed": embed, "taps": taps, "bias": np.zeros(FILTERS, np.float32), "out": rng.normal(0, 0.1, FILTERS).astype(np.float32), "shift": np.zeros(1, np.float32)}
    size = 2 * STRIDE
    pieces, of = [], []
    for i, x in enumerate(texts):
        n = max(1, -(-len(x) // STRIDE) - 1)
        for c in np.unique(np.linspace(0, n - 1, min(n, train_chunks)).astype(int)):
            pieces.append(x[c * STRIDE : c * STRIDE + size + WIDTH - 1])
            of.append(i)
    of = np.array(of)
    lengths = np.array([len(x) for x in pieces])
    chunk_bytes = np.zeros((len(pieces), size + WIDTH - 1), np.uint8)
    for i, x in enumerate(pieces):
        chunk_bytes[i, : len(x)] = np.frombuffer(x, np.uint8)
    y = labels[of].astype(np.float32)
    weight = (1 / np.bincount(of, minlength=len(texts))[of]).astype(np.float32)
    for c in (0, 1):
        weight[y == c] *= 0.5 / max(weight[y == c].sum(), 1e-9)
    weight *= len(y)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for s in range(0, len(order), batch):
            rows = order[s : s + batch]
            b = chunk_bytes[rows]
            x = params["embed"][b]
            wide = np.concatenate([x[:, t : t + size] for t in range(WIDTH)], axis=2)
            conv = (wide.reshape(-1, WIDTH * EMBEDDED) @ params["taps"].reshape(WIDTH * EMBEDDED, FILTERS)).reshape(len(rows), size, FILTERS)
            conv[(np.arange(size)[None, :] > lengths[rows][:, None] - WIDTH) & (np.arange(size) > 0)[None, :]] = -np.inf
            arg = conv.argmax(1)
            top = np.take_along_axis(conv, arg[:, None, :], 1)[:, 0] + params["bias"]
            h = np.maximum(top, 0)
            logit = h @ params["out"] + params["shift"]
            d = weight[rows] * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[rows]) / len(rows)
            grads = {"out": h.T @ d + 1e-3 * params["out"], "shift": np.array([d.sum()], np.float32)}
            back = np.where(top > 0, d[:, None] * params["out"][None, :], 0)
            grads["bias"] = back.sum(0)
            # only the place of each maximum learns
            index = np.arange(len(rows))[:, None]
            window = np.stack([x[index, arg + t] for t in range(WIDTH)])
            back[~np.isfinite(top)] = 0
            grads["taps"] = np.einsum("tnfe,nf->tef", window, back).astype(np.float32)
            ge = np.zeros_like(embed)
            for t in range(WIDTH):
                np.add.at(ge, b[index, arg + t], back[..., None] * params["taps"][t].T[None])
            grads["embed"] = ge
            step += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                params[k] -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    tables = np.stack([params["embed"] @ params["taps"][t] for t in range(WIDTH)])
    pairs = np.stack([(tables[t][:, None, :] + tables[t + 1][None, :, :]).reshape(65536, FILTERS) for t in range(0, WIDTH, 2)]).astype(np.float32)
    net = Network(pairs, params["bias"], params["out"].astype(np.float64), float(params["shift"][0]), np.array([1.0, 0, 0, 0, 0]))
    made = []
    for i, j, data, at in blocks(pa.array([x.decode("utf-8") for x in texts]), 1 << 18):
        made.append(summaries(data, at, net))
    features = np.concatenate(made)
    w = np.full(len(labels), 1 / len(labels))
    scale = np.abs(features).max(0) + 1e-9
    z, head = features / scale, np.zeros(5)
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(z @ head, -30, 30)))
        grad = z.T @ (w * (p - labels)) + 1e-4 * head
        hess = (z * (w * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(5)
        head = head - np.linalg.solve(hess, grad)
    net.head = head / scale
    return net


def blank() -> Network:
    return Network(np.zeros((WIDTH // 2, 1, FILTERS), np.float32), np.zeros(FILTERS), np.zeros(FILTERS), 0.0, np.zeros(5), True)


def sample(docs: DataFrame, labels: DataFrame, train_docs: int, train_bytes: int, total_bytes: int) -> list[tuple[str, int]]:
    """The bounded sample (text, quality). Only ids and sizes are joined with the labels; texts are read of the chosen ones."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").alias("quality"))
    sized = docs.where("text is not null").select("doc_id", F.octet_length("text").alias("size")).where(F.col("size") <= train_bytes).groupBy("doc_id").agg(F.max("size").alias("size"))
    first = sized.join(known, F.col("doc_id") == F.col("labelled")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs).select("labelled", "quality", "size").collect()
    chosen, left = [], total_bytes
    for r in first:
        left -= r["size"]
        if left < 0:
            break
        chosen.append((r["labelled"], int(r["quality"])))
    if not chosen:
        return []
    picked = F.broadcast(docs.sparkSession.createDataFrame(chosen, f"labelled {docs.schema['doc_id'].dataType.simpleString()}, quality int"))  # at most train_docs rows
    # an id that repeats gives its least text
    rows = docs.where("text is not null").where(F.octet_length("text") <= train_bytes).join(picked, F.col("doc_id") == F.col("labelled"))
    got = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "quality").toArrow()
    return list(zip(got["text"].to_pylist(), got["quality"].to_pylist(), strict=True))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = 3_000, train_bytes: int = 1 << 18, total_bytes: int = 1 << 26, **options) -> Network:
    """Learns from docs (doc_id, text) and labels (doc_id, quality)."""
    rows = sample(docs, labels, train_docs, train_bytes, total_bytes)
    y = np.array([q for _, q in rows], int)
    if len(set(y.tolist())) < 2:
        return blank()
    return fit_network([x.encode() for x, _ in rows], y, **options)


def score(docs: DataFrame, net: Network, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.7) -> DataFrame:
    """keep columns, score and predicted for each row of docs (with text)."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema[c] for c in keep)), "score double, predicted int"])
    shared = docs.sparkSession.sparkContext.broadcast(net)  # 25 MB, whatever the data

    def run(batches):
        net = shared.value
        for batch in batches:
            p = np.full(batch.num_rows, 0.5)
            if not net.blank:
                for i, j, data, at in blocks(batch.column("__text"), 1 << 18):
                    p[i:j] = 1 / (1 + np.exp(-np.clip(summaries(data, at, net) @ net.head, -30, 30)))
            p = np.round(p, 6)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    return map_batches(docs.select(*keep, F.col("text").alias("__text")), run, schema)
