"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut where every match of the pre-splitting pattern ends (such as before white
space that follows other characters), so pieces encode as the whole text would; pieces keep about
`piece_chars` characters and memory stays bounded for texts of any length. A null text counts
as empty: no ids, and the digests of no bytes. Repeated rows give repeated results; columns
other than the id and the text are not read. Ids are turned back into raw bytes, so that
characters whose bytes fall into different tokens come out whole.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_batches

#: No match of the pattern reaches over these: white space after other characters, and between ASCII letters, digits and the signs after them.
_EDGE = re.compile(r"(?<=\S)(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z0-9])(?=[!-/:-@\[-`{-~])")


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The tokenizer of a rank file (base64 token, space, rank), without special tokens; one per worker process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, piece_chars: int) -> Iterator[str]:
    """The text in pieces that end where no match of the pattern can go on; a stretch without such a place stays whole."""
    start = 0
    while len(text) - start > piece_chars:
        edge = _EDGE.search(text, start + piece_chars)
        if not edge:
            break
        yield text[start : edge.start()]
        start = edge.start()
    yield text[start:]


def encode(text: str, path: str, pattern: str, piece_chars: int = 50_000) -> np.ndarray:
    enc = encoding(path, pattern)
    parts = [enc.encode_ordinary(piece) for piece in pieces(text, piece_chars)]
    return np.fromiter((i for part in parts for i in part), dtype="<u4", count=sum(map(len, parts)))


def decode(ids: np.ndarray, path: str, pattern: str, piece_ids: int = 100_000) -> bytes:
    enc = encoding(path, pattern)
    return b"".join(enc.decode_bytes(ids[i : i + piece_ids].tolist()) for i in range(0, len(ids), piece_ids))


def tokenize(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False, piece_chars: int = 50_000) -> DataFrame:
    """keep columns, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int), for each row of docs."""
    fields = [docs.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_tokens long, ids_sha256 string, decoded_sha256 string", *(["ids array<int>"] if with_ids else [])])

    def run(batches):
        for batch in batches:
            n, sha, back, all_ids = [], [], [], []
            for text in batch.column("__text"):
                ids = encode(text.as_py() or "", path, pattern, piece_chars)
                n.append(len(ids))
                sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                back.append(hashlib.sha256(decode(ids, path, pattern)).hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
            made = [batch.column(c) for c in keep] + [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                made.append(pa.array(all_ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(made, [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])

    return map_batches(docs.select(*keep, F.col("text").alias("__text")), run, schema)
