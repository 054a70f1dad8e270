"""Vector functions as Spark expressions, and the feature-hash embedding."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hireloom.functions.text import key_start, normalize_key_py, tokenize_py

DIM = 384


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """Unit vector; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; 0 if either vector is zero."""
    return F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), norm(a) * norm(b)))), F.lit(0.0))


#: Weights of the features, and how much of a text's key is read.
WORD, PAIR, TRIGRAM, KEY_CHARS = 1.0, 0.7, 0.35, 4000
#: Words and trigrams that a worker remembers at most; word pairs are mostly new, and are hashed where they occur.
MEMO = 250_000
_CELLS: dict[str, int] = {}


def signed_cells(features: list[str], dim: int = DIM) -> np.ndarray:
    """Cells of features, counted from 1, negative where their sign is: a 64-bit hash modulo the width, its top bit the sign."""
    digests = b"".join([blake2b(f.encode("utf-8", "replace"), digest_size=8).digest() for f in features])
    value = np.frombuffer(digests, ">u8").astype(np.uint64)
    return (value % np.uint64(dim) + np.uint64(1)).astype(np.int64) * np.where(value >> np.uint64(63), 1, -1)


def _known_cells(features: list[str], dim: int) -> np.ndarray:
    """`signed_cells` of distinct features; this worker hashes each once, as long as it remembers it."""
    if len(_CELLS) > MEMO:
        _CELLS.clear()
    known = _CELLS if dim == DIM else {}
    fresh = [f for f in features if f not in known]
    known.update(zip(fresh, signed_cells(fresh, dim).tolist()))
    return np.fromiter(map(known.__getitem__, features), np.int64, len(features))


def _trigram_cells(keys: list[str], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, signed cell) of the character trigrams of all keys."""
    points = np.frombuffer("".join(keys).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    size = np.array([len(k) for k in keys], dtype=np.int64)
    count = np.maximum(size - 2, 0)
    row = np.repeat(np.arange(len(keys)), count)
    at = np.arange(count.sum()) + np.repeat(np.cumsum(size) - size - (np.cumsum(count) - count), count)
    triples, back = np.unique(points[at] << 42 | points[at + 1] << 21 | points[at + 2], return_inverse=True)
    mask = (1 << 21) - 1
    names = ["c:" + chr(t >> 42) + chr(t >> 21 & mask) + chr(t & mask) for t in triples.tolist()]
    return row, _known_cells(names, dim)[back]


def _word_cells(tokens: list[list[str]], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, signed cell) of all words, and of all pairs of neighbouring words."""
    every = list(chain.from_iterable(tokens))
    words = list(dict.fromkeys(every))
    number = dict(zip(words, range(len(words))))
    ids = np.fromiter(map(number.__getitem__, every), np.int64, len(every))
    row = np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
    same = row[1:] == row[:-1]
    pairs, back = np.unique((ids[:-1] * len(words) + ids[1:])[same], return_inverse=True)
    first, second = np.divmod(pairs, max(len(words), 1))
    names = [f"b:{words[a]}_{words[b]}" for a, b in zip(first.tolist(), second.tolist())]
    return row, _known_cells(["w:" + w for w in words], dim)[ids], row[1:][same], signed_cells(names, dim)[back]


def embed_many(texts: list[str | None], dim: int = DIM, key_chars: int | None = KEY_CHARS) -> np.ndarray:
    """One row per text: signed hash of words, word pairs and the trigrams of its key (of all of it with `key_chars` None), dampened and of length 1."""
    keys = [normalize_key_py(t) if key_chars is None else key_start(t, key_chars) for t in texts]
    parts = [(*_trigram_cells(keys, dim), TRIGRAM)]
    word_row, word_cell, pair_row, pair_cell = _word_cells([tokenize_py(t or "") for t in texts], dim)
    parts += [(word_row, word_cell, WORD), (pair_row, pair_cell, PAIR)]
    row, cell = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    weight = np.repeat([p[2] for p in parts], [len(p[0]) for p in parts])
    out = np.bincount(row * dim + np.abs(cell) - 1, np.sign(cell) * weight, len(texts) * dim).reshape(len(texts), dim)
    out = np.sign(out) * np.log1p(np.abs(out))
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norms == 0, 1.0, norms)).astype(np.float32)


def embed_py(text: str | None, dim: int = DIM) -> np.ndarray:
    """`embed_many` for a driver-side query string."""
    return embed_many([text], dim)[0]


#: Texts, and about how many of their characters, whose features stand in memory at a time.
AT_ONCE, CHARS = 256, 1 << 20


def _steps(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in their order, a few at a time."""
    sizes = np.cumsum([len(t or "") for t in texts], dtype=np.int64)
    at = 0
    while at < len(texts):
        done = sizes[at - 1] if at else 0
        end = min(at + AT_ONCE, max(at + 1, int(np.searchsorted(sizes, done + CHARS, side="right"))))
        yield texts[at:end]
        at = end


def _embedding(key_chars: int | None):
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embedding(texts: pa.Array) -> pa.Array:
        # Short texts repeat: each distinct one of a batch is embedded once.
        held = texts.dictionary_encode(null_encoding="encode")
        vectors = [embed_many(some, key_chars=key_chars) for some in _steps(held.dictionary.to_pylist())]
        found = np.concatenate(vectors)[held.indices.to_numpy()] if vectors else np.zeros((0, DIM), np.float32)
        return pa.ListArray.from_arrays(np.arange(0, (len(found) + 1) * DIM, DIM, dtype=np.int32), found.reshape(-1))

    # Marked so that Spark doesn't make every vector once more for a filter on vectors.
    return embedding.asNondeterministic()


hash_embedding = _embedding(KEY_CHARS)
#: The same with the trigrams of the whole key; equal for texts whose key has no more than KEY_CHARS.
whole_embedding = _embedding(None)
