"""Vectors as array columns."""

from __future__ import annotations

import hashlib
import re
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 768
#: Texts whose vectors are made at a time, and grams whose places a task remembers.
SLICE, KNOWN = 512, 500_000
_TOKEN = re.compile("[a-z0-9€£%]+")


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector counts as of norm one."""
    norm = lambda v: F.sqrt(dot(v, v))
    n = norm(a) * norm(b)
    return dot(a, b) / F.when(n == 0, 1.0).otherwise(n)


def rescale(similarity: Column) -> Column:
    """Similarity .45 to .85 stretched over 0 to 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.greatest(F.lit(0.0), similarity) - 0.45) / 0.4))


def _hashed(size: int):
    """Vectors of each batch of (key, lower-case text); the places of grams are remembered, for most come again."""

    def run(batches):
        known: dict[str, tuple[int, float]] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                out = np.zeros((part.num_rows, size))
                for row, text in enumerate(part.column(1).to_pylist()):
                    tokens = _TOKEN.findall(text or "")
                    places, signs = [], []
                    for gram in chain(tokens, map("_".join, pairwise(tokens))):
                        if gram not in known:
                            if len(known) > KNOWN:
                                known.clear()
                            h = int.from_bytes(hashlib.md5(gram.encode(), usedforsecurity=False).digest())
                            known[gram] = h % size, 1.0 if h >> 20 & 1 else -1.0
                        place, sign = known[gram]
                        places.append(place)
                        signs.append(sign)
                    if places:
                        out[row] = np.bincount(places, signs, size)
                norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
                out /= np.where(norm == 0, 1, norm)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * size), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), vectors], names=["key", "vector"])

    return run


def hashed_embeddings(rows: DataFrame, key: str, text: str, size: int = SIZE) -> DataFrame:
    """(key, vector): signed counts of hashed tokens and bigrams, of length one (a text without tokens stays zero). Vectors are made where their text is read."""
    texts = rows.select(F.col(key).alias(key), F.lower(text).alias("_text"))
    return texts.mapInArrow(_hashed(size), f"key {texts.schema[key].dataType.simpleString()}, vector array<double>").withColumnRenamed("key", key)
