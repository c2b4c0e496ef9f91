"""Hashed sparse embeddings, cosine, and random-projection buckets with multiprobing."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import QUERY_TOKEN, TOKEN_EDGES

# Index format of the projections.
DIMENSIONS, BANDS, BITS, SEED = 1024, 8, 8, 0xA11CE5
SPARSE = "array<struct<i:int,v:double>>"
_TOKEN = re.compile(QUERY_TOKEN)


def hashed_features(text: str, dimensions: int = DIMENSIONS) -> dict[int, float]:
    """Unit sparse vector of words and of character trigrams within padded words."""
    counts: Counter[int] = Counter()
    for found in _TOKEN.findall(text):
        word = found.casefold().strip(TOKEN_EDGES)
        if word:
            spaced = f"  {word} "
            for feature in [f"w:{word}", *(f"c:{spaced[k : k + 3]}" for k in range(len(spaced) - 2))]:
                counts[int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little") % dimensions] += 1
    norm = sum(n * n for n in counts.values()) ** 0.5
    return {i: n / norm for i, n in counts.items()}


def embed(text: Column, dimensions: int = DIMENSIONS, stored: bool = False) -> Column:
    """Sparse vector sorted by index; stored: values rounded to half precision, as an index keeps them."""

    @F.pandas_udf(SPARSE)
    def run(texts: pd.Series) -> pd.Series:
        kept = (lambda v: float(np.float16(v))) if stored else float
        return texts.map(lambda t: [{"i": i, "v": kept(v)} for i, v in sorted(hashed_features(t or "", dimensions).items())])

    return run(text)


def dot(a: Column, b: Column) -> Column:
    """Dot product of dense arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


@lru_cache
def signs(dimensions: int) -> np.ndarray:
    """The fixed matrix of -1 and +1, a row for each bit of each band."""
    return np.random.default_rng(SEED).choice(np.array((-1.0, 1.0), np.float32), size=(BANDS * BITS, dimensions))


def buckets(vector: Column, dimensions: int, sparse: bool = False) -> Column:
    """array<int> with a bucket a band: bit k is set if the band's projection k is not negative."""

    @F.pandas_udf("array<int>")
    def run(vectors: pd.Series) -> pd.Series:
        dense = np.zeros((len(vectors), dimensions))
        for row, v in zip(dense, vectors):
            if sparse:
                for x in v:
                    row[x["i"]] = x["v"]
            else:
                row[:] = v
        up = (dense @ signs(dimensions).T >= 0).reshape(-1, BANDS, BITS)
        return pd.Series(list((up * (1 << np.arange(BITS))).sum(2).astype(np.int32)))

    return run(vector)


def probe_masks() -> list[int]:
    """XOR masks of the probes of a band: the bucket itself, one bit flipped, two bits flipped."""
    one = [1 << i for i in range(BITS)]
    return [0, *one, *[a | b for i, a in enumerate(one) for b in one[i + 1 :]]]
