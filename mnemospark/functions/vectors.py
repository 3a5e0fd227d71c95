"""Vector functions. Spark has no vector built-ins here, so they are higher-order functions over arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.functions.strings import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for unequal lengths, empty vectors and zero norms."""
    scale = norm(a) * norm(b)
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (scale > 0)
    return F.coalesce(F.when(usable, dot(a, b) / scale), F.lit(0.0))


def l2(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x))


def l2_similarity(a: Column, b: Column) -> Column:
    """1 - distance, clamped to 0..1."""
    return F.least(F.greatest(1 - l2(a, b), F.lit(0.0)), F.lit(1.0))


def resample(a: Column, size: int) -> Column:
    """Truncate a longer vector; else interpolate linearly and scale to unit length."""
    n = F.size(a)
    at = lambda i: F.get(a, i).cast("double")

    def value(i: Column) -> Column:
        place = i * (n - 1) / F.lit(max(size - 1, 1))
        low = F.floor(place).cast("int")
        high = F.least(low + 1, n - 1)
        return at(low) * (1 - (place - low)) + at(high) * (place - low)

    wide = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), value)
    scaled = lambda w: let(norm(w), lambda length: F.when(length > 0, F.transform(w, lambda x: x / length)).otherwise(w))
    unit = let(wide, scaled)
    return F.when(n >= size, F.transform(F.slice(a, 1, size), lambda x: x.cast("double"))).otherwise(unit)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_blob(blobs: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to an array; no built-in reads floats from bytes."""
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


@F.pandas_udf(T.BinaryType())
def to_blob(vectors: pd.Series) -> pd.Series:
    """An array to little-endian float32 bytes."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def toy_embedding(texts: pd.Series) -> pd.Series:
    """A deterministic stand-in embedding of 384 numbers; needs 32-bit wrapping, which SQL lacks."""

    def one(text: str | None) -> np.ndarray:
        h = 0
        for unit in np.frombuffer((text or "").encode("utf-16-le"), "<u2").tolist():
            h = (h * 31 + unit) & 0xFFFFFFFF
        h = h - (1 << 32) if h >> 31 else h
        return np.fmod(np.sin(np.arange(384) * float(h)), 1.0)

    return texts.map(one)
