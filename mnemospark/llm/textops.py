"""Small byte-level helpers that the document operators share.

``bytes.split`` without arguments splits at exactly ``[\\x20\\x09-\\x0D]`` and
``bytes.lower`` changes A-Z alone, which is what the contracts of this package
ask for; working on UTF-8 bytes also spares decoding every text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.session import materialize

#: Keys up to which a small side of a join is broadcast.
BROADCAST_KEYS = 500_000
BLANKS = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
#: A-Z to lower case, other ASCII that is no letter or digit to a blank.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def alnum_words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and any non-ASCII, A-Z lower-cased."""
    return text.translate(ALNUM).split()


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts of a string column as bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def code_points(text: bytes) -> int:
    return len(text.translate(None, CONTINUATION))


def word_ids(words: list[bytes]) -> np.ndarray:
    """Dense ids of the words of one text, in order of first use."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))


def map_batches(
    df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """Apply ``fn`` to the Arrow batches of the named columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):  # long texts: hold few at a time
                out = fn(batch.slice(start, 512))
                if out is not None and out.num_rows:
                    yield out

    return df.select(*columns).mapInArrow(run, schema)


def small_side(df: DataFrame, name: str, most: int = BROADCAST_KEYS) -> DataFrame:
    """A stored table of keys, marked for broadcast if it has ``most`` rows at most, else joined in a shuffle."""
    kept = materialize(df, name)
    return F.broadcast(kept) if kept.count() <= most else kept


def matched(docs: DataFrame, keys: list[Column], others: DataFrame, how: str, most: int = BROADCAST_KEYS) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose keys are (``left_semi``) or aren't (``left_anti``) among ``others``.

    Texts stay where they are as long as ``others`` is small; nulls match nulls.
    """
    side = small_side(others.toDF(*[f"k{i}" for i in range(len(keys))]).distinct(), "keys", most)
    on = [key.eqNullSafe(side[f"k{i}"]) for i, key in enumerate(keys)]
    return docs.join(side, on, how)


def without_keys(docs: DataFrame, keys: list[Column], others: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    return matched(docs, keys, others, "left_anti", most)
