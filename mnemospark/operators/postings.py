"""Posting lists of a chunk of rows, read for a block of weighted wishes.

A wish is a list of features with weights, rarest first, of which it reads the first
few lists. What stands in one of these is weighed by all its features, so that the
weight of a row is known without looking at its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Features of the rows that are held together.
CHUNK = 1 << 20


class Wishes:
    """A block of wishes from rows (wish, place, feature, w, read, least), in any order.

    ``read`` says whether the list of this feature is read, ``least`` what a row must weigh.
    """

    def __init__(self, rows: pa.Table) -> None:
        rows = rows.sort_by([("wish", "ascending"), ("place", "ascending")]).combine_chunks()
        names = rows.column("wish").combine_chunks().dictionary_encode()
        self.names = names.dictionary
        self.starts = np.searchsorted(names.indices.to_numpy(), np.arange(len(self.names) + 1))
        features = rows.column("feature").combine_chunks().dictionary_encode()
        self.features, self.feature = features.dictionary, features.indices.to_numpy()
        self.weights = rows.column("w").to_numpy()
        read = np.concatenate([[0], np.cumsum(rows.column("read").to_numpy(zero_copy_only=False))])
        self.read = read[self.starts[1:]] - read[self.starts[:-1]]
        self.least = rows.column("least").to_numpy()[self.starts[:-1]]


class Lists:
    """The posting lists of rows of features, and the features of each row, both of a block's features only."""

    def __init__(self, features: pa.ListArray, wanted: pa.Array) -> None:
        sizes = np.asarray(features.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        known = pc.index_in(features.flatten(), value_set=wanted)
        held = np.asarray(known.is_valid().to_numpy(zero_copy_only=False), bool)
        self.feature = known.drop_null().to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)[held]
        self.starts = np.searchsorted(row, np.arange(len(sizes) + 1))
        order = np.argsort(self.feature, kind="stable")
        self.rows = row[order]
        self.lists = np.searchsorted(self.feature[order], np.arange(len(wanted) + 1))
        self.weight = np.zeros(len(wanted))

    def weighed(self, wishes: Wishes, number: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows in the lists that a wish reads, and what they weigh."""
        low = wishes.starts[number]
        read = wishes.feature[low : low + wishes.read[number]]
        found = [self.rows[self.lists[f] : self.lists[f + 1]] for f in read]
        rows = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        if not len(rows):
            return rows, np.empty(0)
        own = slice(low, wishes.starts[number + 1])
        self.weight[wishes.feature[own]] = wishes.weights[own]
        sizes = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(sizes)
        flat = np.repeat(self.starts[rows] - ends + sizes, sizes) + np.arange(ends[-1])
        total = np.add.reduceat(self.weight[self.feature[flat]], ends - sizes)
        self.weight[wishes.feature[own]] = 0
        return rows, total


def matches(batches: Iterator[pa.RecordBatch], wishes: Wishes, best: int | None) -> Iterator[pa.RecordBatch]:
    """(wish, raw, the other columns) of the rows (.., features) that weigh enough; with ``best``, of the heaviest of each chunk only."""

    def close(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        lists = Lists(rows.column("features").combine_chunks(), wishes.features)
        asked, at, raw, size = [], [], [], 0

        def made() -> pa.RecordBatch:
            kept = rows.drop_columns(["features"]).take(pa.array(np.concatenate(at))).combine_chunks()
            columns = [kept.column(c).combine_chunks() for c in kept.column_names]
            return pa.RecordBatch.from_arrays([wishes.names.take(pa.array(np.concatenate(asked))), pa.array(np.concatenate(raw)), *columns], ["wish", "raw", *kept.column_names])

        for number in np.flatnonzero(wishes.read):
            found, total = lists.weighed(wishes, number)
            enough = total >= wishes.least[number]
            found, total = found[enough], total[enough]
            if best is not None and len(found) > best:
                heavy = np.argpartition(-total, best)[:best]
                found, total = found[heavy], total[heavy]
            if len(found):
                asked.append(np.full(len(found), number))
                at.append(found)
                raw.append(total)
                size += len(found)
            if size > 10000:
                yield made()
                asked, at, raw, size = [], [], [], 0
        if size:
            yield made()

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += len(batch.column("features").flatten())
        if size >= CHUNK:
            yield from close(held)
            held, size = [], 0
    if held:
        yield from close(held)
