"""The nearest rows within a distance, found in vectors by tiles: only a row's own nearest leave a task, no candidate pair becomes a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tiles import PLACE, ranges, tile_groups, whole_groups

#: Cells of the distance along a tile, and pairs looked at together.
WIDE, PAIRS = 8, 1_048_576


def _best(key: np.ndarray, mine: np.ndarray, place: np.ndarray, cell: np.ndarray, r: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other, d2): for each row of `mine` its k nearest other rows within r, ties by key. cell: (n, 4), the group, and the cell of edge r
    within the tile, from 1 for the tile's own cells."""
    code, wide = cell[:, 0], WIDE + 4
    for c in range(1, 4):
        code = code * wide + cell[:, c]
    probing, other = np.flatnonzero(mine), np.flatnonzero(~mine)
    other = other[np.argsort(code[other], kind="stable")]
    filled, found = code[other], []
    beside = code[probing][:, None] + np.array([x * wide * wide + y * wide for x in (-1, 0, 1) for y in (-1, 0, 1)])
    lo, hi = np.searchsorted(filled, beside - 1), np.searchsorted(filled, beside + 1, side="right")
    upto = np.cumsum((hi - lo).sum(axis=1))
    at = 0
    while at < len(probing):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
        a, b = np.repeat(probing[at:end], (hi - lo)[at:end].sum(axis=1)), other[ranges(lo[at:end].ravel(), hi[at:end].ravel())]
        g = [place[b, c] - place[a, c] for c in range(3)]
        d2 = g[0] * g[0] + g[1] * g[1] + g[2] * g[2]
        near = np.flatnonzero((d2 <= r * r) & (key[a] != key[b]))
        a, b, d2 = a[near], b[near], d2[near]
        order = np.lexsort((key[b], d2, a))
        a, b, d2 = a[order], b[order], d2[order]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, "int64")
        kept = np.flatnonzero(np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)])) < k)
        found.append((a[kept], b[kept], d2[kept]))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def nearest_within(open_rows: DataFrame, points: DataFrame, axes: tuple[str, ...], r: float, k: int, key: str, block: int = 65_536) -> DataFrame:
    """(i, j, d2): for each of open_rows (rows of points) its k nearest other points within r or, where a dense tile is cut into parts, those by part.

    At most three axes.
    """
    at = [*(F.col(c).cast("double") for c in axes), F.lit(0.0), F.lit(0.0)][:3]
    named = [F.col(key).alias("i"), *(x.alias(c) for x, c in zip(at, PLACE, strict=True))]
    rows = points.join(open_rows.select(key, F.lit(True).alias("_open")), key, "left").select(*named, F.coalesce("_open", F.lit(False)).alias("_own"))
    met, by = tile_groups(rows, r, (), block, WIDE)
    tile = ("_t0", "_t1", "_t2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, by):
            mine, place = t["_mine"].to_numpy(), np.stack([t[c].to_numpy() for c in PLACE], -1)
            if not mine.any() or mine.all():
                continue
            cell = np.floor(place / r).astype("int64") - np.stack([t[c].to_numpy() for c in tile], -1) * WIDE + 1
            group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, t.num_rows]))
            keys = t["i"].combine_chunks()
            keys = keys.to_numpy(zero_copy_only=False)
            if keys.dtype == object:
                keys = np.unique(keys, return_inverse=True)[1]
            a, b, d2 = _best(keys, mine, place, np.c_[group, cell], r, k)
            yield pa.RecordBatch.from_arrays([t["i"].take(pa.array(x)).combine_chunks() for x in (a, b)] + [pa.array(d2)], ["i", "j", "d2"])

    kind = dict(points.dtypes)[key]
    return met.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, f"i {kind}, j {kind}, d2 double")
