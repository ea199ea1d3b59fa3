"""Rows of space held against those around them in vectors: tiles of bounded size as groups, so no pair becomes a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbors import XYZ, cells

PLACE = tuple(f"_{c}" for c in XYZ)


def tile_groups(rows: DataFrame, r: float, seq: tuple[str, ...] = (), block: int = 16_384, wide: int = 2) -> tuple[DataFrame, list[str]]:
    """rows (i, *seq, _own, _X, _Y, _Z and more) once for each group that they are in, with _mine, and the columns that tell groups apart.

    Space is cut into tiles of edge `wide` r, apart by `seq`. A tile's rows that are _own are held (_mine) against those of the tile and r
    around it, which are whole cells of edge r. A tile's own rows are dealt into parts of about `block` rows, those around into parts four times as
    large; each pair of parts is a group. A row is repeated for the parts of the other side, so small parts cost copies.
    Every pair of rows at most r apart is in one group, the first as _mine. Rows without a place or a value of `seq` are left out.
    """
    known = [f"abs(`{c}`) < double('Infinity')" for c in PLACE] + [f"`{c}` IS NOT NULL" for c in seq]
    more = [c for c in rows.columns if c not in ("_own", *seq)]
    cell, tile = ["_c0", "_c1", "_c2"], ["_t0", "_t1", "_t2"]
    rows = rows.filter(" AND ".join(known)).withColumns(dict(zip(cell, cells(PLACE, r), strict=True)))
    counts = rows.groupBy(*seq, *cell).agg(F.count(F.lit(1)).alias("_n"), F.count_if("_own").alias("_m"))
    for c, t in zip(cell, tile, strict=True):  # a cell at the side of its tile also borders the tile beyond
        own, at = F.expr(f"({c} - pmod({c}, {wide})) DIV {wide}"), F.pmod(c, F.lit(wide))
        beyond = F.when(at == wide - 1, F.array(own, own + 1)).when(at == 0, F.array(own, own - 1)).otherwise(F.array(own))
        counts = counts.withColumn(t, F.explode(beyond))
    counts = counts.withColumn("_home", F.expr(" AND ".join(f"{t} = ({c} - pmod({c}, {wide})) DIV {wide}" for c, t in zip(cell, tile, strict=True))))
    sizes = counts.groupBy(*seq, *tile).agg(F.sum(F.when(F.col("_home"), F.col("_m")).otherwise(0)).alias("_m"), F.sum("_n").alias("_n")).filter("_m > 0")
    sizes = sizes.select(*seq, *tile, F.ceil(F.col("_m") / block).alias("_p"), F.ceil(F.col("_n") / (4 * block)).alias("_q"))
    links = counts.drop("_n", "_m").join(sizes.hint("merge"), [*seq, *tile]).groupBy(*seq, *cell).agg(F.collect_list(F.struct(*tile, "_home", "_p", "_q")).alias("_to"))  # 8 at most
    met = rows.join(links.hint("merge"), [*seq, *cell]).withColumn("_to", F.explode("_to"))
    met = met.select(*seq, "_own", *more, *(F.col(f"_to.{c}").alias(c) for c in (*tile, "_home", "_p", "_q")))
    dealt = lambda n: F.pmod(F.xxhash64("i", *PLACE), F.col(n))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    other = F.transform(every("_p"), lambda p: F.struct(F.lit(False).alias("mine"), p.alias("p"), dealt("_q").alias("q")))
    mine = F.transform(every("_q"), lambda q: F.struct(F.lit(True).alias("mine"), dealt("_p").alias("p"), q.alias("q")))
    met = met.withColumn("_in", F.explode(F.when(F.col("_own") & F.col("_home"), F.concat(mine, other)).otherwise(other)))
    return met.select(*seq, *more, *tile, F.col("_in.p").cast("int").alias("_p"), F.col("_in.q").cast("int").alias("_q"), F.col("_in.mine").alias("_mine")), [*seq, *tile, "_p", "_q"]


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows, which come sorted by `by`, as tables of whole groups, each with the places where its groups start."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        if all(waiting[0][c][0] == batch[c][-1] for c in by):  # all of one group so far
            continue
        t = pa.Table.from_batches(waiting).combine_chunks()
        new = np.logical_or.reduce([pc.not_equal(t[c].slice(1), t[c].slice(0, t.num_rows - 1)).to_numpy() for c in by])
        starts = np.flatnonzero(np.r_[True, new])
        waiting = t.slice(int(starts[-1])).to_batches()  # more rows of the last group may follow
        yield t.slice(0, int(starts[-1])), starts[:-1]
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks(), np.array([0])


def small_cells(place: np.ndarray, r: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of places (n, 3) in the order of cells of edge r or a fraction of it, with about `most` rows or less each on average, and the
    places in that order where cells start. Cells run along the longest axis first."""
    axes = np.argsort(-np.ptp(place, axis=0))
    off = place[:, axes] - place[:, axes].min(axis=0)
    for level in range(24):
        cell = np.floor(off * (2 ** (level / 2) / r)).astype("int64")
        across = cell.max(axis=0) + 1
        code = (cell[:, 0] * across[1] + cell[:, 1]) * across[2] + cell[:, 2]
        if len(place) <= most * (1 + np.count_nonzero(np.diff(np.sort(code)))):
            break
    order = np.argsort(code, kind="stable")
    return order, np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])


def boxes(place: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest and highest place (cells, 3) of each cell of places in the order of cells."""
    return np.minimum.reduceat(place, starts, axis=0), np.maximum.reduceat(place, starts, axis=0)


def gaps(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The squared distances between one box and many that no pair of their rows is under, and that none is over, rounding included."""
    least, most = np.zeros(lows.shape[1]), np.zeros(lows.shape[1])
    for k in range(3):
        up, down = highs[k] - low[k], lows[k] - high[k]
        far, near = np.maximum(up, -down), np.maximum(np.maximum(down, -up), 0.0)
        least += near * near
        most += far * far
    return least, most


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    size = ends - starts
    return np.arange(size.sum()) + np.repeat(starts - np.r_[0, np.cumsum(size)[:-1]], size)
