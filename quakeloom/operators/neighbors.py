"""Neighbour joins in space and time, on a grid: rows meet only in the cells around them, by an equi-join.

Dense cells are skewed keys; adaptive execution splits their partitions, as both sides are plain shuffles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut

XYZ = ("X", "Y", "Z")
#: Open rows from which knn() goes by tiles, whose plans are larger but whose candidates don't become rows.
MANY = 250_000


def cells(axes: tuple[str, ...], size: float) -> list[Column]:
    return [F.floor(F.col(c) / size).cast("long") for c in axes]


def _around(axes: tuple[str, ...], size: float, span: int = 1) -> Column:
    """Array of the cells at most `span` away in every axis."""
    offsets = F.array(*(F.lit(i).cast("long") for i in range(-span, span + 1)))
    out = F.transform(offsets, lambda i: F.struct((cells(axes, size)[0] + i).alias("c0")))
    for n in range(1, len(axes)):
        out = _extend(out, offsets, cells(axes, size)[n], n)
    return out


def _extend(out: Column, offsets: Column, here: Column, n: int) -> Column:
    def per(c: Column) -> Column:
        return F.transform(offsets, lambda i: F.struct(*(c[f"c{k}"].alias(f"c{k}") for k in range(n)), (here + i).alias(f"c{n}")))

    return F.flatten(F.transform(out, per))


def grid_pairs(probe: DataFrame, build: DataFrame, axes: tuple[str, ...], size: float, on: tuple[str, ...] = ()) -> DataFrame:
    """All pairs whose cells of edge `size` touch, with probe's columns as i_*, build's as j_*; equal in the columns `on`.

    A superset of the pairs at most `size` apart; the caller filters by distance. The probe side is repeated for the
    cells around it (3 per axis), the build side stays as it is. Neither is broadcast, whatever size is estimated.
    """
    names = [f"c{k}" for k in range(len(axes))]
    left = probe.select(*(F.col(c).alias(f"i_{c}") for c in probe.columns), *(F.col(c).alias(f"_on_{c}") for c in on), F.explode(_around(axes, size)).alias("_c"))
    left = left.select("*", *(F.col(f"_c.{c}").alias(f"_{c}") for c in names)).drop("_c")
    right = build.select(*(F.col(c).alias(f"j_{c}") for c in build.columns), *(F.col(c).alias(f"_on_{c}") for c in on), *(x.alias(f"_{c}") for c, x in zip(names, cells(axes, size), strict=True)))
    keys = [f"_{c}" for c in names] + [f"_on_{c}" for c in on]
    return left.join(right.hint("merge"), keys).drop(*keys)


def d2(axes: tuple[str, ...] = XYZ) -> Column:
    return sum(((F.col(f"j_{c}") - F.col(f"i_{c}")) * (F.col(f"j_{c}") - F.col(f"i_{c}")) for c in axes), F.lit(0.0))


def neighbor_pairs(cat: DataFrame, r: float, dt_h: float | None = None, key: str = "ID", seq: tuple[str, ...] = (), extra_build: DataFrame | None = None) -> DataFrame:
    """(i, j, dx, dy, dz, d2, dt_s, *seq): for each event all within r metres and dt_h hours, itself included.

    Hours are cut to whole ones, so the span reaches to the next full hour. extra_build: more points to be found (key
    of their event, X, Y, Z, Date, seq). A span under a year also keys the join by time.
    """
    t = F.unix_timestamp("Date").alias("_t")
    cols = [key, *XYZ, *seq]
    probe = cat.select(*cols, t)
    build = probe if extra_build is None else probe.unionByName(extra_build.select(*cols, t))
    most = None if dt_h is None else (math.floor(dt_h) + 1) * 3600
    axes = XYZ
    if most and most < 366 * 86_400:  # time as a fourth axis, in units in which the span is as long as r
        probe, build = (x.withColumn("_s", F.col("_t") * F.lit(r / most)) for x in (probe, build))
        axes = (*XYZ, "_s")
    pairs = grid_pairs(probe, build, axes, r, seq).withColumn("d2", d2()).filter(F.col("d2") <= r * r)
    dt = F.abs(F.col("j__t") - F.col("i__t"))
    if most:
        pairs = pairs.filter(dt < most)
    return pairs.select(F.col(f"i_{key}").alias("i"), F.col(f"j_{key}").alias("j"), *((F.col(f"j_{c}") - F.col(f"i_{c}")).alias(f"d{c.lower()}") for c in XYZ), "d2", dt.alias("dt_s"), *(F.col(f"i_{c}").alias(c) for c in seq))


def crowding(points: DataFrame, axes: tuple[str, ...], sizes: list[float]) -> list[float]:
    """For each cell size, the mean over rows of the number of rows in their own cell. sizes: each twice the one before."""
    fine = points.groupBy(*(c.alias(f"c{k}") for k, c in enumerate(cells(axes, sizes[0])))).agg(F.count(F.lit(1)).alias("n"))
    at = fine.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(sizes) - 1))).alias("level"))
    coarse = at.groupBy("level", *(F.expr(f"shiftright(c{k}, level)").alias(f"c{k}") for k in range(len(axes)))).agg(F.sum("n").alias("n"))
    found = {r["level"]: r["q"] for r in coarse.groupBy("level").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("q")).collect()}  # a row a size
    return [found[level] for level in range(len(sizes))]


def knn(points: DataFrame, k: int, key: str = "ID", axes: tuple[str, ...] = XYZ, start: float | None = None) -> DataFrame:
    """(i, j, d, rank 1 .. k): each row's k nearest others; ties by key. Rows with fewer than k others have them all.

    The search radius doubles from `start` for the rows that are not settled; in the end it spans all rows, so none stays
    open. By default it starts where a row's own cell holds about k rows on average, so dense parts, which hold most rows,
    meet few others each, and only sparse rows go on to larger cells.
    """
    from .nearest import nearest_within  # which needs this module

    n, *spread = points.agg(F.count(F.lit(1)), *(F.max(c) - F.min(c) for c in axes)).first()
    if n < 2:
        return points.select(F.col(key).alias("i"), F.col(key).alias("j"), F.lit(0.0).alias("d"), F.lit(1).alias("rank")).limit(0)
    k_eff = min(k, n - 1)
    spread = [max(float(s or 0), 1e-9) for s in spread]
    size = start or max(max(spread) / 1e6, (math.prod(spread) / n * (k_eff + 1)) ** (1 / len(axes)) / 2)
    if start is None:  # the mean spacing is a bound from above where rows cluster
        ladder = [size / 2**level for level in range(8, -1, -1)]
        size = max((s for s, q in zip(ladder, crowding(points, axes, ladder), strict=True) if q <= k_eff + 1), default=ladder[0])
    open_rows, done, left = points.select(key, *axes), None, n
    rank = Window.partitionBy("i").orderBy("d2", "j")
    while True:
        if left >= MANY and len(axes) <= 3:
            near = nearest_within(open_rows, points.select(key, *axes), axes, size, k_eff, key)
        else:
            near = grid_pairs(open_rows, points.select(key, *axes), axes, size).filter(F.col(f"i_{key}") != F.col(f"j_{key}"))
            near = near.select(F.col(f"i_{key}").alias("i"), F.col(f"j_{key}").alias("j"), d2(axes).alias("d2")).filter(F.col("d2") <= size * size)
        near = near.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k_eff)
        near = cut(near.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("i"))).filter(F.col("_n") == k_eff).drop("_n"))
        done = near if done is None else done.union(near)
        open_rows = cut(open_rows.join(near.filter("rank = 1").select(F.col("i").alias(key)), key, "left_anti"))
        left = open_rows.count()
        if not left:
            break
        size *= 2
    return done.select("i", "j", F.sqrt("d2").alias("d"), "rank")


def anisotropic_pairs(points: DataFrame, in_plane: float, out_of_plane: float, key: str = "ID", on: tuple[str, ...] = ()) -> DataFrame:
    """(i, j, dist): pairs of plane points with dist = max(in / in_plane, out / out_of_plane) at most 1.

    out is the distance along the mean of the two normals, in the rest. Normals: normal_vector_x, _y, _z.
    """
    n = [f"normal_vector_{c}" for c in "xyz"]
    bound = math.sqrt(in_plane**2 + out_of_plane**2)
    pairs = grid_pairs(points.select(key, *XYZ, *n, *on), points.select(key, *XYZ, *n, *on), XYZ, bound, on).filter(F.col(f"i_{key}") != F.col(f"j_{key}"))
    m = [(F.col(f"i_{c}") + F.col(f"j_{c}")) / 2 for c in n]
    size = F.sqrt(m[0] * m[0] + m[1] * m[1] + m[2] * m[2])
    along = sum(((F.col(f"j_{c}") - F.col(f"i_{c}")) * x for c, x in zip(XYZ, m, strict=True)), F.lit(0.0))
    out = F.abs(along) / size
    inside = F.sqrt(F.greatest(d2() - out * out, F.lit(0.0)))
    dist = F.greatest(inside / in_plane, out / out_of_plane)
    return pairs.filter(size > 0).withColumn("dist", dist).filter("dist <= 1").select(F.col(f"i_{key}").alias("i"), F.col(f"j_{key}").alias("j"), "dist", *(F.col(f"i_{c}").alias(c) for c in on))


def in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule: whether (x, y) lies inside the ring, an array of struct(x, y)."""
    n = F.size(ring)
    edges = F.transform(ring, lambda p, i: F.struct(p.x.alias("x1"), p.y.alias("y1"), F.get(ring, F.pmod(i + 1, n)).x.alias("x2"), F.get(ring, F.pmod(i + 1, n)).y.alias("y2")))
    crossed = F.filter(edges, lambda e: ((e.y1 > y) != (e.y2 > y)) & (x < (e.x2 - e.x1) * (y - e.y1) / (e.y2 - e.y1) + e.x1))
    return F.size(crossed) % 2 == 1


def _box_cut(e: Column, x: Column, y: Column, size: Column) -> Column:
    """Whether the line from (e.x1, e.y1) to (e.x2, e.y2) may touch the square of edge `size` whose lowest corner is (x, y)."""
    over = (F.least(e.x1, e.x2) <= x + size) & (F.greatest(e.x1, e.x2) >= x) & (F.least(e.y1, e.y2) <= y + size) & (F.greatest(e.y1, e.y2) >= y)
    across = F.abs((e.y2 - e.y1) * (x + size / 2 - e.x1) - (e.x2 - e.x1) * (y + size / 2 - e.y1))
    return over & (across <= (F.abs(e.x2 - e.x1) + F.abs(e.y2 - e.y1)) * size / 2 * (1 + 1e-9) + 1e-9)


def polygon_cells(domains: DataFrame, cells_across: int = 16) -> DataFrame:
    """(domain columns, level, cx, cy, inside): squares of edge 2 ** level that a domain's ring holds whole (inside), or cuts.

    A domain has its own level, at which it is at most cells_across squares wide, so it has at most (cells_across + 1) ** 2 of them.
    """
    box = {f"_{f}_{c}": F.expr(f"array_{f}(transform(ring, p -> p.{c}))") for f in ("min", "max") for c in "xy"}
    d = domains.withColumns(box)
    wide = F.greatest(F.col("_max_x") - F.col("_min_x"), F.col("_max_y") - F.col("_min_y"))
    d = d.filter(wide > 0).withColumn("level", F.ceil(F.log2(wide / cells_across)).cast("int"))
    d = d.withColumn("_size", F.pow(F.lit(2.0), F.col("level")))
    for c in "xy":
        d = d.withColumn(f"c{c}", F.explode(F.sequence(*(F.floor(F.col(f"_{f}_{c}") / F.col("_size")).cast("long") for f in ("min", "max")))))
    x, y = F.col("cx") * F.col("_size"), F.col("cy") * F.col("_size")
    n = F.size("ring")
    edges = F.transform("ring", lambda p, i: F.struct(p.x.alias("x1"), p.y.alias("y1"), F.get("ring", F.pmod(i + 1, n)).x.alias("x2"), F.get("ring", F.pmod(i + 1, n)).y.alias("y2")))
    d = d.withColumn("inside", ~F.exists(edges, lambda e: _box_cut(e, x, y, F.col("_size"))))
    half = F.col("_size") / 2
    return d.filter(~F.col("inside") | in_polygon(x + half, y + half, F.col("ring"))).drop("_size", *box)


def with_domain(events: DataFrame, domains: DataFrame, key: str = "ID") -> DataFrame:
    """events with the stress field of the first domain (by Domain) whose ring holds them, else null.

    Domains are cut into squares by their size, and events meet the squares that they lie in by an equi-join, once for each
    size in use. Only events in squares that the ring cuts are tested against the ring. Any number of domains will do.
    """
    fields = [c for c in domains.columns if c not in ("ring", "Domain")]
    d = cut(domains.withColumn("_id", F.xxhash64("Domain", "ring")).dropDuplicates(["_id"]))
    squares = cut(polygon_cells(d.select("_id", "ring")).select("_id", "level", "cx", "cy", "inside"))
    levels = [r["level"] for r in squares.select("level").distinct().collect()]  # one a power of two
    at = events.select(key, "X", "Y").withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    size = F.pow(F.lit(2.0), F.col("level"))
    met = at.withColumns({"cx": F.floor(F.col("X") / size).cast("long"), "cy": F.floor(F.col("Y") / size).cast("long")}).join(squares, ["level", "cx", "cy"]).select(key, "X", "Y", "_id", "inside")
    unsure = met.filter(~F.col("inside")).join(d.select("_id", "ring"), "_id").filter(in_polygon(F.col("X"), F.col("Y"), F.col("ring")))
    hit = met.filter("inside").select(key, "_id").union(unsure.select(key, "_id")).join(d.select("_id", "Domain", *fields), "_id")
    first = hit.groupBy(key).agg(F.min_by(F.struct("Domain", *fields), F.struct("Domain", "_id")).alias("_d"))
    return events.join(first, key, "left").select(*events.columns, *(F.col(f"_d.{c}").alias(c) for c in ("Domain", *fields)))
