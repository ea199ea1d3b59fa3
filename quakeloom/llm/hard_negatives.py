"""Hard-negative mining with an inverted multi-index.

Vectors are cut into two halves, each half with a codebook of its own; a pair of codes is a cell. Within a shard of the
rows, an anchor visits cells by the sum of two half bounds (inner product with the half's centre, plus the anchor half's
length times the radius of the cluster there), which a heap of index pairs yields in falling order without listing all
sums. A visit ends once no cell left can hold a row that would change the answer: the k-th score found, or the window of
wanted scores, lies above the next bound. So each shard's answer is certified, and the shards' answers merge exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, scratch, table

POSITIVES, NEGATIVES = 5, 3
#: Share of the positive's score, in per cent, that a negative's score has at least and at most.
WINDOW = (50, 95)
#: Rows of which the codebooks are learned, codes of a half, rows of a shard, anchors of a block on average.
SAMPLE, CODES, SHARD, ANCHORS = 4096, 16, 16384, 2048
#: Rows scored at once on a visit.
BATCH = 1024


def valid_rows(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(uid, vec_id, label, q): rows with an id, a label and finite components only; q are the components times 256, rounded down."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & fine)
    return kept.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", F.transform("x", lambda v: F.floor(v * 256).cast("long")).alias("q"))


def matrix(lists: pd.Series, dims: int) -> np.ndarray:
    """The vectors as rows of whole numbers; shorter ones are filled up with zeros."""
    out = np.zeros((len(lists), dims), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def codebook(x: np.ndarray, codes: int, rounds: int = 12) -> np.ndarray:
    """Centres of x by Lloyd's rounds, from rows spread over the order of their first principal direction."""
    x = x.astype(float)
    if not len(x):
        return np.zeros((1, x.shape[1]))
    axis = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][0] if x.shape[1] else np.zeros(0)
    centres = x[np.argsort(x @ axis, kind="stable")[np.linspace(0, len(x) - 1, min(codes, len(x))).astype(int)]]
    for _ in range(rounds):
        of = nearest(x, centres)
        n = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * x @ centres.T, axis=1)


class MultiIndex:
    """The cells of one shard's rows."""

    def __init__(self, rows: pd.DataFrame, books: tuple[np.ndarray, np.ndarray]):
        self.books, self.cut = books, books[0].shape[1]
        dims = self.cut + books[1].shape[1]
        x = matrix(rows["q"], dims)
        halves = x[:, : self.cut].astype(float), x[:, self.cut :].astype(float)
        codes = [nearest(h, b) for h, b in zip(halves, books, strict=True)]
        label, vec_id = rows["label"].to_numpy(np.int64), rows["vec_id"].to_numpy(np.int64)
        order = np.lexsort((vec_id, label, codes[1], codes[0]))
        self.uid, self.vec_id, self.label = rows["uid"].to_numpy(np.int64)[order], vec_id[order], label[order]
        # whole numbers below 2 ** 53 in every sum are exact as doubles, which multiply faster
        top = int(np.abs(x).max(initial=0))
        self.exact = dims * top * top < 1 << 53
        self.top, self.x = top, x[order].astype(float) if self.exact else x[order].astype(object)
        cell = (codes[0] * len(books[1]) + codes[1])[order]
        self.first = np.searchsorted(cell, np.arange(len(books[0]) * len(books[1]) + 1))
        self.places, self.radius = np.arange(len(order)), []
        for h, b, c in zip(halves, books, codes, strict=True):
            far, r = np.sqrt(((h - b[c]) ** 2).sum(axis=1)), np.zeros(len(b))
            np.maximum.at(r, c, far)
            self.radius.append(r)

    def scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.exact and self.x.shape[1] * self.top * int(np.abs(q).max(initial=0)) < 1 << 53:
            return (self.x[at] @ q.astype(float)).astype(np.int64)
        return np.array([sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in self.x[at]], np.int64)

    def cells(self, q: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(first row, end, bound) of the cells with rows, by falling upper bounds of their rows' inner products with q."""
        bounds = []
        for h, b, r in zip((q[: self.cut].astype(float), q[self.cut :].astype(float)), self.books, self.radius, strict=True):
            u = b @ h + np.sqrt(h @ h) * r
            bounds.append(u + 1e-9 * np.abs(u) + 1e-6)
        by = [np.argsort(-u, kind="stable") for u in bounds]
        one, two = (u[o].tolist() for u, o in zip(bounds, by, strict=True))
        codes = by[0].tolist(), by[1].tolist()
        heap, seen = [(-(one[0] + two[0]), 0, 0)], [0] * len(one)  # seen: how many of a row's pairs have left the heap
        while heap:
            bound, i, j = heapq.heappop(heap)
            seen[i] = j + 1
            if i + 1 < len(one) and (j == 0 or seen[i + 1] == j):
                heapq.heappush(heap, (-(one[i + 1] + two[j]), i + 1, j))
            if j + 1 < len(two) and (i == 0 or seen[i - 1] > j + 1):
                heapq.heappush(heap, (-(one[i] + two[j + 1]), i, j + 1))
            cell = codes[0][i] * len(two) + codes[1][j]
            if self.first[cell] < self.first[cell + 1]:
                yield int(self.first[cell]), int(self.first[cell + 1]), -bound

    def visit(self, q: np.ndarray, stop: float, take: Callable[[np.ndarray, np.ndarray], float], fits: Callable[[np.ndarray], np.ndarray]) -> None:
        """Hands the rows that fit with their scores to take, batch by batch, while what is left may score `stop` or more; take returns the new `stop`."""
        held, n = [], 0
        for a, b, bound in self.cells(q):
            if bound < stop:
                break
            held.append(self.places[a:b])
            n += b - a
            if n >= BATCH:
                rows = np.concatenate(held)
                rows = rows[fits(rows)]
                stop = take(rows, self.scores(rows, q))
                held, n = [], 0
        if n:
            rows = np.concatenate(held)
            rows = rows[fits(rows)]
            take(rows, self.scores(rows, q))

    def best(self, at: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.uid[at], self.vec_id[at], -score))[:k]
        return at[order], score[order]

    def positives(self, q: np.ndarray, label: int, uid: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first k rows of the label other than uid: places and scores."""
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def take(at: np.ndarray, score: np.ndarray) -> float:
            found[:] = self.best(np.append(found[0], at), np.append(found[1], score), k)
            return found[1][-1] if len(found[0]) == k else -np.inf

        self.visit(q, -np.inf, take, lambda at: (self.label[at] == label) & (self.uid[at] != uid))
        return found[0], found[1]

    def negatives(self, q: np.ndarray, label: int, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (least, most) of scores, the first k rows of other labels with such scores."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        stops = [float(least) if least <= most else np.inf for least, most in windows]  # a window is settled once all that is left scores less

        def take(at: np.ndarray, score: np.ndarray) -> float:
            for i, (least, most) in enumerate(windows):
                ok = (score >= stops[i]) & (score <= most)
                if ok.any():
                    found[i] = self.best(np.append(found[i][0], at[ok]), np.append(found[i][1], score[ok]), k)
                    if len(found[i][0]) == k:
                        stops[i] = found[i][1][-1]
            return min(stops)

        if stops:
            self.visit(q, min(stops), take, lambda at: self.label[at] != label)
        return found


def learned_books(rows: DataFrame, dims: int, sample: int, codes: int) -> tuple[np.ndarray, np.ndarray]:
    """A codebook for each half, from the `sample` rows of the smallest hashes."""
    some = matrix(rows.orderBy(F.xxhash64("vec_id"), "uid").limit(sample).select("q").toPandas()["q"], dims)
    cut = (dims + 1) // 2
    return codebook(some[:, :cut], codes), codebook(some[:, cut:], codes)


def _dealt(anchors: DataFrame, shards: int) -> DataFrame:
    return anchors.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, sample: int = SAMPLE, codes: int = CODES, per_shard: int = SHARD) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows (vec_id, embedding, label) where is_anchor holds.

    is_anchor is a condition on vec_id. An anchor's positives are its first other rows of the same label; for each, the first
    rows of other labels whose score is within `window` per cent of the positive's are returned. Scores are inner products
    of floor(256 * x); higher first, ties by the smaller vec_id. Rows with a null id, label, vector or component, or with a
    component that is not finite, take no part. Rows of one vec_id are rows of their own, each one of the others' others.
    Vectors of different lengths count as filled up with zeros. Positives without negatives give no row, nor do empty tables.
    The codebooks come from `sample` rows; every row is in the index, and the result doesn't depend on the sample.
    """
    spark = rows.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    with scratch(spark):
        rows = materialize(valid_rows(rows), "vectors")
        n, dims, n_anchors = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("q")), F.lit(0)), F.count_if(is_anchor)).first()
        if not n_anchors:
            return spark.createDataFrame([], out)
        books = learned_books(rows, dims, sample, codes)
        shards, blocks = -(-n // per_shard), -(-n_anchors // ANCHORS)
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
        index = rows.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards))).withColumn("block", every)
        anchors = rows.filter(is_anchor).withColumn("block", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(blocks)))

        def find(part: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(part) and len(asked):
                cells = MultiIndex(part, books)
                for uid, label, q in zip(asked["uid"], asked["label"], matrix(asked["q"], dims), strict=True):
                    at, score = cells.positives(q, label, uid, positives)
                    found += zip([uid] * len(at), cells.uid[at], cells.vec_id[at], score, strict=True)
            return pd.DataFrame(found, columns=["uid", "pos", "positive_id", "positive_score"], dtype=np.int64)

        def reject(part: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(part) and len(asked):
                cells = MultiIndex(part, books)
                for uid, label, q, pos, scores in zip(asked["uid"], asked["label"], matrix(asked["q"], dims), asked["pos"], asked["scores"], strict=True):
                    windows = [(-(-window[0] * int(p) // 100), window[1] * int(p) // 100) for p in scores]
                    for p, (at, score) in zip(pos, cells.negatives(q, label, windows, negatives), strict=True):
                        found += zip([uid] * len(at), [p] * len(at), cells.uid[at], cells.vec_id[at], score, strict=True)
            return pd.DataFrame(found, columns=["uid", "pos", "neg", "negative_id", "negative_score"], dtype=np.int64)

        def first(df: DataFrame, by: list[str], score: str, ids: list[str], k: int) -> DataFrame:
            return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *ids))).filter(F.col("rank") <= k)

        parts = index.groupBy("shard", "block")
        found = parts.cogroup(_dealt(anchors, shards).groupBy("shard", "block")).applyInPandas(find, "uid long, pos long, positive_id long, positive_score long")
        found = materialize(first(found, ["uid"], "positive_score", ["positive_id", "pos"], positives).drop("rank"), "positives")
        asked = found.groupBy("uid").agg(F.collect_list(F.struct("pos", "positive_score")).alias("p")).select("uid", F.col("p.pos").alias("pos"), F.col("p.positive_score").alias("scores"))
        asked = materialize(anchors.join(asked, "uid"), "asked")
        worse = parts.cogroup(_dealt(asked, shards).groupBy("shard", "block")).applyInPandas(reject, "uid long, pos long, neg long, negative_id long, negative_score long")
        worse = first(worse, ["uid", "pos"], "negative_score", ["negative_id", "neg"], negatives)
        named = worse.join(found, ["uid", "pos"]).join(anchors.select("uid", F.col("vec_id").alias("anchor_id")), "uid")
        return materialize(named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "mined", keep=True)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", noisy.alias("label")), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) for x in embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0
),
a AS (SELECT * FROM v WHERE vec_id % 50 = 0),
s AS (SELECT a.uid AS a_uid, a.vec_id AS anchor_id, v.uid, v.vec_id, a.label = v.label AS same, list_inner_product(a.q, v.q)::BIGINT AS score FROM a JOIN v ON a.uid <> v.uid),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a_uid ORDER BY score DESC, vec_id, uid) AS r FROM s WHERE same) WHERE r <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.a_uid, p.uid ORDER BY s.score DESC, s.vec_id, s.uid)::INT AS rank
  FROM p JOIN s ON s.a_uid = p.a_uid AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLE_SQL = {"op13_hard_negatives": SQL}
