"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact shingle similarity.

Every item has a SimHash of its word shingles. In a document, each window of an item's length has one too. The
fingerprints' 64 bits are cut into blocks; if two fingerprints differ in at most `radius` bits, some block differs in at
most radius // blocks bits, so a table from each near value of each block to the items that have it finds every item
within the radius. The candidates' similarity is then computed exactly: the weighted Jaccard index of the shingles of
window and item, each weighted by how often it occurs.

Windows that share no shingle with any item have similarity zero, so their fingerprints aren't computed; this loses
nothing. Items go to the tasks in blocks of bounded size, however many there are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

WORD = re.compile(r"\w+")
SHINGLE, SIMILARITY = 5, 0.8
#: Blocks of a fingerprint and bits that a block may differ in; together they cover a radius of BLOCKS * (FLIPS + 1) - 1 bits.
BLOCKS, FLIPS = 6, 2
#: Items and bytes of item text that one pass over the documents broadcasts.
ITEMS, ITEM_BYTES = 20_000, 16 << 20


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingles(w: list[str], k: int) -> list[tuple]:
    return list(zip(*(w[i:] for i in range(k)), strict=False))


def shingle_bits(grams: list[tuple]) -> np.ndarray:
    """A row of +1 and -1 for the 64 hash bits of each shingle."""
    h = np.fromiter((xxhash.xxh64_intdigest("\x1f".join(g)) for g in grams), np.uint64, len(grams))
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def pack_bits(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard index: the sum of smaller over the sum of larger counts."""
    small = sum(min(n, b[g]) for g, n in a.items() if g in b)
    return small / (sum(a.values()) + sum(b.values()) - small)


class Index:
    """Items by shingle, and by near value of each fingerprint block."""

    def __init__(self, items: list[tuple[int, str]], shingle: int = SHINGLE, blocks: int = BLOCKS, flips: int = FLIPS):
        self.radius = blocks * (flips + 1) - 1
        self.bounds = [round(i * 64 / blocks) for i in range(blocks + 1)]
        self.ids, self.sizes, self.grams, prints = [], [], [], []
        self.by_gram: dict[int, dict[tuple, set]] = {}
        for item_id, text in items:
            w = words(text)
            if not w:
                continue
            k, at = min(shingle, len(w)), len(self.ids)
            grams = shingles(w, k)
            self.ids.append(item_id)
            self.sizes.append(len(w))
            self.grams.append(Counter(grams))
            prints.append(pack_bits(shingle_bits(grams).sum(axis=0, keepdims=True))[0])
            for g in grams:
                self.by_gram.setdefault(k, {}).setdefault(g, set()).add(at)
        self.prints = np.array(prints, np.uint64)
        self.near: list[dict[int, list[int]]] = [{} for _ in range(blocks)]
        for b in range(blocks):
            width = self.bounds[b + 1] - self.bounds[b]
            masks = [sum(1 << i for i in c) for n in range(flips + 1) for c in combinations(range(width), n)]
            for at, v in enumerate(self.block(self.prints, b).tolist()):
                for m in masks:
                    self.near[b].setdefault(v ^ m, []).append(at)

    def block(self, prints: np.ndarray, b: int) -> np.ndarray:
        width = self.bounds[b + 1] - self.bounds[b]
        return prints >> np.uint64(self.bounds[b]) & np.uint64((1 << width) - 1)

    def within(self, prints: np.ndarray) -> list[tuple[int, int, int]]:
        """(place in prints, item, distance) of every item within the radius."""
        found = set()
        for b in range(len(self.near)):
            for at, v in enumerate(self.block(prints, b).tolist()):
                found.update((at, i) for i in self.near[b].get(v, ()))
        if not found:
            return []
        at, item = np.array(sorted(found)).T
        d = np.bitwise_count(prints[at] ^ self.prints[item])
        keep = d <= self.radius
        return list(zip(at[keep].tolist(), item[keep].tolist(), d[keep].tolist(), strict=True))

    def matches(self, text: str | None, least: float = SIMILARITY) -> list[tuple]:
        """(item_id, start, n_words, distance, similarity) of each item's best window of at least that similarity."""
        w = words(text)
        best: dict[int, tuple] = {}
        for k, by_gram in self.by_gram.items():
            if len(w) < k or by_gram.keys().isdisjoint(zip(*(w[i:] for i in range(k)), strict=False)):
                continue
            grams = shingles(w, k)
            hits = [(p, by_gram[g]) for p, g in enumerate(grams) if g in by_gram]
            spots: dict[int, set[int]] = {}  # window length: starts of windows that hold a shared shingle
            for p, items in hits:
                for n in {self.sizes[i] for i in items}:
                    size = min(n, len(w))
                    spots.setdefault(size, set()).update(range(max(0, p + k - size), min(p, len(w) - size) + 1))
            for size, starts in spots.items():
                at = np.array(sorted(starts))
                low = at[0]
                sums = np.cumsum(np.vstack([np.zeros((1, 64), np.int32), shingle_bits(grams[low : at[-1] + size - k + 1])]), axis=0)
                prints = pack_bits(sums[at - low + size - k + 1] - sums[at - low])
                for j, i, d in self.within(prints):
                    if min(self.sizes[i], len(w)) != size or min(SHINGLE, self.sizes[i]) != k:
                        continue
                    s = similarity(Counter(grams[at[j] : at[j] + size - k + 1]), self.grams[i])
                    if s >= least and (i not in best or (-s, int(at[j])) < (-best[i][4], best[i][1])):
                        best[i] = (self.ids[i], int(at[j]), size, d, s)
        return [best[i] for i in sorted(best)]


def item_blocks(items: DataFrame, most: int = ITEMS, most_bytes: int = ITEM_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of at most `most` rows and about `most_bytes` of text (one longer item stands alone)."""
    rows = items.select(F.col("item_id").cast("long"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    held, size = [], 0
    for item_id, text in rows.orderBy("item_id", "text").toLocalIterator():
        if held and (len(held) == most or size + len(text) > most_bytes):
            yield held
            held, size = [], 0
        held.append((item_id, text))
        size += len(text)
    if held:
        yield held


def find(docs: DataFrame, items: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per document and item of `least` similarity or more: doc_id, item_id, start, n_words, distance, similarity.

    start and n_words (in words) give the best window, the leftmost of equals. Words are runs of letters, digits and
    underscores, lower-cased; items of fewer than five words count as one shingle. Null texts and items without words
    match nothing. Repeated rows of docs give one row; rows without a doc_id are left out. A document shorter than an
    item is one window. Empty tables give an empty result.
    """
    spark, schema = docs.sparkSession, "doc_id long, item_id long, start int, n_words int, distance int, similarity double"
    out = spark.createDataFrame([], schema)
    for block in item_blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = Index(shared.value)
            for pdf in batches:
                rows = [(doc_id, *m) for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True) for m in index.matches(text, least)]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "n_words", "distance", "similarity"])

        out = out.union(docs.select("doc_id", "text").filter("doc_id IS NOT NULL").mapInPandas(run, schema))
    first = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("similarity"), "start", "n_words")
    return out.withColumn("rank", F.row_number().over(first)).filter("rank = 1").drop("rank")


def remove(docs: DataFrame, items: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of docs whose document matches no item; rows without a doc_id go together, if any of them matches."""
    k = F.coalesce("doc_id", F.lit(-(2**63)))
    bad = materialize(find(docs.select(k.alias("doc_id"), "text"), items, least).select(F.col("doc_id").alias("k")).distinct(), "contaminated")
    return docs.select(F.struct("*").alias("doc"), k.alias("k")).join(bad, "k", "left_anti").select("doc.*")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_decontamination": op5_decontamination}
ORACLE_SQL: dict[str, str] = {}
