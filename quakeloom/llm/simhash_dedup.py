"""SimHash near-duplicate search with pigeonring filtering.

A fingerprint of 64 bits is cut into `segments` pieces that form a ring. If two fingerprints differ in at most
`radius` bits, some piece starts a chain in which the first l pieces together differ in at most
l * radius / segments bits, for every l up to the whole ring (the pigeonring principle). While that budget is
below one bit, the chain's pieces are equal, so they serve as an exact join key; the longer prefixes are
checked on the joined pairs before the full Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_heavy, materialize, table
from .components import components

BITS = 64
#: Shingles hashed at once; bounds the memory for one very long text.
CHUNK = 1 << 16


def majority(hashes: np.ndarray) -> np.ndarray:
    """Count of set bits at each of the 64 places over unsigned hashes (the lowest bit first)."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned SimHash of one text: a bit is set where over half of the shingles' XXH64 (seed 42) have it."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    k = min(shingle, len(words))
    n = len(words) - k + 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + k - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(k)), strict=False))
        ones += majority(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64))
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long. Null and blank texts have 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in pdf["text"]), np.uint64, len(pdf))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fp.view(np.int64)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, fp long")


def bounds(segments: int) -> list[int]:
    return [round(i * BITS / segments) for i in range(segments + 1)]


def chain_bits(i: int, length: int, segments: int) -> int:
    """Bits in the chain of `length` pieces that starts with piece i of the ring."""
    b = bounds(segments)
    return sum(b[(j % segments) + 1] - b[j % segments] for j in range(i, i + length))


def rotated(fp: str, start: int) -> str:
    return f"(shiftleft({fp}, {start}) | shiftrightunsigned({fp}, {BITS - start}))" if start else fp


def close_pairs(prints: DataFrame, radius: int = 2, segments: int = 5, bucket: int = 64) -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints at `radius` or fewer bits into the same components.

    prints: one row per distinct fp (long). Pairs within a bucket of equal chain keys are compared while the
    bucket has at most `bucket` fingerprints. Larger ones are linked through the words at one bit's distance
    instead, which is exact for a radius of 2: two fingerprints differ in at most two bits if and only if some
    word is within one bit of both. At most 65 fingerprints surround such a word, so this work is linear.
    """
    if radius != 2:
        raise ValueError("large buckets are linked exactly for radius 2 only")
    exact = next(n for n in range(segments, 0, -1) if n * radius < segments)
    b = bounds(segments)
    keys = ", ".join(f"struct({i} AS i, shiftrightunsigned({rotated('fp', b[i])}, {BITS - chain_bits(i, exact, segments)}) AS k)" for i in range(segments))
    keyed = prints.selectExpr("fp", f"explode(array({keys})) AS e").selectExpr("fp", "e.i AS i", "e.k AS k")
    sizes = keyed.groupBy("i", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialize(keyed.join(sizes, ["i", "k"]), "chains")
    small = shared.filter(F.col("n") <= bucket)
    pair = small.selectExpr("i", "k", "fp AS a").join(small.selectExpr("i", "k", "fp AS b"), ["i", "k"]).filter("a < b")
    chain = " ".join(
        f"WHEN {i} THEN " + " AND ".join(f"bit_count(shiftrightunsigned({rotated('(a ^ b)', b[i])}, {BITS - chain_bits(i, n, segments)})) <= {n * radius // segments}" for n in range(exact + 1, segments))
        for i in range(segments)
    )
    near = pair.filter(F.expr(f"CASE i {chain} END")).filter(F.expr(f"bit_count(a ^ b) <= {radius}")).select("a", "b")
    hot = shared.filter(F.col("n") > bucket).select("fp").distinct()
    around = hot.selectExpr("fp", f"explode(concat(array(fp), transform(sequence(0, {BITS - 1}), i -> fp ^ shiftleft(1L, i)))) AS word")
    ring = around.groupBy("word").agg(F.collect_set("fp").alias("fps")).filter("size(fps) > 1")
    linked = ring.selectExpr("array_min(fps) AS a", "explode(fps) AS b").filter("a <> b")
    return near.union(linked).distinct()


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2, segments: int = 5) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text, any other columns).

    component_id is the smallest doc_id reachable over links of `radius` or fewer differing bits, the
    document's own included. Null, empty and blank texts have fingerprint zero and are linked like any other;
    repeated rows are returned as often as they come; a null doc_id never becomes a component_id unless the
    whole component has no other. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    reps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = components(close_pairs(reps.select("fp"), radius, segments)).withColumnRenamed("node", "fp")
    rooted = reps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    group = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialize(rooted.join(group, "root").select("fp", "component_id", "n"), "classes")
    return join_heavy(prints, classes, "fp", "n").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


QUERIES = {"op4_simhash_dedup": op4_simhash_dedup}
ORACLE_SQL: dict[str, str] = {}
