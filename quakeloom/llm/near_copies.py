"""Near-duplicate documents: SimHash chains and a prefix join propose pairs, exact five-word-shingle similarity decides.

Two ways propose pairs. SimHash fingerprints of the shingles, joined by pigeonring chains (simhash_dedup), find most near
copies. A fingerprint can miss a pair at the threshold, so a prefix join completes the search: under one order of all
shingles, the first element that two sets with a Jaccard index of t or more share is, n the set's size, among the first
n - ceil(2t / (1 + t) n) + 1 of the smaller set and among the first n - ceil(t n) + 1 of the larger one. Shingles that are
common in a sample come last in the order, which makes the keys rare. Met pairs are dropped only where that is sure: by
sizes, by the places of the shared key, and by the parities of 1024 classes of shingles, of which each element in one set
alone changes one.

A key's texts are compared in blocks of fixed size. First each text is verified with its likeliest partner of the block
only, and what is near is united. What is left are pairs of different groups: those of keys with few texts are verified
one by one; of the other keys, the texts outside the key's largest group meet all texts of the key, block by block, each
block uniting as it goes. So every pair that may be near is decided, and no step returns a key's pairs.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_heavy, likely, materialize, scratch
from .components import components
from .simhash_dedup import close_pairs, majority

SHINGLE, SIMILARITY = 5, 0.8
#: Texts of a block, and texts of a key up to which its pairs are listed.
BLOCK, FEW = 256, 48
#: One in SAMPLE texts is counted for common shingles: those in COMMON of them, the LISTED most frequent.
SAMPLE, COMMON, LISTED = 8, 2, 1 << 18
#: 64-bit words of parities.
PARITIES = 16
#: Characters hashed at once; bounds the memory for one very long text.
CHUNK = 1 << 18

WORD = re.compile(r"\w+")
_FACTORS = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) & (2**64 - 1) | 1 for i in range(64)], np.uint64)
_BASE = 0xD6E8FEB86659FD93


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each code point belongs to words, and the powers of _BASE and of its inverse modulo 2 ** 64."""
    inside = np.zeros(0x110000, bool)
    for at in range(0, 0x110000, 4096):
        for m in WORD.finditer("".join(map(chr, range(at, at + 4096)))):
            inside[at + m.start() : at + m.end()] = True
    powers = (np.cumprod(np.append(np.uint64(1), np.full(CHUNK, x, np.uint64)), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 2**64)))
    return inside, *powers


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_BASE)
    return x ^ (x >> np.uint64(29))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word (run of letters, digits and underscores, lower-cased) in turn: the word's code points as digits
    of a number, taken as a difference of running sums over the text, and mixed."""
    inside, powers, inverse = _tables()
    low, out, at = (text or "").lower(), [], 0
    while at < len(low):
        code = np.frombuffer(low[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        edge = np.diff(np.concatenate([[False], inside[code], [False]]).view(np.int8))
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        step = len(code)
        if at + step < len(low) and len(end) and end[-1] == step and first[-1]:  # the last word may go on: it is left to the next chunk
            step, first, end = first[-1], first[:-1], end[:-1]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * powers[: len(code)], dtype=np.uint64)])
        out.append(mixed((sums[end] - sums[first]) * inverse[first]))
        at += int(step)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; a shorter text is one shingle, a text without words none.
    A word of over CHUNK characters counts as several."""
    h = word_hashes(text)
    if not len(h):
        return np.zeros(0, np.int64)
    k = min(shingle, len(h))
    n = len(h) - k + 1
    x = h[:n] * _FACTORS[0] + np.uint64(k)
    for i in range(1, k):
        x += h[i : i + n] * _FACTORS[i]
    x = np.sort(mixed(x).view(np.int64))
    return x[np.append(True, x[1:] != x[:-1])]


def shingled(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches with the shingle sets of their column text; few texts at a time are taken out of Arrow."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, [shingle_set(t.as_py()) for t in part.column("text")]


def lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))


def simhash(s: np.ndarray) -> int:
    """SimHash (signed) of a set of shingle hashes."""
    return int(np.packbits(2 * majority(s.view(np.uint64)) > len(s), bitorder="little").view("<i8")[0]) if len(s) else 0


def parities(s: np.ndarray) -> np.ndarray:
    """Whether the number of shingles is odd, in each of 64 * PARITIES classes. Two sets differ in as many elements at least as in bits."""
    odd = np.bincount((s.view(np.uint64) % np.uint64(64 * PARITIES)).view(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def prefix_length(n: int, least: float) -> int:
    """First elements of a set of n among which one is shared with any set that has `least` * n elements of it or more."""
    return min(n, n - math.ceil(least * n - 1e-9) + 1)


def short_length(n: int, least: float) -> int:
    """First elements of a set of n among which one is shared with any set of n elements or more and Jaccard index `least` or more."""
    return prefix_length(n, 2 * least / (1 + least))


def common_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of a sample of the texts, sorted, and in how many of them each occurs. They only set the order of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in shingled(batches):
            yield pa.RecordBatch.from_pydict({"s": np.concatenate(found)})

    some = rows.filter(F.pmod(F.xxhash64("own", F.lit(1)), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "s long")
    found = some.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "s").limit(LISTED).toArrow()
    s, n = found["s"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def keys(rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per row of rows (k, own, text): k, own, tid (own, but one value for all texts without words), n (shingles),
    fp (SimHash), par (parities) and keys (the prefix in order)."""
    shared = rows.sparkSession.sparkContext.broadcast(common_shingles(rows))

    def prefix(s: np.ndarray) -> np.ndarray:
        often, count = shared.value
        weight = np.zeros(len(s), np.int64)
        if len(often):
            at = np.minimum(np.searchsorted(often, s), len(often) - 1)
            weight = np.where(often[at] == s, count[at], 0)
        return s[np.lexsort((s, weight))][: prefix_length(len(s), least)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in shingled(batches):
            own, n = part.column("own").to_numpy(), np.array([len(s) for s in found], np.int32)
            cols = {"k": part.column("k"), "own": own, "tid": np.where(n > 0, own, 0), "n": n, "fp": np.array([simhash(s) for s in found], np.int64)}
            yield pa.RecordBatch.from_pydict(cols | {"par": pa.array([parities(s).tobytes() for s in found], pa.binary()), "keys": lists([prefix(s) for s in found])})

    return rows.select("k", "own", "text").mapInArrow(run, "k long, own long, tid long, n int, fp long, par binary, keys array<long>")


def meetings(texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(c, m, tid, n, pos, short): keys that pairs may share, with each of the key's m texts; pos is the key's place
    there and short says that it is among the first that a larger set would share. texts: one row per text of keys()."""
    short = F.col("pos") < F.expr(f"n - ceil({2 * least / (1 + least)!r}D * n - 1e-9D) + 1")
    flat = texts.select("tid", "n", F.posexplode("keys").alias("pos", "c")).withColumn("short", short)
    shared = flat.groupBy("c").agg(F.count(F.lit(1)).alias("m"), F.max("short").alias("any")).filter("m > 1 AND any").select("c", "m")
    shared = materialize(shared, "shared")
    held = materialize(likely(flat, shared, ["c"]), "likely")  # so that frequent keys are taken out after the bitmap, not before
    return materialize(join_heavy(held, shared, "c", "m"), "meetings")


class Members:
    """Texts of some keys as arrays, with the sure bounds on pairs of them."""

    def __init__(self, pdf: pd.DataFrame, least: float):
        self.least, self.tid = least, pdf["tid"].to_numpy(np.int64)
        self.n, self.pos = pdf["n"].to_numpy(np.int64), pdf["pos"].to_numpy(np.int64)
        self.short, self.g = pdf["short"].to_numpy(bool), pdf["g"].to_numpy(np.int64)
        self.par = np.frombuffer(b"".join(pdf["par"]), np.uint64).reshape(len(pdf), PARITIES)

    def slack(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of places: how far the parities are from ruling it out, relative to the bound; below 0 if ruled out."""
        t, na, nb = self.least, self.n[i], self.n[j]
        need = np.ceil(t / (1 + t) * (na + nb) - 1e-9)
        ok = (self.g[i] != self.g[j]) & (na - self.pos[i] >= need) & (nb - self.pos[j] >= need) & np.where(na < nb, self.short[i], np.where(na > nb, self.short[j], self.short[i] | self.short[j]))
        most = (1 - t) / (1 + t) * (na + nb) + 1e-6
        ok &= np.abs(na - nb) <= most
        out, at = np.full(len(ok), -1.0), np.flatnonzero(ok)
        if len(at):
            i, j = np.broadcast_to(i, ok.shape)[at], np.broadcast_to(j, ok.shape)[at]
            out[at] = 1 - np.bitwise_count(self.par[i] ^ self.par[j]).sum(axis=1, dtype=np.int64) / most[at]
        return out


def whole_blocks(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    """The batches of a table sorted by names, cut so that rows of equal names stay together; blocks are of bounded size."""
    held = None
    for pdf in batches:
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(held):
            continue
        last = (held[names] == held[names].iloc[-1]).all(axis=1).to_numpy()
        cut = len(held) - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield held.iloc[:cut].reset_index(drop=True)
            held = held.iloc[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def lags(pdf: pd.DataFrame, names: list[str]) -> Iterator[tuple[np.ndarray, int]]:
    """(places, lag): all places i where i and i + lag are in one block, for lags from 1 on."""
    block = np.cumsum(np.append(False, (pdf[names].iloc[1:].to_numpy() != pdf[names].iloc[:-1].to_numpy()).any(axis=1)))
    last = np.searchsorted(block, block, side="right") - 1
    i = np.arange(len(block))
    lag = 1
    while len(i := i[i + lag <= last[i]]):
        yield i, lag
        lag += 1


def likeliest(met: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b): each text of a block with the partner that its parities leave most room for. Keys of over BLOCK texts are
    dealt into blocks, each key in its own way."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_blocks(batches, ["c", "block"]):
            x = Members(pdf.assign(g=pdf["tid"]), least)
            best, with_ = np.full(len(pdf), -0.5), np.zeros(len(pdf), np.int64)
            for i, lag in lags(pdf, ["c", "block"]):
                s = x.slack(i, i + lag)
                for at, other in ((i, i + lag), (i + lag, i)):
                    better = s > best[at]
                    best[at[better]], with_[at[better]] = s[better], other[better]
            i = np.flatnonzero(best >= 0)
            a, b = x.tid[i], x.tid[with_[i]]
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    dealt = met.withColumn("block", F.when(F.col("m") > BLOCK, F.pmod(F.xxhash64("tid", "c"), F.ceil(F.col("m") / BLOCK))).otherwise(F.lit(0)))
    dealt = dealt.join(texts.select("tid", "par"), "tid")
    return dealt.repartition("c", "block").sortWithinPartitions("c", "block").mapInPandas(run, "a long, b long").distinct()


def open_meetings(met: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of met, with g (its text's group), of keys whose texts are in several groups; major: in the key's largest one."""
    grouped = materialize(met.join(roots.select(F.col("node").alias("tid"), F.col("root").alias("g")), "tid", "left").withColumn("g", F.coalesce("g", "tid")), "grouped")
    sizes = grouped.groupBy("c", "g").agg(F.count(F.lit(1)).alias("own"))
    top = sizes.groupBy("c").agg(F.max(F.struct("own", "g")).alias("top"), F.count(F.lit(1)).alias("groups"), F.sum("own").alias("m")).filter("groups > 1")
    top = materialize(top.select("c", "m", F.col("top.own").alias("own"), F.col("top.g").alias("top")), "open_keys")
    return materialize(join_heavy(grouped.drop("m"), top, "c", "m").withColumn("major", F.expr("g = top")).drop("top"), "open")


def listed(met: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b): all pairs of different groups in a key that may be near; for keys of few texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_blocks(batches, ["c"]):
            x = Members(pdf, least)
            for i, lag in lags(pdf, ["c"]):
                i = i[x.slack(i, i + lag) >= 0]
                if len(i):
                    a, b = x.tid[i], x.tid[i + lag]
                    yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return met.join(texts.select("tid", "par"), "tid").repartition("c").sortWithinPartitions("c").mapInPandas(run, "a long, b long").distinct()


def blocks_against(met: DataFrame, texts: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) that unite all near pairs of different groups in keys of many texts: the texts outside a key's largest
    group, in blocks, against all texts of the key, in blocks. A pair is compared unless its block has united it."""
    light = met.select("c", "tid", "n", "pos", "short", "g", "major", F.ceil(F.col("m") / BLOCK).alias("nb"), F.ceil((F.col("m") - F.col("own")) / BLOCK).alias("nm"))
    at = lambda salt, n: F.pmod(F.xxhash64("tid", "c", F.lit(salt)), F.col(n))
    minor = light.filter("NOT major").withColumn("i", at(1, "nm")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    every = light.withColumn("j", at(2, "nb")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nm") - 1)))
    both = minor.withColumn("probe", F.lit(True)).unionByName(every.withColumn("probe", F.lit(False)))
    whole = sets(met.select("tid"), texts, rows).join(texts.select("tid", "par"), "tid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_blocks(batches, ["c", "i", "j"]):
            cuts = np.flatnonzero((pdf[["c", "i", "j"]].iloc[1:].to_numpy() != pdf[["c", "i", "j"]].iloc[:-1].to_numpy()).any(axis=1)) + 1
            found: list[tuple[int, int]] = []
            for first, end in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
                part = pdf.iloc[first:end]
                x, s = Members(part, least), list(part["s"])
                probe = part["probe"].to_numpy(bool)
                other = np.flatnonzero(~probe)
                for i in np.flatnonzero(probe):
                    slack = x.slack(np.full(len(other), i), other)
                    for j in other[np.argsort(-slack, kind="stable")][: int((slack >= 0).sum())]:
                        if x.g[i] != x.g[j] and near(s[i], s[j], least):
                            found.append((min(x.tid[i], x.tid[j]), max(x.tid[i], x.tid[j])))
                            x.g[x.g == x.g[j]] = x.g[i]
            yield pd.DataFrame(found, columns=["a", "b"])

    return both.join(whole, "tid").repartition("c", "i", "j").sortWithinPartitions("c", "i", "j").mapInPandas(run, "a long, b long").distinct()


def near(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have a Jaccard index of `least` or more."""
    same = len(np.intersect1d(x, y, assume_unique=True))
    return same >= least * (len(x) + len(y) - same)


def sets(ids: DataFrame, texts: DataFrame, rows: DataFrame) -> DataFrame:
    """(tid, s): the shingle sets of the texts named in ids (tid), each from its first document."""
    wanted = materialize(texts.join(ids.distinct(), "tid").select("tid", F.col("first.k").alias("k"), F.col("first.own").alias("own")), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in shingled(batches):
            yield pa.RecordBatch.from_pydict({"tid": part.column("tid"), "s": lists(found)})

    found = likely(rows, wanted, ["k", "own"]).join(wanted, ["k", "own"]).select("tid", "text").mapInArrow(run, "tid long, s array<long>")
    return materialize(found.dropDuplicates(["tid"]), "shingles")


def verified(pairs: DataFrame, texts: DataFrame, rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard index of `least` or more."""
    whole = sets(pairs.select(F.explode(F.array("a", "b")).alias("tid")), texts, rows)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = np.fromiter((near(x, y, least) for x, y in zip(pdf["sa"], pdf["sb"], strict=True)), bool, len(pdf))
            yield pdf.loc[ok, ["a", "b"]]

    both = pairs.join(whole.select(F.col("tid").alias("a"), F.col("s").alias("sa")), "a").join(whole.select(F.col("tid").alias("b"), F.col("s").alias("sb")), "b")
    return both.mapInPandas(check, "a long, b long")


def chained(texts: DataFrame) -> DataFrame:
    """(a, b): pairs of texts whose fingerprints are linked by pigeonring chains; one of a fingerprint's texts stands for all."""
    reps = materialize(texts.groupBy("fp").agg(F.min("tid").alias("rep"), F.count(F.lit(1)).alias("size")), "prints")
    same = join_heavy(texts.select("tid", "fp"), reps.filter("size > 1"), "fp", "size").filter("tid <> rep").select(F.col("rep").alias("a"), F.col("tid").alias("b"))
    linked = close_pairs(reps.select("fp"))
    for x in "ab":
        linked = linked.join(reps.select(F.col("fp").alias(x), F.col("rep").alias(f"_{x}")), x)
    return same.union(linked.select(F.least("_a", "_b"), F.greatest("_a", "_b")))


def near_roots(texts: DataFrame, rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """components() over all pairs of texts of Jaccard index `least` or more: (node, root)."""
    met = meetings(texts, least)
    pairs = materialize(chained(texts).union(likeliest(met, texts, least)).distinct(), "pairs")
    roots = components(materialize(verified(pairs, texts, rows, least), "near"))
    left = open_meetings(met, roots)
    pairs = materialize(listed(left.filter(F.col("m") <= FEW), texts, least), "pairs")
    more = [verified(pairs, texts, rows, least)] if pairs.count() else []
    many = left.filter(F.col("m") > FEW)
    if not many.isEmpty():
        more.append(blocks_against(many, texts, rows, least))
    for edges in more:
        edges = materialize(edges, "near")
        if not edges.isEmpty():
            roots = components(edges.union(roots.selectExpr("node", "root")))
    return roots


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs (doc_id, text, any other columns) with one row of each group of near copies: that of the smallest doc_id.

    Groups are the components over pairs of five-word-shingle Jaccard index `least` or more. Equal texts and texts
    without words are one another's copies; a null doc_id comes before all others. Of repeated rows one stays. Other
    columns may have any names. An empty table gives an empty result. Texts and shingles are told apart by 64-bit hashes.
    """
    keyed = docs.select(F.struct("*").alias("doc"), F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own"))
    rows = keyed.select("k", "own", "doc.text")
    with scratch(docs.sparkSession):
        every = materialize(keys(rows, least), "keys")
        texts = every.groupBy("tid").agg(F.min(F.struct("k", "own")).alias("first"), *(F.first(x).alias(x) for x in ("n", "fp", "par", "keys")))
        texts = materialize(texts, "texts")
        roots = near_roots(texts.filter("n > 0"), rows, least)
        rooted = texts.select("tid", "first").join(roots.withColumnRenamed("node", "tid"), "tid", "left").withColumn("root", F.coalesce("root", "tid"))
        firsts = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.k", "first.own")
        counted = every.groupBy("k", "own").agg(F.count(F.lit(1)).alias("rows")).join(firsts.withColumn("stays", F.lit(True)), ["k", "own"], "left")
        counted = materialize(counted.filter("stays IS NULL OR rows > 1"), "judged", keep=True)
    gone = counted.filter("stays IS NULL").select("k", "own")
    kept = likely(keyed, gone, ["k", "own"], inside=False).unionByName(likely(keyed, gone, ["k", "own"]).join(gone, ["k", "own"], "left_anti"))
    if not counted.filter("stays AND rows > 1").isEmpty():
        kept = kept.dropDuplicates(["k", "own"])
    return kept.select("doc.*")
