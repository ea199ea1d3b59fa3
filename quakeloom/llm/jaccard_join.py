"""Similarity self-join of word n-gram sets by T-occurrence search (DivideSkip).

Two sets with a Jaccard index of t or more share at least T = ceil(t / (1 + t) (n + m)) grams. Under one order of all grams,
the rare ones first, an inverted index over each set's first n - ceil(t n) + 1 grams is enough: what two sets share beyond
it is at most max(ceil(t n), ceil(t m)) - 1, so near sets occur together in at least T less that many of the short lists.
Lists with the same texts are kept once, with a weight. Texts that share a list are searched in blocks of bounded size: a
text's local lists are merged with a heap except for the longest, which are only probed by binary search for the texts
that the heap lets through; those with the required occurrences are compared exactly, where the grams beyond the index are
probed in the other text's sorted set. Texts that the parities of 1024 classes of grams rule out (each gram in one set alone
changes one) are not looked for.

First each text asks for one partner of another group in a few of its lists, which unites copies at little cost. Then, in
the lists whose texts are still in several groups, all pairs of different groups with the required occurrences are
compared: the texts outside the list's largest group against all of them, in blocks. No link between groups is lost.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_heavy, likely, materialize, scratch, table
from .components import components
from .near_copies import PARITIES, lists, mixed, parities, whole_blocks

SHINGLE, PERCENT = 4, 85
#: Texts of a block; lists in which a text asks for a partner, and rounds of that.
BLOCK, ASKED, ROUNDS = 256, 2, 2
#: One in SAMPLE texts is counted for common grams: those in COMMON of them, the LISTED most frequent. They set only the order.
SAMPLE, COMMON, LISTED = 8, 2, 1 << 18
#: Bytes hashed at once; a longer word makes the piece longer.
CHUNK = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_BASE = 0xD6E8FEB86659FD93
_FACTORS = np.array([0x9E3779B97F4A7C15 * (2 * i + 3) & (2**64 - 1) | 1 for i in range(64)], np.uint64)
_powers: dict[str, np.ndarray] = {}
#: Occurrences that no text has.
OUT = 1 << 62


def _power(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of _BASE and of its inverse modulo 2 ** 64, at least `size` of them."""
    if len(_powers.get("up", ())) < size:
        for name, x in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            _powers[name] = np.cumprod(np.append(np.uint64(1), np.full(max(size, CHUNK), x, np.uint64)), dtype=np.uint64)
    return _powers["up"], _powers["down"]


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word in turn (runs without ASCII white space, A-Z lower-cased): its bytes as digits of a number, mixed."""
    low, out, at = (text or "").encode("utf-8", "surrogatepass").lower(), [], 0
    while at < len(low):
        gap = _GAP.search(low, at + CHUNK)
        end = gap.start() if gap else len(low)
        code = np.frombuffer(low, np.uint8, end - at, at)
        edge = np.diff(np.concatenate([[False], ~_SPACE[code], [False]]).view(np.int8))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _power(end - at + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code + np.uint64(1)) * up[: end - at], dtype=np.uint64)])
        out.append(mixed((sums[last] - sums[first]) * down[first]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def gram_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams; fewer words make one gram, no words none."""
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


def _least(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Grams that a set of n shares at least with any set near it."""
    return -(-percent * n // 100)


def indexed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Grams of a set of n that are in the index."""
    return n - _least(n, percent) + 1


def occurrences(n: int, m: np.ndarray, percent: int) -> np.ndarray:
    """Least occurrences in the index of a set of n with sets of m grams; more than any set has if the sizes rule it out."""
    most = np.maximum(_least(n, percent), _least(m, percent)) - 1
    out = -(-percent * (n + m) // (100 + percent)) - most
    return np.where(100 * np.minimum(n, m) >= percent * np.maximum(n, m), out, OUT)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * shared >= percent * union, for sorted sets; the smaller one's grams are probed in the larger one."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return False
    same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * same >= percent * (len(x) + len(y) - same)


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def common_grams(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent grams of a sample of the texts, sorted, and in how many of them each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            yield pa.RecordBatch.from_pydict({"s": np.concatenate([gram_set(t.as_py(), shingle) for t in part.column("text")])})

    some = rows.filter(F.pmod(F.xxhash64("own", F.lit(1)), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "s long")
    found = some.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "s").limit(LISTED).toArrow()
    s, n = found["s"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def signature(s: np.ndarray) -> int:
    """64 bits that tell sets apart; 0 for the empty one."""
    return int(mixed(np.array([mixed(s.view(np.uint64) + np.uint64(7)).sum(dtype=np.uint64) + np.uint64(len(s))]))[0].view(np.int64)) if len(s) else 0


def keyed(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, own, tid, n, par, keys) per row of rows (doc_id, own, text): tid is the set's signature, par its parities, keys its
    grams in the index, in order."""
    shared = rows.sparkSession.sparkContext.broadcast(common_grams(rows, shingle))

    def first(s: np.ndarray) -> np.ndarray:
        often, count = shared.value
        if not len(often):
            return s[: indexed(len(s), percent)] if len(s) else s
        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
        weight = np.where(often[at] == s, count[at], 0)
        return s[np.argsort(weight, kind="stable")][: indexed(len(s), percent)] if len(s) else s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            found = [gram_set(t.as_py(), shingle) for t in part.column("text")]
            cols = {"doc_id": part.column("doc_id"), "own": part.column("own"), "tid": np.array([signature(s) for s in found], np.int64), "n": np.array([len(s) for s in found], np.int64)}
            yield pa.RecordBatch.from_pydict(cols | {"par": pa.array([parities(s).tobytes() for s in found], pa.binary()), "keys": lists([first(s) for s in found])})

    return rows.select("doc_id", "own", "text").mapInArrow(run, "doc_id long, own long, tid long, n long, par binary, keys array<long>")


def inverted(texts: DataFrame) -> DataFrame:
    """(tid, n, c, m, weight): the lists with several texts, one row per text on it; c names a list, m is its length, and weight
    counts the grams that have just this list. texts: tid, n, keys."""
    flat = texts.select("tid", "n", F.posexplode("keys").alias("pos", "c"))
    each = flat.groupBy("c").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("tid")).alias("sig"), F.min(F.struct("tid", "pos")).alias("first")).filter("m > 1")
    named = each.groupBy("m", "sig", "first.tid").agg(F.min_by("c", "first.pos").alias("c"), F.count(F.lit(1)).alias("weight")).select("c", "m", "weight")
    named = materialize(named, "lists")
    held = materialize(likely(flat.drop("pos"), named.select("c"), ["c"]), "held")
    return materialize(join_heavy(held, named, "c", "m"), "postings")


def bits(par: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(par), np.uint64).reshape(len(par), PARITIES)


class Block:
    """Inverted lists of a block's texts (cs, ws: the lists that a text is on, with weights), made when they are first asked for."""

    def __init__(self, cs: np.ndarray, ws: np.ndarray):
        self.cs, self.ws, self.made = cs, ws, None

    @property
    def lists(self) -> dict[int, list[int]]:
        if self.made is None:
            self.made = defaultdict(list)
            for i, cs in enumerate(self.cs):
                for c in cs.tolist():
                    self.made[c].append(i)
        return self.made

    def search(self, cs: list[int], ws: list[int], need: np.ndarray) -> Iterator[int]:
        """Places, in order, of the block's texts that occur at least need[place] times, by weight, in the lists cs."""
        least, aside, weight = int(need.min(initial=OUT)), 0, 0
        if least == OUT:
            return
        found = sorted(((self.lists[c], w) for c, w in zip(cs, ws, strict=True) if c in self.lists), key=lambda x: -len(x[0]))
        while aside < len(found) and weight + found[aside][1] < least:  # a text on the long lists alone can't have enough
            weight += found[aside][1]
            aside += 1
        long, short = found[:aside], found[aside:]
        heap = [(x[0], k, 0) for k, (x, _) in enumerate(short)]
        heapq.heapify(heap)
        while heap:
            place, count = heap[0][0], 0
            while heap and heap[0][0] == place:
                _, k, at = heap[0]
                x, w = short[k]
                count += w
                if at + 1 < len(x):
                    heapq.heapreplace(heap, (x[at + 1], k, at + 1))
                else:
                    heapq.heappop(heap)
            if count + weight < need[place]:
                continue
            left = weight
            for x, w in long:
                if count >= need[place] or count + left < need[place]:
                    break
                left -= w
                at = bisect_left(x, place)
                count += w * (at < len(x) and x[at] == place)
            if count >= need[place]:
                yield place


def required(n: np.ndarray, par: np.ndarray, m: np.ndarray, with_: np.ndarray, percent: int) -> np.ndarray:
    """Required occurrences of each of one side's texts (n grams, parities) with each of the other's; OUT where sizes or parities rule them out."""
    n = n[:, None]
    most = n + m - 2 * -(-percent * (n + m) // (100 + percent))
    out = np.where(np.abs(n - m) <= most, occurrences(n, m, percent), OUT)
    i, j = np.nonzero(out < OUT)
    apart = np.bitwise_count(par[i] ^ with_[j]).sum(axis=1, dtype=np.int64)
    gone = apart > most[i, j]
    out[i[gone], j[gone]] = OUT
    return out


def _runs(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[tuple[dict[str, np.ndarray], int, int]]:
    """The columns as arrays and the range of each run of equal names, of a table sorted by them."""
    for pdf in whole_blocks(batches, names):
        cols = {c: pdf[c].to_numpy() for c in pdf.columns if c != "par"} | {"par": bits(pdf["par"])}
        cuts = np.flatnonzero(np.any([cols[c][1:] != cols[c][:-1] for c in names], axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pdf)], strict=True):
            yield cols, a, b


def _pairs(found: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame([(min(x), max(x)) for x in found], columns=["a", "b"], dtype=np.int64)


def open_rows(postings: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The postings of lists whose texts are in several groups, with g (the text's group), top (the list's largest group) and own (its texts)."""
    if roots is None:
        grouped = postings.withColumn("g", F.col("tid"))
    else:
        grouped = materialize(postings.join(roots.select(F.col("node").alias("tid"), F.col("root").alias("g")), "tid", "left").withColumn("g", F.coalesce("g", "tid")), "grouped")
    sizes = grouped.groupBy("c", "g").agg(F.count(F.lit(1)).alias("own"))
    top = sizes.groupBy("c").agg(F.max(F.struct("own", "g")).alias("top"), F.count(F.lit(1)).alias("groups"), F.sum("own").alias("m")).filter("groups > 1")
    top = materialize(top.select("c", "m", F.col("top.own").alias("own"), F.col("top.g").alias("top")), "open_lists")
    held = materialize(likely(grouped.drop("m"), top.select("c"), ["c"]), "open_likely")
    return materialize(join_heavy(held, top, "c", "m"), "open")


def first_partners(rows: DataFrame, texts: DataFrame, round_: int, percent: int) -> DataFrame:
    """(a, b): for each text, in a block of each of a few of its lists, the first text of another group with the required occurrences."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cols, a, b in _runs(batches, ["c", "block"]):
            n, g, par, tid = (cols[c][a:b] for c in ("n", "g", "par", "tid"))
            if (g == g[0]).all():
                continue
            x, g, found = Block(cols["cs"][a:b], cols["ws"][a:b]), g.copy(), []
            need = required(n, par, n, par, percent)
            for i in range(1, b - a):
                mine = np.where(g[:i] == g[i], OUT, need[i, :i])  # earlier ones only, so that many texts ask for the same one
                if mine.min() < OUT:
                    for j in x.search(x.cs[i].tolist(), x.ws[i].tolist(), np.append(mine, np.full(b - a - i, OUT))):
                        found.append((tid[i], tid[j]))
                        g[g == g[i]] = g[j]
                        break
            if found:
                yield _pairs(found)

    entry = F.struct(F.xxhash64("c", F.lit(round_)).alias("h"), "c", "weight", "m")
    short = rows.groupBy("tid", "n", "g").agg(F.sort_array(F.collect_list(entry)).alias("short")).join(texts.select("tid", "par"), "tid")
    asked = short.select("tid", "n", "g", "par", F.col("short.c").alias("cs"), F.col("short.weight").alias("ws"), F.explode(F.slice("short", 1, ASKED)).alias("e"))
    asked = asked.select("tid", "n", "g", "par", "cs", "ws", "e.c", F.pmod(F.xxhash64("tid", "e.c", F.lit(round_)), F.ceil(F.col("e.m") / BLOCK)).alias("block"))
    return asked.repartition("c", "block").sortWithinPartitions("c", "block", "tid").mapInPandas(run, "a long, b long").distinct()


def all_partners(rows: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of texts of different groups on a common list that have the required occurrences. The texts outside a
    list's largest group ask, in blocks, all texts of the list, in blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple[int, int]] = []
        for cols, a, b in _runs(batches, ["c", "i", "j"]):
            ask = cols["ask"][a:b].astype(bool)
            one, two = a + np.flatnonzero(ask), a + np.flatnonzero(~ask)
            if not len(one) or not len(two):
                continue
            need = required(cols["n"][one], cols["par"][one], cols["n"][two], cols["par"][two], percent)
            need[cols["g"][one][:, None] == cols["g"][two]] = OUT
            x = Block(cols["cs"][two], cols["ws"][two])
            for i in np.flatnonzero(need.min(axis=1) < OUT):
                found += [(cols["tid"][one[i]], cols["tid"][two[j]]) for j in x.search(cols["cs"][one[i]].tolist(), cols["ws"][one[i]].tolist(), need[i])]
            if len(found) > 10_000:
                yield _pairs(found)
                found = []
        if found:
            yield _pairs(found)

    short = materialize(rows.groupBy("tid", "n", "g").agg(F.collect_list(F.struct("c", "weight")).alias("s")).select("tid", "n", "g", F.col("s.c").alias("cs"), F.col("s.weight").alias("ws")).join(texts.select("tid", "par"), "tid"), "short")
    at = lambda salt, n: F.pmod(F.xxhash64("tid", "c", F.lit(salt)), F.col(n))
    light = rows.select("tid", "c", F.expr("g <> top").alias("minor"), F.ceil(F.col("m") / BLOCK).alias("nb"), F.ceil((F.col("m") - F.col("own")) / BLOCK).alias("nm"))
    asking = light.filter("minor").withColumn("i", at(1, "nm")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1))).select("tid", "c", "i", "j", F.lit(True).alias("ask"))
    every = light.withColumn("j", at(2, "nb")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nm") - 1))).select("tid", "c", "i", "j", F.lit(False).alias("ask"))
    both = asking.unionByName(every).join(short, "tid")
    return both.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j").mapInPandas(run, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are near. texts: tid and own, a text that has the set; rows: own and text."""
    wanted = materialize(texts.join(pairs.select(F.explode(F.array("a", "b")).alias("tid")).distinct(), "tid").select("tid", "own"), "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            yield pa.RecordBatch.from_pydict({"tid": part.column("tid"), "s": lists([gram_set(t.as_py(), shingle) for t in part.column("text")])})

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = np.fromiter((similar(x, y, percent) for x, y in zip(pdf["sa"], pdf["sb"], strict=True)), bool, len(pdf))
            yield pdf.loc[ok, ["a", "b"]]

    one = likely(rows.select("own", "text"), wanted.select("own"), ["own"]).join(wanted, "own").dropDuplicates(["own"]).select("tid", "text")
    whole = materialize(one.mapInArrow(sets, "tid long, s array<long>"), "sets")
    both = pairs.join(whole.select(F.col("tid").alias("a"), F.col("s").alias("sa")), "a").join(whole.select(F.col("tid").alias("b"), F.col("s").alias("sb")), "b")
    return both.mapInPandas(check, "a long, b long")


def near_groups(texts: DataFrame, rows: DataFrame, shingle: int, percent: int) -> DataFrame | None:
    """(node, root): the groups of texts (tid, own, n, keys) that near pairs link, or None without any."""
    postings = inverted(texts)
    roots = None
    for step in range(ROUNDS + 1):
        left = open_rows(postings, roots) if step or not ROUNDS else postings.withColumn("g", F.col("tid"))
        if left.isEmpty():
            break
        pairs = materialize(first_partners(left, texts, step, percent) if step < ROUNDS else all_partners(left, texts, percent), "pairs")
        if pairs.isEmpty():
            continue
        near = materialize(verified(pairs, texts, rows, shingle, percent), "near")
        if not near.isEmpty():
            roots = components(near if roots is None else near.union(roots.selectExpr("node", "root")))
    return roots


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text, any other columns).

    n_shingles counts the distinct word n-grams of the whole text (ASCII white space separates words, A-Z lower-cased);
    fewer words make one gram. Texts link when 100 * shared >= percent * union. component_id is the smallest doc_id that
    links reach, the row's own included; a null doc_id only if the group has no other. Rows without words link with
    nothing, repeated rows are copies of one another. An empty table gives an empty result. Grams and sets are told apart
    by 64-bit hashes.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own"), "text")
    with scratch(docs.sparkSession):
        every = materialize(keyed(rows, shingle, percent), "keyed")
        texts = every.filter("n > 0").groupBy("tid").agg(F.min("own").alias("own"), F.first("n").alias("n"), F.first("par").alias("par"), F.first("keys").alias("keys"))
        texts = materialize(texts, "texts")
        roots = near_groups(texts, rows, shingle, percent)
        ids = every.filter("n > 0").groupBy("tid").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
        ids = ids.join(roots.withColumnRenamed("node", "tid"), "tid", "left").withColumn("root", F.coalesce("root", "tid")) if roots is not None else ids.withColumn("root", F.col("tid"))
        ids = materialize(ids, "ids")
        ids = materialize(ids.join(ids.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("tid", "rows", "component_id"), "named")
        found = join_heavy(every.filter("n > 0").select("doc_id", "tid", "n"), ids, "tid", "rows").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        return materialize(found.union(every.filter("n = 0").select("doc_id", "n", "doc_id")), "linked", keep=True)


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS uid, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
),
s AS (
  SELECT uid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) END AS s
  FROM d
),
e AS (SELECT uid, len(s) AS n, unnest(s) AS x FROM s),
l AS (
  SELECT a, b FROM (SELECT i.uid AS a, j.uid AS b, any_value(i.n) AS n, any_value(j.n) AS m, count(*) AS same FROM e i JOIN e j ON i.x = j.x AND i.uid <> j.uid AND 100 * least(i.n, j.n) >= 85 * greatest(i.n, j.n) GROUP BY 1, 2)
  WHERE 100 * same >= 85 * (n + m - same)
),
r AS (SELECT uid, uid AS v FROM d UNION SELECT r.uid, l.b FROM r JOIN l ON r.v = l.a),
c AS (SELECT r.uid, min(d.doc_id) AS component_id FROM r JOIN d ON d.uid = r.v GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN c USING (uid)
"""

QUERIES = {"op11_jaccard_join": op11_jaccard_join}
ORACLE_SQL = {"op11_jaccard_join": SQL}
