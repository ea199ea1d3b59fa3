"""Ranked lexical search by pipelined term partitioning.

Terms are dealt to owners, the rare ones to the first and the common ones to the last. An item's bundle (its terms and
its sparse accumulators: documents with integer scores so far) passes through the owners one after another; each stage
is a cogroup of the bundles with the postings of that owner's terms. Bundles and postings are both cut by slices of the
documents, so no group grows with the table, and a common term's list is dealt over all slices.

A bundle drops an accumulator once its score and all that later owners can add stay below the slice's k-th score. Such
a document may come back in a later stage with less than its score, and is still below. So the result is exact.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_heavy, materialize, scratch, table

TOP = 20
#: Term owners, and so stages.
OWNERS = 4
#: Documents of a slice, items and distinct terms of a block on average.
SLICE, ITEMS, TERMS = 4096, 256, 8192
#: Bits of the map that keeps terms of no item out of the postings; its size is fixed.
BITS = 22
#: Bytes of a text taken apart at once.
CHUNK = 1 << 20

#: Fixed values of the score.
SCALE, LEVEL, SLOPE, SHARE = 1_000_000_000, 1000, 12, 25

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def term_counts(text: str | None) -> Counter[bytes]:
    """How often each term occurs: maximal runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z
    lower-cased, in UTF-8. A null text has none."""
    low, out, at = (text or "").encode("utf-8", "surrogatepass").lower(), Counter(), 0
    while at < len(low):
        gap = _GAP.search(low, at + CHUNK)  # so that no term is cut
        end = gap.start() if gap else len(low)
        out.update(_WORD.findall(low, at, end))
        at = end
    return out


def _lists(values: list[list], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array([x for v in values for x in v], kind))


def item_terms(items: DataFrame) -> DataFrame:
    """(ikey, item_id, term, times): the terms of each distinct row of items (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ikey, item_id, text in zip(*(batch.column(c).to_pylist() for c in ("ikey", "item_id", "text")), strict=True):
                found = term_counts(text)
                if found:
                    n = len(found)
                    yield pa.RecordBatch.from_pydict({"ikey": pa.array([ikey] * n, pa.int64()), "item_id": pa.array([item_id] * n, pa.int64()), "term": pa.array(list(found), pa.binary()), "times": pa.array(list(found.values()), pa.int64())})

    keyed = items.select(F.xxhash64("item_id", "text").alias("ikey"), F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates(["ikey"])
    return keyed.mapInArrow(run, "ikey long, item_id long, term binary, times long")


def bitmap(terms: DataFrame) -> np.ndarray:
    """Which of 2 ** BITS hashes the terms (term) have."""
    place = F.pmod(F.crc32("term"), F.lit(1 << BITS))
    words = terms.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("b")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def scanned(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """(uid, doc_id, n, terms, tfs) for each row with at least one term: n counts all its terms, the lists hold those that known lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, hit = (1 << BITS) - 1, shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keep, n, terms, tfs = [], [], [], []
                for i, text in enumerate(part.column("text")):
                    found = term_counts(text.as_py())
                    if found:
                        mine = [t for t in found if hit[zlib.crc32(t) & mask]]
                        keep.append(i)
                        n.append(found.total())
                        terms.append(mine)
                        tfs.append([found[t] for t in mine])
                part = part.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_pydict({"uid": part.column("uid"), "doc_id": part.column("doc_id"), "n": pa.array(n, pa.int64()), "terms": _lists(terms, pa.binary()), "tfs": _lists(tfs, pa.int64())})

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "uid long, doc_id long, n long, terms array<binary>, tfs array<long>")


def weight(n_docs: int, df: Column) -> Column:
    return F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * df + 1).cast("double"))).cast("long")


def owner_bounds(terms: DataFrame, owners: int) -> list[int]:
    """Falling weights at which the next owner begins, so that owners have about equally many postings. terms: w, df."""
    loads = sorted(((r["w"], r["n"]) for r in terms.groupBy("w").agg(F.sum("df").alias("n")).collect()), reverse=True)  # a row a weight, of which there are few thousand
    total, seen, out = sum(n for _, n in loads), 0, []
    for w, n in loads:
        if seen >= (len(out) + 1) * total / owners and len(out) < owners - 1:
            out.append(w)
        seen += n
    return out


def _stage(s: int, last: bool, top: int):
    """What owner s does with a slice's bundles (one row an item) and its postings there."""

    def run(bundles: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
        if not len(bundles):
            return bundles
        held = [np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in bundles["uids"]]
        uids, place = np.unique(np.concatenate([postings["uid"].to_numpy(np.int64), *held]), return_inverse=True)
        at, ends = place[: len(postings)], np.cumsum([len(postings), *map(len, held)])
        order = np.argsort(postings["tno"].to_numpy(np.int64), kind="stable")
        tno, at, add = postings["tno"].to_numpy(np.int64)[order], at[order], postings["c"].to_numpy(np.int64)[order]
        out_uids, out_scores, score = [], [], np.zeros(len(uids), np.int64)
        for i, (owner, term, gain, most, scores) in enumerate(zip(*(bundles[c] for c in ("owners", "tnos", "gains", "mosts", "scores")), strict=True)):
            score[:] = 0
            if scores is not None and len(scores):
                score[place[ends[i] : ends[i + 1]]] = scores
            mine = owner == s
            first, end = np.searchsorted(tno, term[mine]), np.searchsorted(tno, term[mine], side="right")
            for a, b, g in zip(first, end, gain[mine], strict=True):
                score[at[a:b]] += g * add[a:b]  # a document has a term once
            live = np.flatnonzero(score)
            if len(live) > top:
                rest = int((gain * most)[owner > s].sum())
                least = np.partition(score[live], -top)[-top]
                live = live[score[live] + rest >= least]
            out_uids.append(uids[live])
            out_scores.append(score[live])
        return bundles.assign(uids=out_uids, scores=out_scores)

    return run


BUNDLE = "slice long, block long, ikey long, item_id long, owners array<int>, tnos array<long>, gains array<long>, mosts array<long>, uids array<long>, scores array<long>"


def search(docs: DataFrame, items: DataFrame, top: int = TOP, owners: int = OWNERS, per_slice: int = SLICE) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` rows of docs (doc_id, text) with the highest score above 0 for each item (item_id, text).

    Equal scores by ascending doc_id, null first. Every row of docs is a document of its own, also repeated ones; rows of
    items that are equal count once, an item_id with several texts is ranked for each. Null and empty texts have no
    terms: such documents count nowhere, such items have no rows. Empty tables give an empty result. Other columns are
    not looked at and may have any names. Terms are compared as such; they are numbered within a run by 64-bit hashes.
    """
    spark = docs.sparkSession
    with scratch(spark):
        wanted = materialize(item_terms(items), "item_terms")
        texts = materialize(scanned(docs, bitmap(wanted)), "scanned")
        n_docs, length = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        m = F.expr(f"{LEVEL // 10 - SHARE} + (({SHARE}L * n * {n_docs}L) DIV {length}L)")
        flat = texts.withColumn("m", m).select("uid", "m", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("uid", F.col("t.terms").alias("term"), F.expr(f"({SCALE}L * t.tfs) DIV ({LEVEL}L * t.tfs + {SLOPE}L * m)").alias("c"))
        counts = flat.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("c").alias("most"))
        terms = wanted.select("term").distinct().join(counts, "term").withColumn("w", weight(n_docs, F.col("df"))).filter("w > 0").withColumn("tno", F.xxhash64("term"))
        terms = materialize(terms, "terms")
        bounds = owner_bounds(terms, owners)
        owner = sum((F.when(F.col("w") <= b, 1).otherwise(0) for b in bounds), F.lit(0)).cast("int")
        n_items, n_terms = wanted.agg(F.count_distinct("ikey"), F.count(F.lit(1))).first()
        blocks, slices = max(1, -(-n_items // ITEMS), -(-n_terms // (4 * TERMS))), -(-n_docs // per_slice)
        plan = wanted.withColumn("block", F.pmod("ikey", F.lit(blocks)).cast("long")).join(terms.withColumn("owner", owner), "term")
        plan = materialize(plan, "plan")
        steps = F.collect_list(F.struct("owner", "tno", (F.col("w") * F.col("times")).alias("gain"), "most"))
        empty = F.array().cast("array<long>")
        bundles = plan.groupBy("block", "ikey", "item_id").agg(steps.alias("p")).select(
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"), "block", "ikey", "item_id",
            F.col("p.owner").alias("owners"), F.col("p.tno").alias("tnos"), F.col("p.gain").alias("gains"), F.col("p.most").alias("mosts"), empty.alias("uids"), empty.alias("scores"),
        )
        places = plan.select("term", "block", "owner", "tno", "df").distinct().groupBy("term", "owner", "tno", "df").agg(F.collect_list("block").alias("blocks"))
        postings = join_heavy(flat, places, "term", "df").select("owner", F.pmod(F.xxhash64("uid"), F.lit(slices)).alias("slice"), F.explode("blocks").alias("block"), "uid", "tno", "c")
        postings = materialize(postings, "postings")
        for s in range(owners):
            own = postings.filter(F.col("owner") == s).drop("owner")
            bundles = bundles.groupBy("slice", "block").cogroup(own.groupBy("slice", "block")).applyInPandas(_stage(s, s == owners - 1, top), BUNDLE)
        found = bundles.select("ikey", "item_id", F.explode(F.arrays_zip("uids", "scores")).alias("d")).select("ikey", "item_id", F.col("d.uids").alias("uid"), F.col("d.scores").alias("score"))
        found = materialize(found, "found")
        named = join_heavy(texts.select("uid", "doc_id"), found.select("uid").distinct().withColumn("_one", F.lit(1)), "uid", "_one").drop("_one")
        order = Window.partitionBy("ikey").orderBy(F.desc("score"), "doc_id", "uid")
        best = found.join(named, "uid").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        return materialize(best.select("item_id", "rank", "doc_id", "score"), "ranked", keep=True)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {_TERMS.format("text")} AS t FROM documents WHERE text IS NOT NULL),
lens AS (SELECT uid, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lens),
tf AS (SELECT uid, term, count(*)::BIGINT AS tf FROM (SELECT uid, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term, docs),
i AS (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT item_id, text, term, count(*)::BIGINT AS times FROM (SELECT item_id, text, unnest({_TERMS.format("text")}) AS term FROM i) GROUP BY ALL),
s AS (
  SELECT q.item_id, q.text, lens.uid, lens.doc_id,
    sum(q.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * lens.n * total.docs) // total.terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN lens USING (uid), total GROUP BY ALL
),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST, uid)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""

QUERIES = {"op12_lexical_search": op12_lexical_search}
ORACLE_SQL = {"op12_lexical_search": SQL}
