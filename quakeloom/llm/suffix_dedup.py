"""Removal of long repeated byte strings, across and within documents.

A byte goes if it lies in some string of `length` bytes that also starts anywhere else. The literal column-wise
construction of a collection's suffix order takes as many global rounds as the longest document has bytes, each
over all that was built so far; on these tables that is over a hundred thousand rounds, so it cannot meet the
limits (see the README). This operator reaches the same result by locally chosen anchors:

1. In each window of `length` bytes, the k-gram with the smallest hash is the window's anchor. Equal windows have
   equal anchors at equal places, so a string can only repeat if its anchor does. Consecutive windows with one
   anchor form a block. One row per block (its anchor, its whole content as a hash) is all that is shuffled, and
   only blocks whose anchor occurs twice go on.
2. A block whose whole content occurs twice is repeated in all its windows.
3. Blocks that share an anchor but differ (the edges of repeats) are cut out, once each, and taken apart in the same
   way by longer grams, in the end window by window.
4. The windows that repeat are joined back to their documents as byte ranges, and the kept bytes are hashed.

Every step is an aggregation by hash or a join on it; no group of equal strings is gathered anywhere. Strings are
told apart by 64-bit hashes among those with an equal anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KeyFilter, join_heavy, materialize, scratch, table

#: Bytes of a repeated string, and of the k-grams that serve as anchors, level by level.
LENGTH, GRAMS = 200, (40, 150, 185)
#: Bytes of text worked on as one array; a longer text is worked through in overlapping pieces.
PIECE = 1 << 17

_U = np.uint64
#: Low bits of a window's sort key, which hold a place in a piece.
_PLACE = _U((1 << 24) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of unsigned 64-bit values."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def gram_hashes(data: np.ndarray, gram: int = GRAMS[0]) -> np.ndarray:
    """Hash of the `gram` bytes from each place, by combining hashes of shorter strings; len(data) - gram + 1 values."""
    h, n = _BYTE[data], 1
    while n < gram:
        step = min(n, gram - n)
        h = h[: len(h) - step] * _U(0x9FB21C651E98DF25 + 2 * (n + step)) + (h[step:] ^ (h[step:] >> _U(29)))
        n += step
    return _mix(h)


def window_hashes(h: np.ndarray, at: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Hash of the `length` bytes from each place in at, from the hashes of the grams that cover them."""
    out = np.full(len(at), length, np.uint64)
    for k in [*range(0, length - gram, gram), length - gram]:
        out = _mix(out * _U(0x9FB21C651E98DF25) + h[at + k])
    return out


def anchors(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of `width` gram hashes from each place on, by their high bits; the leftmost on ties."""
    n = len(h) - width + 1
    key = h & ~_PLACE | np.arange(len(h), dtype=np.uint64)
    grid = np.full(-(-len(h) // width) * width, ~_U(0), np.uint64)
    grid[: len(h)] = key
    grid = grid.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & _PLACE).astype(np.int64)


def blocks(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAMS[0]) -> tuple[np.ndarray, ...]:
    """first window, further windows, anchor hash and content hash of each block of the texts that end at `ends`.

    data: texts of at least `length` bytes, one after another.
    """
    h = gram_hashes(data, gram)
    place = anchors(h, length - gram + 1)
    n = len(place)
    valid = np.ones(n, bool)
    for e in ends[:-1]:
        valid[e - length + 1 : e] = False
    change = np.append(True, place[1:] != place[:-1]) | np.append(True, valid[1:] != valid[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], n) - 1
    first, last = first[valid[first]], last[valid[first]]
    # first and last window overlap (fewer than `length` windows share an anchor), so the two and their distance tell the content
    whole = _mix(window_hashes(h, first, length, gram) * _U(0x9FB21C651E98DF25) + window_hashes(h, last, length, gram) + (last - first).astype(np.uint64))
    return first, last - first, h[place[first]], whole


def _parts(size: int, length: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of at most PIECE + length bytes that together hold every window once."""
    at = 0
    while at + length <= size:
        end = size if size - at <= PIECE + length else at + PIECE
        yield at, end
        at = end - length + 1


def _bytes(text: str | bytes | None) -> bytes:
    return text.encode("utf-8") if isinstance(text, str) else bytes(text) if text is not None else b""


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with a row key (k, t): t tells rows of one doc_id apart by 64 bits of their text, so rows of equal key count as equal."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), F.xxhash64(text).alias("t"))


def _block_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("k", "t", "first", "span", "anchor", "b")
        for pdf in batches:
            out, rows, held, size = [], 0, [], 0

            def flush(held: list) -> tuple:
                bounds = np.cumsum([len(x[3]) for x in held])
                first, span, anchor, whole = blocks(np.frombuffer(b"".join(x[3] for x in held), np.uint8), bounds, length, gram)
                of = np.searchsorted(bounds, first, side="right")
                k, t, at = (np.array([x[i] for x in held], np.int64) for i in range(3))
                starts = bounds - [len(x[3]) for x in held]
                return k[of], t[of], first - starts[of] + at[of], span, anchor.view(np.int64), whole.view(np.int64)

            for k, t, text in zip(pdf["k"], pdf["t"], pdf["text"], strict=True):
                raw = _bytes(text)
                for a, b in _parts(len(raw), length):
                    held.append((k, t, a, raw[a:b]))
                    size += b - a
                    if size >= PIECE:
                        out.append(flush(held))
                        held, size, rows = [], 0, rows + len(out[-1][0])
                        if rows > 200_000:
                            yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out, strict=True)), strict=True)))
                            out, rows = [], 0
            if held:
                out.append(flush(held))
            if out:
                yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return texts.select("k", "t", "text").mapInPandas(run, "k long, t long, first long, span int, anchor long, b long")


def _contents(texts: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """(k, t, text): the bytes of each block named in marks (k, t, marks: first, span, anchor, b), keyed by its anchor and content hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, *found in zip(pdf["text"], *(pdf[c] for c in names), strict=True):
                raw = _bytes(text)
                rows += [(anchor, b, raw[first : first + span + length]) for first, span, anchor, b in zip(*(x.tolist() for x in found), strict=True)]
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=["k", "t", "text"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["k", "t", "text"])

    names = ("first", "span", "anchor", "b")  # as plain arrays, which are small in Python
    marked = texts.select("k", "t", "text").filter(KeyFilter(marks, ["k", "t"]).may_hold())
    return marked.join(marks, ["k", "t"]).select("text", *(F.col(f"marks.{c}").alias(c) for c in names)).mapInPandas(run, "k long, t long, text binary")


def repeated_windows(texts: DataFrame, length: int = LENGTH, grams: tuple[int, ...] = GRAMS) -> DataFrame:
    """(k, t, first, last): ranges of windows of `length` bytes, by their starts, that occur more than once in all texts (k, t, text).

    Blocks are formed by anchors of grams[0] bytes. Those that share an anchor but differ are taken out, once each, and
    worked on in the same way with the next, longer grams; in the end each window is a block of its own.
    """
    gram, *longer = grams
    rows = materialize(_block_rows(texts, length, gram), f"blocks{gram}")
    twice = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1")
    if not longer:
        return join_heavy(rows, materialize(twice, "repeated"), "anchor", "uses").selectExpr("k", "t", "first", "first + span AS last")
    live = materialize(join_heavy(rows, materialize(twice, f"twice{gram}"), "anchor", "uses").drop("uses"), f"live{gram}")
    kinds = live.groupBy("anchor", "b").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("k", "t", "first", "span")).alias("one"))
    kinds = materialize(kinds, f"kinds{gram}")
    mixed = materialize(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), f"mixed{gram}")
    marks = join_heavy(kinds, mixed, "anchor", "n").select("one.k", "one.t", F.struct("one.first", "one.span", "anchor", "b").alias("mark"))
    marks = materialize(marks.groupBy("k", "t").agg(F.collect_list("mark").alias("marks")), f"marks{gram}")
    inner = repeated_windows(materialize(_contents(texts, marks, length), f"contents{gram}"), length, tuple(longer))
    # a kind's repeated windows: all of them (null), or the ranges found inside, of which there are fewer than `length`
    some = inner.groupBy(F.col("k").alias("anchor"), F.col("t").alias("b")).agg(F.collect_list(F.struct("first", "last")).alias("parts"))
    some = kinds.filter("times = 1").select("anchor", "b", "times").join(some, ["anchor", "b"])
    whole = kinds.filter("times > 1").select("anchor", "b", "times", F.lit(None).cast(some.schema["parts"].dataType).alias("parts"))
    found = join_heavy(live, materialize(whole.union(some), f"repeated{gram}"), ["anchor", "b"], "times")
    ranges = F.expr("if(parts IS NULL, array(struct(first AS s, first + span AS e)), transform(parts, p -> struct(first + p.first AS s, first + p.last AS e)))")
    return found.select("k", "t", F.explode(ranges).alias("r")).selectExpr("k", "t", "r.s AS first", "r.e AS last")


def repeated_ranges(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k, t, ranges): the byte ranges of each text that repeated strings cover, as a set; texts without any are absent."""
    with scratch(texts.sparkSession):
        found = repeated_windows(texts, length, tuple(g for g in GRAMS if g < length) + (length,))
        ranges = found.groupBy("k", "t").agg(F.collect_set(F.struct(F.col("first").alias("s"), (F.col("last") + length).alias("e"))).alias("ranges"))
        return materialize(ranges, "ranges", keep=True)


def _with_ranges(texts: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """texts that may have ranges with them (null for none), and those that surely have none and so take no part in the join."""
    may = KeyFilter(ranges, ["k", "t"]).may_hold()
    return texts.filter(may).join(ranges, ["k", "t"], "left"), texts.filter(~may)


def merge(starts: np.ndarray | None, ends: np.ndarray | None) -> list[tuple[int, int]]:
    """The ranges in order, those that overlap or touch as one; none for null."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip(starts.tolist(), ends.tolist(), strict=True)) if starts is not None else ():
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def cut_repeats(docs: DataFrame, length: int = LENGTH, keep: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, if `keep`, kept (the bytes left).

    Texts are UTF-8 bytes; null counts as empty; texts shorter than `length` keep all. Repeated rows are copies of
    one another like any equal texts. A cut may split a character, so kept is binary. An empty table gives an
    empty result. Different texts of one doc_id (null is one) are told apart by 64-bit hashes; if two clashed, each would
    also lose the other's ranges.
    """
    texts = _keyed(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text, starts, ends in zip(pdf["doc_id"], pdf["text"], pdf["s"], pdf["e"], strict=True):
                raw = _bytes(text)
                spans = merge(starts, ends)
                left = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(raw)], strict=True))
                rows.append((doc_id, len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left)[: 5 + keep])
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep
    some, none = _with_ranges(texts, repeated_ranges(texts, length))
    zero = F.lit(0).cast("long")
    whole = [F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept")]
    return some.select("doc_id", "text", "ranges.s", "ranges.e").mapInPandas(run, schema).union(none.select("doc_id", *whole[: 4 + keep]))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with text cut to what is left of it, and n_chars, if there is such a column, set to its length.

    Characters that a cut splits go. Documents stay even if nothing is left; a text without cuts is unchanged, a null
    text stays null.
    """
    names = docs.columns
    ranges = repeated_ranges(_keyed(docs), length)
    whole = docs.select(F.struct(*names).alias("row"), F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for text, s, e in zip(texts, starts, ends, strict=True):
            if text is None or s is None:
                out.append(text)
                continue
            raw = _bytes(text)
            spans = merge(s, e)
            left = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(raw)], strict=True))
            out.append(left.decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    some, none = _with_ranges(whole, ranges)
    some = some.withColumn("left", cut("row.text", "ranges.s", "ranges.e"))
    chars = F.when(F.col("ranges").isNull(), F.col("row.n_chars")).otherwise(F.length("left").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else None
    new = {"text": F.col("left"), "n_chars": chars}
    return some.select(*((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in names)).union(none.select("row.*"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents"), keep=False)


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
