"""Language-model scores by context-tree weighting, beside a smoothed unigram base.

Each byte of a text (and one closing zero byte) is coded as eight binary decisions. A decision's node is the
bits already seen of the byte; its contexts are the 0 to DEPTH bytes before it. Every (context, node) holds a
Krichevsky-Trofimov estimate from the training texts, and context-tree weighting mixes the estimates of all
depths: P_w = 1/2 P_kt + 1/2 product of the children's P_w, which gives the weight of stopping at each context.
A context that training never saw has no say, so its parent keeps the weight.

Nothing that grows with the corpus is broadcast. Texts are dealt into batches of bounded size; a batch's distinct
words and (DEPTH + 1)-byte grams are counted, counts are summed over batches, and each batch gets back only the
values of its own words and grams.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Context bytes. A gram of DEPTH + 1 bytes and the number of a text in its chunk share one unsigned 64-bit key.
DEPTH = 4
#: Bytes of text in a batch, and in the part of a batch that is held as arrays.
BATCH_BYTES, CHUNK_BYTES = 16 << 20, 3 << 20
#: Batches at least, so that small inputs run in parallel; more would repeat the common words and grams for nothing.
MIN_BATCHES = 8
WORD, GRAM = 0, 1


def byte_text(text: str | None) -> bytes:
    return text.encode("utf-8").lower() if text else b""


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK_BYTES each; a longer text stands alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_BYTES:
            yield at, i
            at, size = i, 0
        size += len(t) + DEPTH + 1
    if at < len(texts):
        yield at, len(texts)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code of the DEPTH bytes before each symbol and the symbol itself (the text's bytes, then a zero), and the text's number."""
    a = np.frombuffer(b"".join([bytes(DEPTH) + t + b"\0" for t in texts]), np.uint8)
    code = np.zeros(len(a) - DEPTH, np.uint64)
    for i in range(DEPTH + 1):
        code = code << np.uint64(8) | a[i : len(a) - DEPTH + i]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    keep = np.ones(len(code), bool)
    starts = np.cumsum(sizes + DEPTH)[:-1]
    for i in range(DEPTH):
        keep[starts - DEPTH + i] = False
    return code[keep], np.repeat(np.arange(len(texts)), sizes)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(0)), np.uint64, len(words)).view(np.int64)


class _Batch:
    """Distinct words and grams of one batch with their counts in training texts (0: only held-out texts have them)."""

    def __init__(self) -> None:
        self.train: Counter = Counter()
        self.other: set = set()
        self.codes = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.int64)

    def add(self, texts: list[bytes], train: bool) -> None:
        for t in texts:
            if train:
                self.train.update(t.split())
                self.train[b""] += 1
            else:
                self.other.update(t.split(), (b"",))
        for i, j in chunks(texts):
            code = np.sort(grams(texts[i:j])[0])
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            n = np.diff(np.append(first, len(code))) if train else np.zeros(len(first), np.int64)
            self.codes, self.counts = _summed(np.concatenate([self.codes, code[first]]), np.concatenate([self.counts, n]))

    def rows(self, batch: int) -> Iterator[pd.DataFrame]:
        words = list(self.train)
        extra = list(self.other - self.train.keys())
        keys = np.concatenate([word_keys(words), word_keys(extra)])
        counts = np.concatenate([np.fromiter(self.train.values(), np.int64, len(words)), np.zeros(len(extra), np.int64)])
        for kind, k, c in ((WORD, keys, counts), (GRAM, self.codes.view(np.int64), self.counts)):
            yield pd.DataFrame({"batch": np.full(len(k), batch, np.int32), "kind": np.full(len(k), kind, np.int8), "key": k, "n": c})


def vocabularies(batches: DataFrame) -> DataFrame:
    """(batch, kind, key, n): one row for each distinct word (kind 0, XXH64) and gram (kind 1, code) of a batch."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, _Batch] = {}
        for pdf in parts:
            for (batch, train), g in pdf.groupby(["batch", "train"], sort=False):
                held.setdefault(int(batch), _Batch()).add([byte_text(t) for t in g["text"]], bool(train))
        while held:
            batch, x = held.popitem()
            yield from x.rows(batch)

    return batches.select("batch", "train", "text").mapInPandas(run, "batch int, kind byte, key long, n long")


def _log_kt(n0: pd.Series, n1: pd.Series) -> pd.Series:
    """Natural logarithm of the Krichevsky-Trofimov probability of a string with n0 zeros and n1 ones."""
    g = np.frompyfunc(math.lgamma, 1, 1)
    a, b = n0.to_numpy(float), n1.to_numpy(float)
    return pd.Series((g(a + 0.5) + g(b + 0.5) - g(a + b + 1.0)).astype(float) - 2 * math.lgamma(0.5))


def _nodes(df: DataFrame, code: str = "key") -> DataFrame:
    """Eight rows per gram: ctx (the bytes before), z (a one, then the symbol's bits so far) and bit."""
    return df.withColumn("k", F.explode(F.expr("sequence(0, 7)"))).selectExpr("*", f"shiftrightunsigned({code}, 8) AS ctx", f"(shiftleft(1L, k) | shiftrightunsigned({code} & 255, 8 - k)) AS z", f"(shiftrightunsigned({code}, 7 - k) & 1) AS bit")


def _shorter(ctx: str, depth: int) -> str:
    return f"({ctx} & {(1 << 8 * depth) - 1}L)"


def context_tree(counts: DataFrame, depth: int = DEPTH) -> list[DataFrame]:
    """For each depth 0 .. depth: (ctx, z, p), p the weighted probability of a one if no longer context is known.

    counts: key (gram code), n > 0. Sums go up the tree by groupBy, weights come down by joins.
    """
    log_kt = F.pandas_udf(_log_kt, "double")
    level = _nodes(counts).groupBy("ctx", "z").agg(F.sum(F.expr("if(bit = 0, n, 0)")).alias("n0"), F.sum(F.expr("if(bit = 1, n, 0)")).alias("n1"))
    level = level.withColumn("kt", log_kt("n0", "n1")).withColumn("pw", F.col("kt")).withColumn("w", F.lit(1.0))
    levels = [materialize(level, f"ctw{depth}")]
    for d in range(depth - 1, -1, -1):
        up = levels[0].selectExpr(f"{_shorter('ctx', d)} AS ctx", "z", "n0", "n1", "pw").groupBy("ctx", "z").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("below"))
        up = up.withColumn("kt", log_kt("n0", "n1")).withColumn("pw", F.expr(f"greatest(kt, below) + ln(1 + exp(-abs(kt - below))) - {math.log(2)!r}D"))
        up = up.withColumn("w", F.expr(f"exp(kt - {math.log(2)!r}D - pw)"))
        levels.insert(0, materialize(up.drop("below"), f"ctw{d}"))
    one = "((n1 + 0.5D) / (n0 + n1 + 1))"
    out, parent = [], None
    for d, level in enumerate(levels):
        if parent is None:
            level = level.withColumn("pre", F.lit(0.0)).withColumn("rest", F.lit(1.0))
        else:
            above = parent.selectExpr("ctx AS up", "z", f"pre + rest * w * {one} AS pre", "rest * (1 - w) AS rest")
            level = level.withColumn("up", F.expr(_shorter("ctx", d - 1))).join(above, ["up", "z"]).drop("up")
        parent = materialize(level, f"weights{d}")
        out.append(parent.selectExpr("ctx", "z", f"pre + rest * {one} AS p"))
    return out


def gram_scores(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, value): log10 probability of each gram's last byte after the bytes before it; counts: key, n (0: not in training)."""
    tree = context_tree(counts.filter("n > 0"), depth)
    log10 = F.sum(F.expr("log10(if(bit = 1, p, 1 - p))")).alias("value")
    seen = _nodes(counts.filter("n > 0").select("key")).join(tree[depth], ["ctx", "z"]).groupBy("key").agg(log10)
    new = _nodes(counts.filter("n = 0").select("key")).withColumn("p", F.lit(None).cast("double"))
    for d in range(depth, -1, -1):
        level = tree[d].selectExpr("ctx AS c", "z", "p AS q")
        new = new.withColumn("c", F.expr(_shorter("ctx", d))).join(level, ["c", "z"], "left").withColumn("p", F.coalesce("p", "q")).drop("c", "q")
    new = new.withColumn("p", F.coalesce("p", F.lit(0.5))).groupBy("key").agg(log10)
    return seen.union(new)


def _score_batch(docs: pd.DataFrame, values: pd.DataFrame, tokens: int, distinct: int) -> pd.DataFrame:
    kind = values["kind"].to_numpy()
    keys, value = values["key"].to_numpy(), values["value"].to_numpy()
    w, g = kind == WORD, kind == GRAM
    order = np.argsort(keys[w])
    wkeys, wvalues = keys[w][order], value[w][order]
    order = np.argsort(keys[g])
    gkeys, gvalues = keys[g][order].view(np.uint64), value[g][order]
    log_total = math.log10(tokens + distinct + 1)

    class Logs(dict):
        known: set = set()

        def __missing__(self, word: bytes) -> float:
            c = wvalues[np.searchsorted(wkeys, word_keys([word])[0])]
            if c > 0:
                self.known.add(word)
            self[word] = x = math.log10(c + 1) - log_total
            return x

    logs, known = Logs(), Logs.known
    texts = [byte_text(t) for t in docs["text"]]
    rows = []
    for t in texts:
        words = [*t.split(), b""]
        base = math.fsum(map(logs.__getitem__, words))
        rows.append((len(words), sum(map(known.__contains__, words)), base))
    score = np.zeros(len(texts))
    for i, j in chunks(texts):
        code, owner = grams(texts[i:j])
        both = np.sort(code << np.uint64(24) | owner.astype(np.uint64))
        code = both >> np.uint64(24)
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        v = np.repeat(gvalues[np.searchsorted(gkeys, code[first])], np.diff(np.append(first, len(code))))
        score[i:j] = np.bincount((both & np.uint64((1 << 24) - 1)).astype(np.int64), v, j - i)
    out = pd.DataFrame(rows, columns=["n_tokens", "n_known", "base_score"])
    n_bytes = np.fromiter(map(len, texts), np.int64, len(texts))
    return pd.DataFrame(
        {
            "doc_id": docs["doc_id"].astype("Int64").to_numpy(),
            "held_out": ~docs["train"].to_numpy(bool),
            "n_tokens": out["n_tokens"],
            "n_known": out["n_known"],
            "train_tokens": tokens,
            "base_score": out["base_score"],
            "score": score,
            "bits_per_byte": -score / math.log10(2) / np.maximum(n_bytes, 1),
        }
    )


def score(docs: DataFrame, held_out: Column, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Texts are lower-cased (A-Z). held_out: a condition on docs; where it is true the text doesn't train. Null text
    counts as empty: one end token, one closing byte. Repeated rows train and are scored as often as they come.
    With no training text every estimate is one half and base_score is 0 (one possible outcome). An empty table
    gives an empty result. Words are told apart by 64-bit hashes.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (~held_out).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(MIN_BATCHES, math.ceil(size / batch_bytes))
    rows = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", F.length("text"), F.substring("text", 1, 64)), F.lit(n)).cast("int"))
    keys = materialize(vocabularies(rows.repartition(n, "batch")), "vocabularies")
    sums = materialize(keys.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    tokens, distinct = sums.filter(F.col("kind") == WORD).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.expr("if(n > 0, 1, null)"))).first()
    found = gram_scores(sums.filter(F.col("kind") == GRAM).select("key", "n")).select(F.lit(GRAM).cast("byte").alias("kind"), "key", "value")
    values = sums.filter(F.col("kind") == WORD).select("kind", "key", F.col("n").cast("double").alias("value")).union(found)
    given = keys.select("batch", "kind", "key").join(values, ["kind", "key"]).select("batch", "kind", "key", "value")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _score_batch(left, right, tokens, distinct)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return rows.groupBy("batch").cogroup(given.groupBy("batch")).applyInPandas(run, schema)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    return score(docs, fold == 2)


QUERIES = {"op10_lm_scoring": op10_lm_scoring}
ORACLE_SQL: dict[str, str] = {}
