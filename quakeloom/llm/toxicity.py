"""Toxicity: a word classifier with a counterfactual penalty.

A logistic model over word presence is fitted on labelled texts. For every labelled sentence that names a
group (identity terms, in interchangeable sets), copies with the term swapped for the others of its set are
built; besides given sets there are learned ones of words that both classes use alike. Only the difference of the words
counts, so a copy is kept as the words that go and come, and the fit pays for each difference between the scores of a text and its copies. So a mention of a
group cannot carry the score by itself, which spares neutral mentions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

WORD = re.compile(r"\w+")

#: Sets of terms that name groups and can stand for one another in a sentence.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young"),
    ("deaf", "blind", "disabled"),
)

#: Bounds of the fit: labelled rows used, and words kept as features. Neither grows with the corpus.
MAX_ROWS, MAX_WORDS = 24_000, 6_000
#: Learned sets of terms, and terms in each.
SETS, SIZE = 8, 4


def words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def swaps(text: str | None, groups: tuple = IDENTITY_TERMS, most: int = 5) -> list[set[str]]:
    """Word sets of copies of text in which each identity term gives way to another of its set."""
    return swapped(words(text), {t: g for g in groups for t in g}, most)


def swapped(found: set[str], turn: dict[str, tuple], most: int = 5) -> list[set[str]]:
    """swaps() of a text of these words; turn: each term's set."""
    terms = turn.keys() & found
    out: list[set[str]] = []
    for step in range(1, most + 1 if terms else 1):
        copy = (found - terms) | {turn[t][(turn[t].index(t) + step) % len(turn[t])] for t in terms}
        if copy not in out and copy != found:
            out.append(copy)
    return out


def training_rows(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic", max_rows: int = MAX_ROWS) -> DataFrame:
    """(text, label) of at most max_rows labelled rows that are not held out, chosen by a hash of doc_id."""
    chosen = labels.filter(~held_out & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "label")


def word_counts(rows: DataFrame) -> tuple[DataFrame, int, float]:
    """(word, neg, pos): labelled texts of either label that hold each word; how many texts there are, and the share of label 1."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(pdf["text"], pdf["label"], strict=True):
                seen[int(label)].update(words(text))
            keys = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"word": keys, "neg": [seen[0][w] for w in keys], "pos": [seen[1][w] for w in keys]})

    n = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    total = max(1, sum(n.values()))
    by_word = rows.select("text", "label").mapInPandas(count, "word string, neg long, pos long").groupBy("word").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    return materialize(by_word, "words"), total, (n.get(1, 0) + 1) / (total + 2)


def _gain(share: float) -> Column:
    expect = (F.col("pos") + F.col("neg")) * F.lit(share)
    return F.abs(F.col("pos") - expect) / F.sqrt(expect * F.lit(1 - share) + 1)


def learned_groups(counts: DataFrame, total: int, share: float, sets: int = SETS, size: int = SIZE) -> tuple:
    """Interchangeable sets of terms from the labelled texts themselves: frequent words that are used alike in texts of
    both labels, those of like frequency together. They are neutral mentions, so a score should not depend on them."""
    df = F.col("pos") + F.col("neg")
    even = counts.filter((df >= 0.02 * total) & (df >= 4) & (F.col("pos") > 0) & (F.col("neg") > 0) & (_gain(share) <= 0.5))
    terms = [r[0] for r in even.orderBy(df.desc(), "word").limit(sets * size).collect()]
    return tuple(g for i in range(0, len(terms), size) if len(g := tuple(terms[i : i + size])) > 1)


def vocabulary(counts: DataFrame, share: float, groups: tuple = IDENTITY_TERMS, max_words: int = MAX_WORDS, least: int = 4) -> list[str]:
    """The words whose presence tells most about the label (by the signed root of the likelihood ratio), and the terms of groups."""
    best = counts.filter(F.col("pos") + F.col("neg") >= least).orderBy(_gain(share).desc(), "word").limit(max_words)
    terms = counts.filter(F.col("word").isin([t for g in groups for t in g]))
    return sorted({r[0] for r in best.select("word").union(terms.select("word")).collect()})


def design(rows: DataFrame, vocab: list[str], groups: tuple = IDENTITY_TERMS) -> pd.DataFrame:
    """label, x (indexes of the words present) and, for every counterfactual copy, what it swaps: i for a word that goes,
    -1 - i for one that comes. A swap holds a few terms, so the size is bounded by max_rows and the words of a text."""
    place = {w: i for i, w in enumerate(vocab)}
    turn = {t: g for g in groups for t in g}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = lambda s: sorted(place[w] for w in place.keys() & s)
        for pdf in batches:
            found = [words(t) for t in pdf["text"]]
            swap = [[index(w - c) + [-1 - i for i in index(c - w)] for c in swapped(w, turn)] for w in found]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "x": [index(w) for w in found], "swapped": swap})

    return rows.mapInPandas(run, "doc_id long, label int, x array<int>, swapped array<array<int>>").toPandas().sort_values("doc_id")


def _csr(lists: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter((len(x) for x in lists), np.int64, len(lists))
    return np.repeat(np.arange(len(lists)), sizes), np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(lists) else np.zeros(0, np.int64)


def fit(data: pd.DataFrame, n_words: int, fairness: float = 1.0, ridge: float = 1e-3, steps: int = 300, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam on mean log loss + ridge * |w|^2 + fairness * mean (score(x) - score(x'))^2 over swapped copies."""
    y = data["label"].to_numpy(float)
    row, col = _csr(list(data["x"]))
    pairs = [(i, s) for i, ss in enumerate(data["swapped"]) for s in ss]
    prow, change = _csr([s for _, s in pairs])
    sign, pcol = np.where(change < 0, -1.0, 1.0), np.where(change < 0, -1 - change, change)
    of = np.array([i for i, _ in pairs], np.int64)
    w, b = np.zeros(n_words), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v = np.zeros(n_words + 1), np.zeros(n_words + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col], len(y)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        r = (p - y) / max(1, len(y))
        if len(of):
            # score differences in logits; both copies share the intercept
            gap = np.bincount(prow, sign * w[pcol], len(of))
            push = 2 * fairness * gap / len(of)
            g = np.bincount(col, r[row], n_words) + np.bincount(pcol, sign * push[prow], n_words)
        else:
            g = np.bincount(col, r[row], n_words)
        g = np.append(g + 2 * ridge * w / max(1, len(y)) ** 0.5, r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic", groups: tuple = IDENTITY_TERMS, fairness: float = 1.0, max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS) -> dict:
    """{"words": {word: weight}, "bias": intercept, "copies": swapped copies in the fit}. groups are taken together with
    learned_groups(). Without any labelled row the model scores 0.5 less a hair."""
    rows = materialize(training_rows(docs, labels, held_out, label, max_rows), "labelled")
    counts, total, share = word_counts(rows)
    known = {t for g in groups for t in g}
    learned = (tuple(t for t in g if t not in known) for g in learned_groups(counts, total, share))
    groups = (*groups, *(g for g in learned if len(g) > 1))
    vocab = vocabulary(counts, share, groups, max_words)
    data = design(rows, vocab, groups)
    if data.empty:
        return {"words": {}, "bias": -1e-6, "copies": 0}
    w, b = fit(data, len(vocab), fairness)
    return {"words": {t: float(x) for t, x in zip(vocab, w, strict=True) if x}, "bias": b, "copies": int(data["swapped"].map(len).sum())}


def score(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """docs with the score (0 to 1) appended; a null or empty text scores the model's intercept. A column of that name is replaced."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most MAX_WORDS + identity terms

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        weight, bias = shared.value["words"], shared.value["bias"]
        known = weight.keys()
        z = np.fromiter((bias + sum(map(weight.__getitem__, sorted(known & words(t)))) for t in texts), float, len(texts))
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -60, 60))))

    return docs.withColumn(name, run("text"))


def fold(column: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; rows with crc32(doc_id) mod 5 = 0 never train."""
    model = train(docs, labels, fold() == 0)
    out = score(docs.select("doc_id", "text"), model).select("doc_id", (fold() == 0).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLE_SQL: dict[str, str] = {}
