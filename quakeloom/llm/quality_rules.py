"""Quality filter by a learned decision list, in DataFrame operations only.

Statistics of every whole text are column expressions. From those of labelled texts, sequential covering learns
rules for the class to drop: a rule starts empty, grows by the threshold test with the largest information gain on
two thirds of the labelled rows, is pruned on the last third by dropping its last tests while that improves it, and
takes the rows it covers out. The list becomes one ordered CASE expression over the statistics.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, materialize, table

#: Bound of the labelled sample, and limits of the list: thresholds per statistic, rules, tests in a rule.
MAX_ROWS, BINS, MAX_RULES, MAX_TESTS = 50_000, 24, 8, 3
WHITE = " \t\n\x0b\f\r"

#: What rules may test, as expressions over the counts below. A text without words has 0 everywhere.
FEATURES = {
    "words": "CAST(n_words AS DOUBLE)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "bangs_per_word": "n_bangs / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_digits, n_bangs.

    Null and blank texts count 0 everywhere. Three-word windows are compared by 64-bit hashes within a text.
    """
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("trimmed", F.btrim("text", F.lit(WHITE)))
    t = t.withColumn("w", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", f"{SPACE}+")))
    t = t.withColumn("lines", F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != ""))
    # windows as (hash, place), sorted: equal ones become neighbours
    t = t.withColumn("g", F.expr("if(size(w) < 3, array(), sort_array(transform(sequence(0, size(w) - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) AS h, i AS i))))"))
    t = t.withColumn("twice", F.expr("sort_array(transform(filter(g, (x, j) -> (j > 0 AND g[greatest(j - 1, 0)].h = x.h) OR (j < size(g) - 1 AND g[least(j + 1, size(g) - 1)].h = x.h)), x -> x.i))"))
    return t.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        (F.length("text") - F.regexp_count("text", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("aggregate(twice, struct(0L AS n, -3 AS p), (a, x) -> struct(a.n + least(3, x - a.p) AS n, x AS p), a -> a.n)").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit("[0-9]")).cast("long").alias("n_digits"),
        F.regexp_count("text", F.lit("[!?]")).cast("long").alias("n_bangs"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """Information that a test adds about the rows of the class that it keeps."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(labelled: DataFrame, features: dict[str, str] = FEATURES, max_rules: int = MAX_RULES, max_tests: int = MAX_TESTS, least: int = 20, purity: float = 0.75) -> list[list[tuple[str, str, float]]]:
    """Ordered rules for the rows with bad = 1; a rule is a list of (feature, "<=" or ">", threshold) that must all hold.

    labelled: the statistics, bad (0 or 1) and grow (boolean: grows rules, else prunes them). A rule needs `least`
    rows of the class and `purity` on the rows that prune; learning stops at the first that hasn't.
    """
    names = list(features)
    x = labelled.select("bad", "grow", *(F.expr(f"CAST({e} AS DOUBLE)").alias(f) for f, e in features.items()))
    marks = x.agg(*(F.percentile_approx(f, [i / BINS for i in range(1, BINS)], 1000).alias(f) for f in names)).first()
    cuts = {f: sorted(set(marks[f] or [])) for f in names}
    # the rows as bins of each statistic: bin b lies above cuts[b - 1] and at or below cuts[b]
    def bin_of(f: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cuts[f])), lambda c: c < F.col(f))) if cuts[f] else F.lit(0)

    binned = materialize(x.select("bad", "grow", *(bin_of(f).alias(f) for f in names)).groupBy("bad", "grow", *names).count(), "binned")

    def holds(rule: list[tuple[str, str, int]]) -> Column:
        out = F.lit(True)
        for f, op, b in rule:
            out = out & (F.col(f) <= b if op == "<=" else F.col(f) > b)
        return out

    def tally(rows: DataFrame) -> tuple[float, float]:
        r = rows.agg(F.sum(F.expr("if(bad = 1, count, 0)")), F.sum(F.expr("if(bad = 1, 0, count)"))).first()
        return float(r[0] or 0), float(r[1] or 0)

    def grown(rows: DataFrame, start: tuple[float, float]) -> list[tuple[str, str, int]]:
        rule: list = []
        (p0, n0) = start
        while len(rule) < max_tests and n0 and p0:
            sides = rows.filter(holds(rule)).select("bad", "count", F.posexplode(F.array(*names)).alias("f", "b"))
            counts = {(r["f"], r["b"]): (r["p"], r["n"]) for r in sides.groupBy("f", "b").agg(F.sum(F.expr("if(bad = 1, count, 0)")).alias("p"), F.sum(F.expr("if(bad = 1, 0, count)")).alias("n")).collect()}
            best = (1e-9, None)
            for i, f in enumerate(names):
                p = n = 0.0
                for b in range(len(cuts[f])):
                    dp, dn = counts.get((i, b), (0, 0))
                    p, n = p + dp, n + dn
                    best = max(best, (_gain(p, n, p0, n0), (f, "<=", b), p, n), (_gain(p0 - p, n0 - n, p0, n0), (f, ">", b), p0 - p, n0 - n), key=lambda c: c[0])
            if best[1] is None:
                break
            rule.append(best[1])
            p0, n0 = best[2], best[3]
        return rule

    rules: list = []
    left = binned
    for _ in range(max_rules):
        start = tally(left.filter("grow"))
        if start[0] < least:
            break
        rule = grown(left.filter("grow"), start)
        scores = [tally(left.filter(~F.col("grow") & holds(rule[:k]))) for k in range(1, len(rule) + 1)]
        worth = [((p - n) / (p + n) if p + n else -1.0, -k) for k, (p, n) in enumerate(scores)]
        if not worth:
            break
        k = -max(worth)[1]
        p, n = scores[k]
        if p < max(1, least / 2) or p / (p + n) < purity:
            break
        rule = rule[: k + 1]
        rules.append([(f, op, float(cuts[f][b])) for f, op, b in rule])
        left = left.filter(~holds(rule))
    return rules


def as_sql(rules: list[list[tuple[str, str, float]]], features: dict[str, str] = FEATURES) -> str:
    """The ordered conditional: false where a rule holds, else true."""
    cases = " ".join("WHEN " + " AND ".join(f"{features[f]} {op} {t!r}D" for f, op, t in rule) + " THEN false" for rule in rules)
    return f"CASE {cases} ELSE true END" if cases else "true"


def decide(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    labels: doc_id and quality (1 good, 0 bad; other rows are left out), of which at most max_rows, chosen by a
    hash of doc_id, are learned from. Null text counts as empty and fails the base. Without labels the base decides
    alone. Repeated rows are judged alike; an empty table gives an empty result.
    """
    stats = materialize(text_statistics(docs), "statistics")
    chosen = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg((1 - F.min("quality")).alias("bad"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    labelled = stats.join(F.broadcast(chosen), "doc_id").filter(~base_failed()).withColumn("grow", F.pmod(F.xxhash64(F.lit("grow"), "doc_id"), F.lit(3)) > 0)
    rules = learn(labelled)
    kept = F.when(base_failed(), F.lit(False)).otherwise(F.expr(as_sql(rules)))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), kept.alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLE_SQL: dict[str, str] = {}
