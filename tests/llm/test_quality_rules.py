import random
import re
from collections import Counter

from quakeloom.llm import quality_rules as Q


def plain(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n, cover = Counter(zip(w, w[1:], w[2:], strict=False)), bytearray(len(w))
    for i in range(len(w) - 2):
        if n[w[i], w[i + 1], w[i + 2]] > 1:
            cover[i : i + 3] = b"\1\1\1"
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(cover)


def test_statistics_against_brute_force(spark):
    r = random.Random(5)
    bits = ["a", "bb", "é", "日本", "x|y", "#", "$$", "\n", "\n", "\t", " ", "  ", "\x0b", "\r\n", " ", "\x1c", "the", "the"]
    rows = [(i, "".join(r.choice(bits) + r.choice(["", " ", "\n"]) for _ in range(r.randrange(120)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "one two three one two three one"), (104, "a a a a"), (105, "x\nx\n\nx\n"), (106, "word " * 3000), (None, "q"), (103, "dup row")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS w", "2 AS lines")
    got = sorted((str(x.doc_id), x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in Q.text_statistics(df).collect())
    assert got == sorted((str(i), *plain(t)) for i, t in rows)


def test_rules_are_learned_and_ordered(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(1200):
        kind = i % 6
        w = ["".join(r.choices("abcdefghij", k=r.randrange(2, 8))) for _ in range(r.randrange(60, 120))]
        if kind == 0:
            w = [x + "$$$" for x in w]
        if kind == 1:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(kind > 1)))
    docs, labs = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 0), (5, None), (3, 7)], "doc_id long, quality int")
    out = Q.decide(docs, labs).toPandas().sort_values("doc_id")
    assert not out.base_failed.any() and (out.kept.astype(int).to_numpy() == [q for _, q in labels]).mean() > 0.99
    none = Q.decide(docs, labs.limit(0)).toPandas()
    assert (none.kept == ~none.base_failed).all()
    assert Q.decide(docs.limit(0), labs).count() == 0


def test_emitted_condition():
    sql = Q.as_sql([[("words", ">", 3.0), ("symbols_per_word", "<=", 0.5)], [("words", "<=", 1.0)]])
    assert sql.startswith("CASE WHEN CAST(n_words AS DOUBLE) > 3.0D AND") and sql.index("> 3.0D") < sql.index("<= 1.0D") and Q.as_sql([]) == "true"
