import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quakeloom.llm import toxicity as T

DOCS = "doc_id long, text string, score string"


def corpus():
    """Toxic texts say an insult; groups are mentioned more often in toxic texts, but not for that."""
    g = np.random.default_rng(0)
    filler = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        w = list(g.choice(filler, 12))
        if toxic:
            w[3] = ["idiot", "scum"][i % 2]
        if g.random() < (0.7 if toxic else 0.05):
            w[7] = "muslim"
        rows.append((i, " ".join(w) + ".", "x"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_counterfactual_penalty_spares_neutral_mentions(spark):
    rows, labels = corpus()
    docs, labs = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    probe = spark.createDataFrame([(1, "w1 w2 muslim w3 w4.", "x"), (2, "w1 w2 christian w3 w4.", "x"), (3, "w1 IDIOT w2 w3.", "x"), (4, None, "x"), (5, "", "x")], DOCS)
    held = F.col("doc_id") % 5 == 0
    scores = {}
    for fairness in (0.0, 5.0):
        model = T.train(docs, labs, held, fairness=fairness)
        scores[fairness] = {r.doc_id: r.score for r in T.score(probe, model).collect()}
    assert scores[5.0][1] < scores[0.0][1] and abs(scores[5.0][1] - scores[5.0][2]) < 0.1
    assert scores[5.0][3] > 0.5 > scores[5.0][2] and scores[5.0][4] == scores[5.0][5]
    assert all(0 <= x <= 1 for x in scores[5.0].values())


def test_held_out_accuracy_and_shape(spark):
    rows, labels = corpus()
    docs, labs = spark.createDataFrame([*rows, rows[0], (None, "idiot", "q")], DOCS), spark.createDataFrame([*labels, labels[1], (None, 1), (7, None)], "doc_id long, toxic int")
    out = T.judge(docs, labs).toPandas()
    assert len(out) == 602 and set(out.columns) >= {"doc_id", "held_out", "score", "predicted"}
    m = out.merge(pd.DataFrame(labels, columns=["doc_id", "toxic"]), on="doc_id").query("held_out")
    assert (m.predicted == m.toxic).mean() > 0.97
    assert (out.predicted == (out.score >= 0.5)).all()


def test_without_labels_or_rows(spark):
    docs, labs = spark.createDataFrame([(1, "a", "x")], DOCS), spark.createDataFrame([], "doc_id long, toxic int")
    assert T.judge(docs, labs).first().predicted == 0
    assert T.judge(docs.limit(0), labs).count() == 0


def test_swapped_copies_by_brute_force(spark):
    """The kept differences give the gaps between the scores of whole texts and their whole copies; learned sets exist."""
    rows, labels = corpus()
    docs, labs = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    train = T.training_rows(docs, labs, F.lit(False))
    counts, total, share = T.word_counts(train)
    groups = (*T.IDENTITY_TERMS, *T.learned_groups(counts, total, share))
    vocab = T.vocabulary(counts, share, groups)
    data = T.design(train, vocab, groups).set_index("doc_id")
    assert len(groups) > len(T.IDENTITY_TERMS) and total == 600 and data["swapped"].map(len).sum() > 600
    w = np.random.default_rng(0).normal(size=len(vocab))
    weight = dict(zip(vocab, w, strict=True))
    z = lambda found: sum(weight.get(t, 0) for t in found)
    for i, text, _ in rows[:100]:
        gaps = [z(T.words(text)) - z(c) for c in T.swaps(text, groups)]
        kept = [sum(w[j] if j >= 0 else -w[-1 - j] for j in s) for s in data.loc[i, "swapped"]]
        assert np.allclose(gaps, kept)
    gap = {}
    for fairness in (0.0, 5.0):
        fitted, _ = T.fit(data.reset_index(), len(vocab), fairness)
        gap[fairness] = np.mean([sum(fitted[j] if j >= 0 else -fitted[-1 - j] for j in s) ** 2 for ss in data["swapped"] for s in ss])
    assert gap[5.0] < gap[0.0]


def test_swaps_go_sentence_by_sentence():
    got = T.swaps("Women sing. A gay man left.")
    assert len(got) >= 3 and all("women" not in g and "man" not in g and "gay" not in g for g in got[:3]) and T.swaps("nothing here") == [] == T.swaps(None)
