import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quakeloom.llm import near_copies as N

from .test_decontamination import brute as held_items
from .test_suffix_dedup import brute as repeats

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_copies_against_brute_force(spark):
    r = random.Random(8)
    vocab = [f"v{i}" for i in range(2000)]
    rows = []
    for g in range(25):
        base = r.choices(vocab, k=r.randrange(60, 400))
        rows.append(" ".join(base))
        for n in (0, 1, 1, 2, 4, 9):
            w = list(base)
            for i in r.sample(range(len(w)), min(n, len(w))):
                w[i] = r.choice(vocab)
            rows.append(" ".join(w))
    rows += [None, "", "!!", "two words", "Two  words!", "a b c d e f"]
    order = list(range(len(rows)))
    r.shuffle(order)
    data = [(i, rows[j]) for i, j in enumerate(order)] + [(None, "lone row"), (3, rows[order[3]])]
    sets = [set(N.shingle_set(t).tolist()) for _, t in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    groups = {}
    for i, (k, _) in enumerate(data):
        groups.setdefault(find(i), set()).add(-1 if k is None else k)
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'z' AS tid", "1 AS least")
    kept = N.keep_one(df).collect()
    assert sorted(-1 if x.doc_id is None else x.doc_id for x in kept) == sorted(min(g) for g in groups.values())
    assert N.keep_one(df.limit(0)).count() == 0


def test_fingerprints_move_little():
    w = [f"v{i}" for i in range(300)]
    a, b = (N.simhash(N.shingle_set(" ".join(x))) for x in (w, w[:-2] + ["x"] * 2))
    far = N.simhash(N.shingle_set(" ".join(f"q{i}" for i in range(300))))
    bits = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
    assert bits(a, b) < 12 < bits(a, far)


def test_stages_keep_what_they_should(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        out = out.checkpoint() if spark.sparkContext.getCheckpointDir() else out.cache()
        assert 0 < out.count() <= docs.count()
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()} and before * 0.6 < docs.count() < before
    assert (packed.groupby("sequence_id")["length"].sum() <= 2048).all()
    assert np.all(packed.groupby("sequence_id")["offset"].min() == 0)


def test_run_is_the_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_strings", "decontamination", "packing"]
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns[:2] == ["doc_id", "piece"] and out.count() > 0


def planted():
    """(doc_id, text, toxic): plain texts, toxic ones, near copies, repeated passages, benchmark items, nulls and repeated rows."""
    r = random.Random(12)
    vocab, vile = [f"word{i}" for i in range(1500)], [f"vile{i}" for i in range(12)]
    some = lambda n: " ".join(r.choices(vocab, k=n))
    items = [some(40), some(60), some(8)]
    passage = some(55)
    rows = [(some(r.randrange(30, 200)), 0) for _ in range(110)]
    rows += [(" ".join(r.sample([*r.choices(vocab, k=60), *r.choices(vile, k=12)], 72)), 1) for _ in range(60)]
    for i in range(8):
        w = rows[i][0].split()
        w[r.randrange(len(w))] = "other"
        rows += [(" ".join(w), 0), (rows[i][0], 0)]
    rows += [(f"{some(40)} {passage} {some(40)}", 0) for _ in range(5)]
    rows += [(f"{some(30)} {items[0]} {some(30)}", 0), (f"{some(30)} {items[2]}", 0), (f"{some(30)} {items[1]} {some(9)}", 0), (f"{some(50)} {items[1]}", 0)]
    rows += [(None, 0), ("", 0), ("one", 0), (some(9000), 0)]
    r.shuffle(rows)
    return [(7 * i, *x) for i, x in enumerate(rows)] + [(None, some(50), 0)], items


def reference_run(docs, items):
    """What is left of (doc_id, text, toxic), stage by stage, each over all that is left."""
    docs = [(k, t) for k, t, toxic in docs if not toxic]
    sets = [set(N.shingle_set(t).tolist()) for _, t in docs]
    group = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    first = {}
    for (k, t), g in zip(docs, group, strict=True):
        if g not in first or (k is not None and (first[g][0] is None or k < first[g][0])):
            first[g] = (k, t)
    docs = list(first.values())
    docs = [(k, b[4].decode()) for (k, _), b in zip(docs, repeats([t for _, t in docs], 200), strict=True)]
    return {k: t for k, t in docs if not held_items(t, items, 0.8)}


def test_run_against_plain_stages(spark, tmp_path):
    rows, items = planted()
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "toxic"]).astype({"doc_id": "Int64"})
    docs = frame[["doc_id", "text"]].assign(lang="en", source=None, n_chars=1, score="clash", tid=3, k=None, _m=1.5, kept=True)
    docs["source"] = docs["source"].astype("string")
    docs["k"] = docs["k"].astype("string")
    docs.to_parquet(tmp_path / "documents.parquet")
    frame.dropna(subset="doc_id")[["doc_id", "toxic"]].assign(quality=1).to_parquet(tmp_path / "labels.parquet")
    pd.DataFrame({"item_id": range(len(items)), "text": items}).to_parquet(tmp_path / "benchmark.parquet")
    want = reference_run(rows, list(enumerate(items)))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert {None if pd.isna(k) else int(k) for k in got.doc_id} == set(want)
    assert (got.groupby("sequence_id")["length"].sum() <= 2048).all()
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for k, t in want.items():
        ids = np.array([*encode.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = got[got.doc_id.isna() if k is None else got.doc_id == k].sort_values("piece")
        assert [(p.start, p.length, p.ids_crc32) for p in pieces.itertuples()] == [(a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for a in range(0, len(ids), 2048)]


def test_run_on_empty_tables(spark, tmp_path):
    pd.DataFrame({"doc_id": pd.Series([], dtype="int64"), "text": pd.Series([], dtype="string"), "lang": pd.Series([], dtype="string"), "source": pd.Series([], dtype="string"), "n_chars": pd.Series([], dtype="int64")}).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame({"doc_id": pd.Series([], dtype="int64"), "toxic": pd.Series([], dtype="int32")}).to_parquet(tmp_path / "labels.parquet")
    pd.DataFrame({"item_id": pd.Series([], dtype="int64"), "text": pd.Series([], dtype="string")}).to_parquet(tmp_path / "benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
