"""The CRF is fitted on whole documents."""

import numpy as np

from treeslab.llm import quality


def test_training_reads_whole_documents(spark, monkeypatch):
    line = lambda doc, k: " ".join(f"w{doc}x{k}x{j}" for j in range(5))
    clean = "\n".join(line(1, k) for k in range(300))
    repeats_late = "\n".join([line(2, k) for k in range(200)] + [line(2, 200)] * 300)
    docs = spark.createDataFrame([(1, clean), (2, repeats_late)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "train", lambda sequences: seen.extend(sequences) or quality.Crf.blank())
    quality.fit(docs, labels)
    assert [(len(y), int(y[0])) for _, y in seen] == [(300, 1)]


def test_groups_give_the_same_model(monkeypatch):
    rng = np.random.default_rng(3)
    sequences = [(rng.random((n, quality.N_FEATURES)), rng.integers(0, 2, n)) for n in (4, 90, 7, 1, 30, 12)]
    whole = quality.train(sequences, rounds=20)
    monkeypatch.setattr(quality, "PADDED_LINES", 60)
    assert len(quality._groups(sequences)) > 2 and sum(map(len, quality._groups(sequences))) == len(sequences)
    parts = quality.train(sequences, rounds=20)
    assert np.allclose(whole.weights, parts.weights) and np.allclose(whole.moves, parts.moves) and np.allclose(whole.first, parts.first)


def test_lines_are_told_apart(spark, sf_dir):
    """Known heads and feet around content: the labels change within documents, and the share counts content words."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghijklmno"), rng.integers(2, 9))) for _ in range(600)]
    line = lambda n: " ".join(rng.choice(words, n)).capitalize() + "."
    head, foot = "Home | Login | Subscribe | Share", ["All rights reserved.", "Licensed under the terms of the Example License."]
    rows, labels = [], []
    for k in range(160):
        if k % 4 == 3:
            rows.append((k, "\n".join(" | ".join(w.upper() + "!!" for w in rng.choice(words, 9)) for _ in range(4))))  # passes the base rules, so it trains
        else:
            rows.append((k, "\n".join([head, *(line(int(n)) for n in rng.integers(8, 25, 5)), foot[k % 2]])))
        labels.append((k, int(k % 4 != 3)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    crf = quality.fit(docs, spark.createDataFrame(labels[:80], "doc_id long, quality int"))
    good = wrong = 0
    for k, text in rows[80:]:
        data = np.frombuffer((text + " ").encode(), dtype=np.uint8)
        at, counts = quality.lines_of(data, np.array([0, len(data)]))
        got = crf.viterbi(quality.features(data, at, counts), counts)
        want = [0] + [1] * 5 + [0] if k % 4 != 3 else [0] * 4
        good, wrong = good + sum(got == want), wrong + sum(got != want)
    assert wrong <= 0.02 * (good + wrong)
    for r in quality.judge(docs, crf).where("doc_id >= 80").collect():
        assert (0 < r.content_share < 1 and r.kept) if r.doc_id % 4 != 3 else (r.content_share == 0 and not r.kept), r


def test_shares_between(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = quality.judge(docs, quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))).where("not base_failed").collect()
    between = [r for r in found if 0 < r.content_share < 1]
    assert len(between) > 0.05 * len(found), (len(between), len(found))
