from __future__ import annotations

import zlib

import numpy as np

from shelfmark.llm import classifier

GOOD = "The quiet river carried leaves past the old mill while children counted boats from the bridge"


def texts(n):
    words = GOOD.split()
    for i in range(n):
        turned = words[i % 16 :] + words[: i % 16]
        if i % 4:
            yield " ".join(turned) + f". Then evening number {i} came.", 1
        else:
            yield " ".join(w + "###" for w in turned) + f" {i}", 0


def test_features_read_whole_texts_in_pieces(monkeypatch):
    text = (GOOD + "\n").encode() * 300
    whole = classifier.features(text)
    monkeypatch.setattr(classifier, "PIECE", 1000)
    assert np.allclose(classifier.features(text), whole)
    assert np.allclose(classifier.features(None), classifier.features(b""))
    assert not np.allclose(classifier.features(text + b"### " * 2000), whole)


def test_votes_are_exact_nearest_neighbours():
    rnd = np.random.default_rng(1)
    rows = np.abs(rnd.normal(size=(60, classifier._WIDTH))).astype(np.float32)
    labels = rnd.integers(0, 2, 60)
    model = classifier.fit(rows, labels)
    got = classifier.vote(model, rows[:9])
    unit = lambda x: x / np.linalg.norm(x)
    vectors = [unit(unit(r * model.weights) @ model.directions) for r in rows]
    for k in range(9):
        near = sorted(((float(vectors[k] @ v), y) for v, y in zip(vectors, labels, strict=True)), reverse=True)
        weights = [(max(c, 0) ** classifier.SHARP, y) for c, y in near[: classifier.NEIGHBOURS]]
        want = sum(w * y for w, y in weights) / sum(w for w, _ in weights)
        assert abs(got[k] - want) < 1e-3


def test_scores(spark, make_docs):
    made = list(texts(300))
    rows = [(i, t, "s") for i, (t, _) in enumerate(made)]
    rows += [(1000, None, None), (1001, "", None), (None, GOOD, None), (5, made[5][0], "s"), (1002, GOOD * 3000, None)]
    docs = make_docs(rows)
    labels = [(i, y, 0) for i, (_, y) in enumerate(made)] + [(1000, None, 0), (None, 1, 1), (5, 1, 0), (9999, 1, 0)]
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = classifier.learn(docs, labelled)
    got = classifier.scores(docs, model).collect()
    assert len(got) == len(rows)
    right = 0
    for r in got:
        fold = zlib.crc32(str(r.doc_id).encode()) % 4 if r.doc_id is not None else 0
        assert r.held_out == (fold == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        if r.doc_id is not None and r.doc_id < 300 and r.held_out:
            right += r.predicted == made[r.doc_id][1]
    assert right >= 0.97 * sum(r.held_out for r in got if r.doc_id is not None and r.doc_id < 300)
    # Held-out labels are never learnt.
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y, 0) for i, (_, y) in enumerate(made)]
    again = classifier.learn(docs, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"))
    assert np.array_equal(again.labels, model.labels) and np.allclose(again.vectors, model.vectors)


def test_without_rows(spark, make_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = classifier.learn(make_docs([]), labels)
    assert classifier.scores(make_docs([]), model).count() == 0
    assert [r.score for r in classifier.scores(make_docs([(1, "x", None)]), model).collect()] == [0.5]


def test_held_out_accuracy_on_the_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = classifier.scores(docs, classifier.learn(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in scored) >= 0.95 * len(scored)


def test_pairs_are_counted_at_every_length(monkeypatch):
    # 400 words of 20: few words are different, most pairs are.
    text = " ".join(f"w{k % 20} w{(k * 7 + k // 20) % 20}" for k in range(200)).encode()
    words = text.split()
    pairs = len(set(zip(words, words[1:])))
    whole = classifier.features(text)
    monkeypatch.setattr(classifier, "PIECE", 400)
    assert len(words) >= classifier.PIECE and pairs > 5 * len(set(words))
    assert classifier._distinct_pairs(words) == pairs
    assert np.allclose(classifier.features(text), whole)
