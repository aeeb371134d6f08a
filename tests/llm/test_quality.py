import random
import zlib

import numpy as np

from plumbline.llm.quality import FEATURES, Discriminant, _line, drop_rejected, quality_scores, squash, statistics


def corpus(n):
    rng = random.Random(4)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = rng.choices(words, k=rng.randint(20, 200))
        good = rng.random() < 0.7
        junk = [str.upper, lambda x: x + "***", lambda x: x + " |", lambda x: f"{x} {x} {x}"][i % 4]
        docs.append((i, " ".join(w).capitalize() + "." if good else " ".join(map(junk, w))))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy(spark, frame, odd_texts):
    docs, labels = corpus(600)
    odd = [(10_000 + k, t) for k, (_, t) in enumerate(odd_texts)] + [(None, "text without an id")]
    known = spark.createDataFrame(labels + [(None, 1, 0), (10_000, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality_scores(frame(docs + odd), known).collect()
    assert len(rows) == len(docs) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    truth = {i: q for i, q, _ in labels}
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    out = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(out) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.95


def test_held_out_labels_teach_nothing(spark, frame):
    docs, labels = corpus(200)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in labels]
    score = lambda ls: sorted((r.doc_id, round(r.score, 9)) for r in quality_scores(frame(docs), spark.createDataFrame(ls, "doc_id long, quality int, toxic int")).collect())
    assert score(labels) == score(flipped)


def test_density_equals_the_plain_formula():
    rng = np.random.default_rng(2)
    x = [rng.normal(size=(50, 3)) * [1, 2, 3] + 1, rng.normal(size=(80, 3))]
    n, s, o = np.array([50.0, 80.0]), np.stack([v.sum(0) for v in x]), np.stack([v.T @ v for v in x])
    model = Discriminant.fit(n, s, o, 0.2, 0.1)
    cov = [np.cov(v.T, bias=True) for v in x]
    common = (50 * cov[0] + 80 * cov[1]) / 130
    full = [0.9 * (0.8 * c + 0.2 * common) + 0.1 * np.diag(np.diag(common)) for c in cov]
    point = np.array([[0.3, -1.0, 2.0]])
    dens = [np.log(k / 130) - 0.5 * np.log(np.linalg.det(c)) - 0.5 * ((point - v.mean(0)) @ np.linalg.inv(c) @ (point - v.mean(0)).T).item() for k, c, v in zip(n, full, x, strict=True)]
    assert np.isclose(model.difference(point)[0], dens[1] - dens[0])


def test_calibration_stays_finite_on_separable_scores():
    slope, shift = _line(np.array([-30.0, -3, 4, 30]), np.array([0.0, 0, 1, 1]), np.array([500.0, 5, 7, 900]))
    assert 0 < slope < 50 and abs(shift) < 50 and squash(np.array([-4.0]))[0] == -2


def test_no_labels_and_empty_tables(spark, frame):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_scores(frame([]), none).collect() == []
    assert [(r.score, r.predicted) for r in quality_scores(frame([(1, "a")]), none).collect()] == [(1.0, 1)]
    assert len(statistics(None)) == len(FEATURES) and drop_rejected(frame([(1, "a")]), none).count() == 1
