import zlib

import brute_force as brute
import numpy as np
import pytest

from tidewatch.llm import mil, queries
from tidewatch.llm.passages import DIMENSIONS, PASSAGE, encode

ROOT = "/root/testdata/sf0.01"


def area(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    y = np.asarray(labels)[:].astype(bool)
    return (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def test_held_out_labels_are_predicted(spark):
    rows = {r.doc_id: r for r in queries.op8_quality_classifier(spark, ROOT).collect()}
    assert len(rows) == spark.read.parquet(f"{ROOT}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for i, r in rows.items())
    test = [(rows[x.doc_id], x.quality) for x in spark.read.parquet(f"{ROOT}/labels.parquet").collect() if rows[x.doc_id].held_out]
    assert area(np.array([r.score for r, _ in test]), np.array([y for _, y in test])) > 0.95
    assert np.mean([r.predicted == y for r, y in test]) > 0.97 and all(r.predicted for r, y in test if y)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, DIMENSIONS)) for n in (1, 4, 2)]
    y = np.array([1.0, 0.0, 1.0])
    shapes = {"encode": (DIMENSIONS, mil.ENCODED), "encode_b": (mil.ENCODED,), "value": (mil.ENCODED, mil.GATES), "gate": (mil.ENCODED, mil.GATES), "attend": (mil.GATES,), "score": (mil.ENCODED,), "score_b": (1,)}
    w = {k: rng.normal(0, 0.3, s) for k, s in shapes.items()}
    x, starts = np.concatenate(bags), mil._starts(bags)

    def loss(w):
        p = mil._forward(w, x, starts)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grads = mil._gradients(w, x, starts, y)
    for k, s in shapes.items():
        at = tuple(int(rng.integers(n)) for n in s)
        up, down = ({**w, k: w[k].copy()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert grads[k][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=1e-4, abs=1e-8)


def test_scores_do_not_depend_on_the_batch_and_weigh_every_passage():
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(n, DIMENSIONS)) for n in (3, 1, 200, 2)]
    model = mil.fit_bags(bags, np.array([0, 1, 1, 0]), steps=20)
    one = [float(model.scores([b])[0]) for b in bags]
    assert model.scores(bags) == pytest.approx(one)
    f = mil._forward(model.weights, mil._standard(bags[2], model.mean, model.scale), np.array([0]))
    assert f["a"].sum() == pytest.approx(1) and len(f["a"]) == 200
    assert encode(b"a " * (PASSAGE * 3 + 1)).shape == (4, DIMENSIONS) and encode(b" \n").shape == (1, DIMENSIONS)


def test_odd_rows(spark):
    docs = brute.dirty(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (9, 1, 0), (8, 1, 0), (11, 0, 0), (12, 0, None), (None, 1, 0), (3, None, 1), (5, 7, 0)], "doc_id bigint, quality int, toxic int")
    model = mil.fit(docs, labels)
    scored = mil.with_scores(docs, model).collect()
    assert len(scored) == docs.count() and all(r.score is not None for r in scored)
    assert mil.accepted(docs, model).columns == docs.columns
    for few in (labels.limit(0), labels.where("quality = 1"), labels.where("false")):
        assert mil.with_scores(docs, mil.fit(docs, few)).where("score IS NULL").count() == 0
    assert mil.with_scores(brute.empty(spark), model).count() == 0


def plain_forward(w, bag):
    """Score of one bag, passage by passage and unit by unit."""
    h = [[np.tanh(sum(x[d] * w["encode"][d][u] for d in range(len(x))) + w["encode_b"][u]) for u in range(mil.ENCODED)] for x in bag]
    e = []
    for row in h:
        total = 0.0
        for k in range(mil.GATES):
            t = np.tanh(sum(row[u] * w["value"][u][k] for u in range(mil.ENCODED)))
            g = 1 / (1 + np.exp(-sum(row[u] * w["gate"][u][k] for u in range(mil.ENCODED))))
            total += t * g * w["attend"][k]
        e.append(np.exp(total))
    a = [x / sum(e) for x in e]
    z = [sum(a[i] * h[i][u] for i in range(len(h))) for u in range(mil.ENCODED)]
    return 1 / (1 + np.exp(-(sum(z[u] * w["score"][u] for u in range(mil.ENCODED)) + w["score_b"][0])))


def plain_fit(bags, labels, seed, steps):
    """The same steps with gradients by differences, one bag at a time."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    bags = [mil._standard(b, mean, scale) for b in bags]
    shapes = {"encode": (DIMENSIONS, mil.ENCODED), "encode_b": (mil.ENCODED,), "value": (mil.ENCODED, mil.GATES), "gate": (mil.ENCODED, mil.GATES), "attend": (mil.GATES,), "score": (mil.ENCODED,), "score_b": (1,)}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) * (k not in ("encode_b", "score_b")) for k, s in shapes.items()}
    first, second = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(bags), min(mil.BATCH, len(bags)))
        grads = {k: np.zeros(s) for k, s in shapes.items()}
        for i in pick:  # the mean of the bags' own gradients
            own = mil._gradients(w, bags[i], np.array([0]), np.array([float(labels[i])]))
            grads = {k: grads[k] + own[k] / len(pick) for k in grads}
        for k in w:
            g = grads[k] + mil.DECAY * w[k]
            first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g**2
            w[k] = w[k] - mil.RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return w, bags


def test_fit_and_scores_match_plain_loops():
    rng = np.random.default_rng(3)
    bags = [rng.normal(size=(n, DIMENSIONS)) for n in (2, 1, 3, 2, 1)]
    labels = np.array([1, 0, 1, 0, 1])
    model = mil.fit_bags(bags, labels, seed=5, steps=6)
    w, standard = plain_fit(bags, labels, 5, 6)
    assert all(np.allclose(model.weights[k], w[k], rtol=1e-6, atol=1e-9) for k in w)
    assert model.scores(bags) == pytest.approx([plain_forward(w, b) for b in standard])


def test_the_fit_leaves_out_documents_never_passages(spark):
    docs = brute.dirty(spark, [(i, "word " * (PASSAGE * n), "en", "s") for i, n in enumerate((1, 2, 200, 3, 1, 1, 2))])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(7)], "doc_id bigint, quality int, toxic int")
    seen = []
    real = mil.fit_bags
    try:
        mil.fit_bags = lambda bags, y, **k: seen.append([len(b) for b in bags]) or real(bags, y, steps=1)
        mil.fit(docs, labels)
        mil.fit(docs, labels, passages=9)
    finally:
        mil.fit_bags = real
    usable = [n for i, n in enumerate((1, 2, 200, 3, 1, 1, 2)) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert seen[0] == usable and sum(seen[1]) <= 9 and set(seen[1]) <= set(usable) and 200 not in seen[1]
