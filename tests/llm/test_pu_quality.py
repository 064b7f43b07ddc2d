import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from driftloom.llm import pu_quality

from .support import ODD, rows, table


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    data, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 120))]
        text = " ".join(words) + "." if good else rng.choice([" ".join(w.upper() + "!!" for w in words), " ".join(w + "###" for w in words), "\n".join([" ".join(words[:6])] * 20)])
        data.append((i, text, "en", "s", len(text)))
        if rng.random() < 0.5:
            labels.append((i, int(good), 0))
    return data, labels, "doc_id long, quality int, toxic int"


def test_held_out_accuracy_from_positives_alone(spark):
    data, labels, schema = corpus()
    marks = spark.createDataFrame([r for r in labels if r[1] == 1], schema)
    got = {r["doc_id"]: r for r in rows(pu_quality.score(table(spark, data), marks, F.crc32(F.col("doc_id").cast("string")) % 4 == 2))}
    held = [(got[i]["predicted"], q) for i, q, _ in labels if got[i]["held_out"]]
    assert len(held) > 40 and sum(p == q for p, q in held) / len(held) > 0.9


def test_prior_is_near_the_truth():
    rng = np.random.default_rng(0)
    count = lambda x: np.histogram(x, np.linspace(-10, 10, 2001))[0]
    p, u = rng.normal(2, 1, 4000), np.concatenate([rng.normal(2, 1, 2800), rng.normal(-2, 1, 1200)])
    assert abs(pu_quality.class_prior(count(p), count(u)) - 0.7) < 0.06


def test_bins_are_quantiles_and_ends():
    x = np.float32([[i / 100] * len(pu_quality.MEASURES) for i in range(1000)])
    levels, n = np.unique(x[:, 0].view(np.uint32) >> pu_quality._DROPPED, return_counts=True)
    bounds = pu_quality.bin_bounds({True: [(levels.astype(np.int64), n)] * len(pu_quality.MEASURES), False: [(levels[:0].astype(np.int64), n[:0])] * len(pu_quality.MEASURES)}, 4)[0]
    assert np.allclose(bounds, [0.1, 0.3, 2.5, 5, 7.5, 9.7, 9.9], rtol=0.006, atol=0.015)


def _plain_risk(bins, positive, starts, w, prior):
    """The non-negative risk by its definition, text by text."""
    z = [sum(w[starts[m] + b] for m, b in enumerate(row)) + w[-1] for row in bins]
    loss = lambda z, call: np.log1p(np.exp(-call * z))
    own = [v for v, p in zip(z, positive, strict=True) if p]
    rest = np.mean([loss(v, -1) for v in z]) - prior * np.mean([loss(v, -1) for v in own])
    return prior * np.mean([loss(v, 1) for v in own]) + rest + (pu_quality.DECAY / len(own) * w[:-1] ** 2).sum() / 2 + 1e-6 * w[-1] ** 2 / 2, rest


def _some(n=300, measures=3, each=4, seed=2):
    rng = np.random.default_rng(seed)
    positive = rng.random(n) < 0.3
    bins = np.minimum(rng.integers(0, each, (n, measures)) + (positive | (rng.random(n) < 0.4))[:, None], each - 1)
    model = pu_quality.Scorer([np.arange(each - 1.0)] * measures)
    return bins, positive, model, rng


def test_risk_and_slope_are_those_of_the_definition():
    bins, positive, model, rng = _some()
    w = rng.normal(0, 0.5, len(model.weights))
    model.weights = w
    sums = pu_quality._Sums(len(w))
    sums.add(model, bins, positive)
    value, rest, slope, curve = pu_quality.risk(sums, w, 0.5)
    assert np.allclose((value, rest), _plain_risk(bins, positive, model.starts, w, 0.5))
    for i in range(len(w)):
        d = np.eye(len(w))[i] * 1e-5
        up, down = (_plain_risk(bins, positive, model.starts, w + s * d, 0.5)[0] for s in (1, -1))
        assert abs((up - down) / 2e-5 - slope[i]) < 1e-6
        sums_up = pu_quality._Sums(len(w))
        model.weights = w + d
        sums_up.add(model, bins, positive)
        assert np.allclose((pu_quality.risk(sums_up, w + d, 0.5)[2] - slope) / 1e-5, curve[i], atol=1e-4)
        model.weights = w


def test_fit_over_partitions_finds_the_least_risk(spark, monkeypatch):
    bins, positive, model, rng = _some()
    monkeypatch.setattr(pu_quality, "MEASURES", ("a", "b", "c"))
    coded = spark.createDataFrame([(bytes(map(int, b)), bool(p)) for b, p in zip(bins, positive, strict=True)], "bins binary, positive boolean").repartition(5)
    monkeypatch.setattr(pu_quality, "_unpacked", lambda b: np.array([list(x.as_py()) for x in b], int).reshape(len(b), 3))
    for prior in (0.4, 0.8):  # the rest is free with the one, at its bound with the other

        def clipped(w, prior=prior):
            value, rest = _plain_risk(bins, positive, model.starts, w, prior)
            return value - rest + max(-pu_quality.SLACK * prior, rest), rest

        pu_quality._fit(coded, model, prior)
        least, rest = clipped(model.weights)
        assert rest >= -pu_quality.SLACK * prior - 3e-3 and (prior == 0.4) == (rest > 0.01)
        for size in (0.3, 0.05, 0.01):
            for _ in range(60):
                assert clipped(model.weights + rng.normal(0, size, len(model.weights)))[0] > least - 3e-3


def test_odd_rows_repeated_labels_and_no_labels(spark):
    marks = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    got = rows(pu_quality.score(table(spark, ODD), marks, F.lit(False)))
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    none = rows(pu_quality.score(table(spark, ODD), marks.limit(0), F.lit(False)))
    assert {r["score"] for r in none} == {0.5} and {r["predicted"] for r in none} == {0}
    assert rows(pu_quality.score(table(spark, []), marks, F.lit(False))) == []


def test_measures_of_a_text():
    x = dict(zip(pu_quality.MEASURES, pu_quality.measures(pa.array(["Ab c. Ab c. Ab c.\nAb c. Ab c. Ab c.", None]))[0], strict=True))
    assert abs(x["words"] - np.log1p(12)) < 1e-6 and x["line_repeats"] == 0.5 and x["ends"] == 1.0 and x["upper"] == np.float32(6 / 24)
