import random

import numpy as np

from driftloom.llm import hmm_lm

from .support import rows, table
from .test_hmm_lm import left_out


def test_what_stands_late_in_texts_shapes_the_states(spark):
    rng = random.Random(3)
    tongues = [[f"{c}{i}" for i in range(60)] for c in "abcd"]
    data = [(i, " ".join([*(f"same{rng.randrange(20)}" for _ in range(400)), *(rng.choice(tongues[i % 4]) for _ in range(200))]), "en", "s", 1) for i in range(240)]
    got = [r for r in rows(hmm_lm.score(table(spark, data, clashes=False), left_out(), states=5)) if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got) + 0.3 * sum(r["n_tokens"] for r in got)


def test_rounds_end_when_the_likelihood_settles(spark, monkeypatch):
    seen, one = [], hmm_lm.baum_welch
    monkeypatch.setattr(hmm_lm, "baum_welch", lambda *a: (lambda r: (seen.append(r[1]), r)[1])(one(*a)))
    rng = random.Random(1)
    data = [(i, " ".join(f"{'abcd'[i % 4]}{rng.randrange(60)}" for _ in range(60)), "en", "s", 1) for i in range(120)]
    hmm_lm.score(table(spark, data, clashes=False), left_out(), states=4).collect()
    gains, tokens = np.diff(seen), 61 * 120
    assert 3 <= len(seen) < hmm_lm.ROUNDS and gains.min() > -0.001 * tokens and gains[0] > 0.01 * tokens and max(gains[-2:]) < hmm_lm.SETTLED * tokens


def test_long_texts_go_through_whole(monkeypatch):
    rng = np.random.default_rng(8)
    draw = lambda *s: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(s))
    model = hmm_lm.Model(draw(3), draw(3, 3), np.ascontiguousarray(draw(3, 9).T))
    seen = rng.integers(0, 9, 103).astype(np.int32)
    whole = np.zeros((3, 9)), np.zeros((3, 3)), np.zeros(3)
    log = hmm_lm.expected(model, hmm_lm._one(seen), *whole)
    for size in (103, 50, 17, 1):
        monkeypatch.setattr(hmm_lm, "BATCH", size)
        blocks = np.zeros((3, 9)), np.zeros((3, 3)), np.zeros(3)
        assert abs(hmm_lm.expected_long(model, seen, *blocks) - log) < 1e-9
        assert all(np.allclose(a, b) for a, b in zip(whole, blocks, strict=True))


def test_what_rounds_gather_follows_the_training_texts(spark):
    frame = spark.range(0, 400, 1, 40).selectExpr("false as held_out", "array(cast(id % 700 as int)) as ids")
    for parts in (40, 20, 3, 1):
        assert hmm_lm._training(frame, parts * hmm_lm.SHARE).rdd.getNumPartitions() == parts


def test_a_round_adds_up_all_partitions(spark):
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 700, rng.integers(1, 40)).tolist() for _ in range(60)]
    draw = lambda *s: (lambda x: (x / x.sum(axis=-1, keepdims=True)).astype(np.float32))(rng.random(s))
    model, plain = hmm_lm.Model(draw(3), draw(3, 3), np.ascontiguousarray(draw(3, 700).T)), np.full(700, 1 / 700)
    n = np.array([len(t) for t in texts])
    sums = np.zeros((3, 700)), np.zeros((3, 3)), np.zeros(3)
    log = hmm_lm.expected(model, hmm_lm._Laid(np.concatenate(texts).astype(np.int32), np.cumsum(n) - n, n), *sums)
    wanted = hmm_lm.renew(model, plain, *sums)
    got, found = hmm_lm.baum_welch(spark.createDataFrame([(t,) for t in texts], "ids array<int>").repartition(7), model, plain)
    assert abs(found - log) < 1e-2 and all(np.allclose(getattr(got, k), getattr(wanted, k), atol=1e-5) for k in ("start", "move", "emit"))
