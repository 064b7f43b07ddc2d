import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from driftloom.llm import hmm_lm

from .support import ODD, ascii_lower, rows, table, words


def left_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1


def brute(data):
    tokens = [[*words(ascii_lower(t)), None] for _, t, *_ in data]
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1 for d, *_ in data]
    c = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return sorted((str(d), h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for (d, *_), t, h in zip(data, tokens, held, strict=True))


def test_base_of_odd_rows_with_and_without_rare_words(spark):
    data = [*ODD, *((100 + i, f"word{i % 3} alpha beta gamma unseen{i}", "en", "s", 1) for i in range(30))]
    for top in (1 << 17, 6):
        got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows(hmm_lm.score(table(spark, data, clashes=False), left_out(), top=top)))
        assert got == brute(data)


def test_forward_is_the_sum_over_all_paths():
    rng = np.random.default_rng(2)
    draw = lambda *s: (lambda x: (x / x.sum(axis=-1, keepdims=True)).astype(np.float32))(rng.random(s))
    model = hmm_lm.Model(draw(3), draw(3, 3), np.ascontiguousarray(draw(3, 5).T))
    sequences = [[0, 1, 4], [2], [3, 3, 1, 0, 4]]
    flat = np.array([x for s in sequences for x in s], np.int32)
    n = np.array(list(map(len, sequences)))
    got = hmm_lm.forward(model, hmm_lm._Laid(flat, np.cumsum(n) - n, n), False)[0]
    for s, g in zip(sequences, got, strict=True):
        p = sum(math.prod([model.start[y[0]], model.emit[s[0], y[0]], *(model.move[y[i - 1], y[i]] * model.emit[s[i], y[i]] for i in range(1, len(s)))]) for y in product(range(3), repeat=len(s)))
        assert abs(g - math.log10(p)) < 1e-4


def test_a_round_never_lowers_the_likelihood():
    rng = np.random.default_rng(4)
    flat = rng.integers(0, 8, 600).astype(np.int32)
    n = np.full(30, 20)
    laid = hmm_lm._Laid(flat, np.cumsum(n) - n, n)
    plain = np.full(8, 1 / 8)
    emit = rng.random((8, 3)).astype(np.float32)
    model = hmm_lm.Model(np.full(3, 1 / 3, np.float32), np.full((3, 3), 1 / 3, np.float32), emit / emit.sum(axis=0))
    before = -math.inf
    for _ in range(6):
        now = hmm_lm.forward(model, laid, False)[0].sum()
        assert now > before - 0.5
        before = now
        sums = np.zeros((3, 8)), np.zeros((3, 3)), np.zeros(3)
        hmm_lm.expected(model, laid, *sums)
        assert abs(sums[0].sum() - 600) < 1e-2
        model = hmm_lm.renew(model, plain, *sums)


def test_states_beat_single_words_on_held_out_texts(spark):
    rng = random.Random(1)
    tongues = [[f"{c}{i}" for i in range(60)] for c in "abcd"]
    data = [(i, " ".join(rng.choice(tongues[i % 4]) for _ in range(60)), "en", "s", 1) for i in range(240)]
    got = [r for r in rows(hmm_lm.score(table(spark, data, clashes=False), left_out(), states=4)) if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got) + 0.3 * sum(r["n_tokens"] for r in got)


def test_empty_table_and_no_training_text(spark):
    assert rows(hmm_lm.score(table(spark, [], clashes=False), left_out())) == []
    got = rows(hmm_lm.score(table(spark, ODD[:1], clashes=False), F.lit(True)))
    assert got[0]["held_out"] and got[0]["train_tokens"] == 0 and math.isfinite(got[0]["score"])
