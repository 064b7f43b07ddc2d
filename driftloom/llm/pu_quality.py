"""Operator 8: a quality classifier learnt from trusted positives and unlabelled web text.

A linear model over binned measures of a text's whole bytes and words minimises the non-negative unbiased risk
pi * R_p(+) + max(-SLACK * pi, R_u(-) - pi * R_p(-)) with logistic loss, which is the larger of two convex functions. The class prior pi is estimated from the data: a first
model ranks positives against unlabelled texts, and the share of unlabelled texts beyond a rank, over the share of positives
beyond it, is an upper bound of pi whose least value is taken; each half is ranked by a model of the other. Texts labelled 0 are never
used.

Every text that isn't held out takes part: the bins, the class prior and the risk come from sums over all partitions,
which are added up in two steps, so that the driver gets a few vectors of a size that only the bins set. Newton's
method needs some ten such passes over one narrow row a text, which is stored once.

Defined results: a null or empty text has measures of zero and gets a score like any other; null ids are carried and
never labelled; a doc_id labelled twice counts once, as positive if any label says so; without positives every score is 0.5; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_hot, prepare, spread, table, vector_sum
from .hmm_lm import split_words
from .tokens import plain, steps

#: Bins of a measure; Newton steps at most, and the decrease of the risk at which they end; the decay of the weights, over
#: the number of positives (as a prior on the weights has it).
BINS, ROUNDS, SETTLED, DECAY = 12, 40, 1e-7, 2.0
#: Shares beyond which the ends of a measure have bins of their own, however few texts are there.
TAILS = (0.01, 0.03, 0.97, 0.99)
#: How far below zero, as a share of the prior, the part of the risk that must not be negative may go: sampling error.
SLACK = 0.1
THRESHOLD = 0.7
#: Low bits of a measure that its histogram passes over: 8 bits of the mantissa stay.
_DROPPED = 15
#: Margins are counted in steps of 1 / _FINE, from -_REACH to _REACH.
_FINE, _REACH = 100, 30
MEASURES = ("words", "word_length", "upper", "digits", "symbols", "marks", "other_letters", "lines", "line_repeats", "distinct", "repeats", "long_words", "ends")


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


_SETS = {
    "upper": _class(bytes(range(65, 91))), "digits": _class(b"0123456789"), "symbols": _class(b"#*$%&|<>=_{}[]\\^~@+/"), "marks": _class(b".,;:!?\"'()-"),
    "other_letters": _class(bytes(range(0xC0, 256))), "lines": _class(b"\n"), "solid": 1 - _class(b" \t\n\r\x0b\x0c"),
}


def measures(texts: pa.Array) -> np.ndarray:
    """One row of MEASURES per text."""
    texts = plain(texts)
    raw = texts.cast(pa.large_binary())
    at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[at[0] : at[-1]] if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    sums = {}
    for name, of in _SETS.items():
        run = np.concatenate([[0], np.cumsum(of[data], dtype=np.int64)])
        sums[name] = (run[at[1:]] - run[at[:-1]]).astype(float)
    lists = split_words(texts)
    w = lists.offsets.to_numpy()
    n = np.diff(w)
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy().astype(np.uint64)
    text = np.repeat(np.arange(len(n)), n)
    distinct = np.bincount(np.unique(text * np.int64(len(coded.dictionary) + 1) + code.astype(np.int64)) // (len(coded.dictionary) + 1), minlength=len(n))
    # Runs of three words that occur before in the text.
    mix = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
    tri = code[:-2] * mix[0] ^ code[1:-1] * mix[1] ^ code[2:] * mix[2] if len(code) > 2 else code[:0]
    same = text[2:] == text[:-2]
    tri = (tri ^ (text[2:].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))[same]
    owner = text[2:][same]
    order = np.argsort(tri, kind="stable")
    again = np.zeros(len(tri), bool)
    again[order[1:]] = tri[order][1:] == tri[order][:-1]
    repeats = np.bincount(owner[again], minlength=len(n))
    length = pc.binary_length(lists.flatten()).to_numpy()
    long_words = np.bincount(text[length > 12], minlength=len(n))
    repeated, ends, lines = np.zeros((3, len(n)))
    for i, t in enumerate(raw):
        own = [x for x in t.as_buffer().to_pybytes().split(b"\n") if x.strip()]
        lines[i], repeated[i] = len(own), len(own) - len(set(own))
        ends[i] = sum(x.rstrip()[-1:] in b".!?:;\"')" for x in own)
    per = lambda a, b: np.divide(a, b, out=np.zeros(len(n)), where=b > 0)
    solid = sums["solid"]
    return np.stack([
        np.log1p(n), per(solid, n), per(sums["upper"], solid), per(sums["digits"], solid), per(sums["symbols"], solid), per(sums["marks"], solid), per(sums["other_letters"], solid), per(sums["lines"], n),
        per(repeated, lines), per(distinct, np.maximum(n, 1) ** 0.9), per(repeats, n), per(long_words, n), per(ends, lines),
    ], axis=1).astype(np.float32)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, held, x): x is the array of measures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                x = measures(part.column("text"))
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), rows], ["doc_id", "held_out", "x"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, x array<float>")


class Scorer:
    """Bins of each measure (bounds at quantiles), a weight for each bin, and a bias, the last of ``weights``."""

    def __init__(self, bounds: list[np.ndarray]):
        self.bounds = bounds
        self.starts = np.cumsum([0, *(len(b) + 1 for b in bounds)])
        self.weights = np.zeros(self.starts[-1] + 1)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(b, x[:, i], "right") for i, b in enumerate(self.bounds)], axis=1)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        return self.weights[self.starts[:-1] + bins].sum(axis=1) + self.weights[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(self.bins(x))) if len(x) else np.zeros(0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _histogram(rows: DataFrame) -> dict[bool, list[tuple[np.ndarray, np.ndarray]]]:
    """positive -> (levels, texts) of each measure; levels are the high bits of floats that aren't negative, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            level = (np.ascontiguousarray(x).view(np.uint32) >> _DROPPED).astype(np.int64)
            keys = (level * len(MEASURES) + np.arange(level.shape[1])) * 2 + batch.column("positive").to_numpy(zero_copy_only=False)[:, None]
            keys, n = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["k", "n"])

    got = rows.select("x", "positive").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").toArrow()  # bounded by the levels
    k, n = got.column("k").to_numpy(), got.column("n").to_numpy()
    place = lambda m, c: (k % 2 == c) & (k // 2 % len(MEASURES) == m)
    return {bool(c): [(k[own] // 2 // len(MEASURES), n[own]) for own in (place(m, c) for m in range(len(MEASURES)))] for c in (0, 1)}


def bin_bounds(found: dict[bool, list[tuple[np.ndarray, np.ndarray]]], bins: int = BINS) -> list[np.ndarray]:
    """Quantiles of each measure over positives and over all texts, both counted as one half."""
    out = []
    for m in range(len(MEASURES)):
        (own, n_own), (rest, n_rest) = found[True][m], found[False][m]
        levels = np.union1d(own, rest)
        p, u = np.zeros(len(levels)), np.zeros(len(levels))
        p[np.searchsorted(levels, own)] = n_own
        u[np.searchsorted(levels, rest)] = n_rest
        u += p
        shares = [v / v.sum() for v in (p, u) if v.sum()]
        share = np.cumsum(np.mean(shares, axis=0)) if shares else np.zeros(0)
        at = np.unique(np.searchsorted(share, np.sort([*np.linspace(0, 1, bins + 1)[1:-1], *TAILS]))) if len(levels) else np.zeros(0, int)
        out.append((levels[at[at > 0]].astype(np.uint32) << _DROPPED).view(np.float32).astype(float))
    return out


def _design(bins: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row a text: a one for the bin of each measure and for the bias."""
    out = np.zeros((len(bins), starts[-1] + 1))
    out[np.arange(len(bins))[:, None], starts[:-1] + bins] = 1
    out[:, -1] = 1
    return out


class _Sums:
    """Of positives and of all texts: texts, losses of a positive and of a negative call, slope, design and curvature."""

    def __init__(self, size: int, flat: np.ndarray | None = None):
        self.size, each = size, 3 + 2 * size + size * size
        self.flat = np.zeros(2 * each) if flat is None else flat
        self.p, self.u = self.flat[:each], self.flat[each:]

    def parts(self, v: np.ndarray):
        k = self.size
        return v[0], v[1], v[2], v[3 : 3 + k], v[3 + k : 3 + 2 * k], v[3 + 2 * k :].reshape(k, k)

    def add(self, model: Scorer, bins: np.ndarray, positive: np.ndarray) -> None:
        for i in range(0, len(bins), 1 << 13):
            x = _design(bins[i : i + (1 << 13)], model.starts)
            z = x @ model.weights
            s = _sigmoid(z)
            for v, own in ((self.p, positive[i : i + (1 << 13)]), (self.u, slice(None))):
                xo, so, zo = x[own], s[own], z[own]
                v += np.concatenate([[len(xo), np.logaddexp(0, -zo).sum(), np.logaddexp(0, zo).sum()], so @ xo, xo.sum(axis=0), (xo.T @ (xo * (so * (1 - so))[:, None])).ravel()])


def risk(sums: _Sums, weights: np.ndarray, prior: float | None, share: float = 1.0) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(pi * R_p(+) + share * rest with decay, rest, slope, curvature); rest is R_u(-) - pi * R_p(-).

    Without a prior, the risk of telling positives from all texts.
    """
    (n, plus, minus, s, x, h), (un, _, uminus, us, _, uh) = sums.parts(sums.p), sums.parts(sums.u)
    decay = np.append(np.full(len(weights) - 1, DECAY / n), 1e-6)
    tail = (decay * weights**2).sum() / 2
    if prior is None:
        return plus / n + uminus / un + tail, 0.0, (s - x) / n + us / un + decay * weights, h / n + uh / un + np.diag(decay)
    rest = uminus / un - prior * minus / n
    # For the logistic loss, the losses of both calls of a positive differ by its margin, so this is convex.
    slope = prior * (s - x) / n + share * (us / un - prior * s / n) + decay * weights
    return prior * plus / n + share * rest + tail, rest, slope, prior * (1 - share) * h / n + share * uh / un + np.diag(decay)


def _newton(coded: DataFrame, model: Scorer, prior: float | None, share: float, rounds: int) -> float:
    """Minimise ``risk`` from the model's weights on; returns its rest. A step that doesn't lower the risk is halved."""

    def at(weights: np.ndarray):
        trial = Scorer(model.bounds)
        trial.weights = weights

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            out = _Sums(len(weights))
            for batch in batches:
                out.add(trial, _unpacked(batch.column("bins")), batch.column("positive").to_numpy(zero_copy_only=False))
            yield out.flat

        return risk(_Sums(len(weights), vector_sum(coded, run, 2 * (3 + 2 * len(weights) + len(weights) ** 2))), weights, prior, share)

    value, rest, slope, curve = at(model.weights)
    step = 1.0
    for _ in range(rounds):
        to = model.weights - step * np.linalg.solve(curve, slope)
        new, new_rest, new_slope, new_curve = at(to)
        if new > value + 1e-12:
            step /= 2
            if step < 1 / 64:
                break
            continue
        gain, value, rest, slope, curve, model.weights = value - new, new, new_rest, new_slope, new_curve, to
        if gain < SETTLED:
            break
        step = min(1.0, 2 * step)
    return rest


def _fit(coded: DataFrame, model: Scorer, prior: float | None, rounds: int = ROUNDS) -> None:
    """The least non-negative risk. Where the unbiased one has its least value with a rest below the bound, the rest is
    at its bound instead: there the slopes of both parts cancel for some share of the rest, which is bisected."""
    rest = _newton(coded, model, prior, 1.0, rounds)
    if prior is None or rest >= -SLACK * prior:
        return
    low, high = 0.0, 1.0
    while high - low > 1 / 256 and abs(rest + SLACK * prior) > 2e-3:
        share = (low + high) / 2
        rest = _newton(coded, model, prior, share, rounds)
        low, high = (low, share) if rest < -SLACK * prior else (share, high)


def _unpacked(bins: pa.Array) -> np.ndarray:
    """The bins of each text, one byte a measure."""
    if not len(bins):
        return np.zeros((0, len(MEASURES)), int)
    at = np.frombuffer(bins.buffers()[1], np.int32)[bins.offset : bins.offset + len(bins) + 1]
    return np.frombuffer(bins.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(len(bins), -1).astype(int)


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Least ratio of the shares of all and of positive texts beyond a rank.

    p, u: texts by margin, from the lowest step up. Each ratio bounds the prior from above; ranks stop at the positives'
    median, where both shares are still well known.
    """
    below_p, below_u = np.cumsum(p) - p, np.cumsum(u) - u
    ranks = np.unique(np.searchsorted(np.cumsum(p), np.linspace(0, 0.5, 51) * p.sum(), "right"))
    ratios = (1 - below_u[ranks] / u.sum()) / (1 - below_p[ranks] / p.sum())
    return float(np.clip(ratios.min(), 0.02, 0.98))


def _margins(coded: DataFrame, model: Scorer) -> np.ndarray:
    """Texts by margin, of positives and of all."""
    steps_ = 2 * _REACH * _FINE + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        out = np.zeros((2, steps_))
        for batch in batches:
            z = np.rint((np.clip(model.margin(_unpacked(batch.column("bins"))), -_REACH, _REACH) + _REACH) * _FINE).astype(int)
            out[0] += np.bincount(z[batch.column("positive").to_numpy(zero_copy_only=False)], minlength=steps_)
            out[1] += np.bincount(z, minlength=steps_)
        yield out.ravel()

    return vector_sum(coded, run, 2 * steps_).reshape(2, -1)


def learn(rows: DataFrame, bins: int = BINS) -> tuple[Scorer, float]:
    """The scorer and the class prior that was estimated, of stored rows (doc_id, x, positive)."""
    model = Scorer(bin_bounds(_histogram(rows), bins))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            own = [b.tobytes() for b in model.bins(x).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), batch.column("positive"), batch.column("half")], ["bins", "positive", "half"])

    half = F.xxhash64("doc_id", "x").bitwiseAND(1).cast("boolean").alias("half")
    coded = cut(rows.select("x", "positive", half).mapInArrow(run, "bins binary, positive boolean, half boolean"))
    by_half = {(r["half"], r["positive"]): r["count"] for r in coded.groupBy("half", "positive").count().collect()}
    if not sum(n for (_, positive), n in by_half.items() if positive):
        return model, 0.5
    # One half ranks the other, so that the prior isn't read from what was fitted; too few positives are all in both.
    apart = all(by_half.get((h, True), 0) for h in (False, True))
    halves = [coded.where(F.col("half") == h) for h in (False, True)] if apart else [coded, coded]
    ranks = 0
    for fitted, ranked in (halves, halves[::-1]):
        ranker = Scorer(model.bounds)
        _fit(fitted, ranker, None)
        ranks = ranks + _margins(ranked, ranker)
    prior = class_prior(*ranks)
    _fit(coded, model, prior)
    return model, prior


def score(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every text; labels are those of texts that aren't held out."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    rows = cut(measured(texts))
    trusted = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("positive")).where("doc_id is not null").distinct()
    open_rows = join_hot(rows.where(~F.col("held_out")), cut(trusted), "doc_id")
    model, _ = learn(cut(open_rows.select("doc_id", "x", F.coalesce("positive", F.lit(False)).alias("positive"))))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            s = sent.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op8_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    left_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    return score(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"), left_out)


QUERIES = {"op8_pu_quality": op8_pu_quality}
ORACLES: dict[str, str] = {}
