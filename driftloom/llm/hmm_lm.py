"""Operator 7: a hidden Markov language model.

Tokens are words (ASCII lower case, between white space) and one end token per text. The ``TOP`` most frequent words
of the training texts, the end, and one class for all other words are what the states emit; a word of that class has a
share of it by its own count. Counts come from all training texts. The states start from the words of the
texts that a hash gives them; each Baum-Welch round runs over all training texts in full, partitions summing expected
counts that Spark then adds up, state by state and word by word, until the likelihood settles. Scores are exact log likelihoods by the scaled forward recursion.

What is broadcast is bounded by parameters: TOP words and STATES * (TOP + 2) emission rates. Counts of the other words, as many
as the corpus has, meet the texts in a shuffled join, one row per text and distinct word; no such word holds more than 1 / TOP of all tokens.

Defined results: a null or empty text is its end token; a null doc_id counts as training; repeated rows are scored
apart; an empty table gives no rows; with no training text every token has the same rate; other columns are not read.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, prepare, spread, table
from .tokens import plain, steps

TOP, STATES = 1 << 17, 8
#: Most and fewest rounds; they end when two in a row gain less than SETTLED decimal digits a token.
ROUNDS, FEWEST, SETTLED = 60, 10, 5e-4
#: Tokens added to each word, shared out as the states share all tokens: a rare word is nobody's own.
PULL = 2.0
#: Tokens of a numpy batch; longer texts go through the recursions block by block, each block from where the last one ended.
BATCH = 1 << 19
#: Training tokens that a partition should have, so that its sums are smaller than its texts.
SHARE = 3_000_000
#: Words whose sums make one row, and rows' names that one task adds up.
BLOCK, NAMES = 256, 16
_LOG = logging.getLogger(__name__)


def split_words(texts: pa.Array) -> pa.ListArray:
    """Words in ASCII lower case; nulls have none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(plain(texts)))
    flat = lists.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(full)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), flat.filter(pa.array(full)))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all of column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in steps(batch, "text", 32 << 20):
                found = split_words(x.column("text")).flatten().value_counts()
                yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], ["word", "n"])

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Training counts: top words and theirs, texts (ends), and tokens and distinct words in all and in the class of the others."""

    words: pa.Array
    counts: np.ndarray
    ends: int
    total: int
    distinct: int

    @property
    def other(self) -> tuple[int, int]:
        """Tokens and distinct words of the class of the other words."""
        return self.total - self.ends - int(self.counts.sum()), self.distinct - (self.ends > 0) - len(self.words)

    def rates(self) -> np.ndarray:
        """Plain rates of the top words, the other class and the end."""
        c = np.concatenate([self.counts, [self.other[0]], [self.ends]]) + 0.5
        return c / c.sum()


def vocabulary(counts: DataFrame, ends: int, top: int = TOP) -> Vocabulary:
    """The top words are all that occur a least number of times, the smallest (of a fixed scale) that gives ``top`` at most."""
    steps = counts.groupBy(F.floor(8 * F.log2("n")).alias("step")).agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.min("n").alias("least")).collect()  # at most 8 * 63 rows
    total, distinct = sum(r["n"] for r in steps), sum(r["words"] for r in steps)
    least, room = None, top
    for r in sorted(steps, key=lambda r: -r["step"]):
        room -= r["words"]
        if room < 0:
            break
        least = r["least"]
    best = counts.where(F.col("n") >= least if least is not None else F.lit(False)).toPandas().sort_values(["n", "word"], ascending=[False, True])
    return Vocabulary(pa.array(best["word"], pa.large_string()), best["n"].to_numpy(np.int64), ends, total + ends, distinct + (ends > 0))


_ENCODED = "row long, doc_id long, held_out boolean, ids array<int>, top_known long, top_log double, others array<struct<word:string,n:int>>"


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """docs (row, doc_id, held_out, text) as token ids, with the base score's share of the top words, and the other words."""
    sent = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        top = len(v.words)
        logs = np.concatenate([np.log10(v.counts + 0.5), [0.0], [np.log10(v.ends + 0.5)]]) - np.log10(v.total + 0.5 * (v.distinct + 1))
        logs[top] = 0.0
        for batch in batches:
            for x in steps(batch, "text"):
                lists = split_words(x.column("text"))
                at = lists.offsets.to_numpy()
                coded = lists.flatten().dictionary_encode()
                slot = pc.fill_null(pc.index_in(coded.dictionary, value_set=v.words), top).to_numpy()
                code = coded.indices.to_numpy()
                ids = slot[code].astype(np.int32)
                text = np.repeat(np.arange(len(at) - 1), np.diff(at))
                rare = ids == top
                pairs, n = np.unique(text[rare] * np.int64(len(coded.dictionary) + 1) + code[rare], return_counts=True)
                whose, which = np.divmod(pairs, len(coded.dictionary) + 1)
                bounds = np.searchsorted(whose, np.arange(len(at)))
                others = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([coded.dictionary.take(pa.array(which)).cast(pa.string()), pa.array(n, pa.int32())], ["word", "n"]))
                ids = np.insert(ids, at[1:], top + 1)
                ends = at + np.arange(len(at))
                sums = np.add.reduceat(logs[ids], ends[:-1]) if len(ends) > 1 else np.zeros(0)
                known = np.add.reduceat((ids < top).astype(np.int64), ends[:-1]) + (v.ends > 0) if len(ends) > 1 else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*(x.column(k) for k in ("row", "doc_id", "held_out")), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)), pa.array(known), pa.array(sums), others], ["row", "doc_id", "held_out", "ids", "top_known", "top_log", "others"])

    return docs.select("row", "doc_id", "held_out", "text").mapInArrow(run, _ENCODED)


@dataclass
class Model:
    """start: (states); move: (states, states); emit: (words + 2, states)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def doubled(self) -> Model:
        """The same rates as doubles, each set of them with a sum of one."""
        x = [v.astype(np.float64) for v in (self.start, self.move, self.emit)]
        return Model(x[0] / x[0].sum(), x[1] / x[1].sum(axis=1, keepdims=True), x[2] / x[2].sum(axis=0))


class _Laid:
    """Sequences side by side: the tokens of all of them at time 0, then at time 1 and so on, longest sequence first."""

    def __init__(self, flat: np.ndarray, begin: np.ndarray, n: np.ndarray):
        self.order = np.argsort(-n, kind="stable")
        n, begin = n[self.order], begin[self.order]
        self.active = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), "left")  # sequences longer than t
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        which = np.repeat(np.arange(len(n)), n)
        when = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        self.seen = np.empty(len(which), np.int32)
        self.seen[self.at[when] + which] = flat[begin[which] + when]


def forward(model: Model, laid: _Laid, keep: bool, a: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None, np.ndarray, np.ndarray | None]:
    """Log10 likelihood of each sequence (in its given place); if kept, scaled forward rates, scales; emission rates; last rates.

    ``a``: the rates that the sequences' earlier blocks ended with. Numbers are of the model's kind, the logarithms doubles.
    """
    emit = model.emit[laid.seen]
    rows = len(laid.order)
    scales = np.empty(len(emit), emit.dtype)
    rates = np.empty_like(emit) if keep else None
    logs = np.zeros(rows)
    for t, d in enumerate(laid.active):
        i = laid.at[t]
        a = (model.start if a is None else a[:d] @ model.move) * emit[i : i + d]
        s = a.sum(axis=1)
        a /= s[:, None]
        scales[i : i + d] = s
        logs[:d] += np.log10(s)
        if keep:
            rates[i : i + d] = a
    out = np.empty(rows)
    out[laid.order] = logs
    return out, rates, scales, emit, a


def expected(model: Model, laid: _Laid, emitted: np.ndarray, moved: np.ndarray, started: np.ndarray) -> float:
    """Add the expected counts of one batch to (states, words + 2), (states, states) and (states); returns its log10 likelihood."""
    if not len(laid.order):
        return 0.0
    logs, begun, _ = _counted(model, laid, emitted, moved)
    started += begun
    return float(logs.sum())


def expected_long(model: Model, seen: np.ndarray, emitted: np.ndarray, moved: np.ndarray, started: np.ndarray) -> float:
    """``expected`` of one sequence of any length: forward over all blocks, then back over them, one in memory at a time."""
    blocks = [_one(seen[i : i + BATCH]) for i in range(0, len(seen), BATCH)]
    ends: list[np.ndarray | None] = [None]
    log = 0.0
    for block in blocks:
        logs, _, _, _, a = forward(model, block, False, ends[-1])
        ends.append(a)
        log += float(logs.sum())
    later = None
    for block, a in zip(blocks[::-1], ends[-2::-1], strict=True):
        _, begun, later = _counted(model, block, emitted, moved, a, later)
    started += begun
    return log


def _one(seen: np.ndarray) -> _Laid:
    return _Laid(seen, np.zeros(1, np.int64), np.array([len(seen)]))


def _counted(model: Model, laid: _Laid, emitted: np.ndarray, moved: np.ndarray, a: np.ndarray | None = None, later: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihoods, the states' shares of the first tokens, and what the block before needs as its ``later``."""
    logs, rates, scales, emit, _ = forward(model, laid, True, a)
    back = model.move.T.copy()
    for t in range(len(laid.active) - 1, -1, -1):
        i, d = laid.at[t], laid.active[t]
        b = np.ones((d, model.move.shape[0]), np.float32)
        if later is not None:
            e = len(later)
            moved += rates[i : i + e].T @ later
            b[:e] = later @ back
        later = emit[i : i + d] * b / scales[i : i + d, None]
        rates[i : i + d] *= b
    for k in range(len(emitted)):
        emitted[k] += np.bincount(laid.seen, weights=rates[:, k], minlength=emitted.shape[1])
    return logs, rates[: laid.active[0]].sum(axis=0), later


def renew(model: Model, plain: np.ndarray, emitted: np.ndarray, moved: np.ndarray, started: np.ndarray) -> Model:
    """The model of these expected counts; ``moved`` is still to be multiplied by the rates of moving."""
    move = model.move * moved + 1.0 / len(moved)
    use = emitted.sum(axis=1, keepdims=True) + 1e-3
    emit = emitted + PULL * use / use.sum() + 1e-3 * plain
    start = started + 1.0
    return Model((start / start.sum()).astype(np.float32), (move / move.sum(axis=1, keepdims=True)).astype(np.float32), np.ascontiguousarray((emit / emit.sum(axis=1, keepdims=True)).T.astype(np.float32)))


def _batches(ids: pa.ListArray) -> Iterator[tuple[_Laid | None, np.ndarray, np.ndarray]]:
    """Laid batches of similar lengths, and the places of their sequences; a sequence longer than BATCH alone, as it is."""
    at, flat = ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy()
    begin, n = at[:-1], np.diff(at)
    for place in np.flatnonzero(n > BATCH):
        yield None, np.array([place]), flat[at[place] : at[place + 1]]
    order = np.argsort(-n, kind="stable")
    order = order[n[order] <= BATCH]
    done = np.cumsum(n[order])
    i = 0
    while i < len(order):
        j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + BATCH, "right")))
        own = order[i:j]
        yield _Laid(flat, begin[own], n[own]), own, flat[:0]
        i = j


def _training(encoded: DataFrame, tokens: int) -> DataFrame:
    """All training texts in as many partitions as they have SHARE tokens, whatever the number of cores: each hands on its sums."""
    return encoded.where(~F.col("held_out")).select("ids").coalesce(max(1, -(-tokens // SHARE)))


def _blocks(values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(words, states) sums as rows of BLOCK words; a block of zeros is left out."""
    for i in range(0, len(values), BLOCK):
        part = values[i : i + BLOCK]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK], pa.int32()), pa.ListArray.from_arrays(pa.array([0, part.size], pa.int32()), pa.array(part.ravel()))], ["block", "sums"])


def _added(rows: DataFrame, words: int, states: int) -> np.ndarray:
    """(words, states): the blocks of all partitions, added up as doubles, block by block on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column("block").to_pylist(), batch.column("sums"), strict=True):
                sums[k] = sums.get(k, 0.0) + x.values.to_numpy().astype(np.float64)
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))], ["block", "sums"])

    met = rows.repartition(-(-words // (BLOCK * NAMES)), "block").mapInArrow(run, "block int, sums array<double>").toArrow()  # words * states numbers
    out = np.zeros((words, states))
    for k, x in zip(met.column("block").to_pylist(), met.column("sums"), strict=True):
        out[k * BLOCK : (k + 1) * BLOCK] = x.values.to_numpy().reshape(-1, states)
    return out


def starting_model(training: DataFrame, plain: np.ndarray, states: int = STATES) -> Model:
    """Each state has the words of the training texts that a hash gives it: all of them, in full."""
    words = len(plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emitted = np.zeros((states, words))
        for batch in batches:
            ids = batch.column("ids")
            own = np.repeat(batch.column("own").to_numpy(), np.diff(ids.offsets.to_numpy()))
            seen = ids.flatten().to_numpy()
            for k in range(states):
                emitted[k] += np.bincount(seen[own == k], minlength=words)
        yield from _blocks(emitted.T)

    rows = training.select("ids", F.pmod(F.xxhash64("ids"), F.lit(states)).alias("own")).mapInArrow(run, "block int, sums array<double>")
    emitted = _added(rows, words, states).T
    stay = np.where(np.eye(states, dtype=bool), 0.97, 0.03 / max(1, states - 1))
    return renew(Model(np.full(states, 1 / states), stay, plain[:, None]), plain, emitted, np.full((states, states), 1e6), np.ones(states))


def baum_welch(training: DataFrame, model: Model, plain: np.ndarray) -> tuple[Model, float]:
    """One round over all training texts: expected counts by partition, added up by word and state; and the log10 likelihood before it."""
    states, words = len(model.start), len(plain)
    sent = training.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emitted, moved, started, log = np.zeros((states, words)), np.zeros((states, states)), np.zeros(states), 0.0
        for batch in batches:
            for laid, _, seen in _batches(batch.column("ids")):
                log += expected(sent.value, laid, emitted, moved, started) if laid else expected_long(sent.value, seen, emitted, moved, started)
        # Words first, then one row for each state moved from, then the starts and the likelihood.
        yield from _blocks(np.concatenate([emitted, moved.T, started[:, None], np.full((states, 1), log)], axis=1).astype(np.float32).T)

    full = _added(training.mapInArrow(run, "block int, sums array<float>"), words + states + 2, states).T
    sent.unpersist()
    return renew(model, plain, full[:, :words], full[:, words : words + states].T, full[:, -2]), float(full[0, -1])


def learn(encoded: DataFrame, vocab: Vocabulary, plain: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Rounds over all training texts until two in a row gain less than SETTLED a token."""
    training = _training(encoded, vocab.total)
    model, last, calm = starting_model(training, plain, states), -np.inf, 0
    for done in range(1, rounds + 1):
        model, log = baum_welch(training, model, plain)
        encoded.sparkSession._jvm.System.gc()  # what the round shuffled goes from the executors' disks
        _LOG.info("round %d: log10 likelihood %.6g, %.6g a token", done, log, log / max(1, vocab.total))
        calm = calm + 1 if log - last <= SETTLED * vocab.total else 0
        if calm >= 2 and done >= FEWEST:
            break
        last = log
    return model


def likelihoods(encoded: DataFrame, model: Model) -> DataFrame:
    """(row, doc_id, held_out, n_tokens, top_known, top_log, n_other, forward): forward is the log10 likelihood of the ids."""
    sent = encoded.sparkSession.sparkContext.broadcast(model.doubled())
    other = len(model.emit) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            at = ids.offsets.to_numpy().astype(np.int64)
            out = np.zeros(batch.num_rows)
            for laid, place, seen in _batches(ids):
                if laid:
                    out[place] = forward(sent.value, laid, False)[0]
                    continue
                a = None
                for i in range(0, len(seen), BATCH):
                    logs, _, _, _, a = forward(sent.value, _one(seen[i : i + BATCH]), False, a)
                    out[place] += logs
            rare = np.concatenate([[0], np.cumsum(ids.values.to_numpy() == other)])
            n_other = rare[at[1:]] - rare[at[:-1]]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("row", "doc_id", "held_out")), pa.array(np.diff(at)), *(batch.column(k) for k in ("top_known", "top_log")), pa.array(n_other), pa.array(out)], ["row", "doc_id", "held_out", "n_tokens", "top_known", "top_log", "n_other", "forward"])

    return encoded.select("row", "doc_id", "held_out", "ids", "top_known", "top_log").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, top_known long, top_log double, n_other long, forward double")


def score(docs: DataFrame, held_out, top: int = TOP, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text; learns where not held_out."""
    prepare(docs.sparkSession)
    # Rows are numbered as they are read, before they are dealt out anew: the same in a task that runs again.
    texts = spread(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text")))
    training = texts.where(~F.col("held_out"))
    counts = cut(word_counts(training))
    vocab = vocabulary(counts, training.count(), top)
    plain = vocab.rates()
    encoded = cut(encode(texts, vocab))
    model = learn(encoded, vocab, plain, states, rounds)
    met = encoded.select("row", F.explode("others").alias("x")).select("row", "x.word", F.col("x.n").alias("k"))
    own = met.join(counts, "word", "left").groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("known"), F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("own_log"))
    both = likelihoods(encoded, model).join(own, "row", "left")
    own_log = F.coalesce("own_log", F.lit(0.0))
    other, distinct = vocab.other
    base = F.col("top_log") + own_log - F.col("n_other") * F.log10(F.lit(vocab.total + 0.5 * (vocab.distinct + 1)))
    full = F.col("forward") + own_log - F.col("n_other") * F.log10(F.lit(other + 0.5 * (distinct + 1)))
    known = (F.col("top_known") + F.coalesce("known", F.lit(0))).cast("long")
    return both.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"), base.alias("base_score"), full.alias("score"))


def op7_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    left_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    return score(table(spark, sf_dir, "documents"), left_out)


QUERIES = {"op7_hmm_lm": op7_hmm_lm}
ORACLES: dict[str, str] = {}
