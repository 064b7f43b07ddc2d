"""Operator 3: quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a text's counted features. Nobody knows the rules' accuracies;
expectation-maximisation estimates them from how the rules agree over all texts: a text is good with a prior
probability, each rule has its own accuracy on good and on bad texts, and rules err apart from each other. The posterior
probability that a text is good replaces the usual demand that every rule passes.

The only thing that is aggregated is the number of texts per pattern of votes, at most 3 ** rules rows however many
texts there are; the iterations run over that table. The features are then computed again in the pass that uses the
posterior, so texts are neither shuffled nor stored.

Defined results: a null text is an empty one; a text of no words makes every rule but the length rule abstain; equal
rows get equal verdicts and all stay; null ids are carried; an empty table gives no rows; other columns are carried by
``judge`` (names of its own that clash are replaced).
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, prepare, spread, table

#: A text with fewer words, or a larger share (in per cent) of words in repeated windows, fails whatever the rules say.
MIN_WORDS, MAX_REPEAT = 50, 50
#: Words of a window that counts as repeated, and iterations and starting values of the estimation.
SPAN, ROUNDS, PRIOR = 3, 40, 0.8
#: Starting rates of each vote on good and on bad texts. A bad text need not look bad to every rule.
START = {1: (0.9, 0.7), -1: (0.01, 0.2), 0: (0.09, 0.1)}
#: More repeated windows than this in a text are looked up by sorting rather than by scanning.
FEW = 48
_SPACE = r"[\x20\x09-\x0D]+"

#: Feature -> (good at or below, bad from) where low is good; the other way round where good is the larger.
#: The bounds are those commonly published for web text.
RULES: dict[str, tuple[float, float]] = {
    "symbols_per_word": (0.02, 0.1),
    "dup_line_share": (0.1, 0.3),
    "repeat_share": (0.2, 0.5),
    "upper_share": (0.15, 0.4),
    "digit_share": (0.15, 0.4),
    "mark_share": (0.08, 0.15),
    "mean_word_excess": (1.5, 4.0),
    "end_mark_share": (0.5, 0.1),
    "n_words": (80, 50),
}
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(keys: Column, repeated: Column, span: int) -> Column:
    """Words that lie in windows (keys, by position) whose key is among the repeated ones."""
    at = F.sequence(F.lit(0), F.size(keys) - 1)
    scanned = F.filter(at, lambda i: F.array_contains(repeated, F.get(keys, i)))
    ordered = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    sorted_ = F.transform(
        F.array(ordered),
        lambda s: F.transform(
            F.filter(F.transform(s, lambda x, j: F.struct(x["i"].alias("i"), ((x["k"] == F.get(s, j - 1)["k"]) | (x["k"] == F.get(s, j + 1)["k"])).alias("twice"))), lambda x: F.coalesce(x["twice"], F.lit(False))),
            lambda x: x["i"],
        ),
    )[0]
    found = F.when(F.size(repeated) <= FEW, scanned).otherwise(sorted_)
    covered = F.size(F.array_distinct(F.flatten(F.transform(found, lambda i: F.array(*[i + j for j in range(span)])))))
    return F.when(F.size(repeated) == 0, 0).otherwise(covered)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``_f``: a struct of the counted features (longs and doubles).

    Its field ``row`` is there for the optimizer: a filter that uses it stays above the counting, instead of being moved
    below with all of the counting written out in it, once for each use.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.withColumn("_w", F.array_remove(F.split(whole, _SPACE), "")).withColumn("_l", lines)
    n = F.size("_w")
    starts = F.when(n >= SPAN, F.sequence(F.lit(0), n - SPAN)).otherwise(F.array().cast("array<int>"))
    hashed = first.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    keyed = hashed.withColumn("_k", F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col("_h"), i + j) for j in range(SPAN)])))
    ordered = keyed.withColumn("_s", F.sort_array("_k"))
    again = ordered.withColumn("_r", F.array_distinct(F.filter("_s", lambda x, i: (i > 0) & (x == F.get(F.col("_s"), i - 1)))))
    counted = again.withColumn("_chars", F.char_length(F.array_join("_w", ""))).withColumn("_n", n).withColumn("_lines", F.size("_l"))
    marks = F.size(F.filter("_l", lambda x: x.rlike(r"[.!?…。！？:;\"'»”)\]][\x20\x09-\x0D]*$")))
    known = counted.select(
        *docs.columns, "_n", "_chars", "_lines",
        F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).alias("_sym"), F.regexp_count(whole, F.lit(r"\p{Lu}")).alias("_up"), F.regexp_count(whole, F.lit(r"[0-9]")).alias("_dig"), F.regexp_count(whole, F.lit(r"[^\p{L}\p{M}\p{N}\s]")).alias("_other"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).alias("_dup"), _repeat_words(F.col("_k"), F.col("_r"), SPAN).alias("_rep"), marks.alias("_marks"),
        F.monotonically_increasing_id().alias("_row"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    values = {
        "n_words": F.col("_n").cast("long"), "word_chars": F.col("_chars").cast("long"), "n_symbols": F.col("_sym").cast("long"), "n_dup_lines": F.col("_dup").cast("long"), "n_repeat_words": F.col("_rep").cast("long"),
        "symbols_per_word": share("_sym", "_n"), "dup_line_share": share("_dup", "_lines"), "repeat_share": share("_rep", "_n"), "upper_share": share("_up", "_chars"),
        "digit_share": share("_dig", "_chars"), "mark_share": share("_other", "_chars"), "mean_word_excess": F.abs(share("_chars", "_n") - 5.0), "end_mark_share": share("_marks", "_lines"), "row": F.col("_row"),
    }
    return known.select(*docs.columns, F.struct(*[v.alias(k) for k, v in values.items()]).alias("_f"))


def votes(feature: str = "_f") -> list[Column]:
    """One vote (1, -1, 0) per rule, in the order of RULES."""
    out = []
    for name, (good, bad) in RULES.items():
        x = F.col(f"{feature}.{name}")
        is_good, is_bad = (x <= good, x >= bad) if good < bad else (x >= good, x < bad)
        out.append(F.when(is_good, 1).when(is_bad, -1).otherwise(0))
    return out


def estimate(patterns: DataFrame, rules: int, rounds: int = ROUNDS) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """(prior, rates) by expectation-maximisation over ``patterns``: (v0, v1, ..., n).

    rates[i][vote] is how often rule i casts that vote on good and on bad texts: its accuracy on either class, and how
    often it abstains there. The patterns, 3 ** rules at most, become one row, and all rounds are one expression over it.
    """
    casts = list(START)
    slot = [F.when(F.col(f"v{i}") == casts[0], 3 * i).when(F.col(f"v{i}") == casts[1], 3 * i + 1).otherwise(3 * i + 2) for i in range(rules)]
    row = patterns.agg(F.collect_list(F.struct(F.array(*slot).alias("slots"), F.col("n").cast("double").alias("n"))).alias("all"))
    start = [F.array(*[F.lit(START[v][c]) for _ in range(rules) for v in casts]) for c in (0, 1)]
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))

    def once(model: Column, _: Column) -> Column:
        def shared(p: Column) -> Column:
            logit = F.aggregate(p["slots"], F.log(model["prior"] / (1 - model["prior"])), lambda a, k: a + F.log(F.get(model["good"], k) / F.get(model["bad"], k)))
            good = p["n"] / (1 + F.exp(-logit))
            return F.struct(p["slots"].alias("slots"), good.alias("good"), (p["n"] - good).alias("bad"))

        def renewed(split: Column) -> Column:
            # The starting rates count as one text of each class, so that nothing is ever certain.
            rate = lambda name, first: F.transform(first, lambda r, k: (r + total(split, lambda w: F.when(F.array_contains(w["slots"], k), w[name]).otherwise(0.0))) / (1 + total(split, lambda w: w[name])))
            good, bad = (total(split, lambda w, name=name: w[name]) for name in ("good", "bad"))
            return F.struct(((good + PRIOR) / (good + bad + 1)).alias("prior"), rate("good", start[0]).alias("good"), rate("bad", start[1]).alias("bad"))

        return F.transform(F.array(F.transform("all", shared)), renewed)[0]

    first = F.struct(F.lit(PRIOR).alias("prior"), start[0].alias("good"), start[1].alias("bad"))
    got = row.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, once).alias("m")).first()["m"]
    return got["prior"], [{v: (got["good"][3 * i + k], got["bad"][3 * i + k]) for k, v in enumerate(casts)} for i in range(rules)]


def posterior(cast: list[Column], prior: float, rates: list[dict[int, tuple[float, float]]]) -> Column:
    """Probability that a text with these votes is good."""
    logit = F.lit(log(prior / (1 - prior)))
    for vote, rate in zip(cast, rates, strict=True):
        weight = {v: F.lit(log(g / b)) for v, (g, b) in rate.items()}
        logit = logit + F.when(vote == 1, weight[1]).when(vote == -1, weight[-1]).otherwise(weight[0])
    return 1 / (1 + F.exp(-logit))


def judge(docs: DataFrame, text: str = "text", threshold: float = 0.5, keep_text: bool = True, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the base columns, base_failed, quality (the posterior) and kept.

    With ``min_words`` of 0, being short is left to the rules' votes, as the only thing that fails a text outright is repetition.

    Without the text, rows are narrow: their features are counted once and stored. With it, they are counted again in
    the pass that carries the texts, which is less than storing these.
    """
    prepare(docs.sparkSession)
    own = [c for c in docs.columns if c not in {*_BASE, "base_failed", "quality", "kept", "_f", "_row"}]
    rows = features(docs.select(*own), text)
    if not keep_text:
        own.remove(text)
        rows = cut(rows.drop(text))
    cast = [v.alias(f"v{i}") for i, v in enumerate(votes())]
    patterns = (features(docs.select(text), text) if keep_text else rows).select(*cast).groupBy(*[f"v{i}" for i in range(len(cast))]).agg(F.count("*").alias("n"))
    prior, rates = estimate(patterns, len(RULES))
    failed = (F.col("_f.n_words") < min_words) | (100 * F.col("_f.n_repeat_words") > MAX_REPEAT * F.col("_f.n_words"))
    judged = rows.select(*own, *[F.col(f"_f.{c}").alias(c) for c in _BASE], failed.alias("base_failed"), posterior(votes(), prior, rates).alias("quality"), F.col("_f.row").alias("_row"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold) & (F.col("_row") >= 0)).drop("_row")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spread(table(spark, sf_dir, "documents")).select("doc_id", "text"), keep_text=False)


QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLES: dict[str, str] = {}
