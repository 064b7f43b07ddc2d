import re
from collections import Counter

from driftloom.llm import quality_rules

from .support import ODD, rows, table, words

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Texts in which no three words come twice.
PROSE = [" ".join(w if k % 2 else f"{w}{LETTERS[i % 26]}{LETTERS[k % 26]}{LETTERS[k // 26 + i // 26]}" for k, w in enumerate("a long walk by the river makes every evening better for people who like quiet places and slow water".split() * 4)) + "." for i in range(40)]
JUNK = ["BUY NOW!!! " * 60, "### $$$ %%% " * 60, "\n".join(["same line again and again"] * 50)]


def base(text):
    w = words(text)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_base_counts_of_odd_rows(spark):
    many = " ".join(f"{'abc'[i % 3]}{i // 7}" for i in range(900)) + " " + " ".join(f"w{i} x{i} y{i} w{i} x{i} y{i}" for i in range(120))
    data = [*ODD, (20, many, "en", "s", 1), (21, "a b c a b c a b c d", "en", "s", 1), (22, "l1\nl2\r\nl1\n\nl1", "en", "s", 1)]
    for keep in (True, False):
        got = quality_rules.judge(table(spark, data), keep_text=keep)
        assert ("text" in got.columns) == keep
        shown = sorted((str(r["doc_id"]), *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))) for r in rows(got))
        assert shown == sorted((str(d), *base(t)) for d, t, *_ in data)


def test_junk_goes_and_prose_stays(spark):
    data = [(i, t, "en", "s", 1) for i, t in enumerate(PROSE)] + [(100 + i, t * 2, "en", "s", 1) for i, t in enumerate(JUNK * 4)]
    got = {r["doc_id"]: r["kept"] for r in rows(quality_rules.judge(table(spark, data)))}
    assert all(got[i] for i in range(len(PROSE))) and not any(v for k, v in got.items() if k >= 100)


def test_one_symptom_is_enough_once_the_rates_are_known(spark):
    patterns = [(1,) * 4 + (900,), (-1, 1, 1, 1, 40), (1, -1, -1, 1, 30), (1, 1, -1, -1, 30), (0, 1, 1, 1, 50)]
    frame = spark.createDataFrame(patterns, "v0 int, v1 int, v2 int, v3 int, n long")
    prior, rates = quality_rules.estimate(frame, 4)
    assert 0.8 < prior < 0.97 and all(abs(sum(g for g, _ in r.values()) - 1) < 1e-6 for r in rates)
    from pyspark.sql import functions as F

    p = [r[0] for r in frame.select(quality_rules.posterior([F.col(f"v{i}") for i in range(4)], prior, rates)).collect()]
    assert p[0] > 0.95 and p[2] < 0.2 and p[3] < 0.2


def test_empty_table_and_filter_stays_above(spark):
    judged = quality_rules.judge(table(spark, []))
    assert rows(judged) == []
    plan = quality_rules.judge(table(spark, ODD)).where("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array") <= 3
