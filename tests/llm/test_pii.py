import re

import numpy as np
import pytest

from driftloom.llm import pii

from .support import ODD, rows, table

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TEXTS = [
    "write to a.b+c@mail.example.com, or x@y and p@q.r.s; a@b.c@d.e @z.w %@a.b", "hosts 97.51.17.173 300.1.1.1 1.2.3.4.5.6.7.8 01.002.0003.4 1.2.3", "cards 4111 1111 1111 1111, 4111-1111-1111-1112 5500005555555559 4111  1111",
    "call +1 (017) 555-7713 or +12 or +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 and ++49.30.1234567.", "ünï a@b.co ö 10.0.0.1 \U0001f600 +49 (0)30 1234567", "4" * 5000 + ".", "a" * 3000 + "@" + "b" * 3000, "+" * 200 + "1 2 3",
]


def brute(text):
    out = []
    for k, kind in enumerate(pii.BASE_KINDS):
        for m in re.finditer(PATTERNS[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda m: 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda m: 9 <= len(digits) <= 15}[kind](m)
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans_match_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.luhn("378282246310005")


def test_field_finds_other_forms_and_leaves_numbers_alone():
    field = pii.default_field()
    found = lambda t: [(t[a:b], pii.KINDS[k]) for a, k, b in pii.all_spans([t], field)[0][1]]
    assert found("reach me at john.doe (at) example.com or 017-555-7713 today") == [("john.doe (at) example.com", "email"), ("017-555-7713", "phone")]
    assert found("mail bob[at]site[dot]org please") == [("bob[at]site[dot]org", "email")]
    # A value that is assigned to such a name is a secret, a kind of its own; the same value elsewhere is a key like others.
    assert found("token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"") == [("04dbebab91ab85687d33eeaaf9ac699e1188f962", "secret")]
    for clean in ("see commit 04dbebab91ab85687d33eeaaf9ac699e1188f962 there", "on 2024-01-02 we paid $12.50 for v1.2.3 and 1234567890 items", "order 1234-5678 from 1999-2003, 12/05/2020", "Licensed under CC BY-NC 4.0.", "pi is 3.14159265358979"):
        assert found(clean) == []


def test_field_on_held_out_sentences():
    field, right, total = pii.default_field(), 0, 0
    for words, labels in pii.training_table(200, seed=99):
        runs = [field.emissions(words, 0, len(words))]
        right += int((field.decode(runs, [(False, False)])[0] == np.array(labels)).sum())
        total += len(labels)
    assert right / total > 0.98


def test_decode_is_the_best_of_all_labellings():
    from itertools import product

    field, rng = pii.default_field(), np.random.default_rng(0)
    for length in (1, 2, 4):
        run = rng.normal(size=(length, field.k))
        for before, after in product((False, True), repeat=2):
            value = lambda y: sum(run[t, y[t]] for t in range(length)) + sum(field.move[y[t], y[t + 1]] for t in range(length - 1)) + before * field.move[0, y[0]] + after * field.move[y[-1], 0]  # noqa: E731, B023
            assert tuple(field.decode([run], [(before, after)])[0]) == max(product(range(field.k), repeat=length), key=value)


def test_odd_rows_and_empty_table(spark):
    data = [*ODD, *((50 + i, t, "en", "s", 1) for i, t in enumerate(TEXTS))]
    got = sorted((str(r["doc_id"]), [(s["start"], s["kind"], s["end"]) for s in r["base"]]) for r in rows(pii.find(table(spark, data))))
    assert got == sorted((str(d), [(a, pii.KINDS[k], b) for a, k, b in brute(t)]) for d, t, *_ in data)
    assert rows(pii.find(table(spark, []))) == []


def test_redaction_keeps_rows_and_columns(spark):
    docs = table(spark, [*ODD, (60, "mail a@b.co or call +1 (017) 555-7713 now", "en", "s", 1)])
    out = pii.redact(docs)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in rows(out)}
    assert texts[60] == "mail <EMAIL> or call <PHONE> now" and texts[2] is None and texts[1] == ODD[0][1]


def test_held_out_sentences_and_forms_that_no_pattern_finds():
    field, found, missed, wrong = pii.default_field(), 0, 0, 0
    for words, labels in pii.training_table(400, seed=99):
        text = " ".join(words)
        starts = [sum(len(w) + 1 for w in words[:i]) for i in range(len(words))]
        gold = [0] * len(text)
        for a, w, label in zip(starts, words, labels, strict=True):
            gold[a : a + len(w)] = [label] * len(w)
        base, added = pii.all_spans([text], field)[0]
        taken = {k for a, _, b in base for k in range(a, b)}
        for i, label in enumerate(labels):
            if label and not taken & set(range(starts[i], starts[i] + len(words[i]))) and (i == 0 or labels[i - 1] != label):
                hit = any(k + 1 == label and a < starts[i] + len(words[i]) and starts[i] < b for a, k, b in added)
                found, missed = found + hit, missed + (not hit)
        wrong += sum(k + 1 not in gold[a:b] for a, k, b in added)
    assert found > 60 and found / (found + missed) > 0.95 and found / (found + wrong) > 0.95


def test_secrets_are_found_and_plain_numbers_left_alone():
    texts = ['so token = "ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e"### nicht', "the number 9807915762804490 is no card", "x" * 300 + "@host[dot]org and more"]
    got = [[(pii.KINDS[k], t[a:b]) for a, k, b in added] for t, (_, added) in zip(texts, pii.all_spans(texts, pii.default_field()), strict=True)]
    assert got[:2] == [[("secret", "ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e")], []]
