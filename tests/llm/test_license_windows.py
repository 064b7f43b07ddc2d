from itertools import combinations

from driftloom.llm import licenses

from .support import rows, table

MIT, GPL, APACHE = (licenses.TEMPLATES[k] for k in ("MIT", "GPL-3.0", "Apache-2.0"))
PROSE = "a long story of many other words that goes on and on " * 30


def cut_at(text, *starts):
    for s in starts:
        assert s in text
        text = text.replace(s, "\n\n" + s)
    return text


def test_licences_inside_longer_documents(spark):
    texts = {
        1: PROSE + "\n\n" + cut_at(MIT, "The above copyright", "THE SOFTWARE IS") + "\n\n" + PROSE,
        2: PROSE + "\n\n" + cut_at(GPL, "This program is distributed") + "\n\n" + PROSE,
        3: PROSE + "\n\n" + cut_at(APACHE, "You may obtain", "Unless required") + "\n\n" + PROSE,
        4: "Copyright 2021 Jane Doe. Released under the MIT License.",
        5: PROSE + MIT + " " + PROSE,
    }
    got = {(r["doc_id"], r["license"]): r for r in rows(licenses.scan(table(spark, [(i, t, "en", "s", 1) for i, t in texts.items()])))}
    for key, t in {(1, "MIT"): MIT, (2, "GPL-3.0"): GPL, (3, "Apache-2.0"): APACHE, (4, "MIT-notice"): licenses.TEMPLATES["MIT-notice"], (5, "MIT"): MIT}.items():
        assert got[key]["dice"] == 1.0, key
        assert licenses.normalised(texts[key[0]][got[key]["start"] : got[key]["end"]]) == licenses.normalised(t)


def test_nearest_run_equals_that_of_all_runs():
    scanner = licenses.Scanner({"a": "x y x y z x w", "b": "y z", "c": "w w w w", "d": "x"})
    for text in ["q x y x y q z x w q x y z x", "w w w q w w w w w", "y q y z q", "x y x y x y z z x w w w", "q q", "q x"]:
        words = text.split()
        best = {}
        for i, j in combinations(range(len(words) + 1), 2):
            for name, pairs in scanner.templates:
                d = licenses.dice(licenses.bigrams(words[i:j]), pairs)
                if d >= licenses.LEAST:
                    best[name] = max(best.get(name, 0), d)
        assert {k: d for k, d, *_ in scanner.scan(text)} == best
