from driftloom.llm import licenses

from .support import ODD, rows, table

MIT = licenses.TEMPLATES["MIT"]
TEXTS = [
    "some text\nReleased under the MIT License.\nmore", "RELEASED   under the MIT license", "released under the BSD license today", MIT, "\n\n".join(["intro words here", MIT.replace(". ", ".\n"), "outro"]), MIT + " " + "and other words " * 200, MIT.replace("Software", "Program"), "This work is licensed under the GNU General Public License, version 3.", "nothing here at all",
    "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.",
]


def brute(text):
    best = {}
    for a, b in licenses.passages(text or ""):
        own = licenses.bigrams(licenses.normalised(text[a:b]))
        for k, t in licenses.TEMPLATES.items():
            d = licenses.dice(own, licenses.bigrams(licenses.normalised(t)))
            if d >= licenses.LEAST and (k not in best or (-d, a, b) < (-best[k][0], *best[k][1:])):
                best[k] = (d, a, b)
    return [(k, *v) for k, v in sorted(best.items())]


def test_pruned_scan_equals_all_comparisons(spark):
    data = [*ODD, *((30 + i, t, "en", "s", 1) for i, t in enumerate(TEXTS))]
    got = sorted((str(r["doc_id"]), r["license"], r["dice"], r["start"], r["end"]) for r in rows(licenses.scan(table(spark, data))))
    assert got == sorted((str(d), *x) for d, t, *_ in data for x in brute(t))
    found = {(i, k) for i, k, *_ in got}
    assert {("30", "MIT-notice"), ("33", "MIT"), ("34", "MIT"), ("37", "GPL-3.0-notice")} <= found and not any(i in ("32", "38") for i, _ in found)


def test_an_anchor_is_in_every_match():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for k, t in licenses.TEMPLATES.items():
        words = licenses.normalised(t)
        for drop in range(0, len(words), 5):
            part = words[:drop] + words[drop + 1 :]
            d = licenses.dice(licenses.bigrams(part), licenses.bigrams(words))
            assert d < licenses.LEAST or not scanner.anchors.isdisjoint(part), k


def test_empty_table_and_own_templates(spark):
    assert rows(licenses.scan(table(spark, []))) == []
    got = rows(licenses.scan(table(spark, ODD), {"fox": "the quick brown fox jumps over the lazy dog again and again"}))
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "7", "7"]
