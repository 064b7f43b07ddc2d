"""Dice by definition over all runs of words, and real licence files where the machine has them."""

import re
from collections import Counter
from pathlib import Path

import pytest

from driftloom.llm import licenses

SMALL = {"one": "you may copy this work freely and share it", "two": "all rights reserved by the owner", "three": "licence"}
COMMON = Path("/usr/share/common-licenses")


def nearest(text, template):
    """The largest Dice coefficient of any run of words."""
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    pairs = lambda w: Counter(zip(w, w[1:])) if len(w) > 1 else Counter([(w[0], "")])  # noqa: E731, B905
    words, own, best = split(text), pairs(split(template)), 0.0
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            other = pairs(words[i:j])
            best = max(best, 2 * sum((own & other).values()) / (sum(own.values()) + sum(other.values())))
    return best


@pytest.mark.parametrize("text", [
    "Well, you may copy this work freely and share it. All that.", "you may\n\ncopy this work freely\n\nand share it", "may copy this work freely and then share it with all rights reserved by the owners", "all rights reserved by the owner all rights reserved by the owner", "one licence here", "you may copy it", "", "reserved by the owner you may copy this work freely and share",
])
def test_scan_finds_the_nearest_run_anywhere(text):
    got = {k: d for k, d, *_ in licenses.Scanner(SMALL).scan(text)}
    for name, template in SMALL.items():
        best = nearest(text, template)
        assert (name in got) == (best >= licenses.LEAST) and abs(got.get(name, best) - best) < 1e-9


def test_notices_inside_paragraphs_are_found():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    names = lambda t: {k for k, *_ in scanner.scan(t)}
    assert "MIT-notice" in names("Copyright 2021 Jane Doe. Released under the MIT License. Please write to us with any questions.")
    assert "GPL-2.0" in names("Foo - a tool\n\n" + licenses.TEMPLATES["GPL-2.0"].replace(". This", ".\n\nThis") + "\n\nYou should have received a copy.")


@pytest.mark.skipif(not COMMON.exists(), reason="needs the licence files of the system")
def test_real_licence_files():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    wanted = {"BSD": "BSD-3-Clause", "GPL-2": "GPL-2.0-text", "GPL-3": "GPL-3.0-text", "LGPL-2.1": "LGPL-2.1-text", "LGPL-3": "LGPL-3.0-text", "Apache-2.0": "Apache-2.0-text", "MPL-2.0": "MPL-2.0-text"}
    for file, name in wanted.items():
        text = "A program\n\n" + (COMMON / file).read_text(encoding="utf-8").replace("copy", "Copy", 3) + "\n\nthe end of the file"
        assert name in {k for k, *_ in scanner.scan(text)}, file
