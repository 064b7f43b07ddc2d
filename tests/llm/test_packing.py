import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftloom.llm import packing, tokens

from .support import ODD, rows, table

PATH = tokens.default_tokenizer()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_every_id_once_and_no_gaps(spark, tokenizer):
    got = rows(packing.pack(packing.pieces(table(spark, ODD), PATH)))
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.SEQ_LEN
    left = [(d, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")) for d, t, *_ in ODD]
    assert sum(r["length"] for r in got) == sum(len(i) for _, i in left)
    for r in got:
        assert any(d == r["doc_id"] and len(i) == r["doc_tokens"] and zlib.crc32(i[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for d, i in left)


def test_sequences_hold_the_ids(spark, tokenizer):
    got = rows(packing.sequences(packing.pack(packing.pieces(table(spark, ODD), PATH, with_ids=True))))
    ids = sorted(i for r in got for i in r["ids"])
    assert ids == sorted(i for _, t, *_ in ODD for i in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    assert all(len(r["ids"]) <= packing.SEQ_LEN and r["starts"][0] == 0 for r in got)


def test_other_columns_are_carried_and_own_names_replaced(spark):
    pieces = packing.pieces(table(spark, ODD), PATH).withColumns({c: F.lit(f"own {c}") for c in ("part", "sequence_id", "offset", "x")})
    got = rows(packing.pack(pieces))
    assert all(r["part"] == "own part" and r["x"] == "own x" and isinstance(r["sequence_id"], int) and isinstance(r["offset"], int) for r in got)


def test_empty_table(spark):
    assert rows(packing.pack(packing.pieces(table(spark, []), PATH))) == []


def test_patterns_use_up_the_histogram_with_little_padding():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 1025, 20_000)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    packs = packing.patterns(histogram)
    used = {}
    for kind, n in packs:
        assert sum(kind) <= 1024
        for k in kind:
            used[k] = used.get(k, 0) + n
    assert used == histogram and len(packs) <= 2 * 1024
    assert sum(n * (1024 - sum(k)) for k, n in packs) < 0.01 * lengths.sum()


def test_encoder_equals_the_library(tokenizer):
    import pyarrow as pa

    texts = ["", "a", " a", "a ", "a  b", "a \nb c", "x\n y", "foo's bar 's it's", "é à ü", "<|endoftext|> hi <|endoftext|>", "a\tb c", None, "a b c", "1 2 33 444", "\U0001f600 x \U0001f600", "a\x1cb c \x1c"]
    encoder = tokens.Encoder(PATH)
    for batch in (texts, texts[::-1], ["plain words alone", "and more words"]):
        ids, at = encoder.encode(pa.array(batch))
        assert [list(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in batch]
