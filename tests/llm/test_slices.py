"""Arrow batches reach the operators in slices; a slice must give what its texts give by themselves."""

import numpy as np
import pyarrow as pa
import pytest

from driftloom.llm import hmm_lm, jaccard, pu_quality, tokens

from .support import ascii_lower, words

TEXTS = [None if i % 11 == 3 else f"Text {i} Ünï ÄB  #tag {'Word ' * (i % 7)}{i * i}\nLine {i}." for i in range(400)]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("begin", [0, 1, 57, 399, 400])
def test_slices_give_what_their_texts_give(kind, begin):
    part, alone = pa.array(TEXTS, kind).slice(begin), pa.array(TEXTS[begin:], kind)
    assert hmm_lm.split_words(part).to_pylist() == [words(ascii_lower(t)) for t in TEXTS[begin:]]
    assert np.array_equal(pu_quality.measures(part), pu_quality.measures(alone))
    for a, b in zip(jaccard.shingle_sets(part), jaccard.shingle_sets(alone), strict=True):
        assert np.array_equal(a, b)
    encoder = tokens.Encoder(tokens.default_tokenizer())
    for a, b in zip(encoder.encode(part), encoder.encode(alone), strict=True):
        assert np.array_equal(a, b)
    wanted = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in TEXTS[begin:]]
    ids, at = encoder.encode(part)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == wanted


def test_memory_is_given_back_after_each_slice(monkeypatch):
    calls = []
    monkeypatch.setattr(tokens, "_trim", lambda: calls.append)
    batch = pa.RecordBatch.from_arrays([pa.array(["some text"] * 8)], ["text"])
    assert sum(x.num_rows for x in tokens.steps(batch, "text", 20)) == 8 and calls == [0] * 4
