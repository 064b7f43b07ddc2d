"""Token ids by the tokenizers library, each distinct space-separated chunk of a batch encoded once.

Byte-level BPE with the usual word pattern never joins a non-space character with a following single space: a token
may start with one space but none goes on over it. So a text whose every U+0020 stands between two characters that
are not white space can be cut before each space, and the chunks' ids in a row are the text's ids. Texts with other
spacing (runs of spaces, spaces beside line ends, at the start or at the end) are cut at such spaces only.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space (and some more, which is harmless): a U+0020 beside one of these isn't a place to cut.
_NEAR = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_UNCUT = rf"^ | $|{_NEAR} | {_NEAR}"
#: The spaces at which any text may be cut.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Distinct chunks that a worker keeps, over all batches; the first ones met are mostly the frequent ones.
CACHE = 1 << 19
#: Text bytes that are encoded at a time; a longer text goes alone.
STEP = 8 << 20
#: Chunks that are handed to the library as one text, and characters that it encodes at a time.
JOINED, ENCODED = 256, 1 << 16


def _flat(encodings: list) -> tuple[np.ndarray, np.ndarray]:
    ids = [e.ids for e in encodings]
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum())), n


def may_be_cut(settings: dict) -> bool:
    """Whether a tokenizer file is byte-level BPE with the usual word pattern and nothing that reaches over a space."""
    before, model = settings.get("pre_tokenizer") or {}, settings["model"]
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space", True) and before.get("use_regex", True)
    whole = settings.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
    added = all(" " not in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in settings.get("added_tokens", []))
    return plain and whole and added and settings.get("truncation") is None and settings.get("padding") is None


class Encoder:
    """``encode(texts)`` gives all ids in one array and the offsets of each text in it.

    ``known`` holds distinct chunks (without their leading space); ``ids`` their token ids, one after another.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cuts = may_be_cut(json.loads(self.tokenizer.to_str()))
        #: Whether a token begins with a space: of a chunk's tokens, the first alone does.
        self.opens = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.opens[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items() if t.startswith("\u0120")]] = True
        self.known = pa.array([], pa.large_string())
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and their number per text. Encodings are large (some hundred bytes a token), so few live at a time."""
        done, size, begin = [], 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size > ENCODED or i + 1 == len(texts):
                done.append(_flat(self.tokenizer.encode_batch_fast(texts[begin : i + 1], add_special_tokens=False)))
                begin, size = i + 1, 0
        return tuple(np.concatenate([np.zeros(0, k), *(d[j] for d in done)]) for j, k in enumerate((np.int32, np.int64)))

    def _spaced(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each chunk, with a leading space."""
        if not len(chunks):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        words = chunks.to_pylist()
        if not pc.any(pc.match_substring(chunks, " ")).as_py():
            ids, _ = self._encode([" " + " ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)])
            begin = np.flatnonzero(self.opens[ids])
            if len(begin) == len(words):
                return ids, np.diff(np.append(begin, len(ids)))
        return self._encode([" " + w for w in words])  # chunks with spaces inside, or an odd vocabulary: one by one

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each chunk where its own begin there and how many they are."""
        found = pc.index_in(chunks, value_set=self.known)
        fresh = found.is_null().to_numpy(zero_copy_only=False)
        new = chunks.filter(pa.array(fresh))
        ids, n = self._spaced(new)
        ends = len(self.ids) + np.cumsum(n)
        begin, count = np.empty((2, len(chunks)), np.int64)
        slot = found.drop_null().to_numpy()
        begins = np.concatenate([[0], self.ends])
        begin[~fresh], count[~fresh] = begins[slot], begins[slot + 1] - begins[slot]
        begin[fresh], count[fresh] = ends - n, n
        flat = np.concatenate([self.ids, ids])
        room = min(len(new), CACHE - len(self.known))
        if room > 0:
            self.known = pa.concat_arrays([self.known, new.slice(0, room)])
            self.ends = np.concatenate([self.ends, ends[:room]])
            self.ids = flat[: self.ends[-1]].copy()
        return flat, begin, count

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Nulls count as empty texts."""
        texts = plain(texts)
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        if not self.cuts:
            ids, n = self._encode(texts.to_pylist())
            return ids, np.concatenate([[0], np.cumsum(n)])
        odd = pc.match_substring_regex(texts, _UNCUT).to_numpy(zero_copy_only=False)
        if odd.any():
            return self._mixed(texts, odd)
        parts = pc.split_pattern(texts, " ")
        return self._words(parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py())

    def _words(self, words: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in chunks; the first chunk of each has no space before it."""
        first = np.zeros(len(words), bool)
        first[at[:-1]] = True
        head_ids, head_n = self._encode(words.filter(pa.array(first)).to_pylist())
        tails = words.filter(pa.array(~first)).dictionary_encode()
        code = tails.indices.to_numpy()
        ids, begin, count = self._chunks(tails.dictionary)
        each, start = np.empty((2, len(words)), np.int64)
        each[first], start[first] = head_n, len(ids) + np.cumsum(head_n) - head_n
        each[~first], start[~first] = count[code], begin[code]
        end = np.cumsum(each)
        return np.concatenate([ids, head_ids])[_runs(start, each, end)], np.concatenate([[0], end])[at]

    def _mixed(self, texts: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that are cut at every space and texts that are cut at some only, each apart, then back in their order."""
        lists = [_CUT.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        some, some_at = self._words(pa.array(chain.from_iterable(lists), pa.large_string()), np.cumsum([0, *map(len, lists)]))
        every, every_at = self.encode(texts.filter(pa.array(~odd)))
        begin, n = np.empty((2, len(texts)), np.int64)
        n[~odd], begin[~odd] = np.diff(every_at), every_at[:-1]
        n[odd], begin[odd] = np.diff(some_at), len(every) + some_at[:-1]
        end = np.cumsum(n)
        return np.concatenate([every, some])[_runs(begin, n, end)], np.concatenate([[0], end])


def plain(texts: pa.Array) -> pa.LargeStringArray:
    """The texts, nulls as empty ones, in an array that begins at its buffers' beginning.

    Slices don't, and pyarrow's ``ascii_lower`` (23.0) then gives other bytes, without an error.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if at is not None and len(texts) else np.zeros(1, np.int64)
    data = data.slice(int(at[0]), int(at[-1] - at[0])) if data is not None else pa.py_buffer(b"")
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), data)


def _runs(start: np.ndarray, n: np.ndarray, end: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for n each, one after another; end is the running sum of n."""
    kind = np.int32 if len(end) and start.max() + n.max() < 1 << 31 and end[-1] < 1 << 31 else np.int64
    take = np.repeat((start - (end - n)).astype(kind), n)
    take += np.arange(len(take), dtype=kind)
    return take


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def steps(batch: pa.RecordBatch, column: str, most: int = STEP) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        done = int(size[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, done + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end
        give_back()


@lru_cache(maxsize=1)
def _trim():
    """The C library's ``malloc_trim``, or nothing to do where it has none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Return what Arrow and the C library have freed, but keep for later, to the system: a worker is one of several that share an executor's memory."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def default_tokenizer() -> str:
    """The place of the public byte-level BPE vocabulary; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
