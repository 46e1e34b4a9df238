"""Byte-level words and hashes against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from vernissage.llm import bytewords as bw

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\t\n.X9\x00", max_size=30)), max_size=12)


@given(TEXTS)
def test_word_spans(texts):
    data, offsets = bw.text_bytes(pa.array(texts, pa.string()))
    for table, pattern in ((bw.SPACE_BYTES, rb"[^\x20\x09-\x0D]+"), (bw.NOT_ALNUM_BYTES, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        start, end, first = bw.word_spans(data, offsets, table)
        words = [data[s:e].tobytes() for s, e in zip(start, end)]
        got = [words[first[i] : first[i + 1]] for i in range(len(texts))]
        assert got == [re.findall(pattern, (t or "").encode()) for t in texts]


@given(TEXTS, st.integers(1, 4))
def test_hashes_tell_words_and_windows_apart(texts, n):
    data, offsets = bw.text_bytes(pa.array(texts, pa.string()))
    start, end, _ = bw.word_spans(data, offsets, bw.SPACE_BYTES)
    words = [data[s:e].tobytes() for s, e in zip(start, end)]
    hashes = bw.word_hashes(data, start, end, 3)
    assert len(set(hashes.tolist())) == len(set(words))
    assert {(w, int(h)) for w, h in zip(words, hashes)}.__len__() == len(set(words))
    windows = bw.window_hashes(hashes, n, 1)
    plain = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    assert len(set(zip(plain, windows.tolist()))) == len(set(plain)) == len(set(windows.tolist()))


def test_slices_cover_all_rows():
    texts = pa.array(["x" * n for n in (0, 5, 100, 0, 7, 300, 1)])
    parts = bw.slices(texts, 100)
    assert parts[0][0] == 0 and parts[-1][1] == 7 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert bw.slices(pa.array([], pa.string()), 10) == [(0, 0)]
    assert np.array_equal(bw.text_bytes(texts.slice(2, 3))[1], [0, 100, 100, 107])
