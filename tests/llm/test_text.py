import random

import numpy as np
import pyarrow as pa
import pytest
from frames import awkward, words

from siltstone.llm.common import blocks, range_hashes, span_hashes, text_bytes, window_hashes, word_spans
from siltstone.llm.substrings import sliding_min


def test_words_of_arrow_columns():
    texts = [r[1] for r in awkward()]
    for column in (pa.array(texts, pa.string()), pa.array([None, *texts, "z"], pa.string())[1:-1], pa.array(texts, pa.large_string())):
        data, off = text_bytes(column)
        starts, ends, first = word_spans(data, off)
        raw = data.tobytes()
        got = [[raw[p:q].decode() for p, q in zip(starts[i:j], ends[i:j])] for i, j in zip(first[:-1], first[1:])]
        assert got == [words(t) for t in texts]


def test_hashes_follow_content():
    data = np.frombuffer(b"aa bb aa cc bb aa", np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    h = span_hashes(data, starts, ends)
    assert h[0] == h[2] == h[5] and len(set(h.tolist())) == 3
    w = window_hashes(h, 2)
    assert w[1] == w[4] and len(set(w.tolist())) == 4
    assert range_hashes(h, np.array([1]), np.array([2]))[0] == w[1]


@pytest.mark.parametrize("k", [1, 2, 3, 7, 16, 31])
def test_sliding_min(k):
    x = np.array([random.Random(3).randrange(99) for _ in range(60)], np.uint64)
    assert sliding_min(x, k).tolist() == [x[i : i + k].min() for i in range(60 - k + 1)]


def test_blocks_cover_all_values():
    off = np.array([0, 5, 5, 400, 401, 900])
    assert [x for i, j in blocks(off, 100) for x in range(i, j)] == list(range(5))
