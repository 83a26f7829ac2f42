import numpy as np
import pyarrow as pa
from brute import words
from hypothesis import given, settings
from hypothesis import strategies as st

from halyard.llm.text import range_hash, words_of

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x0b\x0c\r\x1c\x85\xa0ñ", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.booleans())
def test_words_are_bytes_between_ascii_white_space(texts, lower):
    w = words_of(pa.array(texts, pa.string()), lower)
    raw = w.data.tobytes()
    for d, text in enumerate(texts):
        found = [raw[w.start[i] : w.end[i]] for i in range(w.first[d], w.first[d + 1])]
        assert found == words(text, lower)


def test_hashes_do_not_depend_on_place():
    w = words_of(pa.array(["a bb a", "bb", None, "a"]))  # a bb a bb a
    h = w.hashes()
    assert h[0] == h[2] == h[4] and h[1] == h[3] and h[0] != h[1]
    at = np.array([0, 2, 1])
    a, b, c = range_hash(h, at, at + 2)
    assert a == b != c


def test_null_and_empty_columns():
    assert len(words_of(pa.array([], pa.string())).start) == 0
    assert words_of(pa.array([None, ""], pa.string())).counts().tolist() == [0, 0]


def test_rows_in_any_order_are_numbered_alike():
    """Both passes over a chunk must agree on the numbers of strings and words."""
    from halyard.llm.language_model import _Vocabulary
    from halyard.llm.substring_dedup import _Chunk

    table = pa.table({"id": pa.array([3, None, 1, 1, 2, None], pa.int64()), "text": ["a b c d", "e f g h", "c b a d", None, "h g f e b", "a"], "train": [True, False, True, True, False, True]})
    shuffled = table.take(pa.array([5, 3, 0, 4, 2, 1]))
    assert list(_Chunk(table, 3, 2, 2).blobs()) == list(_Chunk(shuffled, 3, 2, 2).blobs())
    assert list(_Vocabulary(table, 3).blobs()) == list(_Vocabulary(shuffled, 3).blobs())
