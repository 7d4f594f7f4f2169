import re
import string

import pyarrow as pa
import pytest

from folio.llm import words
from folio.llm.jaccard import document_sets

from .conftest import ODD_TEXTS

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []


@pytest.mark.parametrize("chunk", [1 << 18, 64])
def test_shingles_equal_brute_force(monkeypatch, chunk):
    monkeypatch.setattr(words, "CHUNK_BYTES", chunk)
    texts = [*ODD_TEXTS, "a b c d", "a b c d e", "A\tB\nc d e f", "a b c d e a b c d e"]
    seen, back = {}, {}
    got = [s for _, _, h, n in words.iter_word_hashes(pa.array(texts)) for s in _split(*words.shingle_hashes(h, n))]
    assert len(got) == len(texts)
    for text, hashes in zip(texts, got, strict=True):
        want = shingles(text)
        assert len(hashes) == len(want)
        for s, h in zip(want, hashes.tolist(), strict=True):
            assert seen.setdefault(s, h) == h and back.setdefault(h, s) == s


def _split(hashes, sizes):
    at = 0
    for n in sizes:
        yield hashes[at : at + n]
        at += n


def test_sets_are_distinct_and_sorted():
    a, b = document_sets(pa.array(["a b c d e a b c d e", None]), 5)
    assert len(a) == 5 and (a[1:] > a[:-1]).all() and len(b) == 0


@pytest.mark.parametrize("n", [1 << 10, 1 << 12, 1 << 16])
def test_words_of_opposite_order_differ(n):
    """Thue-Morse words, which have one polynomial hash modulo 2 ** 64 whatever its base."""
    x, y = "a", "b"
    while len(x) < n:
        x, y = x + y, y + x
    a, b, again = (next(words.iter_word_hashes(pa.array([t])))[2].tolist() for t in (x, y, x))
    assert a == again and a != b
    both = document_sets(pa.array([f"{x} one two three four", f"{y} one two three four"]), 5)
    assert len({s.tobytes() for s in both}) == 2
