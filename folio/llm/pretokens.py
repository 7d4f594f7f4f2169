"""Vectorised split of texts by ``public_tokenizers.PATTERN``.

The pattern's alternatives depend only on character classes and on the apostrophe endings, so the matches of many texts
are found at once from an array of code points. Each text is split alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE, END = range(5)
#: Characters worked on at once; a longer text is one chunk.
CHUNK_CHARS = 1 << 18
APOSTROPHE, BLANK = 0x27, 0x20


@cache
def char_classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    points = [*range(0xD800), *range(0xE000, 0x110000)]
    everything = "".join(map(chr, points))
    table = np.zeros(0x110000, np.uint8)
    at = np.array(points)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, everything):
            table[at[m.start() : m.end()]] = kind
    return table


def _starts(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Flags of the first character of each match; ``kinds`` has END between texts and at the end."""
    n = len(points)
    new_run = np.ones(n, bool)
    new_run[1:] = kinds[1:] != kinds[:-1]
    space = kinds == SPACE
    st = new_run.copy()
    # a run of white space before a visible character gives its last character away: to the next match if a blank
    after = np.zeros(n, bool)
    after[:-1] = space[:-1] & ~space[1:] & (kinds[1:] != END)
    st |= after
    joined = np.zeros(n, bool)
    joined[1:] = after[:-1] & (points[:-1] == BLANK)
    st &= ~joined
    quotes = np.flatnonzero((points == APOSTROPHE) & st & new_run)
    quotes = quotes[kinds[quotes] != END]
    quotes = quotes[kinds[quotes + 1] == LETTER]
    if len(quotes):
        a = points[quotes + 1]
        b = points[np.minimum(quotes + 2, n - 1)]
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        one = np.isin(a, [ord(x) for x in "stmd"])
        length = np.where(one, 1, np.where(two, 2, 0))
        quotes, length = quotes[length > 0], length[length > 0]
        st[quotes + 1] = False
        rest = quotes + 1 + length
        rest = rest[kinds[rest] == LETTER]
        st[rest] = True
    return st & (kinds != END)


def split_texts(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Matches of a run of texts, and the number that each of them has; runs follow one another."""
    table = char_classes()
    lo = 0
    while lo < len(texts):
        hi, size = lo + 1, len(texts[lo])
        while hi < len(texts) and size + len(texts[hi]) < CHUNK_CHARS:
            size += len(texts[hi]) + 1
            hi += 1
        joined = "\x00".join(texts[lo:hi]) + "\x00"
        try:
            points = np.frombuffer(joined.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = table[points]
        ends = np.cumsum([len(x) + 1 for x in texts[lo:hi]]) - 1
        kinds[ends] = END
        st = _starts(points, kinds)
        st[ends] = True
        bounds = np.flatnonzero(st)
        opens = kinds[bounds] != END
        starts, stops = bounds[opens], bounds[1:][opens[:-1]]
        words = [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        yield words, np.diff(np.searchsorted(starts, ends), prepend=0).tolist()
        lo = hi


class WordCache:
    """Token ids of a match as little-endian 32-bit integers, kept up to a number of matches in a worker.

    ``encode`` takes a list of matches not met before and returns their ids.
    """

    def __init__(self, encode, most: int = 400_000, longest: int = 64):
        self.encode, self.most, self.longest, self.known = encode, most, longest, {}

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """All ids of each text."""
        for words, counts in split_texts(texts):
            get = self.known.get
            parts = list(map(get, words))
            if None in parts:
                missing = list(dict.fromkeys(w for w, p in zip(words, parts, strict=True) if p is None))
                new = dict(zip(missing, self.encode(missing), strict=True))
                parts = [new[w] if p is None else p for w, p in zip(words, parts, strict=True)]
                if len(self.known) + len(new) > self.most:  # forget the older half
                    kept = list(self.known.items())[-self.most // 2 :]
                    self.known.clear()
                    self.known.update(kept)
                self.known.update((w, p) for w, p in new.items() if len(w) <= self.longest)
            at = 0
            for n in counts:
                yield b"".join(parts[at : at + n])
                at += n
