"""Words of many texts at once, hashed on arrays of code points."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

PIECE = 1 << 20  # characters of text that are in memory as arrays at once
U = np.uint64
_BASE = 0x9E3779B97F4A7C15


SPACE, LETTER, DIGIT, SIGN, LINE_END, STOP = range(6)


@lru_cache(1)
def kinds() -> np.ndarray:
    """The kind of each code point; marks are letters, and so is all beyond U+FFFF; a stop ends a sentence."""
    first = {"L": LETTER, "M": LETTER, "N": DIGIT, "Z": SPACE, "C": SPACE}
    t = np.full(0x110000, LETTER, np.uint8)
    t[: 1 << 16] = [first.get(unicodedata.category(chr(c))[0], SIGN) for c in range(1 << 16)]
    t[[10, 13, 0x2028, 0x2029]] = LINE_END
    t[[33, 46, 63]] = STOP
    return t


@lru_cache(1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64: hashes of any stretch from one running sum."""
    out = []
    for x in (_BASE, pow(_BASE, -1, 1 << 64)):
        a = np.full(2 * PIECE + 2, x, U)
        a[0] = 1
        out.append(np.cumprod(a, dtype=U))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U(64 - bits)).astype(np.int32)


_NUMBER = U(0x1234567)  # stands for every word with a digit


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, passage number, text, is a word of letters) of every word and sign of the texts together."""
    low = [t.lower() for t in texts]
    first = np.cumsum([0, *(len(t) + 1 for t in low)])[:-1]
    cp = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(U), none, none, none.astype(bool)
    kind = kinds()[cp]
    word, sign, stop = (kind == LETTER) | (kind == DIGIT), (kind == SIGN) | (kind == STOP), kind == STOP
    up, down = powers()
    total = np.zeros(n + 1, U)
    np.cumsum((cp + np.uint32(1)) * up[:n], out=total[1:])
    digits = np.zeros(n + 1, np.int32)
    np.cumsum(kind == DIGIT, out=digits[1:])
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    start = np.flatnonzero(begins | sign)
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    is_word, end = word[start], start + 1
    end[is_word] = np.flatnonzero(ends) + 1
    h = mix((total[end] - total[start]) * down[start])
    number = digits[end] > digits[start]
    h[number] = _NUMBER
    cut = kind == LINE_END
    cut[1:] |= stop[:-1] & ((kind[1:] == SPACE) | (kind[1:] == LINE_END))
    passage, text = np.cumsum(cut, dtype=np.int32)[start], np.repeat(np.arange(len(first)), np.diff(np.append(np.searchsorted(start, first), len(start))))
    return h, passage, text, is_word & ~number


def pieces(texts: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """(texts or parts of them, position of each one's text), together at most half a ``PIECE`` and 1,000 of them.

    Longer texts are cut at line ends or else spaces; an unbroken run of half a million characters
    is cut where the piece ends. All of every text is in some piece.
    """
    group: list[str] = []
    owner: list[int] = []
    held, most = 0, PIECE // 2
    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = len(t)
            if end - at > most:
                end = at + most
                cut = t.rfind("\n", at + 1, end)
                cut = cut if cut > at else t.rfind(" ", at + 1, end)
                end = cut if cut > at else end
            if held and (held + end - at > most or len(group) == 1000):
                yield group, np.array(owner)
                group, owner, held = [], [], 0
            group.append(t[at:end])
            owner.append(i)
            held += end - at + 1
            at = end
    if group:
        yield group, np.array(owner)


def text_words(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the distinct hashed words and signs of each text."""
    out = [np.zeros(0, np.int64)]
    for group, owner in pieces(texts):
        h, _, part, _ = tokens(group)
        seen = np.zeros(len(group) << bits, bool)  # at most 1,000 texts
        seen[(part << bits) | bucket(h, bits)] = True
        at = np.flatnonzero(seen)
        out.append((owner[at >> bits].astype(np.int64) << bits) | (at & ((1 << bits) - 1)))
    both = np.concatenate(out)
    if len(both) and (np.diff(both) <= 0).any():  # a text in several pieces
        both = np.unique(both)
    return both >> bits, both & ((1 << bits) - 1)
