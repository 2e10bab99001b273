"""Hashes of words and word runs of one text, by numpy over its bytes.

A word is a run of bytes other than ASCII white space.  Its hash is a polynomial over
random 64-bit values of its bytes, so all words of a text are hashed by one cumulative
sum; long texts go piece by piece, cut at white space, which bounds memory.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
#: A random value for each byte, A-Z as a-z, and the base of the polynomial.
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_VALUE[65:91] = BYTE_VALUE[97:123]
BASE = np.uint64(int(_RNG.integers(1, 2**62)) * 2 + 1)
BASE_BACK = np.uint64(pow(int(BASE), -1, 2**64))
RUN_BASE = np.uint64(int(_RNG.integers(1, 2**62)) * 2 + 1)
RUN_BASE_BACK = np.uint64(pow(int(RUN_BASE), -1, 2**64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All ASCII bytes but letters and digits.
IS_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
PIECE = 1 << 15
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(1 << int(n - 1).bit_length(), base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[int(base)] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def span_hashes(values: np.ndarray, first: np.ndarray, end: np.ndarray, base: np.uint64, back: np.uint64) -> np.ndarray:
    """Hash of values[first:end] for every span, by one cumulative sum."""
    n = len(values)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _power(base, n + 1)[:n], dtype=np.uint64)))
        return mix((total[end] - total[first]) * _power(back, n + 1)[first] + (end - first).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values evenly."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _pieces(text: bytes, breaks: np.ndarray):
    """(start, end) of pieces of about PIECE bytes that end at a break."""
    start, n = 0, len(text)
    while n - start > PIECE:
        end = start + PIECE
        while end < n and not breaks[text[end]]:
            end += 1
        yield start, end
        start = end
    yield start, n


def word_hashes(text: bytes, breaks: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of every word, that is, of every run of bytes that are no breaks."""
    hashes, firsts, lasts = [], [], []
    for at, end in _pieces(text, breaks):
        a = np.frombuffer(text, np.uint8, end - at, at)
        edge = np.diff(np.concatenate(([True], breaks[a], [True])).view(np.int8))
        s, e = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(s):
            hashes.append(span_hashes(BYTE_VALUE[a], s, e, BASE, BASE_BACK))
            firsts.append(s + at)
            lasts.append(e + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts)


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words; fewer words make one run; no words, none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    size_here = min(size, len(words))
    h = np.zeros(len(words) - size_here + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size_here):
            h = h * RUN_BASE + words[j : j + len(h)]
        return mix(h + np.uint64(size_here))


def shingles(text: bytes | None, size: int = 5) -> np.ndarray:
    """The distinct run hashes of a text, sorted."""
    return np.unique(run_hashes(word_hashes(text or b"")[0], size))
