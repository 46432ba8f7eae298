"""Word shingles as 64-bit hashes, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from wordloom.llm.kernels import U64, mix

WIDTH = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15


_PIECE = 1 << 20
_BLANK = re.compile(b"[ \t-\r]")


def pieces(text: bytes, size: int = _PIECE) -> Iterator[bytes]:
    """A text in pieces of about ``size`` bytes, cut at blanks; no word is cut."""
    at = 0
    while len(text) - at > 2 * size and (cut := _BLANK.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each text and the end); words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.

    Long texts are walked in pieces, so that what is held beside the hashes stays small.
    """
    if any(len(t) > 4 * _PIECE for t in texts):
        found = [[_word_hashes([p])[0] for p in pieces(t)] for t in texts]
        counts = [sum(map(len, f)) for f in found]
        return np.concatenate([h for f in found for h in f]), np.concatenate([[0], np.cumsum(counts)])
    return _word_hashes(texts)


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = _LOWER[np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)]
    blank = _SPACE[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    lengths = ends - starts
    begins = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])
    if not len(starts):
        return np.zeros(0, U64), np.zeros(len(texts) + 1, np.int64)
    powers = np.empty(int(lengths.max()), U64)
    powers[0] = 1
    powers[1:] = U64(_BASE)
    powers = np.multiply.accumulate(powers)
    letters = data[~blank].astype(U64) + U64(1)
    firsts = np.cumsum(lengths) - lengths
    letters *= powers[np.arange(len(letters)) - np.repeat(firsts, lengths)]
    return mix(np.add.reduceat(letters, firsts) + lengths.astype(U64)), np.searchsorted(starts, begins)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's distinct 5-word shingles, sorted; a text of fewer words has one for the whole, one without words has none."""
    words, at = word_hashes(texts)
    grams = np.zeros(0, U64)
    if len(words) >= WIDTH:
        grams = words[: len(words) - WIDTH + 1].copy()
        for k in range(1, WIDTH):
            grams *= U64(0x2545F4914F6CDD1D)
            grams += words[k : len(words) - WIDTH + 1 + k]
        mix(grams)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            mine = np.sort(grams[a : b - WIDTH + 1])
            sets.append(mine[np.concatenate([[True], mine[1:] != mine[:-1]])])
        elif b > a:
            whole = U64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    whole = whole * U64(0x2545F4914F6CDD1D) + w
            sets.append(mix(np.array([whole], U64)))
        else:
            sets.append(np.zeros(0, U64))
    return sets
