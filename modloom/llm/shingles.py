"""Hashes of words and word shingles of many texts at once, in numpy.

Words are runs of bytes other than white space (space, \\t \\n \\v \\f \\r), with A-Z folded. A word's hash is the sum over its bytes of
a random number of the byte times one of its place, modulo 2**64, finished by mixing; a shingle's hash mixes its words'.
"""

from __future__ import annotations

import re

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240917)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BREAK = re.compile(rb"[ \t\n\v\f\r]")
#: Everything in ASCII but letters and digits.
_MARKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def mixed(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_PLACE = mixed(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)


#: Bytes of one text that are hashed at once; more where a word crosses the end.
PART = 1 << 20


def word_hashes(texts: list[bytes], marks: bool = False, part: int = PART) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in a row, and the number of words of each text. With marks, ASCII punctuation parts words too.

    Long texts are hashed part by part, cut before white space, so that only the hashes grow with the text."""
    if max(map(len, texts), default=0) <= part:
        return _word_hashes(texts, marks)
    found, counts = [], []
    for t in texts:
        n, at = 0, 0
        while at < len(t):
            end = min(len(t), at + part)
            while end < len(t) and not (m := _BREAK.search(t, end, end + part)):
                end = min(len(t), end + part)
            if end < len(t):
                end = m.start()
            h, c = _word_hashes([t[at:end]], marks)
            found.append(h)
            n += int(c[0])
            at = end
        counts.append(n)
    return np.concatenate([np.zeros(0, np.uint64), *found]), np.array(counts, np.int64)


def _word_hashes(texts: list[bytes], marks: bool) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"\n".join([*texts, b""]) if texts else b"", np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    letter = ~(_MARKS if marks else _SPACE)[raw]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    start = np.flatnonzero(first)
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(start, np.concatenate([[0], ends])))
    if not len(start):
        return np.zeros(0, np.uint64), counts
    index = np.cumsum(first, dtype=np.int64) - 1
    place = np.arange(len(raw)) - start[np.maximum(index, 0)]
    far = place >= 256
    p = _PLACE[place & 255]
    if far.any():  # words of over 256 bytes
        p[far] = mixed((place[far].astype(np.uint64) + U(1)) * U(0x9E3779B97F4A7C15)) | U(1)
    return mixed(np.add.reduceat(np.where(letter, _BYTE[raw] * p, U(0)), start)), counts


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words, in order; of the whole sequence where it is shorter; none without words."""
    n = len(words)
    if n == 0:
        return words
    size = min(n, k)
    h = np.full(n - size + 1, (size * 0x9E3779B97F4A7C15) % 2**64, np.uint64)
    for i in range(size):
        h = mixed(h ^ words[i : n - size + 1 + i]) + U(0x632BE59BD9B4E019)
    return h
