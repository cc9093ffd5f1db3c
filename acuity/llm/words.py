"""Hashed words and word shingles of many texts at once, in numpy.

A chunk of texts is one array of code points. The hash of a word is a
difference of prefix sums, so no Python object is made for a word. Chunks are
bounded by ``CHUNK`` characters; only a single text that is longer makes a
longer one.
"""

from collections.abc import Iterator

import numpy as np

CHUNK = 1_000_000
SHINGLE = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_FACTORS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
                    np.uint64)
_powers: list[np.ndarray] = []
_table: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
                      for b in (_BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


def _is_word(codes: np.ndarray) -> np.ndarray:
    """Letters, digits and the underscore."""
    if not _table:
        _table.append(np.array([chr(i).isalnum() or i == 95 for i in range(0x10000)]))
    if len(codes) and codes.max() > 0xFFFF:
        word = _table[0][np.minimum(codes, 0xFFFF)]
        far = codes > 0xFFFF
        word[far] = [chr(c).isalnum() for c in codes[far]]
        return word
    return _table[0][codes]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def chunks(texts: list) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) with at most ``CHUNK`` characters together; null texts count as empty."""
    first, part, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if part and size + len(text) > CHUNK:
            yield first, part
            first, part, size = i, [], 0
        part.append(text)
        size += len(text)
    if part:
        yield first, part


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of all texts, bounds of each text in them, places of words in the joined codes."""
    lowered = [t.lower() for t in texts]
    codes = code_points("\n".join([*lowered, ""]))
    word = np.zeros(len(codes) + 1, bool)
    word[1:] = _is_word(codes)
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _power(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    text_ends = np.cumsum([len(t) + 1 for t in lowered])
    return hashes, np.concatenate([[0], np.searchsorted(starts, text_ends)]), starts


def shingle_hashes(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of five words of each text and the bounds of each text in them.

    A text of one to four words has one shingle of all its words; a text
    without words has none.
    """
    sizes = np.diff(bounds)
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    n = len(hashes) - SHINGLE + 1
    if n > 0:
        sums = sum(hashes[k:k + n] * _FACTORS[k] for k in range(SHINGLE))
        text_of = np.repeat(np.arange(len(sizes)), sizes)
        inside = text_of[:n] == text_of[SHINGLE - 1:]
        sums, owner = mix(sums[inside]), text_of[:n][inside]
    else:
        sums, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(short):
        extra = [sum(int(hashes[bounds[t] + k]) * int(_FACTORS[k]) for k in range(sizes[t])) + int(sizes[t]) for t in short]
        extra = mix(np.array([x % (1 << 64) for x in extra], np.uint64))
        owner = np.concatenate([owner, short])
        sums = np.concatenate([sums, extra])[np.argsort(owner, kind="stable")]
        owner = np.sort(owner)
    return sums, np.searchsorted(owner, np.arange(len(sizes) + 1))
