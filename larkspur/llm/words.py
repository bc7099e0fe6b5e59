"""Words and word shingles of byte texts as 64-bit hashes, vectorised over blocks of text.

A word is a run of bytes other than space, \\t, \\n, \\v, \\f and \\r, after
lower-casing A-Z.  Its hash is a sum of per-byte random values times random odd
weights of their places, mixed with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_rng = np.random.default_rng(0x5EED)
BYTE_VALUES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
PLACES = 1 << 16
PLACE_WEIGHTS = _rng.integers(0, 2**64, PLACES, dtype=np.uint64) | np.uint64(1)
SHINGLE_WEIGHTS = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at once; a longer text is cut at white space.
BLOCK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of lower-cased bytes begin and end."""
    gap = SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(data) and not gap[0]:
        edge = np.r_[0, edge]
    if len(edge) % 2:
        edge = np.r_[edge, len(data)]
    return edge[::2], edge[1::2]


def hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the start of every word of lower-cased bytes."""
    starts, ends = bounds(data)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lengths = ends - starts
    ahead = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(ahead, lengths)
    terms = BYTE_VALUES[data[place + np.repeat(starts, lengths)]] * PLACE_WEIGHTS[place & (PLACES - 1)]
    return mix(np.add.reduceat(terms, ahead) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts


def pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces of about a block that end at white space."""
    at = 0
    while len(text) - at > 2 * BLOCK:
        end = at + BLOCK
        while end < len(text) and not (gaps := np.flatnonzero(SPACE[np.frombuffer(text[end : end + BLOCK], np.uint8)])).size:
            end += BLOCK
        end = min(len(text), end + int(gaps[0])) if end < len(text) else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def blocks(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, word hashes, offsets of each text's words) over runs of texts of about a block."""
    i = 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (j == i or held + len(texts[j]) <= BLOCK):
            held += len(texts[j]) + 1
            j += 1
        if j == i + 1 and len(texts[i]) > 2 * BLOCK:
            found = np.concatenate([hash_words(np.frombuffer(p.lower(), np.uint8))[0] for p in pieces(texts[i])])
            yield i, found, np.array([0, len(found)])
        else:
            joined = b"\n".join(texts[i:j]).lower()
            found, starts = hash_words(np.frombuffer(joined, np.uint8))
            ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts[i:j]), np.int64, j - i))
            yield i, found, np.r_[0, np.searchsorted(starts, ends)]
        i = j


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of a text's shingles in order; with fewer words than size, one of the whole sequence; none without words."""
    if not len(words):
        return words
    span = min(size, len(words))
    out = np.full(len(words) - span + 1, span, np.uint64)
    for k in range(span):
        out += words[k : len(words) - span + 1 + k] * SHINGLE_WEIGHTS[k]
    return mix(out)


def shingle_sets(texts: list[bytes], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, sorted distinct shingle hashes) of each text."""
    for first, found, offsets in blocks(texts):
        if len(found) >= size:
            flat = np.full(len(found) - size + 1, size, np.uint64)
            for k in range(size):
                flat += found[k : len(found) - size + 1 + k] * SHINGLE_WEIGHTS[k]
            flat = mix(flat)
        for n in range(len(offsets) - 1):
            lo, hi = offsets[n], offsets[n + 1]
            own = flat[lo : hi - size + 1] if hi - lo >= size else shingle_hashes(found[lo:hi], size)
            yield first + n, np.unique(own)
