"""Words of whole texts and their hashes, for the operators that work on bytes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)
MEMO = 150_000
# Bytes of text that are hashed at a time, and of the longest word that is hashed along with others.
PIECE, LONG = 1 << 16, 255
SPACE = re.compile(rb"[\x20\x09-\x0d]")


def words(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than space and \\x09-\\x0D, with A-Z lower-cased; none in a null text."""
    return text.lower().split() if text else []


class WordHashes(dict):
    """64-bit hash of a word, remembered for the words met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly over the whole range."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SOLID = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
_BYTES = mixed(MIX * np.arange(1, 257, dtype=np.uint64))
_STEP = 0x9E3779B97F4A7C15 | 1


def _powers(step: int) -> np.ndarray:
    out = np.full(4 * PIECE + 1, step, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_AHEAD, _BACK = _powers(_STEP), _powers(pow(_STEP, -1, 1 << 64))


def _hashed(piece: bytes) -> np.ndarray:
    """Hashes of the words of a lower-cased text: differences of one running sum over its bytes."""
    if len(piece) > 4 * PIECE:
        found = [xxhash.xxh3_64_intdigest(w) if len(w) > LONG else int(_hashed(w)[0]) for w in piece.split()]
        return np.array(found, np.uint64)
    codes = np.frombuffer(piece, np.uint8)
    solid = np.zeros(len(codes) + 2, np.int8)
    solid[1:-1] = _SOLID[codes]
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    begin, end = edges[::2], edges[1::2]
    run = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_BYTES[codes] * _AHEAD[: len(codes)], out=run[1:])
    out = mixed((run[end] - run[begin]) * _BACK[begin] + (end - begin).astype(np.uint64))
    for k in np.flatnonzero(end - begin > LONG):
        out[k] = xxhash.xxh3_64_intdigest(piece[begin[k] : end[k]])
    return out


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of ``words(text)``, whatever text they stand in."""
    lower, found, at = (text or b"").lower(), [], 0
    while at < len(lower):
        cut = SPACE.search(lower, at + PIECE)
        end = cut.start() if cut else len(lower)
        found.append(_hashed(lower[at:end]))
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words, given by theirs; of fewer words, one of the whole sequence."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    size = min(size, len(hashes))
    total = np.full(len(hashes) - size + 1, size, np.uint64)
    for i in range(size):
        total = total * MIX + hashes[i : len(hashes) - size + 1 + i]
    return distinct(mixed(total))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]
