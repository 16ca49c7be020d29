"""Vectorised hashing of word sequences.

Many whole texts become one flat array of 128-bit word hashes with document
bounds; hashes of n consecutive words are prefix sums modulo 2**64, so they
cost a few numpy passes whatever n is.  Words are ``[^\\x20\\x09-\\x0D]+``,
which on UTF-8 bytes is exactly ``bytes.split()``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from xxhash import xxh3_128_digest

#: Odd multipliers of the rolling hashes: of the two halves of a digest, and of the shorter grams.
HIGH, LOW, GRAM = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
#: Bits for a position inside a piece; a piece has fewer words than that.
POSITION_BITS = 22
#: Words hashed together; a longer document goes through overlapping pieces.
PIECE_WORDS = 1 << 19

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over each other, reversibly."""
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def _power_table(multiplier: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, at least n of each."""
    have = _powers.get(multiplier)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        tables = []
        for base in (multiplier, pow(multiplier, -1, 1 << 64)):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            tables.append(np.multiply.accumulate(factors))
        have = _powers[multiplier] = (tables[0], tables[1])
    return have


def rolling(word_hashes: np.ndarray, n: int, multiplier: int) -> np.ndarray:
    """Hash of each run of n consecutive words; empty if there are fewer."""
    count = len(word_hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _power_table(multiplier, len(word_hashes))
    sums = np.cumsum(word_hashes * power[: len(word_hashes)], dtype=np.uint64)
    spans = sums[n - 1 :].copy()
    spans[1:] -= sums[: count - 1]
    return _mix(spans * inverse[:count])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


class Piece:
    """Words of some documents, or of a stretch of one long document."""

    def __init__(self, numbers: list[int], words: list[list[bytes]], offset: int):
        self.hashes = np.frombuffer(b"".join([xxh3_128_digest(w) for ws in words for w in ws]), dtype="<u8").reshape(-1, 2)
        lengths = np.array([len(ws) for ws in words], dtype=np.int64)
        self.document = np.repeat(np.array(numbers, dtype=np.int64), lengths)
        #: index of each word in its document
        self.start = np.arange(len(self.document)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + offset
        self.left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(self.document))

    def windows(self, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows inside one document, the anchor of each, and the grams' hashes.

        The anchor of a window is the place of the gram with the least hash in
        it, the leftmost of equal ones, so equal windows have equal anchors.
        """
        grams = rolling(np.ascontiguousarray(self.hashes[:, 0]), gram, GRAM)
        if len(self.document) < size:
            none = np.zeros(0, dtype=np.int64)
            return none, none, grams
        low = np.uint64((1 << POSITION_BITS) - 1)
        keyed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        least = sliding_min(keyed, size - gram + 1)
        starts = np.flatnonzero(self.left[: len(least)] >= size)
        return starts, (least[starts] & low).astype(np.int64), grams

    def digests(self, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """128-bit digests of the windows of ``size`` words at ``starts``, as two halves."""
        return tuple(rolling(np.ascontiguousarray(self.hashes[:, i]), size, m)[starts] for i, m in ((0, HIGH), (1, LOW)))


def pieces(texts: Iterable[str | None], size: int) -> Iterator[Piece]:
    """Pieces that hold every window of ``size`` words of the numbered texts exactly once."""
    numbers: list[int] = []
    words: list[list[bytes]] = []
    have = 0
    for number, text in enumerate(texts):
        own = (text or "").encode().split()
        if len(own) > PIECE_WORDS:
            for at in range(0, len(own) - size + 1, PIECE_WORDS):
                yield Piece([number], [own[at : at + PIECE_WORDS + size - 1]], at)
            continue
        numbers.append(number)
        words.append(own)
        have += len(own)
        if have >= PIECE_WORDS:
            yield Piece(numbers, words, 0)
            numbers, words, have = [], [], 0
    if numbers:
        yield Piece(numbers, words, 0)
