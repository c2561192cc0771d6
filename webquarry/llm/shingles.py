"""Word shingles of texts as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9FB21C651E98DF25)
_Q = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(32))) * _Q
    x = (x ^ (x >> np.uint64(29))) * _P
    return x ^ (x >> np.uint64(32))


#: A number for each byte, A-Z as a-z; and which bytes part words (20 and 09 to 0D).
_BYTES = mix(np.array([b + 33 if 65 <= b <= 90 else b + 1 for b in range(256)], dtype=np.uint64) * _P)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BASE = 0x5851F42D4C957F2D
#: Bytes that are hashed at once, unless one text is longer.
_PIECE = 1 << 20


class Words:
    """64-bit hashes of the words of texts: A-Z lower-cased, split at the ASCII white space 20 and 09 to 0D.

    A word's hash is a difference of prefix sums of a polynomial in its bytes, so that all words of many texts are hashed
    at once and no word is an object.
    """

    def __init__(self) -> None:
        self.powers = self.inverses = np.empty(0, dtype=np.uint64)

    def _tables(self, n: int) -> None:
        if len(self.powers) < n:
            ones = [np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, dtype=np.uint64)]) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
            self.powers, self.inverses = (np.cumprod(x, dtype=np.uint64) for x in ones)

    def _hash(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        n = len(data)
        if not n:
            return [np.empty(0, np.uint64)] * (len(offsets) - 1)
        self._tables(max(n, _PIECE))
        word = ~_SPACE[data]
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True
        starts = np.flatnonzero(word & (first[:-1] | np.concatenate([[True], ~word[:-1]])))
        ends = np.flatnonzero(word & (first[1:] | np.concatenate([~word[1:], [True]]))) + 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * self.powers[:n], dtype=np.uint64)])
        hashes = mix((sums[ends] - sums[starts]) * self.inverses[starts])
        return np.split(hashes, np.searchsorted(starts, offsets[1:-1]))

    def __call__(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The hashes of the words of each text of a binary column; none for nulls."""
        if column.null_count:
            column = column.fill_null(b"")
        if not len(column):
            return
        if pa.types.is_large_binary(column.type):
            column = column.cast(pa.binary())
        _, places, values = column.buffers()
        offsets = np.frombuffer(places, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.empty(0, np.uint8)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _PIECE, side="right")) - 1)
            yield from self._hash(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to


def positions(hashes: np.ndarray, width: int) -> np.ndarray:
    """The shingle that begins at each word; with fewer words than ``width`` the whole sequence as one; none without."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    size = min(width, n)
    x = mix(hashes[: n - size + 1] + np.uint64(size))
    for k in range(1, size):
        x = mix(x * _P + hashes[k : n - size + 1 + k])
    return x


class Shingler:
    """The sets of shingles of texts, sorted."""

    def __init__(self, width: int):
        self.width, self.words = width, Words()

    def of(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The set of each text of a binary column."""
        return (np.unique(positions(x, self.width)) for x in self.words(column))


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit fingerprint of a set; 0 for the empty set."""
    if not len(shingles):
        return 0
    both = np.array([mix(shingles).sum(dtype=np.uint64), np.bitwise_xor.reduce(shingles)], dtype=np.uint64)
    h = mix(both + np.uint64(len(shingles)))
    return int((h * np.array([1, _P], dtype=np.uint64)).sum(dtype=np.uint64).astype(np.int64)) or 1
