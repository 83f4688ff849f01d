"""Vectorised word scanning over the UTF-8 bytes of whole texts.

Both word rules used here can be decided byte by byte, since every byte of a
multi-byte UTF-8 character is 0x80 or above: a 256-entry table maps each byte
to its lower-cased form, or to 0 where the byte separates words.  A word is
hashed as the sum of (byte + 1) * R[place], R being 64-bit pseudo-random
numbers, followed by a mixing step; two different words collide with a chance
of about 2**-56.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: White space of `[^\x20\x09-\x0D]+`.
SPACES = [0x20, *range(0x09, 0x0E)]
#: Text bytes that are scanned at once; a longer text is scanned alone.
SHARD_BYTES = 1 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(separators: list[int], lower: bool) -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    if lower:
        out[0x41:0x5B] += 32
    out[separators] = 0
    return out


#: Words `[^\x20\x09-\x0D]+`, as they stand and with A-Z in lower case. The byte 0 is a word character, and shares its code with 0xFF, which UTF-8 never has.
SPACED = table(SPACES, False)
SPACED[0] = 0xFF
SPACED_LOWER = table(SPACES, True)
SPACED_LOWER[0] = 0xFF
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` with A-Z in lower case.
ALNUM_LOWER = table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = np.asarray(x, np.uint64) + GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_places = mix(np.arange(4096, dtype=np.uint64))


def places(n: int) -> np.ndarray:
    global _places
    if n > len(_places):
        _places = mix(np.arange(1 << int(n - 1).bit_length(), dtype=np.uint64))
    return _places


def shards(column: pa.Array, most: int = SHARD_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows in them) for runs of rows of `most` bytes, or of one longer row. Null is the empty text."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, len(column))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Words:
    """The words of a run of texts: `start` and `end` byte, `hash`, and `first`: the index of each text's first word, with the number of words at its end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rule: np.ndarray):
        self.bytes = rule[data]
        inside = np.zeros(len(data) + 1, np.bool_)
        inside[:-1] = self.bytes != 0
        begins = inside[:-1].copy()
        begins[1:] &= ~inside[:-2]
        cuts = offsets[1:-1]
        cuts = cuts[cuts < len(data)]
        begins[cuts] = inside[cuts]
        ends = inside[:-1] & ~inside[1:]
        last = cuts[cuts > 0] - 1
        ends[last] = inside[last]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        n = len(self.start)
        if not n:
            self.hash = np.zeros(0, np.uint64)
            return
        length = self.end - self.start
        kept = np.flatnonzero(inside[:-1])
        at = np.zeros(n, np.int64)
        np.cumsum(length[:-1], out=at[1:])
        place = np.arange(len(kept)) - np.repeat(at, length)
        terms = self.bytes[kept].astype(np.uint64)
        terms += np.uint64(1)
        terms *= places(int(length.max()))[place]
        self.hash = mix(np.add.reduceat(terms, at) + length.astype(np.uint64))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n hashes; those that cross a text's end are to be left out by the caller."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out += hashes[k : k + m] * (places(n)[k] | np.uint64(1))
    return mix(out)
