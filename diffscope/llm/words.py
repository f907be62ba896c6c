"""Words of whole Arrow text batches and 64-bit hashes of words and word n-grams, with numpy inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# An odd multiplier for the rolling hashes, the increment and multipliers of the splitmix64 finaliser.
MULTIPLIER = 0x9E3779B97F4A7C15
GAMMA = 0xBF58476D1CE4E5B9
FINAL = 0x94D049BB133111EB

WHITE_SPACE = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALPHANUMERIC = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
CHUNK_BYTES = 1 << 20


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values."""
    x = x + np.uint64(salt * MULTIPLIER % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(GAMMA)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(FINAL)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some documents: byte range and hash of each; `first[d]:first[d + 1]` are those of document d."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


class Hasher:
    """Splits bytes at separator bytes. `fold` treats A-Z as a-z. UTF-8 bytes from 0x80 on belong to words."""

    def __init__(self, separators: bytes = WHITE_SPACE, fold: bool = False):
        self.inside = np.ones(256, dtype=bool)
        self.inside[list(separators)] = False
        self.value = mixed(np.arange(256, dtype=np.uint64), 1)
        if fold:
            self.value[65:91] = self.value[97:123]
        self.power = self.inverse = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.power) < n:
            size = max(n, CHUNK_BYTES)
            for name, base in (("power", MULTIPLIER), ("inverse", pow(MULTIPLIER, -1, 1 << 64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.power, self.inverse

    def words(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        n = len(data)
        if n == 0:
            none = np.zeros(0, dtype=np.int64)
            return Words(none, none, np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64))
        inside = self.inside[data]
        before = np.concatenate(([False], inside[:-1]))
        after = np.concatenate((inside[1:], [False]))
        cuts = offsets[(offsets > 0) & (offsets < n)]
        before[cuts] = False
        after[cuts - 1] = False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        power, inverse = self._powers(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.value[data] * power[:n], out=sums[1:])
        h = (sums[end] - sums[start]) * inverse[start]
        return Words(start, end, mixed(h + (end - start).astype(np.uint64), 2), np.searchsorted(start, offsets))

    def grams(self, words: Words, k: int, salt: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """Positions (word numbers) at which k words of one document follow each other, and the hash of these words."""
        h, n = words.hash, len(words.hash)
        if n < k:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        left = np.repeat(words.first[1:], words.counts) - np.arange(n)
        at = np.flatnonzero(left >= k)
        power, inverse = self._powers(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mixed(h, salt) * power[:n], out=sums[1:])
        return at, mixed((sums[at + k] - sums[at]) * inverse[at], k)


class BlockHasher(Hasher):
    """Hashes words by mixing each block of 8 bytes with its number before they are summed.

    A word of up to 8 bytes is one block, and no pattern of letters makes long words meet whatever the multiplier is.
    """

    def __init__(self, separators: bytes = WHITE_SPACE, fold: bool = False):
        super().__init__(separators, fold)
        self.inside_table, letter = self.inside.tobytes(), np.arange(256, dtype=np.uint8)
        if fold:
            letter[65:91] = letter[97:123]
        self.letter_table = letter.tobytes() if fold else None

    def words(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        n, raw = len(data), data.tobytes()  # tables of bytes are looked up faster by bytes than by arrays
        inside = np.frombuffer(raw.translate(self.inside_table), dtype=bool)
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        before[cuts] = after[cuts - 1] = False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        size = end - start
        padded = np.zeros(n + 8, dtype=np.uint8)
        padded[:n] = np.frombuffer(raw.translate(self.letter_table), dtype=np.uint8) if self.letter_table else data
        eight = np.ndarray(n + 1, dtype="<u8", buffer=padded, strides=(1,))  # the 8 bytes from each place on

        def hashed(at: np.ndarray, left: np.ndarray, number: np.ndarray | int) -> np.ndarray:
            spare = (8 * np.maximum(8 - left, 0)).astype(np.uint64)
            return mixed((eight[at] << spare) + np.uint64(MULTIPLIER) * (np.uint64(1) + np.uint64(number)))

        sums = hashed(start, size, 0)
        long = np.flatnonzero(size > 8)
        if len(long):
            more = (size[long] - 1) // 8  # blocks after the first
            heads = np.cumsum(more) - more
            number = np.arange(int(more.sum())) - np.repeat(heads, more) + 1
            found = hashed(np.repeat(start[long], more) + 8 * number, np.repeat(size[long], more) - 8 * number,
                           number.astype(np.uint64))
            sums[long] += np.add.reduceat(found, heads)
        return Words(start, end, mixed(sums + size.astype(np.uint64), 2), np.searchsorted(start, offsets))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, offsets) of consecutive texts with about `limit` bytes; null texts are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset:texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        low = high


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
