"""Vectorised helpers on Arrow text columns, used inside Spark's Python tasks.

Everything here works on one bounded chunk of rows at a time; Spark deals the
rows, moves them and joins them. A task's memory follows the chunk size and
the longest single text, never the size of the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
CHUNK_BYTES = 1 << 20


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


BYTE_VALUES = _odd(11, 256)
#: Two independent families of fingerprints: a base each, with its inverse.
_BASES = [int(_odd(13, 1)[0]) | 5, int(_odd(17, 1)[0]) | 5]
_powers = [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in _BASES]
#: Sums of powers modulo 2**64 tell all short stretches apart well, but there are known pairs of
#: unequal ones of 2,048 letters that no base does; longer stretches are hashed by content.
LONGEST_SUM = 512

IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACE)] = False

#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased.
IS_ALNUM = np.zeros(256, bool)
IS_ALNUM[0x30:0x3A] = IS_ALNUM[0x61:0x7B] = IS_ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def powers(n: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n, modulo 2**64."""
    found = _powers[family]
    if len(found[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        for k, base in enumerate((_BASES[family], pow(_BASES[family], -1, 1 << 64))):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            found[k] = np.multiply.accumulate(step)
    return found[0][:n], found[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Prints:
    """Fingerprints of any stretch (below LONGEST_SUM values) of a sequence of 64-bit values in constant time."""

    def __init__(self, values: np.ndarray, family: int = 0):
        up, self.down = powers(len(values) + 1, family)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.down[start])

    def grams(self, m: int) -> np.ndarray:
        """Fingerprints of all stretches of m values."""
        n = len(self.sums) - m
        return mixed((self.sums[m:] - self.sums[:n]) * self.down[:n])


def chunks(column, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about `limit` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    values = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = min(len(column), max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1))
        yield row, values[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def stretch_prints(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of the bytes of each stretch; those of LONGEST_SUM bytes and more by BLAKE2."""
    found = Prints(BYTE_VALUES[values]).of(starts, stops)
    for k in np.flatnonzero(stops - starts >= LONGEST_SUM):
        found[k] = int.from_bytes(hashlib.blake2b(values[starts[k] : stops[k]].tobytes(), digest_size=8).digest(), "little")
    return found


class Words:
    """The words of a chunk: byte positions, and where each row's words begin."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = IS_WORD):
        n = len(values)
        w = is_word[values]
        edge = np.zeros(n, bool)
        edge[1:] = w[:-1]
        edge[offsets[:-1][offsets[:-1] < n]] = False
        self.starts = np.flatnonzero(w & ~edge)
        edge[-1:] = False
        edge[:-1] = w[1:]
        full = offsets[1:] > offsets[:-1]
        edge[offsets[1:][full] - 1] = False
        self.stops = np.flatnonzero(w & ~edge) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.values = values

    def prints(self) -> np.ndarray:
        return stretch_prints(self.values, self.starts, self.stops)


def row_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each unit, for rows that begin at bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] times, for each i."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - before, counts)


def covered(size: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """True where any stretch from start to stop lies."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, stops, -1)
    return np.cumsum(steps[:-1]) > 0


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the maximal runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, in three passes."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def window_runs(units: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows of a row that share their first least gram.

    Equal windows have the same least gram wherever they stand, so windows
    need comparing only under one anchor, the fingerprint of that gram.
    Returns arrays: first window, number of windows, anchor,
    fingerprint of the whole stretch that the run's windows cover.
    """
    n = len(units) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    prints = Prints(units)
    grams = prints.grams(gram)
    least = sliding_minimum(grams, window - gram + 1)
    valid = np.zeros(n, bool)
    counts = np.maximum(np.diff(bounds) - window + 1, 0)
    valid[ranges(bounds[:-1], counts)] = True
    begins = valid.copy()
    # Where a window begins with its least gram, the next one has another, if of the same value.
    begins[1:] &= (least[1:] != least[:-1]) | (grams[: n - 1] == least[:-1]) | ~valid[:-1]
    heads = bounds[:-1][counts > 0]
    begins[heads] = True
    first = np.flatnonzero(begins)
    ends = np.zeros(n, bool)
    ends[:-1] = begins[1:] | ~valid[1:]
    ends[-1] = True
    count = np.flatnonzero(ends & valid) + 1 - first
    stretch = Prints(mixed(units ^ np.uint64(0xA5A5F00DCAFE1234)), family=1)
    return first, count, least[first], stretch.of(first, first + count + window - 1)


def lists(bounds: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.asarray(bounds, np.int32)), values)
