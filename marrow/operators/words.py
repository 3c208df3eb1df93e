"""Words of whole texts as 64-bit numbers, many texts at a time.

The bytes of a batch stand behind one another as Arrow has them. A rolling sum of a random number per
byte value times a power of an odd base gives every word its number, whatever its place; A-Z count as
a-z where asked for. Equal words have equal numbers; that different ones do has a chance of 2**-64 a pair.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=2)
def byte_numbers(lower: bool) -> np.ndarray:
    out = np.random.default_rng(7919).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out[BLANK] = 0
    if lower:
        out[65:91] = out[97:123]
    return out


_powers: dict[str, np.ndarray] = {}


def powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, 1 << 20), base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers[name][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts (one entry more than rows); nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8), at - at[0]


#: ASCII other than letters and digits.
NO_LETTER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def numbers(data: np.ndarray, rows: np.ndarray, lower: bool = True, blank: np.ndarray = BLANK, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The number, first byte and end of every word, and the first word of each row (one entry more than rows). cuts: where else a word ends and another begins."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(rows), np.int64)
    solid = ~blank[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[rows] = True
    if cuts is not None:
        cut[cuts] = True
    first = np.flatnonzero(solid & (cut[:-1] | np.r_[True, ~solid[:-1]]))
    end = np.flatnonzero(solid & (cut[1:] | np.r_[~solid[1:], True])) + 1
    with np.errstate(over="ignore"):
        total = np.cumsum(byte_numbers(lower)[data] * powers("up", BASE, len(data)), dtype=np.uint64)
        before = np.where(first > 0, total[first - 1], np.uint64(0))
        number = mixed((total[end - 1] - before) * powers("down", BACK, len(data))[first])
    return number, first, end, np.searchsorted(first, rows)


def shingles(number: np.ndarray, row: np.ndarray, size: int) -> list[np.ndarray]:
    """For each row the sorted distinct numbers of its runs of `size` words; of fewer words, the whole is one run."""
    salt = mixed(np.arange(1, size + 1).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    with np.errstate(over="ignore"):
        n = max(0, len(number) - size + 1)
        runs = np.zeros(n, np.uint64)
        for k in range(size):
            runs += number[k : k + n] * salt[k]
        runs = mixed(runs)
        out = []
        for a, b in zip(row[:-1].tolist(), row[1:].tolist(), strict=True):
            if b - a >= size:
                out.append(np.unique(runs[a : b - size + 1]))
            elif b > a:
                out.append(mixed(np.array([(number[a:b] * salt[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out

