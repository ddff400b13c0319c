"""Words and shingles of Arrow text columns as 64-bit numbers, for whole batches at once.

Texts are taken as their UTF-8 bytes with A-Z lowered; words are runs of bytes other
than space and \\x09-\\x0D.  A word's number is a polynomial over random byte values,
mixed; with 64 bits, two of ten million words agree with a chance of about 3e-6.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
BASE_INVERSE = pow(BASE, -1, 2 ** 64)
BLOCK_BYTES = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit number."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def byte_values() -> np.ndarray:
    """A random odd number per byte; capitals have those of their small letters."""
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
    values[65:91] = values[97:123]
    return values


def word_bytes(letters: bool) -> np.ndarray:
    """Which of the 256 byte values are part of a word."""
    code = np.arange(256)
    if letters:
        small = code | 32
        return ((small >= 97) & (small <= 122)) | ((code >= 48) & (code <= 57)) | (code >= 128)
    return ~((code == 32) | ((code >= 9) & (code <= 13)))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Ranges of rows with about `limit` bytes each; a longer text has one of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def word_numbers(data: np.ndarray, offsets: np.ndarray, letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, word offsets) of the texts between the byte offsets.

    With `letters`, words are runs of ASCII letters, digits and bytes from 128 on only.
    """
    first, last = int(offsets[0]), int(offsets[-1])
    part, texts = data[first:last], offsets - first
    if not len(part):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = word_bytes(letters)[part]
    begin = np.empty(len(part), bool)
    begin[0] = True
    np.logical_not(word[:-1], out=begin[1:])
    begin[texts[:-1][texts[:-1] < len(part)]] = True
    begin &= word
    starts = np.flatnonzero(begin)
    stop = np.empty(len(part), bool)
    stop[-1] = True
    np.logical_not(word[1:], out=stop[:-1])
    inner = texts[1:]
    stop[inner[(inner > 0)] - 1] = True
    stop &= word
    ends = np.flatnonzero(stop) + 1
    powers = np.full(len(part), BASE, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(byte_values()[part] * powers, out=sums[1:])
    back = np.full(len(part), BASE_INVERSE, np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    numbers = mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    return numbers, np.searchsorted(starts, texts).astype(np.int64)


def shingle_numbers(numbers: np.ndarray, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, offsets) of the distinct shingles of each text, sorted.

    A text with fewer words than `width` has its whole sequence as its only shingle, one
    without words has none.
    """
    k = np.uint64(BASE)
    n = len(numbers)
    rolled = np.zeros(max(n - width + 1, 0), np.uint64)
    for i in range(width):
        rolled = rolled * k + numbers[i:i + len(rolled)]
    rolled = mixed(rolled + np.uint64(width))
    out, ends = [], [0]
    for a, b in zip(words[:-1].tolist(), words[1:].tolist()):
        if b - a >= width:
            own = np.unique(rolled[a:b - width + 1])
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for i in range(a, b):
                whole = whole * k + numbers[i:i + 1]
            own = mixed(whole + np.uint64(b - a))
        else:
            own = rolled[:0]
        out.append(own)
        ends.append(ends[-1] + len(own))
    return np.concatenate(out) if out else rolled[:0], np.array(ends, np.int64)
