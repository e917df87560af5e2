"""Words and shingles of Arrow text columns as numpy arrays of 64-bit hashes, with no loop over words.

The hash of a word is a polynomial over its bytes modulo 2**64, read off prefix sums, and mixed with its
length. Texts are cut between words into blocks, so working memory does not follow the text; a word that is
longer than two blocks is hashed by itself (BLAKE2b).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
BASE, INVERSE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BLOCK = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All but letters, digits and bytes of non-ASCII characters; and ASCII capitals to small letters.
NOT_ALNUM = np.array([not (chr(i).isalnum() or i >= 128) if i < 128 else False for i in range(256)])
FOLD = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)

_powers = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, BLOCK + 4096)
        for i, b in enumerate((BASE, INVERSE)):
            p = np.full(n, b, U)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: 1: ASCII letters and digits, 2: other visible ASCII, 0: all else.
CLASS = np.array([0 if i <= 32 or i >= 127 else 1 if chr(i).isalnum() else 2 for i in range(256)], np.uint8)


def unit_starts(part: np.ndarray) -> np.ndarray:
    """Where a word changes from ASCII letters and digits to ASCII marks or back; never behind an apostrophe."""
    kind = CLASS[part]
    out = np.zeros(len(part), bool)
    out[1:] = (kind[1:] * kind[:-1] == 2) & (part[:-1] != 39)
    return out


def _bounds(data: np.ndarray, new_row: np.ndarray, apart: np.ndarray, units: bool, a: int, b: int) -> np.ndarray:
    """At which places of [a, b) no word goes on from the byte before (a is at least 1)."""
    out = apart[data[a:b]] | apart[data[a - 1 : b - 1]] | new_row[a:b]
    return out | unit_starts(data[a - 1 : b])[1:] if units else out


def _between(data: np.ndarray, new_row: np.ndarray, apart: np.ndarray, units: bool, b: int) -> int:
    """The first place from ``b`` on where no word goes on."""
    step = 4096
    while b < len(data):
        part = _bounds(data, new_row, apart, units, b, min(len(data), b + step))
        if part.any():
            return b + int(part.argmax())
        b, step = b + len(part), min(step * 2, 1 << 22)
    return len(data)


def word_hashes(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE, fold: np.ndarray | None = None, units: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in order, words per row, and the first and behind-last byte of each word.

    ``apart``: bytes between words; ``fold``: bytes that count as others; ``units``: cut words by ``unit_starts`` too.
    """
    n = len(data)
    new_row = np.zeros(n + 1, bool)
    new_row[offsets] = True
    hashes, firsts, lasts = [], [], []
    a = 0
    while a < n:
        b = min(n, a + BLOCK)
        if b < n:  # up to a place between words, which is near but for words as long as a block
            b = _between(data, new_row, apart, units, b)
            if b - a > 2 * BLOCK:
                near = np.flatnonzero(_bounds(data, new_row, apart, units, a + 1, a + BLOCK))
                if len(near):
                    b = a + 1 + int(near[-1])
                elif not apart[data[a]]:  # one long word from here on
                    word = data[a:b] if fold is None else fold[data[a:b]]
                    hashes.append(np.frombuffer(hashlib.blake2b(word.tobytes(), digest_size=8).digest(), "<u8").astype(U))
                    firsts.append(np.array([a]))
                    lasts.append(np.array([b]))
                    a = b
                    continue
                else:
                    b = a + 1
        part = data[a:b]
        gap = apart[part]
        before = np.empty(len(part), bool)
        before[0] = True
        before[1:] = gap[:-1]
        before |= new_row[a:b]
        cut = unit_starts(part) if units else None
        if units:
            before |= cut
        first = np.flatnonzero(before & ~gap)
        after = np.empty(len(part), bool)
        after[-1] = True
        after[:-1] = gap[1:]
        after |= new_row[a + 1 : b + 1]
        if units:
            after[:-1] |= cut[1:]
        last = np.flatnonzero(after & ~gap) + 1
        up, down = _power(len(part) + 1)
        total = np.zeros(len(part) + 1, U)
        np.cumsum((part if fold is None else fold[part]).astype(U) * up[: len(part)], out=total[1:])
        h = (total[last] - total[first]) * down[first]
        hashes.append(mix(h ^ ((last - first).astype(U) << U(48))))
        firsts.append(first + a)
        lasts.append(last + a)
        a = b
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    h, first, last = cat(hashes, U), cat(firsts, np.int64), cat(lasts, np.int64)
    counts = np.diff(np.searchsorted(first, offsets))
    return h, counts, first, last


def runs(counts: np.ndarray) -> np.ndarray:
    """The row of each item, given the items per row."""
    return np.repeat(np.arange(len(counts)), counts)


def windows(h: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words in each row, items per row, first word of each.

    A row of fewer words has one run, of all its words; a row without words has none.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    made = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    at = np.repeat(starts - (np.cumsum(made) - made), made) + np.arange(int(made.sum()))
    size = np.repeat(np.minimum(counts, n), made)
    out = np.zeros(len(at), U)
    for j in range(n):
        there = size > j
        out = np.where(there, (out + h[np.minimum(at + j, max(len(h) - 1, 0))]) * BASE if len(h) else out, out)
    return mix(out ^ size.astype(U)), made, at


def slices(offsets: np.ndarray, most: int = 1 << 21) -> list[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer row stands alone."""
    out, a = [], 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        out.append((a, b))
        a = b
    return out
