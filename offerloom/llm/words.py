"""Words of many texts at once as 64-bit hashes, with numpy."""

from __future__ import annotations

from functools import cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        a = np.full(1 << max(12, (n - 1).bit_length()), base, np.uint64)
        a[0] = 1
        _powers[base] = np.multiply.accumulate(a)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over all bits (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each run, the same wherever the run lies."""
    sums = np.zeros(len(values) + 1, np.uint64)
    sums[1:] = values
    sums[1:] += np.uint64(1)
    sums[1:] *= powers(_BASE, len(values))
    np.cumsum(sums, out=sums)
    return mix((sums[end] - sums[start]) * powers(_INVERSE, len(values) + 1)[start] ^ (end - start).astype(np.uint64))


def runs_of(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of marked places start and end."""
    edge = np.zeros(len(marked) + 1, bool)
    edge[:-1] = marked
    edge[1:] ^= marked
    at = np.flatnonzero(edge)
    return at[::2], at[1::2]


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    is_letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            is_letter[cp] = True
            low = c.lower()
            if len(low) == 1:
                lower[cp] = ord(low)
    return is_letter, lower


def stem_terms(texts: list[str], stems: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-case runs of letters, and of their first letters, stems of them (of longer words), the text of
    each, and how many runs each text has."""
    is_letter, lower = _letters()
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    begins = np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts])))[:-1]
    start, end = runs_of(is_letter[codes])
    doc = np.searchsorted(begins, start, side="right") - 1
    starts, ends, docs = [start], [end], [doc]
    for k in stems:
        longer = end - start > k
        starts.append(start[longer])
        ends.append(start[longer] + k)
        docs.append(doc[longer])
    return run_hashes(lower[codes], np.concatenate(starts), np.concatenate(ends)), np.concatenate(docs), np.bincount(doc, minlength=len(texts))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _byte_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    parts = [x.encode("utf-8", "surrogatepass") for x in texts]
    data = np.frombuffer(b"\n".join(parts), np.uint8)
    begins = np.concatenate(([0], np.cumsum([len(x) + 1 for x in parts])))
    start, end = runs_of(~_SPACE[data])
    return data, start, end, np.searchsorted(start, begins)


def byte_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of bytes other than ASCII white space, A-Z in lower case, and the first word of each text.

    The second array has one entry more than there are texts.
    """
    data, start, end, first = _byte_runs(texts)
    return run_hashes(_LOWER[data], start, end), first


def placed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """byte_words, and where each word starts and ends in its text, in characters."""
    data, start, end, first = _byte_runs(texts)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    begins = np.repeat(np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts])))[:-1], np.diff(first)).astype(np.int64)
    return run_hashes(_LOWER[data], start, end), first, chars[start] - begins, chars[end] - begins


def shingles(words: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of size words of each text, a shorter text's whole sequence as one; and where each text's begin."""
    count = np.diff(first)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    begins = np.concatenate(([0], np.cumsum(n)))
    owner = np.repeat(np.arange(len(count)), n)
    start = first[:-1][owner] + np.arange(begins[-1]) - begins[:-1][owner]
    return run_hashes(words, start, start + np.minimum(count[owner], size)), begins


def distinct_sets(hashes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in ascending order, and where each text's begin."""
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    keep = np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1]))) if len(h) else np.empty(0, bool)
    h, o = h[keep], o[keep]
    return h, np.searchsorted(o, np.arange(len(begins)))
