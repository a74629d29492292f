"""Simple-8b: unsigned integers in 64-bit words. The top 4 bits are a selector, the other 60 hold n values of b bits.

Ids are cut into blocks of BLOCK values that begin on a word of their own. So blocks are coded side by side with
numpy, and any block can be decoded from its offset alone. A block's last word may hold fewer values than its
selector says; the caller knows the block's length. Selector 15 is an escape: the next word is one raw value.
"""

from __future__ import annotations

import numpy as np

#: Fixed by the format: values a word for selectors 1 to 14, each of 60 // n bits. Selector 0: 240 zeros.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ZEROS, ESCAPE, BLOCK = 240, 15, 240
#: A block in memory has room for what its last word's selector says it may hold.
ROW = BLOCK + COUNTS[0]
#: Bits that small values need.
_WIDTHS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)
_TAKES = np.array([ZEROS, *COUNTS, 1], np.int64)


def _choices(values: np.ndarray) -> np.ndarray:
    """For each place of the padded blocks the selector whose word takes most values from there."""
    if values.max() < len(_WIDTHS):
        width = _WIDTHS[values]
    else:  # a rounded-up value over 2**53 asks for one bit more at most
        width = np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    best, widest, span = np.where(width > 60, ESCAPE, 14).astype(np.uint8), width, 1
    for sel in range(13, 0, -1):  # more and narrower values each time
        count = COUNTS[sel - 1]
        after = np.zeros_like(widest)
        after[:, : ROW - count + span] = widest[:, count - span :]  # count is at most twice span: both runs cover all
        widest, span = np.maximum(widest, after), count
        np.copyto(best, sel, where=widest <= 60 // count)
    if not values[:, :BLOCK].all():
        best[~np.maximum.accumulate(values[:, ::-1] > 0, axis=1)[:, ::-1]] = 0  # zeros up to the block's end
    return best


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words (little-endian unsigned 64-bit) and, for each block, the index of its first word."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.empty(0, "<u8"), np.empty(0, np.int64)
    blocks = -(-n // BLOCK)
    padded = np.zeros((blocks, ROW), np.uint64)
    whole = n // BLOCK
    padded[:whole, :BLOCK] = values[: whole * BLOCK].reshape(whole, BLOCK)
    padded[whole:, : n - whole * BLOCK] = values[whole * BLOCK :]
    choice, padded = _choices(padded).ravel(), padded.ravel()
    takes = _TAKES[choice]
    pos = np.arange(blocks) * ROW
    ends, starts = pos + np.minimum(BLOCK, n - np.arange(blocks) * BLOCK), []
    while len(pos):  # all blocks one word further
        starts.append(pos)
        pos = pos + takes[pos]
        live = pos < ends
        pos, ends = pos[live], ends[live]
    start = np.sort(np.concatenate(starts))
    sel = choice[start]
    escaped = sel == ESCAPE
    where = np.arange(len(start)) + np.concatenate(([0], np.cumsum(escaped)[:-1]))
    words = np.zeros(len(start) + int(escaped.sum()), np.uint64)
    for s in np.unique(sel).tolist():
        own = np.flatnonzero(sel == s)
        at, word = start[own], np.full(len(own), s << 60, np.uint64)
        if 0 < s < ESCAPE:
            for k in range(COUNTS[s - 1]):
                word |= padded[at + k] << np.uint64(k * (60 // COUNTS[s - 1]))
        words[where[own]] = word
    words[where[escaped] + 1] = padded[start[escaped]]
    first = np.searchsorted(start, np.arange(blocks) * ROW)
    return words.astype("<u8"), where[first]


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values. offsets: as encode() gave them."""
    words = words.astype(np.uint64)
    if not n:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    head = np.ones(len(words), bool)
    for i in np.flatnonzero(sel == ESCAPE):  # a raw word may look like an escape itself
        if head[i]:
            head[i + 1] = False
    index = np.flatnonzero(head)
    sel, codes = sel[index], words[index]
    takes = _TAKES[sel]
    first = np.searchsorted(index, offsets)
    before = np.cumsum(takes) - takes
    start = before - np.repeat(before[first] - np.arange(len(first)) * ROW, np.diff(first, append=len(index)))
    out = np.zeros((len(first), ROW), np.uint64)
    flat = out.reshape(-1)
    for s in np.unique(sel).tolist():
        own = np.flatnonzero(sel == s)
        at, word = start[own], codes[own]
        if s == ESCAPE:
            flat[at] = words[index[own] + 1]
        elif s:
            bits = 60 // COUNTS[s - 1]
            mask = np.uint64((1 << bits) - 1)
            for k in range(COUNTS[s - 1]):
                flat[at + k] = (word >> np.uint64(k * bits)) & mask
    return out[:, :BLOCK].reshape(-1)[:n]
