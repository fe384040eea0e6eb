"""Vectorised word and shingle codes for Arrow string columns (numpy, used inside tasks).

A batch is read straight from its Arrow buffers; texts are never turned into Python
strings.  Work goes in chunks of whole texts of about ``CHUNK_BYTES``, so memory depends
on the longest text and the chunk, not on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x100000001B3)  # odd, so that it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 2 ** 64))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer of 64-bit words (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row past the last, bytes, offsets): runs of whole texts; nulls are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + CHUNK_BYTES, "right")) - 1)
        yield a, b, data[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
        a = b


def word_codes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text) of a run of texts."""
    n_texts = len(offs) - 1
    word = ~_BLANK[data]
    first = np.empty(len(data), bool)  # a word starts after a blank or where a text starts
    last = np.empty(len(data), bool)
    if len(data):
        first[0], first[1:] = True, ~word[:-1]
        last[-1], last[:-1] = True, ~word[1:]
        edge = offs[:-1][offs[:-1] < offs[1:]]
        first[edge] = True
        last[edge[1:] - 1] = True
    starts, ends = np.flatnonzero(word & first), np.flatnonzero(word & last) + 1
    # prefix sums of byte * base**i, made relative by the inverse power
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=prefix[1:])
    code = (prefix[ends] - prefix[starts]) * _powers(_INVERSE, len(data) + 1)[starts]
    counts = np.searchsorted(starts, offs[1:]) - np.searchsorted(starts, offs[:-1])
    assert len(counts) == n_texts
    return mix64(code ^ (ends - starts).astype(np.uint64) << np.uint64(56)), counts


def shingle_codes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``k`` words, text number of each); a text of 1 to k-1 words has one
    shingle of all its words, a text without words none."""
    ends = np.cumsum(counts)
    begins = ends - counts
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), n)
    at = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + begins[text]
    code = np.zeros(len(text), np.uint64)
    padded = np.concatenate((words, np.zeros(k, np.uint64)))
    limit = ends[text]
    for j in range(k):
        code = mix64(code + np.uint64(j + 1) + np.where(at + j < limit, padded[at + j], np.uint64(0)))
    return code, text


def counted(code: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (code, text) with their counts, by text and code."""
    order = np.lexsort((code, text))
    code, text = code[order], text[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return code[at], text[at], np.diff(np.append(at, len(code)))
