"""Vectorised scanning of words in the UTF-8 bytes of an Arrow string column (runs inside tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Byte classes: everything but ASCII white space; and letters, digits and bytes of non-ASCII characters.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int):
    """Ranges of rows with at most ``most`` bytes each (a longer row stands alone)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each row the number of its first word (n + 1).  Words never cross rows."""
    within = inside[data]
    before = np.empty_like(within)
    before[1:] = within[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    after = np.empty_like(within)
    after[:-1] = within[1:]
    if len(after):
        after[-1] = False
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(within & ~before)
    ends = np.flatnonzero(within & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M2
    x = (x ^ (x >> np.uint64(29))) * M1
    return x ^ (x >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each span of bytes, eight bytes a step."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    h = mix(lengths.astype(np.uint64) + np.uint64(seed) * M1 + np.uint64(1))
    live, at, left = np.arange(len(starts)), starts.astype(np.int64), lengths.astype(np.int64)
    while len(live):
        take = eight[at]
        short = left < 8
        if short.any():
            take = np.where(short, take & ((np.uint64(1) << (np.minimum(left, 7) * 8).astype(np.uint64)) - np.uint64(1)), take)
        h[live] = mix(h[live] ^ (take * M1))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * M1 ^ ((b << np.uint64(23)) | (b >> np.uint64(41))))


def byte_ngrams(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: int, most: int, part: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the byte n-grams (``least`` to ``most``) of spans between two marks, span by span, and how many each span has; ``part`` spans at a time."""
    parts = [_byte_ngrams(data, starts[i : i + part], lengths[i : i + part], least, most) for i in range(0, len(starts), part)]
    return np.concatenate([np.zeros(0, np.uint32), *(p[0] for p in parts)]), np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])


def _byte_ngrams(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    length = lengths + 2
    chars, head = np.ones(int(length.sum()), np.uint32), np.cumsum(length) - length
    inner = np.repeat(head + 1, lengths) + np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    chars[inner] = data[np.repeat(starts, lengths) + inner - np.repeat(head + 1, lengths)]
    whose, left = np.repeat(np.arange(len(starts)), length), np.repeat(head + length, length) - np.arange(len(chars))
    code, own, found = chars.copy(), [], []
    for n in range(2, most + 1):
        code = code * np.uint32(65599) + np.concatenate([chars[n - 1 :], np.zeros(min(n - 1, len(chars)), np.uint32)])[: len(chars)]
        if n >= least:
            at = np.flatnonzero(left >= n)
            own.append(whose[at])
            found.append(code[at] * np.uint32(2654435761) + np.uint32(n))
    whose = np.concatenate(own)
    by = np.argsort(whose, kind="stable")
    return np.concatenate(found)[by], np.bincount(whose, minlength=len(starts))
