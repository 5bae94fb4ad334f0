"""Texts of an Arrow batch as flat numpy arrays: words, hashes and shingles without a Python object per word."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LONG_WORD = 64
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spreads 64-bit values; another seed gives another hash function."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts (one more entry for the end). Null reads as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about `most` bytes (one row at least), so that memory doesn't follow the batch."""
    ends = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word [^\\x20\\x09-\\x0D]+."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    is_word = ~_SPACE[data]
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge], last[edge - 1] = is_word[edge], is_word[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes."""
    h = np.full(len(start), 0xCBF29CE484222325, np.uint64)
    size = end - start
    order = np.argsort(-size, kind="stable")
    s, n = start[order], size[order]
    acc = h[order]
    many = np.cumsum(np.bincount(np.minimum(n, _LONG_WORD + 1), minlength=_LONG_WORD + 2)[::-1])[::-1] if len(n) else np.zeros(_LONG_WORD + 2, int)
    for k in range(_LONG_WORD):
        if not (c := int(many[k + 1])):
            break
        acc[:c] = (acc[:c] ^ data[s[:c] + k]) * _M1
        acc[:c] ^= acc[:c] >> np.uint64(29)
    for i in np.flatnonzero(n > _LONG_WORD):
        acc[i] = xxhash.xxh64_intdigest(data[s[i] : s[i] + n[i]].tobytes())
    h[order] = acc
    return mix(h ^ size.astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word, lower-cased."""
    data = _LOWER[data]
    start, end, row = words(data, offsets)
    return row, span_hashes(data, start, end)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int, weigh: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """(row, hash) of the distinct shingles of `size` lower-cased words, by row and hash. A row with fewer words has its whole sequence as one shingle; a row without words has none.

    weigh: gives whole numbers for word hashes; then the sum over each shingle's words comes third.
    """
    row, h = word_hashes(data, offsets)
    n = np.bincount(row, minlength=len(offsets) - 1) if len(row) else np.zeros(len(offsets) - 1, int)
    take = np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :]) if len(row) >= size else np.zeros(0, int)
    out = np.full(len(take), size, np.uint64)
    for k in range(size):
        out = mix(out * _M1 ^ h[take + k])
    short = np.flatnonzero((n > 0) & (n < size))
    begin = np.searchsorted(row, short)
    whole = n[short].astype(np.uint64)
    for k in range(size - 1):
        more = n[short] > k
        whole[more] = mix(whole[more] * _M1 ^ h[begin[more] + k])
    rows, out = np.concatenate([row[take], short]), np.concatenate([out, whole])
    order = np.lexsort((out, rows))
    rows, out = rows[order], out[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (out[1:] != out[:-1])
    if weigh is None:
        return rows[new], out[new]
    each = weigh(h)
    weight = np.concatenate([sum((each[take + k] for k in range(size)), np.zeros(len(take), np.int64)), np.zeros(len(short), np.int64)])
    return rows[new], out[new], weight[order][new]


def starts(rows: np.ndarray, count: int) -> np.ndarray:
    """Where each of `count` rows begins in the sorted `rows`, with the end as last entry."""
    return np.searchsorted(rows, np.arange(count + 1))


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each run at[i]:at[i + 1]; empty runs give 0."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


def gather(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... of each run, one run after another."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
