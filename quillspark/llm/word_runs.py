"""Runs of consecutive words in the texts of an Arrow batch, each distinct one of a block made into a string once."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillspark.llm.arrays import _LOWER, gather, utf8

BLOCK = 4 << 20  #: bytes of texts whose runs are counted at once


@dataclass
class Split:
    """Bytes of words, and bytes that end a piece; what is neither lies between words. No run goes over the end of a piece or text."""

    word: np.ndarray
    ends: np.ndarray

    @classmethod
    def at(cls, spaces: bytes, ends: bytes = b"") -> "Split":
        word, stop = np.ones(256, bool), np.zeros(256, bool)
        stop[list(ends)] = True
        word[list(spaces + ends)] = False
        return cls(word, stop)


@dataclass
class Runs:
    """Of one length: the first word of each run, the run's place among the distinct ones, and of these the count and one occurrence."""

    first: np.ndarray
    code: np.ndarray
    count: np.ndarray
    one: np.ndarray


class Block:
    """Words of a column of texts, lower-cased in A-Z. row: the text of each word."""

    def __init__(self, column: pa.Array, split: Split):
        data, offsets = utf8(column)
        data = _LOWER[data]
        is_word = split.word[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], is_word[:-1]]) if len(data) else np.zeros(0, bool)
        after = np.concatenate([is_word[1:], [False]]) if len(data) else np.zeros(0, bool)
        start = np.flatnonzero(is_word & (~before | edge[:-1]))
        end = np.flatnonzero(is_word & (~after | edge[1:])) + 1
        self.rows = len(column)
        self.row = np.searchsorted(offsets, start, "right") - 1
        stops = np.flatnonzero(split.ends[data])
        piece = np.searchsorted(stops, start)
        self.joined = (self.row[1:] == self.row[:-1]) & (piece[1:] == piece[:-1])
        size = end - start
        flat = data[gather(start, size)] if len(start) else np.zeros(0, np.uint8)
        at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        spelled = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(at), pa.py_buffer(flat)]).dictionary_encode()
        order = np.asarray(pc.sort_indices(spelled.dictionary))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        #: Codes follow the spelling, so that distinct runs come sorted, which shuffles compress well.
        self.code, self.spelling = place[np.asarray(spelled.indices)], spelled.dictionary.take(pa.array(order)).cast(pa.string())

    def runs(self, most: int, group: np.ndarray | None = None) -> list[Runs]:
        """Runs of 1 to `most` words. group: of each text; equal runs of different groups are different ones."""
        first = np.arange(len(self.code))
        code, key = None, self.code if group is None else group[self.row] * len(self.spelling) + self.code
        out = []
        for n in range(1, most + 1):
            if n > 1:
                go = self.joined[first[first + n - 1 < len(self.code)] + n - 2]
                first, code = first[: len(go)][go], code[: len(go)][go]
                key = code * len(self.spelling) + self.code[first + n - 1]
            order = np.argsort(key)
            new = np.ones(len(key), bool)
            new[1:] = key[order[1:]] != key[order[:-1]]
            begin = np.flatnonzero(new)
            code = np.empty(len(key), np.int64)
            code[order] = np.cumsum(new) - 1
            out.append(Runs(first, code, np.diff(begin, append=len(key)), first[order[begin]]))
        return out

    def strings(self, first: np.ndarray, n: int) -> pa.Array:
        """The runs of n words that begin at the given words, joined by one space."""
        parts = [self.spelling.take(pa.array(self.code[first + k])) for k in range(n)]
        return parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")
