"""Token counts by rank-synchronous array merging.

The distinct white-space-free chunks of a batch are cut into pre-tokens, which are held as one ragged numpy array of
symbol ids. Each round finds every pre-token's lowest-rank pair and applies it in all pre-tokens at once; a pre-token
without a pair left is done. Works for BPE files of the tokenizers library that end words by a suffix and split at
white space.
"""

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.arrays import pieces, sums

_NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class RankMerger:
    """Counts (or gives) the symbols that are left of each chunk after all merges."""

    KEEP = 200_000  #: chunks whose results are kept between batches

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab, merges, suffix = model["vocab"], model["merges"], model.get("end_of_word_suffix") or ""
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or not suffix:
            raise ValueError(f"{path}: only lower-casing BPE files with a word-end suffix are supported")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int32)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in merges]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # A pair is applied everywhere at once unless its result takes part in an earlier merge; then one place at a time.
        first = np.full(max(vocab.values()) + 1, _NONE)
        for side in (left, right):
            np.minimum.at(first, side, np.arange(len(side)))
        self.single = first[self.merged] < np.arange(len(pairs))
        self._table(left << 17 | right)
        self.seen: dict[str, int] = {}

    def _table(self, keys: np.ndarray) -> None:
        """Open addressing: slot -> (pair, rank)."""
        self.bits = 20
        self.key, self.rank = np.full(1 << self.bits, -1), np.full(1 << self.bits, _NONE, np.int32)
        todo, self.probes = np.arange(len(keys)), 0
        while len(todo):
            slot = self._slot(keys[todo], self.probes)
            free = self.key[slot] < 0
            _, one = np.unique(slot[free], return_index=True)
            won = todo[free][one]
            self.key[slot[free][one]], self.rank[slot[free][one]] = keys[won], won
            todo = np.setdiff1d(todo, won)
            self.probes += 1

    def _slot(self, key: np.ndarray, probe: int) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 17 | b
        out = np.full(len(key), _NONE, np.int32)
        for probe in range(self.probes):
            slot = self._slot(key, probe)
            out = np.where(self.key[slot] == key, self.rank[slot], out)
        return out

    def pretokens(self, chunk: str) -> list[bytes]:
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk.lower().encode()]
            chunk = chunk.lower()
        else:
            chunk = "".join(c.lower() for c in unicodedata.normalize("NFC", chunk))
        return [x.encode() for x in self.pattern.findall(chunk)]

    def merge(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens in a row, and where each begins."""
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        ids = self.inner[raw]
        ids[np.cumsum(size) - 1] = self.final[raw[np.cumsum(size) - 1]]
        own = np.arange(len(tokens))
        done_own, done_ids, done_size = [], [], []
        while len(own):
            begin = np.cumsum(size) - size
            word = np.repeat(np.arange(len(own)), size)
            rank = np.full(len(ids), _NONE, np.int32)
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank[inside] = self.ranks(ids[inside], ids[inside + 1])
            best = np.minimum.reduceat(rank, begin)
            over = best == _NONE
            hit = (rank == best[word]) & ~over[word]
            at = np.flatnonzero(hit)
            # of overlapping places (a a a) every second one counts, from the left
            head = np.ones(len(at), bool)
            head[1:] = at[1:] != at[:-1] + 1
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            at = at[(run % 2 == 0)]
            lone = self.single[rank[at]]
            if lone.any():
                _, one = np.unique(word[at], return_index=True)
                keep = ~lone
                keep[one] = True
                at = at[keep]
            ids[at] = self.merged[rank[at]]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            if over.any():
                out = over[word]
                done_own.append(own[over]), done_ids.append(ids[out]), done_size.append(size[over])
                stay &= ~out
            size = size - np.bincount(word[at], minlength=len(own))
            ids, own, size = ids[stay], own[~over], size[~over]
        if not done_own:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        own, ids, size = map(np.concatenate, (done_own, done_ids, done_size))
        order = np.argsort(own, kind="stable")
        begin = np.cumsum(size) - size
        put = np.repeat(begin[order] - (np.cumsum(size[order]) - size[order]), size[order]) + np.arange(len(ids))
        return ids[put], np.concatenate([[0], np.cumsum(size[order])])

    def counts(self, chunks: list[str]) -> np.ndarray:
        out = np.fromiter((self.seen.get(x, -1) for x in chunks), np.int64, len(chunks))
        new = np.flatnonzero(out < 0)
        tokens, owner, extra = [], [], np.zeros(len(chunks), np.int64)
        for i in new:
            chunk = chunks[i]
            parts = [chunk]
            if "<|" in chunk and (special := self.special_pattern.findall(chunk)):
                extra[i], parts = len(special), self.special_pattern.split(chunk)
            for part in parts:
                found = self.pretokens(part)
                tokens += found
                owner += [i] * len(found)
        out[new] = extra[new]
        if tokens:
            _, begin = self.merge(tokens)
            np.add.at(out, owner, np.diff(begin))
        for i in new[: max(0, self.KEEP - len(self.seen))]:
            self.seen[chunks[i]] = int(out[i])
        return out


@lru_cache(4)
def merger(path: str) -> RankMerger:
    """One for each Python worker."""
    return RankMerger(path)


def text_chunks(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(where each row's chunks begin, the number of each chunk's value, the distinct values). No token crosses ASCII white space."""
    found = pc.ascii_split_whitespace(column.cast(pa.large_string()).fill_null(""))
    offsets = np.asarray(found.offsets)
    coded = found.values.dictionary_encode()
    return offsets, np.asarray(coded.indices), coded.dictionary


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row. `path` is a local file of the tokenizer on every machine.

    A null or empty text has 0 bytes and 0 tokens; repeated rows and null ids give a row each; an empty table none.
    Columns other than the two named are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merger(path)
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                at, code, values = text_chunks(part.column("text"))
                n = sums(model.counts(values.to_pylist())[code] if len(code) else np.zeros(0, np.int64), at)
                size = np.asarray(pc.binary_length(part.column("text").fill_null("")), dtype=np.int64)
                yield pa.record_batch({"doc_id": part.column("id").cast(pa.int64()), "n_bytes": size, "n_tokens": n, "over_limit": pa.array(n > limit)})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
