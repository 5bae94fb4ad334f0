"""Bulk-synchronous best-fit packing of token pieces into sequences.

Documents of equal length are interchangeable, so Spark counts and ranks those of each length, and a round moves runs
of them. A round is one Spark job over the runs that are left: runs of documents and of gaps are partitioned by size; a
successor sweep within each block of sizes, then one over what the blocks left, gives the documents, longest first,
the smallest gaps that hold them; of documents that want one gap the longest, then the first in rank, gets it, and the
others look on. A gap takes one document a round. The round's table holds the moves and the runs that are left, gaps
updated; the next round reads it. Documents much shorter than the longest one left wait, so that they don't fill the
gaps that longer ones need; if nothing moves, new sequences are opened. A round reads at most one run of documents for
each length and the runs of gaps, whose number the capacity bounds, not the documents.
"""

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from quillspark.llm.arrays import gather, pieces, sums
from quillspark.llm.storage import Stash
from quillspark.llm.tokens import text_chunks

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
RUN = "kind int, length long, rank long, room long, sequence long, many long"
DOCUMENTS, GAPS, MOVES = range(3)  #: kinds of runs
_BLOCK = 128  #: sizes of runs that one task sweeps first
_WAIT = 0.2  #: of the longest length left: shorter documents wait
_RANK_ROWS = 200_000  #: documents of one length that are ranked by one task


#: Chunks whose pre-tokens are plain to see: Latin letters that NFC leaves alone and lower-case to one letter, digits, ASCII signs but ' and <.
_PLAIN = "^[!-&(-;=-~\u00c0-\u012f\u0131-\u024f]+$"
_BREAKS = r"([^\pL\pN]+|\pN)"


class IdBook:
    """Ids of white-space-free chunks by the tokenizers library, which sees each pre-token of plain chunks and other chunks whole; the first results are kept between batches."""

    KEEP = 100_000  #: results kept
    LONGEST = 64  #: characters of a chunk whose result is kept
    AT_ONCE = 4_000  #: chunks that the library encodes in one call

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.seen: dict[str, bytes] = {}

    def ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in a row, and where each begins."""
        spaced = pc.replace_substring_regex(pc.utf8_lower(chunks), _BREAKS, r" \1 ")
        parts = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(chunks, _PLAIN), pc.ascii_trim_whitespace(spaced), chunks))
        coded = parts.values.dictionary_encode()
        flat, begin = self._encode(coded.dictionary.to_pylist())
        code = np.asarray(coded.indices)
        size = np.diff(begin)[code] if len(code) else np.zeros(0, np.int64)
        return flat[gather(begin[code], size)], np.concatenate([[0], np.cumsum(size)])[np.asarray(parts.offsets)]

    def _encode(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.seen.get(x) for x in tokens]
        new = [i for i, x in enumerate(found) if x is None]
        for k in range(0, len(new), self.AT_ONCE):
            some = new[k : k + self.AT_ONCE]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([tokens[i] for i in some], add_special_tokens=False)):
                found[i] = np.array(e.ids, np.uint32).tobytes()
        short = [i for i in new if len(tokens[i]) <= self.LONGEST]
        for i in short[: max(0, self.KEEP - len(self.seen))]:
            self.seen[tokens[i]] = found[i]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), np.uint32), np.concatenate([[0], np.cumsum(size)])


@lru_cache(4)
def book(path: str) -> IdBook:
    return IdBook(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of each piece of at most `capacity` tokens.

    A document is its ids and `end_id`; only longer documents are cut. A null or empty text gives one piece of length 1.
    Repeated rows and null ids give their own pieces.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = book(path)
        for batch in batches:
            for part in pieces(batch, "text", 6 << 20):
                at, code, values = text_chunks(part.column("text"))
                flat, begin = model.ids(values)
                size = np.diff(begin)[code] if len(code) else np.zeros(0, np.int64)
                total = sums(size, at) + 1
                ids = np.full(total.sum(), end_id, np.uint32)
                ends = np.cumsum(total)
                body = np.ones(len(ids), bool)
                body[ends - 1] = False
                ids[body] = flat[gather(begin[code], size)] if len(code) else []
                row = np.repeat(np.arange(len(total)), -(-total // capacity))
                piece = np.arange(len(row)) - np.searchsorted(row, row)
                start = piece * capacity
                length = np.minimum(capacity, total[row] - start)
                first = (ends - total)[row] + start
                spans = [ids[a : a + n] for a, n in zip(first, length)]
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in spans]
                out = {"doc_id": part.column("id").cast(pa.int64()).take(pa.array(row)), "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": pa.array(crc, pa.int64())}
                yield pa.record_batch(out | ({"ids": pa.array([x.astype(np.int64) for x in spans], pa.list_(pa.int64()))} if with_ids else {}))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECE + (", ids array<long>" if with_ids else ""))


def successor_sweep(runs: pd.DataFrame) -> pd.DataFrame:
    """Moves of documents to the smallest gaps that hold them, longest first, one to a gap; the runs that are left; moves made before."""
    documents = runs["kind"] == DOCUMENTS
    size = runs["length"].where(documents, runs["room"])
    order = np.lexsort((runs["sequence"], runs["rank"], documents, -size))
    out, free = [], []
    for kind, length, rank, room, sequence, many in runs[[c.split()[0] for c in RUN.split(", ")]].iloc[order].itertuples(index=False):
        if kind == MOVES:
            out.append((kind, length, rank, room, sequence, many))
        elif kind == GAPS:
            free.append([room, sequence, many])
        else:
            while many and free:
                gap = free[-1]
                moved = min(many, gap[2])
                out.append((MOVES, length, rank, gap[0], gap[1], moved))
                rank, many, gap[1], gap[2] = rank + moved, many - moved, gap[1] + moved, gap[2] - moved
                if not gap[2]:
                    free.pop()
            if many:
                out.append((DOCUMENTS, length, rank, 0, 0, many))
    out += [(GAPS, 0, 0, *gap) for gap in free]
    return pd.DataFrame(out, columns=[c.split()[0] for c in RUN.split(", ")])


def best_fit_moves(counts: DataFrame, capacity: int, stash: Stash) -> DataFrame:
    """Moves of all rounds (length, rank, room, sequence, many): documents `rank` on of a length go to as many sequences from `sequence` on, at capacity - room.

    counts: length and count, one row for each length of 1 to `capacity`. No rows give no moves.
    """
    spark = counts.sparkSession
    kind, length, many = F.col("kind"), F.col("length"), F.col("many")

    def measured(runs: DataFrame, limit: int) -> tuple[DataFrame, dict]:
        """The runs, written, and what is left: longest and least length, tokens and large documents of at least `limit`."""
        left = kind == DOCUMENTS
        seen = Observation()
        asked = left & (length >= limit)
        kept = stash.put(
            runs.observe(
                seen,
                F.max(F.when(left, length)).alias("top"),
                F.min(F.when(left, length)).alias("least"),
                F.sum(F.when(asked, length * many)).alias("tokens"),
                F.sum(F.when(asked & (2 * length > capacity), many)).alias("large"),
                F.sum(F.when(kind == MOVES, many)).alias("moved"),
            )
        )
        return kept, seen.get

    start = counts.select(F.lit(DOCUMENTS).alias("kind"), "length", *(F.lit(0).cast("long").alias(c) for c in ("rank", "room", "sequence")), F.col("count").alias("many"))
    limit = int((counts.agg(F.max("length")).first()[0] or 0) * _WAIT)
    runs, left = measured(start, limit)
    rounds, opened = [runs], 0
    while left["top"]:
        moved = kind == MOVES
        room = F.when(moved, F.col("room") - length).otherwise(F.col("room"))
        state = runs.select(
            F.when(moved, GAPS).otherwise(kind).alias("kind"),
            *(F.when(moved, 0).otherwise(F.col(c)).alias(c) for c in ("length", "rank")),
            room.alias("room"),
            "sequence",
            "many",
        ).where((kind == DOCUMENTS) | (F.col("room") >= left["least"]))
        if not left["moved"]:  # what asks for a gap finds none
            new = max(left["large"] or 0, -(-left["tokens"] // capacity))
            state = state.union(spark.range(0, 1, 1, 1).select(F.lit(GAPS), *(F.lit(x).cast("long") for x in (0, 0, capacity, opened, new))))
            opened += new
        limit = int(left["top"] * _WAIT)
        waits = (kind == DOCUMENTS) & (length < limit)
        size = F.when(kind == DOCUMENTS, length).otherwise(F.col("room"))
        swept = state.where(~waits).groupBy(F.floor(size / _BLOCK)).applyInPandas(successor_sweep, RUN).groupBy().applyInPandas(successor_sweep, RUN)
        runs, left = measured(swept.union(state.where(waits)), limit)
        rounds.append(runs)
    return spark.read.schema(RUN).parquet(*(r.stashed_at for r in rounds)).where(kind == MOVES).drop("kind")


def pack(rows: DataFrame, capacity: int = 2048) -> DataFrame:
    """The pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset. rows are read more than once.

    Pieces of equal length are interchangeable: which of several equal rows gets which place doesn't matter. An empty
    table gives an empty result. A length over the capacity or under 1 is an error.
    """
    spark = rows.sparkSession
    stash = Stash(spark)
    counts = stash.put(rows.groupBy("length").count())
    odd, most = counts.agg(F.max(F.col("length").isNull() | ~F.col("length").between(1, capacity)), F.max("count")).first()
    if odd:
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    moves = best_fit_moves(counts, capacity, stash).select("length", "rank", "sequence", "room").collect()
    keyed = np.array(sorted(moves), np.int64).reshape(-1, 4)
    table = spark.sparkContext.broadcast((keyed[:, 0] << 44 | keyed[:, 1], keyed))
    salts = max(8, -(-(most or 0) // _RANK_ROWS))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within)).join(first, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, moves = table.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            own = moves[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            yield pa.record_batch({c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": own[:, 2] + rank - own[:, 1], "offset": capacity - own[:, 3]})

    return ranked.mapInArrow(place, PIECE + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """Tokenises, cuts and packs all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(Stash(docs.sparkSession).put(token_pieces(docs, path, capacity)), capacity)
