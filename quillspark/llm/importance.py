"""Resampling of documents towards a target distribution by the gains of hashed word n-grams.

A dictionary counts every distinct n-gram string of a block of texts and hashes it once; counts of buckets come from the
dictionaries of all blocks, and the gain of a string's bucket is joined back to the texts of the block that hold it. No
string leaves its block: a dictionary over all documents would shuffle more than six times the input (README). The
draw without replacement is a top-k by weight plus seeded Gumbel noise.
"""

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.arrays import pieces
from quillspark.llm.storage import Stash
from quillspark.llm.word_runs import BLOCK, Block, Runs, Split

#: ASCII letters and digits and all that isn't ASCII are word bytes.
SPLIT = Split.at(bytes(b for b in range(128) if not chr(b).isalnum()))
BUCKETS, SIZES, SEED = 10_000, 3, 42


def _zero_byte(crc: np.ndarray) -> np.ndarray:
    return crc >> np.uint32(8) ^ _BYTE[crc & np.uint32(255)]


def _of_bytes(crc: np.ndarray) -> np.ndarray:
    """For each of the four bytes of a checksum, what its 256 values become. crc: what each bit becomes."""
    values = np.arange(256)
    return np.array([[np.bitwise_xor.reduce(crc[8 * k : 8 * k + 8][(v >> np.arange(8) & 1) == 1]) for v in values] for k in range(4)], np.uint32)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """What n further bytes of zero make of a checksum, by its bytes: for n under _SHORT, and for _SHORT, 2 * _SHORT, 4 * _SHORT, ..."""
    bits, short, long = np.uint32(1) << np.arange(32, dtype=np.uint32), [], []
    for _ in range(_SHORT):
        short.append(_of_bytes(bits))
        bits = _zero_byte(bits)
    for _ in range(25):
        long.append(_of_bytes(bits))
        bits = _look_up(long[-1], bits)
    return np.array(short), np.array(long)


def _look_up(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0, crc & np.uint32(255)] ^ table[1, crc >> np.uint32(8) & np.uint32(255)] ^ table[2, crc >> np.uint32(16) & np.uint32(255)] ^ table[3, crc >> np.uint32(24)]


_SHORT = 64
_BYTE = np.array([crc32(bytes([b])) ^ crc32(b"\0") for b in range(256)], np.uint32)
_NEAR, _FAR = _tables()
_FLAT = _NEAR.reshape(-1)


def joined_crc(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of left + right from the crc32 of both and the bytes of the right one: a checksum is linear in its bits."""
    at = (size % _SHORT) * 1024
    for k, table in enumerate(_FAR):
        some = np.flatnonzero(size // _SHORT >> k & 1) if k == 0 or (size >= _SHORT << k).any() else ()
        if len(some):
            left = left.copy()
            left[some] = _look_up(table, left[some])
    low = np.uint32(255)
    moved = _FLAT[at + (left & low)] ^ _FLAT[at + 256 + (left >> np.uint32(8) & low)] ^ _FLAT[at + 512 + (left >> np.uint32(16) & low)] ^ _FLAT[at + 768 + (left >> np.uint32(24))]
    return moved ^ right


def _dictionary(block: Block) -> Iterator[tuple[Runs, np.ndarray]]:
    """For each length, the block's runs and the bucket of each distinct one, hashed once, from the checksums of its words."""
    words = block.spelling.cast(pa.binary()).to_pylist()
    crc = np.fromiter(map(crc32, words), np.uint32, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    spaced = np.fromiter((crc32(b" " + w) for w in words), np.uint32, len(words))
    for n, runs in enumerate(block.runs(SIZES), 1):
        of = crc[block.code[runs.one]]
        for k in range(1, n):
            word = block.code[runs.one + k]
            of = joined_crc(of, spaced[word], size[word])
        yield runs, (of % np.uint32(BUCKETS)).astype(np.int64)


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n) of all runs of 1 to SIZES words; each task adds up its own first. texts: (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in pieces(batch, "text", BLOCK):
                for runs, bucket in _dictionary(Block(part.column("text"), SPLIT)):
                    np.add.at(total, bucket, runs.count)
        some = np.flatnonzero(total)
        yield pa.record_batch({"bucket": some.astype(np.int32), "n": total[some]})

    return texts.mapInArrow(count, "bucket int, n long")


def weighed(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row: numbers of words and of runs of 1 to SIZES words, and the sum of the runs' gains. gains: by bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", BLOCK):
                block = Block(part.column("text"), SPLIT)
                n = np.bincount(block.row, minlength=part.num_rows)
                weight = np.zeros(part.num_rows, np.int64)
                for runs, bucket in _dictionary(block):
                    np.add.at(weight, block.row[runs.first], shared.value[bucket][runs.code])
                features = sum(np.maximum(0, n - k) for k in range(SIZES))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "n_words": n, "n_features": features, "weight": weight})

    return docs.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def bucket_gains(own: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of every bucket. own, target: (bucket, n), in any number of rows."""
    spark = own.sparkSession
    s, t = (df.groupBy("bucket").agg(F.sum("n").alias(c)) for df, c in ((own, "s"), (target, "t")))
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    held = every.join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    rows = held.toPandas().sort_values("bucket")  # BUCKETS rows
    s, t = (rows[c].to_numpy(np.int64).astype(float) for c in ("s", "t"))
    ratio = ((t + 1) * (s.sum() + BUCKETS)) / ((s + 1) * (t.sum() + BUCKETS))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def noise(doc_id: Column) -> Column:
    """floor(1000 x) of a Gumbel variable x that the id is the seed of."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def drawn(scored: DataFrame, share: tuple[int, int], least: int, stash: Stash) -> DataFrame:
    """The rows with `rank` from 1 of those that are drawn, by falling score and rising doc_id; null for the others.

    scored: a written table with n_words, score, doc_id. Only rows near the draw are sorted, in ranges over all tasks.
    """
    able = scored.where((F.col("n_words") >= least) & F.col("score").isNotNull())
    count = able.count()
    take = share[0] * count // share[1]
    none = F.lit(None).cast("long")
    if not take:
        return scored.withColumn("rank", none)
    cut = able.agg(F.percentile_approx("score", max(0.0, 1 - 1.2 * share[0] / share[1]), 1000)).first()[0]
    if able.where(F.col("score") >= cut).count() < take:
        cut = able.agg(F.min("score")).first()[0]
    near = (F.col("n_words") >= least) & F.coalesce(F.col("score") >= cut, F.lit(False))
    order = (F.desc("score"), F.asc("doc_id"))
    ranged = scored.where(near).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stash.put(ranged.withColumn("at", F.monotonically_increasing_id()))
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r.part, r["count"]) for r in ranged.groupBy(part.alias("part")).count().collect())  # a row for each task
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    firsts = scored.sparkSession.createDataFrame(before, "part long, before long")
    placed = ranged.withColumn("part", part).join(F.broadcast(firsts), "part").withColumn("place", F.col("before") + within + 1)
    top = placed.select(*scored.columns, F.when(F.col("place") <= take, F.col("place")).alias("rank"))
    return top.unionByName(scored.where(~near).withColumn("rank", none))


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), least: int = 20, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; rank is null for those that aren't drawn.

    Null and empty texts have no feature, weight 0, and are never drawn. A null id has no score and is never drawn.
    Repeated rows count each and are drawn each. Other columns play no part. An empty table gives an empty result; an
    empty target makes every gain that of no target text.
    """
    stash = Stash(docs.sparkSession)
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = target.select(F.col(target_col).cast("string").alias("text"))
    rows = weighed(table, bucket_gains(bucket_counts(table.select("text")), bucket_counts(wanted)))
    scored = stash.put(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"))))
    return drawn(scored, share, least, stash).select("doc_id", "n_features", "weight", "score", "rank")
