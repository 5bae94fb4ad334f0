"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors, turned to their main axes, are cut into two halves that are quantised separately; a cell is a pair of
centroids. A query goes through the cells by the sum of the two centroid distances with a heap, until the cells hold
the wanted number of vectors. That number is the share of vectors at which a bounded sample's true neighbours are
found with the wanted recall; as neighbours come nearer the more vectors there are, the share falls with their number
as it does from a quarter of the sample to the whole, at half that pace to be safe. Codebooks grow with the number of
vectors too. The entries of the cells are reranked by the cosine of the original vectors.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.groups import runs
from quillspark.llm.storage import Stash
from quillspark.llm.vectors import main_axes, matrix, sample_units, unit, usable, usual_length

SAMPLE = 8_000  #: vectors that centroids and the share to visit are fitted on at most
CENTROIDS = 64, 256  #: of either half, least and most; between them cells hold about PER_CELL vectors
PER_CELL = 2.5
BLOCK = 20_000  #: vectors, and queries, of one task at most


def codebook_size(count: int) -> int:
    return int(min(CENTROIDS[1], max(CENTROIDS[0], (count / PER_CELL) ** 0.5)))


def centroids(x: np.ndarray, count: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(count, len(x)), replace=False)]
    for _ in range(rounds):
        own = nearest_centroid(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(1, n)[:, None], c)
    return c


def nearest_centroid(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)


class MultiIndex:
    """Axes and the two codebooks; `held` (vectors in each cell) is set once all vectors have their cells."""

    def __init__(self, sample: np.ndarray, recall: float, count: int = CENTROIDS[0]):
        axes = main_axes(sample)
        self.axes = np.concatenate([axes[0::2], axes[1::2]]).T  # both halves get as much of the spread
        self.half = (len(axes) + 1) // 2
        y = sample @ self.axes
        self.left, self.right = centroids(y[:, : self.half], count), centroids(y[:, self.half :], count) if len(axes) > 1 else np.zeros((1, 0))
        self.sampled = len(sample)
        self.share = self._share(sample, recall)
        fewer = self._share(sample[::4], recall)
        self.fall = float(np.clip(np.log(max(fewer, 1e-9) / max(self.share, 1e-9)) / np.log(4) / 2, 0, 0.25))

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = x @ self.axes
        return y[:, : self.half], y[:, self.half :]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.halves(x)
        return nearest_centroid(a, self.left), nearest_centroid(b, self.right)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(((h[:, None] - c) ** 2).sum(2) for h, c in zip(self.halves(x), (self.left, self.right)))

    def _share(self, sample: np.ndarray, recall: float, k: int = 5, most: int = 200) -> float:
        """Of the sample, how much must be visited to find the wanted part of all true neighbours."""
        if len(sample) < 20:
            return 1.0
        i, j = self.cells(sample)
        held = np.zeros((len(self.left), len(self.right)), int)
        np.add.at(held, (i, j), 1)
        need = []
        for q in range(0, len(sample), max(1, len(sample) // most)):
            score = sample @ sample[q]
            score[q] = -2
            top = np.argpartition(-score, k)[:k]
            a, b = (d[0] for d in self.distances(sample[q : q + 1]))
            whole = a[:, None] + b[None]
            order = np.argsort(whole, axis=None)
            upto = np.empty(whole.size)
            upto[order] = np.cumsum(held.ravel()[order])
            need.append(upto.reshape(whole.shape)[i[top], j[top]])
        return float(np.quantile(np.concatenate(need), recall)) / len(sample)

    def wanted(self, count: int) -> float:
        """How many of all vectors each query visits."""
        return self.share * count * min(1.0, max(1, self.sampled) / max(1, count)) ** self.fall

    def visited(self, a: np.ndarray, b: np.ndarray, wanted: float) -> np.ndarray:
        """For each row of cells which of its cells to visit, given one query's distances to both codebooks."""
        by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        da, db, held = a[by_a].tolist(), b[by_b].tolist(), self.held[np.ix_(by_a, by_b)].tolist()
        out = np.zeros((len(a), len(b)), bool)
        heap, found, reach = [(da[0] + db[0], 0, 0)], 0, [0] * len(da)  # reach[i]: next free place of row i
        while heap and found < wanted:
            _, i, j = heapq.heappop(heap)
            found += held[i][j]
            out[by_a[i], by_b[j]] = True
            reach[i] = j + 1
            if j + 1 < len(db) and (i == 0 or reach[i - 1] > j + 1):
                heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
            if i + 1 < len(da) and reach[i + 1] == j:
                heapq.heappush(heap, (da[i + 1] + db[j], i + 1, j))
        return out


def _rerank(k: int, queries: pa.Table, entries: pa.Table) -> pa.Table:
    """The k best entries of this block for each query, by exact cosine, ties to the smaller id."""
    kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    if not queries.num_rows or not entries.num_rows:
        return kinds.empty_table()
    entries = entries.sort_by([("cell", "ascending"), ("vec_id", "ascending")])
    cell, ids = np.asarray(entries.column("cell")), np.asarray(entries.column("vec_id"))
    x, names = unit(matrix(entries.column("vector").combine_chunks())), np.asarray(queries.column("query_id"))
    q = unit(matrix(queries.column("vector").combine_chunks()))
    bits = np.frombuffer(b"".join(queries.column("bits").to_pylist()), np.uint8).reshape(len(q), -1)
    spans = [(int(cell[lo]), lo, hi) for lo, hi in runs(cell)]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, 4_000_000 // max(1, len(x)))
    for s in range(0, len(q), step):
        own = np.arange(s, min(s + step, len(q)))
        score = np.full((len(own), len(x)), -np.inf)
        for c, lo, hi in spans:
            here = np.flatnonzero(bits[own, c >> 3] >> (c & 7) & 1)
            if len(here):
                score[here, lo:hi] = q[own[here]] @ x[lo:hi].T
        score[names[own][:, None] == ids[None]] = -np.inf
        least = -np.partition(-score, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(own), -np.inf)
        for r, i in enumerate(own):
            near = np.flatnonzero((score[r] >= least[r] - 1e-9) & (score[r] > -np.inf))
            exact = (x[near] * q[i]).sum(1)
            order = np.lexsort((ids[near], -exact))
            order = order[np.sort(np.unique(ids[near][order], return_index=True)[1])][:k]
            out.append((np.full(len(order), names[i]), ids[near][order], exact[order]))
    return pa.table([np.concatenate([o[c] for o in out]) for c in range(3)], schema=kinds)


def nearest(rows: DataFrame, is_query: Column, k: int = 5, recall: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found by cosine, nearest first, ties to the smaller id.

    is_query: condition on the column `vec_id`. Candidates are all rows of another id. Rows with a null id, and
    vectors that are null, zero, hold null or non-finite components or have another than the usual length take no
    part. Rows that repeat an id count once, by the best score. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    table = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    table = table.where(F.col("vec_id").isNotNull() & usable("vector"))
    dim = usual_length(table, "vector")
    empty = "query_id long, rank int, vec_id long, score double"
    if not dim:
        return spark.createDataFrame([], empty)
    table = table.where(F.size("vector") == dim)
    count = table.count()
    index = MultiIndex(sample_units(table, "vec_id", "vector", SAMPLE, count), recall, codebook_size(count)) if count > 1 else MultiIndex(np.eye(dim), recall)
    shared = spark.sparkContext.broadcast(index)
    kind = dict(table.dtypes)["vector"]

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j = shared.value.cells(unit(matrix(batch.column("vector"))))
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "vector": batch.column("vector"), "line": i.astype(np.int32), "cell": j.astype(np.int32)})

    stash = Stash(spark)
    placed = stash.put(table.mapInArrow(enter, f"vec_id long, vector {kind}, line int, cell int"))
    index.held = np.zeros((len(index.left), len(index.right)), np.int64)
    for r in placed.groupBy("line", "cell").count().collect():
        index.held[r.line, r.cell] = r["count"]
    wanted = max(index.wanted(count), min(count, 200.0 * k))
    shared.destroy()
    shared = spark.sparkContext.broadcast(index)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = shared.value
            for s in range(0, batch.num_rows, 64):
                part = batch.slice(s, 64)
                a, b = index.distances(unit(matrix(part.column("vector"))))
                cells = np.array([index.visited(x, y, wanted) for x, y in zip(a, b)])
                row, line = np.nonzero(cells.any(2))
                bits = np.packbits(cells[row, line], axis=1, bitorder="little")
                taken = part.take(pa.array(row))
                yield pa.record_batch({"query_id": taken.column("vec_id"), "vector": taken.column("vector"), "line": line.astype(np.int32), "bits": pa.array([x.tobytes() for x in bits], pa.binary())})

    queries = placed.where(is_query).select("vec_id", "vector")
    asked = stash.put(queries.mapInArrow(ask, f"query_id long, vector {kind}, line int, bits binary"))
    shared.destroy()
    # A line of cells that many vectors lie in, or many queries visit, is cut into blocks of either; only its own queries and entries are copied.
    visits = np.zeros(len(index.left), np.int64)
    for r in asked.groupBy("line").count().collect():
        visits[r.line] = r["count"]
    splits, turns = (F.element_at(F.array(*(F.lit(int(x)) for x in np.maximum(1, -(-n // BLOCK)))), F.col("line") + 1) for n in (index.held.sum(1), visits))
    of_queries = asked.withColumn("block", F.explode(F.sequence(F.lit(0), splits - 1))).withColumn("turn", F.pmod(F.xxhash64("query_id"), turns).cast("int"))
    of_entries = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), splits).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), turns - 1)))
    found = of_queries.groupBy("line", "block", "turn").cogroup(of_entries.groupBy("line", "block", "turn")).applyInArrow(lambda q, e: _rerank(k, q, e), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
