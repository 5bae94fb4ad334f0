"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation is learnt so that the signs of the rotated vectors make balanced binary codes with wide margins. The code
is cut into substrings, each the key of a hash table. As the rotation keeps distances, two vectors with cosine >= t
differ by at most 2 - 2t in squared distance, so in one substring by at most that over the number of substrings; the
bits that differ there cost at least the sum of both margins each. If either vector flips those of the differing bits
in which its own margin is the smaller one, both reach the same key, and the flips of either cost at most a quarter
of the bound. So each vector enters every key that it reaches at that cost, and no pair within the threshold is lost.

The keys themselves are never rows. A vector is sent to each table once, as a sketch of some 50 bytes: its margins
there, and other coordinates, both rounded such that only more pairs meet. A task builds its table bit by bit, down to
buckets that are small enough to be compared at once. A table of a label with many vectors is dealt to tasks by the
first bits of its keys. What meets and isn't far apart by its sketches makes candidates: their components are groups
that no link leaves. Only there vectors are compared, each pair once, by the cosine of the original vectors.
"""

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.arrays import gather, mix
from quillspark.llm.components import components
from quillspark.llm.groups import runs
from quillspark.llm.storage import Stash
from quillspark.llm.vectors import main_axes, matrix, sample_units, unit, usable, usual_length

SAMPLE = 10_000  #: vectors that the rotation is learnt from at most
BLOCK = 20_000  #: candidates of one component that one task compares with as many others
TASK = 250_000  #: vectors of one label that one task's table takes, about
SHARED = 50_000  #: vectors of several labels that a task's tables take together, about
LEAF = 512  #: vectors of a bucket that are compared at once
CHECKED = 24  #: coordinates by which the vectors of a bucket are told apart
CHUNK = 20_000  #: vectors whose sketches are written together
SLACK = 1e-9
REACH = 126**2  #: squared margins that a vector can flip, in the unit of a sketch
SKETCHES = "task long, part int, bits int, prefix int, rep binary, label binary, near binary, check binary"


class Codes:
    """Rotation, thresholds and substrings."""

    def __init__(self, sample: np.ndarray, threshold: float, rounds: int = 30, seed: int = 5):
        dim = sample.shape[1]
        self.bits = min(64, dim)
        self.parts = max(1, round(self.bits / 16))
        self.budget = (2 - 2 * threshold + SLACK) / self.parts
        centre = sample.mean(0)
        main = main_axes(sample - centre)[: self.bits].T
        v = (sample - centre) @ main
        r, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((self.bits, self.bits)))
        for _ in range(rounds):
            a, _, b = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (a @ b).T
        self.turn = main @ r
        p = sample @ self.turn
        # Between the 40 and 60 % quantiles, the threshold with the fewest vectors near it.
        tries = np.quantile(p, np.linspace(0.4, 0.6, 9), axis=0)
        width = np.sqrt(self.budget) / 2
        near = np.array([(np.abs(p - t) < width).sum(0) for t in tries])
        self.level = tries[near.argmin(0), np.arange(self.bits)]
        self.spans = [(k * self.bits // self.parts, (k + 1) * self.bits // self.parts) for k in range(self.parts)]
        # Margins are rounded towards 0, which only makes flips cheaper; those that can't be flipped are cut.
        self.unit = width * (1 + 1e-6) / np.sqrt(REACH)
        # Other coordinates are rounded by half of 1/127 at most, each; the other substrings' come first.
        self.checked = [np.r_[0:lo, hi : self.bits, lo:hi][:CHECKED] for lo, hi in self.spans]
        self.far = (127 * np.sqrt(2 - 2 * threshold + SLACK) + np.sqrt(min(CHECKED, self.bits))) ** 2

    def sketches(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each substring, margins and coordinates to check by, in whole numbers."""
        p = x @ self.turn
        for (lo, hi), own in zip(self.spans, self.checked):
            margins = (p[:, lo:hi] - self.level[lo:hi]) / self.unit
            yield np.trunc(np.clip(margins, -127, 127)).astype(np.int8), np.rint(np.clip(p[:, own], -1, 1) * 127).astype(np.int8)


def reached(near: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, first bits of the key) of all beginnings of keys that each vector enters."""
    place, spent = np.arange(len(near)), np.zeros(len(near), np.int64)
    code = ((near[:, :bits] >= 0) << np.arange(bits)).sum(1)
    for bit in range(bits):
        more = np.flatnonzero(spent + near[place, bit].astype(np.int64) ** 2 <= REACH)
        place, spent, code = (np.concatenate([x, y]) for x, y in ((place, place[more]), (spent, spent[more] + near[place[more], bit].astype(np.int64) ** 2), (code, code[more] ^ 1 << bit)))
    return place, code


class Places:
    """Which task holds the table of a substring, a label and the first bits of a key: of a large label by itself."""

    def __init__(self, large: dict[int, int], rest: int, parts: int, width: int):
        self.labels = np.array(sorted(large), np.int64)
        self.bits = np.array([min(width, max(0, int(np.ceil(np.log2(large[x] / TASK))))) for x in self.labels.tolist()], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(parts << self.bits)]).astype(np.int64)
        self.shared = max(1, -(-rest // SHARED))
        self.count = int(self.begin[-1]) + self.shared * parts

    def find(self, part: int, label: np.ndarray, near: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(task, bits, first bits of the key, positions)."""
        at = np.searchsorted(self.labels, label)
        own = at < len(self.labels)
        own[own] = self.labels[at[own]] == label[own]
        other = np.flatnonzero(~own)
        task = self.begin[-1] + part * self.shared + (mix(label[other].astype(np.uint64)) % np.uint64(self.shared)).astype(np.int64)
        order = np.argsort(task, kind="stable")
        yield from ((int(task[order[lo]]), 0, 0, other[order[lo:hi]]) for lo, hi in runs(task[order]))
        large = np.flatnonzero(own)
        large = large[np.argsort(at[large], kind="stable")]
        for lo, hi in runs(at[large]):
            rows, k = large[lo:hi], int(at[large[lo]])
            bits = int(self.bits[k])
            place, code = reached(near[rows], bits)
            order = np.argsort(code, kind="stable")
            for b, e in runs(code[order]):
                prefix = int(code[order[b]])
                yield int(self.begin[k]) + (part << bits) + prefix, bits, prefix, rows[place[order[b:e]]]


def lowest(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    """The smallest of `count` positions that is connected with each of them by the edges (a, b)."""
    low = np.arange(count)
    while True:
        x, y = low[a], low[b]
        new = np.flatnonzero(x != y)
        if not len(new):
            return low
        a, b, x, y = a[new], b[new], x[new], y[new]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low != (up := low[low])).any():
            low = up


class Buckets:
    """Connects the vectors of one task's table that may be linked."""

    def __init__(self, codes: Codes, near: np.ndarray, check: np.ndarray):
        self.cost = np.ascontiguousarray((near.astype(np.int16) ** 2).T)
        self.positive = np.ascontiguousarray((near >= 0).T)
        self.check, self.least = check, np.float32(-codes.far / 2)
        self.half = -np.square(check, dtype=np.int32).sum(1) / np.float32(2)
        self.low = np.arange(len(near))
        self.edges, self.waiting = [], 0

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the positions a and b aren't far apart. All sums are whole or half numbers below 2^23, so exact."""
        w = self.check.shape[1]
        left, right = np.ones((len(a), w + 2), np.float32), np.ones((len(b), w + 2), np.float32)
        left[:, :w], left[:, w], right[:, :w], right[:, w + 1] = self.check[a], self.half[a], self.check[b], self.half[b]
        return left @ right.T >= self.least

    def connect(self, a: np.ndarray, b: np.ndarray) -> None:
        self.edges.append((a, b))
        self.waiting += len(a)
        if self.waiting > 200_000:
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            a, b = (np.concatenate(x) for x in zip(*self.edges))
            self.low = lowest(self.low[a], self.low[b], len(self.low))[self.low]
            self.edges, self.waiting = [], 0

    def compare(self, at: np.ndarray) -> None:
        """All pairs of a bucket; most have none near."""
        for s in range(0, len(at), LEAF):
            own, rest = at[s : s + LEAF], at[s:]
            found = self.near(own, rest)
            if np.count_nonzero(found) > len(own):
                low = lowest(*np.divmod(np.flatnonzero(found), len(rest)), len(rest))
                moved = np.flatnonzero(low != np.arange(len(rest)))
                self.connect(rest[moved], rest[low[moved]])

    def strip(self, at: np.ndarray, spent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is left of a large bucket without its dense heaps, each connected with what is near any of its vectors.

        What is near a heap's middle is one component. What is farther from the middle than twice that far is near
        none of the heap's vectors; what lies between is compared with them until one is near.
        """
        while len(at) > LEAF:
            some = at[:: max(1, len(at) // 64)][:64]
            count = self.near(some, some).sum(1)
            if count.max() < 8:
                break
            middle = some[count.argmax() :][:1]
            squared = np.square(self.check[at].astype(np.int32) - self.check[middle].astype(np.int32)).sum(1)
            heap = squared <= -2 * self.least
            members, ring = at[heap], at[~heap & (squared <= -8 * self.least)]
            self.connect(np.repeat(middle, len(members)), members)
            for r in range(0, len(ring), 512):
                wait = ring[r : r + 512]
                for m in range(0, len(members), 4096):
                    hit = self.near(wait, members[m : m + 4096]).any(1)
                    self.connect(np.repeat(middle, hit.sum()), wait[hit])
                    wait = wait[~hit]
                    if not len(wait):
                        break
            at, spent = at[~heap], spent[~heap]
        return at, spent

    def search(self, at: np.ndarray, bits: int, prefix: int) -> None:
        """All buckets of the keys that begin with the prefix."""
        spent = np.zeros(len(at), np.int32)
        for bit in range(bits):
            spent += np.where(self.positive[bit, at] == (prefix >> bit & 1), 0, self.cost[bit, at])
        stack = [(at, spent, bits)]
        while stack:
            at, spent, bit = stack.pop()
            at, spent = self.strip(at, spent)
            if len(at) < 2:
                continue
            if len(at) <= LEAF or bit == len(self.cost):
                self.compare(at)
                continue
            cost, positive = self.cost[bit][at], self.positive[bit][at]
            both = spent + cost <= REACH
            for side in (positive, ~positive):
                keep = np.flatnonzero(side | both)
                stack.append((at[keep], spent[keep] + np.where(side[keep], 0, cost[keep]), bit + 1))


def _candidates(codes: Codes, table: pa.Table) -> pa.Table:
    """(a, b): edges that connect all vectors of one task's table that may be linked."""
    part, bits, prefix = (table.column(c)[0].as_py() for c in ("part", "bits", "prefix"))
    ids, label, near, check = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("rep", np.int64), ("label", np.int64), ("near", np.int8), ("check", np.int8)))
    order = np.argsort(label, kind="stable")
    buckets = Buckets(codes, near.reshape(len(ids), -1)[order], check.reshape(len(ids), -1)[order])
    for lo, hi in runs(label[order]):
        if hi - lo > 1:
            buckets.search(np.arange(lo, hi), bits, prefix)
    buckets.settle()
    ids = ids[order]
    moved = np.flatnonzero(ids != ids[buckets.low])
    return pa.table({"a": ids[moved], "b": ids[buckets.low[moved]]})


def all_pairs(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of positions within each run."""
    own = gather(begin, size)
    later = np.repeat(begin + size, size) - own - 1
    return np.repeat(own, later), gather(own + 1, later)


def stars(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each member to the smallest id of its component, given linked pairs of positions."""
    low = ids.copy()
    while True:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        if (new == low).all():
            break
        low = new
    own = np.unique(np.concatenate([a, b]))
    own = own[ids[own] != low[own]]
    return ids[own], low[own]


def _compare(threshold: float, rows: pa.Table) -> pa.Table:
    """Links within groups of candidates: (a, a, links), and (a, b, 0) for components."""
    rows = rows.sort_by([("label", "ascending"), ("root", "ascending"), ("side", "ascending")])
    label, root, side, ids, weight = (np.asarray(rows.column(c)) for c in ("label", "root", "side", "rep", "copies"))
    x = unit(matrix(rows.column("vector").combine_chunks()))
    cut = np.flatnonzero((label[1:] != label[:-1]) | (root[1:] != root[:-1])) + 1
    begin = np.concatenate([[0], cut])
    size = np.diff(np.concatenate([begin, [len(ids)]]))
    links, low, weight = np.zeros(len(ids)), np.arange(len(ids)), weight.astype(float)
    repeated = len(np.unique(ids)) < len(ids)
    short, error = x.astype(np.float32), (x.shape[1] + 8) * 2.0**-23  # single precision tells all but the pairs close to the threshold

    def exactly(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (x[i] * x[j]).sum(1) >= threshold

    within = np.maximum.reduceat(side, begin) == 0  # else side 1 and side 2 are the two blocks of a pair of blocks
    small = within & (size <= 64)
    for k in np.array_split(np.flatnonzero(small), max(1, int((size[small] ** 2).sum() // 100_000))):
        i, j = all_pairs(begin[k], size[k])
        good = exactly(i, j) & (ids[i] != ids[j])
        i, j = i[good], j[good]
        links += np.bincount(i, weights=weight[j], minlength=len(ids)) + np.bincount(j, weights=weight[i], minlength=len(ids))
        low = lowest(low[i], low[j], len(ids))[low]
    for k in np.flatnonzero(~small):
        lo, hi = begin[k], begin[k] + size[k]
        cut = hi if within[k] else lo + int(np.searchsorted(side[lo:hi], 2))
        right = slice(lo, hi) if within[k] else slice(cut, hi)
        for s, t in itertools.product(range(lo, cut, 256), range(right.start, hi, 2048)):
            a, b = slice(s, min(s + 256, cut)), slice(t, min(t + 2048, hi))
            score = short[a] @ short[b].T
            linked = score >= threshold + error
            for at in np.array_split(close := np.flatnonzero((score >= threshold - error) != linked), max(1, len(close) // 50_000)):
                linked.ravel()[at] = exactly(at // linked.shape[1] + s, at % linked.shape[1] + t)
            if repeated or s < b.stop and t < a.stop:
                linked &= ids[a, None] != ids[None, b]
            each = linked.astype(float)
            links[a] += each @ weight[b]
            if not within[k]:
                links[b] += weight[a] @ each
            if (low[a] != low[s]).any() or (low[b] != low[s]).any():
                i, j = np.divmod(np.flatnonzero(linked & (low[a, None] != low[None, b])), linked.shape[1])
                low = lowest(low[i + s], low[j + t], len(ids))[low]
    some, moved = np.flatnonzero(links), np.flatnonzero(ids != ids[low])
    return pa.table({"a": np.concatenate([ids[some], ids[moved]]), "b": np.concatenate([ids[some], ids[low[moved]]]), "links": np.concatenate([links[some].astype(np.int64), np.zeros(len(moved), np.int64)])})


def linked_vectors(rows: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row: vectors of equal label and cosine >= threshold are linked.

    A null label, a vector that is null, zero or holds null or non-finite components, or one of another than the
    usual length links with nothing. Equal vectors are compared once, as one with a count. Rows with a null id are
    their own components. An empty table gives an empty result; other columns aren't read.
    """
    spark = rows.sparkSession
    stash = Stash(spark)
    table = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).cast("long").alias("label"))
    good = table.where(usable("vector") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    dim = usual_length(good, "vector")
    good = good.where(F.size("vector") == dim)
    if not dim:
        return table.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    marks = (F.xxhash64("vector").alias("mark"), F.xxhash64(F.lit(1), "vector").alias("mark2"))  # 128 bits stand for a vector where rows find their link again
    reps = stash.put(good.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).select("*", *marks))
    count = reps.count()
    sample = sample_units(reps, "rep", "vector", SAMPLE, count)
    coded = Codes(sample if len(sample) else np.eye(dim), threshold)
    large = {r.label: r["count"] for r in reps.groupBy("label").count().where(F.col("count") > SHARED).collect()}
    placed = Places(large, count - sum(large.values()), coded.parts, min(b - a for a, b in coded.spans))
    codes, places = spark.sparkContext.broadcast(coded), spark.sparkContext.broadcast(placed)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in itertools.chain(batches, [None]):
            if held and (batch is None or sum(b.num_rows for b in held) >= CHUNK):
                table, held = pa.Table.from_batches(held), []
                rep, label = (np.asarray(table.column(c)) for c in ("rep", "label"))
                for part, (near, check) in enumerate(codes.value.sketches(unit(matrix(table.column("vector").combine_chunks())))):
                    for task, bits, prefix, at in places.value.find(part, label, near):
                        yield pa.record_batch({"task": pa.array([task]), "part": pa.array([part], pa.int32()), "bits": pa.array([bits], pa.int32()), "prefix": pa.array([prefix], pa.int32())} | {c: pa.array([v[at].tobytes()], pa.binary()) for c, v in (("rep", rep), ("label", label), ("near", near), ("check", check))})
            if batch is not None:
                held.append(batch)

    sketches = reps.select("rep", "label", "vector").mapInArrow(enter, SKETCHES).repartition(min(2_000, placed.count), "task")
    found = stash.put(sketches.groupBy("task").applyInArrow(lambda t: _candidates(codes.value, t), "a long, b long"))
    groups = components(found, stash)
    # A group with many members is cut into blocks, and every pair of blocks is a group of its own.
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    groups = stash.put(groups.join(groups.groupBy("root").agg(F.count("*").alias("members")), "root").select(F.col("node").alias("rep"), "root", blocks.alias("blocks")))
    tasks = max(1, groups.count() // 20_000)
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    halves = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j"))))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("label", "root"), F.lit(tasks))).otherwise(F.xxhash64("label", "root", "pair"))
    work = reps.join(groups, "rep").withColumn("own", own).withColumn("pair", F.explode(halves)).withColumn("side", F.when(F.col("pair.i") == F.col("pair.j"), 0).when(F.col("own") == F.col("pair.i"), 1).otherwise(2))
    work = work.select(task.alias("task"), "label", "root", "side", "rep", "copies", "vector")
    linked = stash.put(work.groupBy("task").applyInArrow(lambda t: _compare(threshold, t), "a long, b long, links long"))
    totals = linked.where("a = b").groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(linked.where("a <> b"), stash)
    stash.drop(found, groups)
    n = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    known = reps.drop("vector").join(totals, reps.rep == totals.a, "left").join(roots, F.col("rep") == F.col("node"), "left").where(n > 0)
    known = known.select(F.col("label").alias("of_label"), F.col("mark").alias("of_mark"), F.col("mark2").alias("of_mark2"), n.alias("n"), F.coalesce("root", "rep").alias("component"))
    rows = table.select("vec_id", "label", *(F.when(usable("vector") & (F.size("vector") == dim) & F.col("vec_id").isNotNull(), m).alias(c) for m, c in zip(marks, ("mark", "mark2"))))
    joined = rows.join(known, (F.col("label") == F.col("of_label")) & (F.col("mark") == F.col("of_mark")) & (F.col("mark2") == F.col("of_mark2")), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
