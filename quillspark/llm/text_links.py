"""Links between texts, from pairs that may be linked to those that are.

The candidate pairs' components are the groups; a link never leaves its group, so each text is sent to one place only.
Groups of any size are handled: small ones are packed into tasks by their bytes, large ones are cut into blocks. A
first round links the members of each block and the group's first members, the pivots. A second round compares the
members outside a large group's main component with all of its members, so that no link is lost; members of one
component aren't compared again.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.arrays import mix, pieces, shingles, starts, sums, utf8
from quillspark.llm.components import components
from quillspark.llm.groups import runs
from quillspark.llm.signature_tree import Signatures, TokenSets, verified_links
from quillspark.llm.storage import Stash

TASK_BYTES = 4 << 20  #: of texts that one task holds, if no single group has more
BLOCK = 1_000  #: members of one group in a block
PIVOTS = 4
SALTS = 64


def set_marks(rows: np.ndarray, tokens: np.ndarray, count: int) -> np.ndarray:
    """A 64-bit mark of each token set, the same for equal sets."""
    at = starts(rows, count)
    return mix(sums(mix(tokens, 11), at) ^ mix(np.diff(at).astype(np.uint64), 12)).view(np.int64)


def _links(size: int, num: int, den: int, table: pa.Table) -> pa.Table:
    """Verified links of the groups in one task. side 0: members of a block; 1 and 2: the two sides of a comparison."""
    item, text = table.column("item"), table.column("text").combine_chunks()
    ids, first, place = np.unique(np.asarray(item), return_index=True, return_inverse=True)
    rows, tokens = [], []
    batch = pa.record_batch({"text": text.take(pa.array(first))})
    at = 0
    for part in pieces(batch, "text"):
        r, t = shingles(*utf8(part.column("text")), size)
        rows.append(r + at)
        tokens.append(t)
        at += part.num_rows
    sets = TokenSets(np.concatenate(rows), np.concatenate(tokens), len(ids))
    signatures = Signatures(sets.size, sets.bitmaps(), num, den)
    root = np.asarray(table.column("root"))
    label = np.arange(len(ids))
    _, label[place] = np.unique(root, return_inverse=True)
    key, side = np.asarray(table.column("key")), np.asarray(table.column("side"))
    order = np.argsort(key, kind="stable")
    out = []
    for lo, hi in runs(key[order]):
        here = order[lo:hi]
        sides = [np.unique(place[here[side[here] == s]]) for s in (0, 1, 2)]
        if len(sides[0]) > 1:
            out += verified_links(sets, signatures, sides[0], None, label)
        if len(sides[1]) and len(sides[2]):
            out += verified_links(sets, signatures, sides[1], sides[2], label)
    a, b = (ids[[p[k] for p in out]] if out else np.zeros(0, np.int64) for k in (0, 1))
    return pa.table({"a": a, "b": b})


def _own_texts(rows: DataFrame, size: int) -> DataFrame:
    """The rows (item, text) whose text has the item's mark: another row may have the same id and another text."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                marks = set_marks(*shingles(*utf8(part.column("text")), size), part.num_rows)
                yield part.filter(pa.array(marks == np.asarray(part.column("item"))))

    return rows.mapInArrow(check, "item long, text string")


def text_links(candidates: DataFrame, texts: Callable[[DataFrame], DataFrame], size: int, num: int, den: int, stash: Stash) -> DataFrame:
    """(node, root) of all items that are linked: Jaccard similarity of their shingles of `size` words >= num / den.

    candidates: (a, b), pairs of items that have all that are to be linked, or as many as keep these connected. texts:
    gives (item, text) of a table with a column `item`, at least one row for each with the text whose set mark it is.
    """
    members = stash.put(components(candidates, stash).select(F.col("root").alias("key"), F.col("node").alias("item")))
    # The pivots are chosen from the least item of each of SALTS parts of a group, which are aggregated before a shuffle.
    least = members.groupBy("key", F.pmod(F.xxhash64("item"), F.lit(SALTS)).alias("salt")).agg(F.count("*").alias("n"), F.min("item").alias("item"))
    groups = least.groupBy("key").agg(F.sum("n").alias("many"), F.slice(F.sort_array(F.collect_list("item")), 1, PIVOTS).alias("pivots"))
    groups = stash.put(groups)
    large = groups.where(F.col("many") > BLOCK)
    first = large.select("key", F.explode("pivots").alias("item"), "many")
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    placed = members.join(groups.select("key", "many"), "key").select("key", "item", F.when(F.col("many") > BLOCK, F.pmod(F.xxhash64("item", "key"), blocks)).otherwise(F.lit(0).cast("long")).alias("block"), "many")
    spread = first.select("key", "item", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)).alias("block"), "many")
    round_one = placed.unionByName(spread).distinct()
    needed = stash.put(_own_texts(texts(members.select("item")), size))
    total = round_one.join(needed.groupBy("item").agg(F.max(F.octet_length("text")).alias("bytes")), "item").agg(F.sum("bytes")).first()[0] or 0
    tasks = max(1, total // TASK_BYTES)
    task = F.when(F.col("many") > BLOCK, F.xxhash64("key", "block")).otherwise(F.pmod(F.xxhash64("key"), F.lit(tasks)))
    work = round_one.withColumn("task", task).withColumn("side", F.lit(0)).withColumn("root", F.col("item"))
    edges = stash.put(_run(work, needed, size, num, den))
    roots = stash.put(components(edges, stash))
    # Second round: in large groups, what lies outside the main component against all members.
    known = members.join(large.select("key", "many"), "key").join(roots, F.col("item") == F.col("node"), "left").select("key", "item", "many", F.coalesce("root", "item").alias("root"))
    known = stash.put(known)
    main = known.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    rest = known.join(main, "key").where("root <> main").drop("main")
    some = rest.groupBy("key").agg(F.count("*").alias("left"))
    if not some.isEmpty():
        rows, cols = F.ceil(F.col("left") / BLOCK).cast("int"), F.ceil(F.col("many") / BLOCK).cast("int")
        one = rest.join(some, "key").withColumn("i", F.pmod(F.xxhash64("item", "key"), rows).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), cols - 1))).withColumn("side", F.lit(1))
        two = known.join(some, "key").withColumn("j", F.pmod(F.xxhash64("item", "key"), cols).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), rows - 1))).withColumn("side", F.lit(2))
        work = one.unionByName(two, allowMissingColumns=True).withColumn("task", F.xxhash64("key", "i", "j")).select("key", "item", "root", "side", "task")
        more = stash.put(_run(work, needed, size, num, den))
        roots = stash.put(components(edges.unionByName(more), stash))
    stash.drop(needed, known, members, groups)
    return roots


def _run(work: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    rows = work.select("task", "key", "item", "root", "side").join(texts, "item")
    return rows.groupBy("task").applyInArrow(lambda t: _links(size, num, den, t), "a long, b long")


def shared_keys(entries: DataFrame, stash: Stash) -> DataFrame:
    """(key, item) of the keys that several items have; of keys with the same items one is kept. entries: (key, item), distinct."""
    whole = {"many": F.count("*"), "mark": F.bit_xor(F.xxhash64("item")), "other": F.bit_xor(F.xxhash64("item", F.lit(1))), "low": F.min("item"), "high": F.max("item")}
    groups = entries.groupBy("key").agg(*(c.alias(n) for n, c in whole.items())).where("many > 1")
    one = groups.groupBy(*whole).agg(F.min("key").alias("key")).select("key", "many")
    return stash.put(entries.join(one, "key").select("key", "item", "many"))
