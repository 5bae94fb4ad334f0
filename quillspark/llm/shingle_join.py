"""Join of documents by the Jaccard similarity of their word shingles, through signature trees.

Equal shingle sets are one item, with a bitmap of its tokens. Two sets that are similar enough share one of the first
tokens of each, if both are sorted by one order and enough tokens are taken; rare tokens come first, so that few items
meet. Items that share such a token meet in a signature tree of their bitmaps and sizes, whose dual traversal leaves
the candidates. The candidates' texts are compared exactly, again by signature trees within each group.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.arrays import pieces, shingles, starts, utf8, word_hashes
from quillspark.llm.mixing import draw
from quillspark.llm.signature_tree import SMALL, Signatures, bitmap
from quillspark.llm.storage import Stash, as_rows, of_rows
from quillspark.llm.text_links import set_marks, shared_keys, text_links
from quillspark.llm.vector_dedup import all_pairs, stars

SAMPLE = 10_000  #: documents that word frequencies are estimated from; they only order tokens, any order gives the same links
WORDS = 400_000  #: most frequent words of the sample whose frequency is kept
SLOTS = 22  #: bits of the table of frequencies
TASK_BYTES = 1 << 20  #: of bitmaps that one task holds, if no single key has more
BLOCK = 1_000  #: items of one key that one task compares with as many others


def word_rarity(docs: DataFrame, total: int) -> np.ndarray:
    """By the low bits of a word's hash: -16 log2 of its share of a sample's words, the largest where the sample has none."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                word, n = np.unique(word_hashes(*utf8(part.column("text")))[1], return_counts=True)
                yield pa.record_batch({"word": word.view(np.int64), "n": n.astype(np.int64)})

    drawn = docs.where(draw(41, F.col("doc_id")) < SAMPLE / max(1, total) * 2.0**48).select("text")
    found = drawn.mapInArrow(find, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(WORDS).toArrow()
    word, n = (np.asarray(found.column(c)) for c in ("word", "n"))
    share = np.zeros(1 << SLOTS, np.float32)
    np.maximum.at(share, word.view(np.uint64) & np.uint64((1 << SLOTS) - 1), (n / max(1, n.sum())).astype(np.float32))
    least = share[share > 0].min() / 2 if len(n) else 1.0
    np.maximum(share, least, out=share)
    np.log2(share, out=share)
    return np.round(share * np.float32(-16)).astype(np.int16)


def first_tokens(rows: np.ndarray, tokens: np.ndarray, rarity: np.ndarray, at: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of the tokens of which similar sets share one: of n tokens the first n - ceil(n num / den) + 1, rare ones first."""
    order = np.lexsort((tokens, -rarity, rows))
    n = np.diff(at)
    take = n - -(-n * num // den) + 1
    rank = np.arange(len(rows)) - at[rows]
    keep = rank < take[rows]
    return rows[keep], tokens[order][keep]


def _candidates(num: int, den: int, table: pa.Table) -> pa.Table:
    """Pairs that may be linked, of all groups in one task, reduced to edges that connect the same items."""
    ids, first, place = np.unique(np.asarray(table.column("item")), return_index=True, return_inverse=True)
    signatures = Signatures(np.asarray(table.column("n_shingles"))[first], table.column("bits").take(pa.array(first)).to_pylist(), num, den)
    order = np.lexsort((np.asarray(table.column("side")), np.asarray(table.column("j")), np.asarray(table.column("i")), np.asarray(table.column("key"))))
    key, i, j, side = (np.asarray(table.column(c))[order] for c in ("key", "i", "j", "side"))
    new = np.ones(len(order), bool)
    new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(order)))
    within = np.maximum.reduceat(side, begin) == 0
    small = within & (size <= SMALL)
    found = []
    for k in np.array_split(np.flatnonzero(small), max(1, int((size[small] ** 2).sum() // 200_000))):
        a, b = (place[order[x]] for x in all_pairs(begin[k], size[k]))
        keep = signatures.near(a, b)
        found.append((a[keep], b[keep]))
    for k in np.flatnonzero(~small):
        own = place[order[begin[k] : begin[k] + size[k]]]
        if within[k]:
            found.append(signatures.pairs(own))
        else:
            cut = int(np.searchsorted(side[begin[k] : begin[k] + size[k]], 2))
            if 0 < cut < len(own):
                found.append(signatures.pairs(own[:cut], own[cut:]))
    a, b = (np.concatenate(x) for x in zip(*found))
    ends, roots = stars(a, b, ids)
    return pa.table({"a": ends, "b": roots})


def candidate_edges(members: DataFrame, signatures: DataFrame, num: int, den: int, stash: Stash) -> DataFrame:
    """(a, b): edges that connect all items of a key that the signature trees can't keep apart.

    members: (key, item, many); signatures: (item, n_shingles, bits). Keys are packed into tasks by the bytes of their
    bitmaps; a key of more than BLOCK items is cut into blocks, and every pair of blocks is a group of its own.
    """
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int")
    halves = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j"))))
    rows = members.join(signatures, "item")
    volume = rows.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
    tasks = max(1, volume // TASK_BYTES)
    split = rows.withColumn("blocks", blocks).withColumn("own", own).withColumn("p", F.explode(halves)).select("*", "p.*")
    split = split.withColumn("side", F.when(F.col("i") == F.col("j"), 0).when(F.col("own") == F.col("i"), 1).otherwise(2))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("key"), F.lit(tasks))).otherwise(F.xxhash64("key", "i", "j"))
    work = split.select(task.alias("task"), "key", "i", "j", "side", "item", "n_shingles", "bits")
    return stash.put(work.groupBy("task").applyInArrow(lambda t: _candidates(num, den, t), "a long, b long"))


def grouped_rows(docs: DataFrame, stash: Stash, size: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark (hash of the text), n_shingles, root, component of every row. root: the same in one group only; root and component are null for rows that link with nothing by rule."""
    spark = docs.sparkSession
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(word_rarity(table, docs.count()))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                rows, tokens, rarity = shingles(*utf8(part.column("text")), size, lambda h: shared.value[h & np.uint64((1 << SLOTS) - 1)])
                at, marks = starts(rows, part.num_rows), set_marks(rows, tokens, part.num_rows)
                own, first = first_tokens(rows, tokens, rarity, at, num, den)
                lists = pa.ListArray.from_arrays(pa.array(starts(own, part.num_rows).astype(np.int32)), pa.array(first.view(np.int64)))
                bits = [bitmap(tokens[a:b]) for a, b in zip(at[:-1], at[1:])]
                yield pa.record_batch({"doc_id": part.column("doc_id"), "mark": part.column("mark"), "n_shingles": np.diff(at), "item": marks, "first": lists, "bits": pa.array(bits, pa.binary())})

    marked = table.withColumn("mark", F.xxhash64("text"))
    described = stash.put(marked.mapInArrow(describe, "doc_id long, mark long, n_shingles long, item long, first array<long>, bits binary"))
    shared.destroy()
    items = described.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("item").agg(F.min("doc_id").alias("rep"))
    items = stash.put(items)
    one = described.select("doc_id", F.col("item").alias("of"), "n_shingles", "first", "bits")
    chosen = stash.put(items.join(one, (F.col("doc_id") == F.col("rep")) & (F.col("of") == F.col("item"))).select("item", "n_shingles", "first", "bits"))
    members = shared_keys(chosen.select("item", F.explode("first").alias("key")), stash)
    edges = candidate_edges(members, chosen.select("item", "n_shingles", "bits"), num, den, stash)
    stash.drop(members, chosen)

    def texts(wanted: DataFrame) -> DataFrame:
        return table.join(stash.small(wanted.join(items, "item").select("item", "rep")), table.doc_id == F.col("rep")).select("item", "text")

    roots = text_links(edges, texts, size, num, den, stash)
    placed = items.join(roots, items.item == roots.node, "left").select("item", "rep", F.coalesce("root", "item").alias("root"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component"))
    of_item = placed.join(least, "root").select("item", "root", "component")
    out = described.select("doc_id", "mark", "n_shingles", "item").join(of_item, "item", "left")
    own = lambda c: F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col(c)).alias(c)
    return out.select("doc_id", "mark", "n_shingles", own("root"), own("component"))


def join_shingles(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row: rows link if den * |intersection| >= num * |union| of their shingle sets.

    A text with fewer words than `size` has its whole sequence as one shingle; a null text or one without words has
    none and links with nothing. component_id is the smallest id reachable by links. Rows with a null id are their own
    components (null); repeated rows give a row each. An empty table gives an empty result.
    """
    rows = grouped_rows(docs, Stash(docs.sparkSession), size, num, den, id_col, text_col)
    return rows.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each group of linked rows, that of the smallest doc_id (of its texts the one of the smallest hash). Columns of any name stay as they are.

    Rows are told apart by doc_id and text: a row that repeats an id with another text belongs to its own text's
    group. Of rows that repeat both, one stays. Null and empty texts and rows with a null id link with nothing and
    stay, all of them. An empty table gives an empty result.
    """
    stash = Stash(docs.sparkSession)
    rows = stash.put(grouped_rows(docs, stash, size, num, den).where("root IS NOT NULL").select("root", "doc_id", "mark"))
    first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    gone = rows.join(first, "root").where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("mark") != F.col("first.mark")))
    # The columns of the documents travel as one, so that none can clash with those of the decisions.
    whole = as_rows(docs, doc_id=F.col("doc_id").cast("long"), mark=F.xxhash64(F.col("text").cast("string")))
    left = whole.join(stash.small(gone.select("doc_id", "mark").distinct()), ["doc_id", "mark"], "left_anti")
    twice = stash.put(rows.groupBy("doc_id", "mark").count().where("count > 1").select("doc_id", "mark"))
    if not twice.isEmpty():
        one = left.join(twice, ["doc_id", "mark"], "left_semi").groupBy("doc_id", "mark").agg(F.min_by("row", F.to_json("row")).alias("row"))
        left = left.join(twice, ["doc_id", "mark"], "left_anti").select("row").unionByName(one.select("row"))
    return of_rows(left, docs.columns)
