"""Repeated passages: paragraph MinHash banding, exact verification, clusters by connected components.

Paragraphs (lines) of enough words have MinHash signatures over their shingles. The bands are tuned for recall: with
`rows` hashes in each of `bands` bands, a pair at the threshold t meets in no band with probability (1 - t^rows)^bands.
Paragraphs that meet are verified by exact Jaccard similarity; of each cluster the first occurrence stays. Runs of over
50 words that come again verbatim inside lines, or over several short ones, are found by `repeats`.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from quillspark.llm.arrays import mix, pieces, shingles, starts, utf8, words
from quillspark.llm.repeats import removed_words, verbatim_repeats, without
from quillspark.llm.storage import Stash
from quillspark.llm.text_links import set_marks, text_links

MISS = 1e-3  #: chance that a pair at the threshold shares no band
MIN_WORDS = 40  #: of a paragraph that counts as a passage


def tuned_bands(threshold: float, miss: float = MISS, rows: int = 3) -> int:
    """Bands of `rows` hashes with which a pair at the threshold is missed with a probability of at most `miss`."""
    return int(np.ceil(np.log(miss) / np.log(1 - threshold**rows)))


def band_keys(tokens: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) keys: each band's smallest hashes as one number. No set may be empty."""
    out = np.empty((len(at) - 1, bands), np.uint64)
    for b in range(bands):
        key = np.full(len(at) - 1, b, np.uint64)
        for r in range(rows):
            key = mix(key ^ np.minimum.reduceat(mix(tokens, 100 + b * rows + r), at[:-1]))
        out[:, b] = key
    return out.view(np.int64)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number in the row, where it begins) of all lines; a row has at least one, and offsets of lines can be used like those of texts."""
    cut = np.flatnonzero(data == 10) + 1
    row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, cut - 1, "right") - 1])
    begin = np.concatenate([offsets[:-1], cut])
    order = np.lexsort((np.arange(len(row)), begin, row))
    row, begin = row[order], begin[order]
    return row, np.arange(len(row)) - np.searchsorted(row, row), np.append(begin, offsets[-1])


def passages(docs: DataFrame, size: int, min_words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, para (from 0), n_words, item, keys of each paragraph of at least `min_words` words."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = utf8(part.column("text"))
                row, para, begin = lines(data, offsets)
                _, _, of = words(data, begin)
                n = np.bincount(of, minlength=len(row))
                good = np.flatnonzero(n >= max(size, min_words))
                owner, tokens = shingles(data, begin, size)
                keep = np.isin(owner, good)
                owner, tokens = np.searchsorted(good, owner[keep]), tokens[keep]
                at = starts(owner, len(good))
                keys = band_keys(tokens, at, bands, rows) if len(good) else np.zeros((0, bands), np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(good) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                yield pa.record_batch({"doc_id": part.column("doc_id").take(pa.array(row[good])), "para": para[good], "n_words": n[good], "item": set_marks(owner, tokens, len(good)), "keys": lists})

    return docs.mapInArrow(find, "doc_id long, para long, n_words long, item long, keys array<long>")


def repeated_passages(docs: DataFrame, size: int = 5, threshold: tuple[int, int] = (80, 100), min_words: int = MIN_WORDS, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, para, n_words, cluster_id, first_doc_id, removed of each paragraph that has a near copy.

    Paragraphs are lines (cut at \\n, numbered from 0 within the whole text) of at least `min_words` words. Clusters
    hold paragraphs linked by a Jaccard similarity of their shingles of at least the threshold; the occurrence of the
    smallest (doc_id, para) stays, the others are removed. A paragraph without a near copy has no row. Null texts have
    no paragraph; rows with a null id have no result; rows that repeat an id and a paragraph count each.
    """
    stash = Stash(docs.sparkSession)
    num, den = threshold
    table = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = 3
    found = stash.put(passages(table, size, min_words, tuned_bands(num / den, miss, rows), rows))
    items = stash.put(found.groupBy("item").agg(F.min(F.struct("doc_id", "para")).alias("at"), F.count("*").alias("copies")))
    one = found.select("doc_id", "para", F.col("item").alias("of"), "keys")
    chosen = items.join(one, (F.col("of") == F.col("item")) & (F.col("doc_id") == F.col("at.doc_id")) & (F.col("para") == F.col("at.para")))
    entries = stash.put(chosen.select("item", F.explode("keys").alias("key")))
    first = entries.groupBy("key").agg(F.min("item").alias("b"), F.count("*").alias("many")).where("many > 1").select("key", "b")
    met = stash.put(entries.join(first, "key").where("item <> b").select(F.col("item").alias("a"), "b").distinct())
    stash.drop(entries)

    def texts(wanted: DataFrame) -> DataFrame:
        return table.join(stash.small(wanted.join(items, "item").select("item", "at.*")), "doc_id").select("item", F.element_at(F.split("text", "\n"), (F.col("para") + 1).cast("int")).alias("text"))

    roots = text_links(met, texts, size, num, den, stash)
    placed = items.join(roots, items.item == roots.node, "left").select("item", "at", "copies", F.coalesce("root", "item").alias("cluster_id"))
    clusters = placed.groupBy("cluster_id").agg(F.min("at").alias("first"), F.sum("copies").alias("copies")).where("copies > 1")
    of_item = placed.select("item", "cluster_id").join(clusters, "cluster_id").select("item", "cluster_id", "first")
    out = found.select("doc_id", "para", "n_words", "item").join(of_item, "item")
    first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("para") == F.col("first.para"))
    return out.select("doc_id", "para", "n_words", "cluster_id", F.col("first.doc_id").alias("first_doc_id"), (~first).alias("removed"))


def all_repeats(docs: DataFrame, **options) -> DataFrame:
    """The rows of repeated_passages (lines), and those of verbatim_repeats (passages inside a line or over several).

    para is null for the latter, word (the first word of the passage, from 0 within the text) for the former.
    """
    runs = verbatim_repeats(docs).select("doc_id", F.lit(None).cast("long").alias("para"), "n_words", "cluster_id", "first_doc_id", "removed", "word")
    return repeated_passages(docs, **options).withColumn("word", F.lit(None).cast("long")).unionByName(runs)


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """The documents without the lines that repeated_passages removes and the words that verbatim_repeats removes; n_chars follows, if there is such a column.

    Documents of which nothing is left go; null, empty and short texts stay as they are. Rows that repeat an id lose
    the same lines, but each its own words. An empty table gives an empty result. Columns of any name are kept.
    """
    stash = Stash(docs.sparkSession)
    lines = repeated_passages(docs, **options).where("removed").groupBy("doc_id").agg(F.collect_set("para").alias("gone"))
    spans = removed_words(verbatim_repeats(docs, clusters=False))
    marks = lines.select("doc_id", F.lit(None).cast("long").alias("mark"), "gone", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    marks = marks.unionByName(spans.select("doc_id", "mark", F.lit(None).cast("array<long>").alias("gone"), "spans"))
    both = marks.groupBy("doc_id").agg(F.flatten(F.collect_list("gone")).alias("lines"), F.collect_list(F.when(F.col("mark").isNotNull(), F.struct("mark", "spans"))).alias("words"))
    size = 64 + 8 * F.size("lines") + F.aggregate("words", F.lit(0), lambda n, x: n + 16 + 24 * F.size(x["spans"]))
    # The columns travel as one, so that none can clash with those that are added.
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    marked = whole.join(stash.small(both, size), F.col("row.doc_id") == F.col("doc_id"), "left")
    own = F.filter("words", lambda x: x["mark"] == F.xxhash64("row.text"))
    marked = marked.select("row", "lines", F.transform(F.flatten(F.transform(own, lambda x: x["spans"])), lambda x: F.array(x["start"], x["end"])).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            text, lines, spans = row.field("text").to_pylist(), batch.column("lines").to_pylist(), batch.column("spans").to_pylist()
            hit = [t is not None and bool(g or s) for t, g, s in zip(text, lines, spans)]
            left = [without(t, g or (), s or ()) if h else t for t, g, s, h in zip(text, lines, spans, hit)]
            yield pa.record_batch({"row": row, "left": pa.array(left, pa.string()), "hit": pa.array(hit, pa.bool_())})

    schema = StructType([*marked.select("row").schema.fields, StructField("left", StringType()), StructField("hit", BooleanType())])
    left = marked.mapInArrow(cut, schema).where(~F.col("hit") | F.col("left").rlike(r"\S"))
    new = {"text": F.col("left"), "n_chars": F.when(F.col("hit"), F.length("left").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return left.select(*((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
