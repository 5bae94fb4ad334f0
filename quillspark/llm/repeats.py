"""Paragraphs that content cuts out, wherever they stand: inside a line or over several, and their repeats over LONG words.

Line breaks say little about what was copied, so paragraphs of WORDS words begin at anchors that the words themselves
choose: of each GAP runs of GRAM words in a row, the one with the smallest hash, the MinHash of that window. Two texts
that share LONG words in a row share such a window, so they choose the same anchor in it and hold the same paragraph.
Paragraphs that stand at one place only go. Neighbouring ones that come again are a chain; chains of LONG words and more
are passages. Shorter ones count if one of the windows of LONG words around them comes again, which is compared exactly.
Chains that share a paragraph are one cluster, by connected components.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.arrays import mix, pieces, utf8, word_hashes, words
from quillspark.llm.components import components
from quillspark.llm.storage import Stash

LONG = 51  #: words that repeat, at least
WORDS = 32  #: of a paragraph
GAP = LONG - WORDS + 1  #: anchors are at most so many words apart
GRAM = 5
HOT = 2_000  #: a key that more than one in so many paragraphs have is joined without a shuffle; fewer than HOT keys can be
_GRAM_BASE, _TEXT_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_PLACE = ("doc_id", "mark", "word")


class Polynomial:
    """Hashes of any run of words in constant time."""

    def __init__(self, h: np.ndarray, base: int):
        power = np.cumprod(np.full(len(h), base, np.uint64))
        self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power)])
        self.back = np.cumprod(np.full(len(h) + 1, pow(base, -1, 1 << 64), np.uint64))

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.back[start] ^ mix((end - start).astype(np.uint64)))


def anchors(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """First words of the paragraphs. row, h: row and hash of each word; rows shorter than the window have none."""
    count = len(h) - GRAM + 1
    if count < GAP:
        return np.zeros(0, np.int64)
    begin = np.arange(count)
    low, where, size = Polynomial(h, _GRAM_BASE).runs(begin, begin + GRAM), begin, 1
    while size < GAP:  # the first of equal ones
        step = min(size, GAP - size)
        later = low[step:] < low[:-step]
        low, where, size = np.where(later, low[step:], low[:-step]), np.where(later, where[step:], where[:-step]), size + step
    inside = row[: len(where)] == row[GAP + GRAM - 2 :]
    chosen = np.zeros(count, bool)
    chosen[where[inside]] = True
    at = np.flatnonzero(chosen)
    at = at[at + WORDS <= len(h)]
    return at[row[at] == row[at + WORDS - 1]]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _paragraphs(table: DataFrame) -> DataFrame:
    """doc_id, mark, word, key, around (a mark of the paragraph with the words that a window of LONG words may reach) of each paragraph."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                row, h = word_hashes(*utf8(part.column("text")))
                at = anchors(row, h)
                of, hashes = row[at], Polynomial(h, _TEXT_BASE)
                begin, end = np.searchsorted(row, of), np.searchsorted(row, of, "right")
                lo, hi = np.maximum(begin, at - GAP + 1), np.minimum(end, at + LONG)
                around = hashes.runs(lo, hi) ^ mix((at - lo).astype(np.uint64))
                yield pa.record_batch({"doc_id": part.column("doc_id").take(pa.array(of)), "mark": part.column("mark").take(pa.array(of)), "word": at - begin, "key": hashes.runs(at, at + WORDS).view(np.int64), "around": around.view(np.int64)})

    return table.mapInArrow(find, "doc_id long, mark long, word long, key long, around long")


def _at_places(table: DataFrame, wanted: DataFrame, stash: Stash) -> DataFrame:
    """The texts in which wanted places (doc_id, mark, word, key, around, many) lie, each with the list of them."""
    lists = wanted.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("word", "key", "around", "many")).alias("places"))
    lists = stash.small(lists, 64 + 40 * F.size("places"))
    # Where the lists are too large to broadcast, their ids mostly aren't: then only these texts are shuffled.
    ids = stash.small(lists.select("doc_id").distinct())
    return table.join(ids, "doc_id", "left_semi").join(lists, ["doc_id", "mark"]).select("doc_id", "mark", "text", "places")


def _windows(texts: DataFrame) -> DataFrame:
    """key, around, many, doc_id, mark, word, shift, window: the marks of the windows of LONG words that hold a place's paragraph; shift: first word of the window, from the paragraph's."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                row, h = word_hashes(*utf8(part.column("text")))
                places, hashes = part.column("places"), Polynomial(h, _TEXT_BASE)
                of = np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(places)))
                word, key, around, many = (np.asarray(places.flatten().field(k)) for k in range(4))
                begin, end = np.searchsorted(row, of), np.searchsorted(row, of, "right")
                shift = np.tile(np.arange(1 - GAP, 1), len(of))
                which = np.repeat(np.arange(len(of)), GAP)
                start = begin[which] + word[which] + shift
                good = (start >= begin[which]) & (start + LONG <= end[which])
                which, shift, start = which[good], shift[good], start[good]
                doc, mark = (part.column(c).take(pa.array(of[which])) for c in ("doc_id", "mark"))
                yield pa.record_batch({"key": key[which], "around": around[which], "many": many[which], "doc_id": doc, "mark": mark, "word": word[which] + shift, "shift": shift, "window": hashes.runs(start, start + LONG).view(np.int64)})

    return texts.mapInArrow(find, "key long, around long, many long, doc_id long, mark long, word long, shift long, window long")


def _contexts(texts: DataFrame) -> DataFrame:
    """doc_id, mark, word, key, left, right: 32-bit hashes of up to GAP - 1 words before (nearest first) and after each place's paragraph."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                row, h = word_hashes(*utf8(part.column("text")))
                cut, h = np.searchsorted(row, np.arange(part.num_rows + 1)), h.astype("<u4")
                places = part.column("places")
                of = np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(places)))
                word, key = (np.asarray(places.flatten().field(k)) for k in range(2))
                left, right = [], []
                for i, w in zip(of.tolist(), word.tolist()):
                    at = cut[i] + w
                    left.append(h[max(cut[i], at - GAP + 1) : at][::-1].tobytes())
                    right.append(h[at + WORDS : min(cut[i + 1], at + LONG - 1)].tobytes())
                yield pa.record_batch({"doc_id": part.column("doc_id").take(pa.array(of)), "mark": part.column("mark").take(pa.array(of)), "word": word, "key": key, "left": pa.array(left, pa.binary()), "right": pa.array(right, pa.binary())})

    return texts.mapInArrow(find, "doc_id long, mark long, word long, key long, left binary, right binary")


def _reach(pairs: DataFrame) -> DataFrame:
    """The rows with `more`: how many words of left (or right) are those of its source."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = []
            for one, two in zip(batch.column("own").to_pylist(), batch.column("source").to_pylist()):
                a, b = np.frombuffer(one, "<u4"), np.frombuffer(two, "<u4")
                n = min(len(a), len(b))
                more.append(int(np.append(a[:n] != b[:n], True).argmax()))
            yield pa.record_batch({c: batch.column(c) for c in ("doc_id", "mark", "word", "side")} | {"more": pa.array(more, pa.int64())})

    return pairs.mapInArrow(find, "doc_id long, mark long, word long, side int, more long")


def _with_keys(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows with the columns of keys (the columns of `on`, `many`, and others; a row or two for each), whatever share of the rows one key has.

    many: paragraphs that have the key, of `total` in all. Keys of more than total / HOT are broadcast: as each paragraph
    has one key, there are fewer than HOT. The others are shuffled, and no task gets more rows of one of them than that.
    """
    hot = F.col("many") * HOT > total
    common = keys.where(hot)
    others = rows.join(F.broadcast(common.select(*on)), on, "left_anti").join(keys.where(~hot).drop("many"), on)
    return rows.join(F.broadcast(common.drop("many")), on).unionByName(others)


def _chains(table: DataFrame, stash: Stash) -> tuple[DataFrame, int]:
    """The paragraphs that come again, and how many there are of any kind.

    doc_id, mark, word, key, around, chain (its first word), last (first word of its last paragraph), first (the key's
    smallest place), many (places of the key).
    """
    found = stash.put(_paragraphs(table))
    total = found.count()
    again = found.groupBy("key").agg(F.count("*").alias("many"), F.min(F.struct(*_PLACE)).alias("first")).where("many > 1")
    again = stash.put(again.withColumn("places", F.col("many")))
    entries = _with_keys(found, again, ["key"], total).withColumnRenamed("places", "many")
    order = Window.partitionBy("doc_id", "mark").orderBy("word")
    new = F.coalesce(F.col("word") - F.lag("word").over(order) > GAP, F.lit(True))
    chained = entries.withColumn("chain", F.last(F.when(new, F.col("word")), True).over(order))
    out = stash.put(chained.withColumn("last", F.max("word").over(Window.partitionBy("doc_id", "mark", "chain"))))
    stash.drop(found, again)
    return out, total


def _around_short(table: DataFrame, chained: DataFrame, total: int, stash: Stash) -> DataFrame:
    """doc_id, mark, chain, start, end, first of the runs of LONG words and more around the paragraphs of short chains that come again."""
    short = chained.where(F.col("last") - F.col("chain") + WORDS < LONG).groupBy("key").agg(F.max("many").alias("many"))
    short = stash.put(short)
    own = stash.put(_with_keys(chained.select(*_PLACE, "key", "around", "chain"), short, ["key"], total))
    one = stash.put(own.groupBy("key", "around").agg(F.count("*").alias("many"), F.min(F.struct(*_PLACE)).alias("at")))
    windows = stash.put(_windows(_at_places(table, one.select("at.*", "key", "around", "many"), stash)))
    place = F.struct(*_PLACE)
    several = (F.max("many") > 1) | (F.min(place) != F.max(place))  # a text that repeats itself may have one window around several paragraphs
    again = windows.groupBy("key", "window").agg(several.alias("several"), F.min(place).alias("first")).where("several").select("key", "window", "first")
    held = windows.select("key", "window", "around", "many", "shift").join(again, ["key", "window"])
    # The first and the last window that come again cover all between them.
    runs = held.groupBy("key", "around").agg(*(f(F.struct("shift", "first")).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"))), F.max("many").alias("many"))
    runs = stash.put(runs.select("key", "around", "many", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x")).select("key", "around", "many", "x.*"))
    start = F.col("word") + F.col("shift")
    out = stash.put(_with_keys(own, runs, ["key", "around"], total).select("doc_id", "mark", "chain", start.alias("start"), (start + LONG).alias("end"), "first"))
    stash.drop(own, one, windows, short, runs)
    return out


def _ends(table: DataFrame, chained: DataFrame, total: int, stash: Stash) -> DataFrame:
    """doc_id, mark, word, side, more: by how many words the first (side 0) and last (1) paragraph of a long chain reaches on like its source."""
    long = chained.where(F.col("last") - F.col("chain") + WORDS >= LONG)
    elsewhere = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("mark") != F.col("first.mark")) | (F.col("word") != F.col("first.word"))
    ends = long.where(elsewhere & ((F.col("word") == F.col("chain")) | (F.col("word") == F.col("last")))).select(*_PLACE, "key", "chain", "last", "first", "many")
    ends = stash.put(ends)
    wanted = ends.select(*_PLACE, "key").unionByName(ends.select("first.*", "key")).distinct()
    context = stash.put(_contexts(_at_places(table, wanted.withColumn("around", F.lit(0).cast("long")).withColumn("many", F.lit(1).cast("long")), stash)))
    source = ends.select("key", "many", "first.*").distinct().join(context, ["key", *_PLACE]).select("key", "many", F.struct("left", "right").alias("of"))
    source = stash.put(source)
    own = ends.select(*_PLACE, "key", "chain", "last").join(context, ["key", *_PLACE])
    sides = F.array(*(F.struct(F.lit(k).alias("side"), (F.col("word") == F.col(c)).alias("ends"), F.col(s).alias("own"), F.col(f"of.{s}").alias("source")) for k, c, s in ((0, "chain", "left"), (1, "last", "right"))))
    pairs = _with_keys(own, source, ["key"], total).select(*_PLACE, F.explode(sides).alias("x")).select(*_PLACE, "x.*").where("ends")
    out = stash.put(_reach(pairs.select(*_PLACE, "side", "own", "source")))
    stash.drop(ends, context, source)
    return out


def _clusters(chained: DataFrame, total: int, stash: Stash) -> DataFrame:
    """doc_id, mark, chain, cluster_id: chains that share a paragraph are in one cluster."""
    name = F.xxhash64("doc_id", "mark", "chain")
    least = stash.put(chained.groupBy("key").agg(F.min(name).alias("b"), F.max("many").alias("many")))
    edges = stash.put(_with_keys(chained.drop("many"), least, ["key"], total).select(name.alias("a"), "b").where("a <> b").distinct())
    roots = components(edges, stash)
    names = chained.select("doc_id", "mark", "chain", name.alias("name")).distinct()
    out = names.join(roots, F.col("name") == F.col("node"), "left").select("doc_id", "mark", "chain", F.coalesce("root", "name").alias("cluster_id"))
    return stash.put(out)


def verbatim_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", clusters: bool = True) -> DataFrame:
    """doc_id, mark, word, n_words, first_doc_id, first_mark, first_word, removed, cluster_id of each passage that comes again.

    Words are lower-cased and what stands between two blanks; word counts them from 0 within the text. mark is the
    xxhash64 of the text, and tells rows apart that repeat an id. Every run of LONG words that several places have lies
    in a row. Of each paragraph the smallest (doc_id, mark, word) stays, the other places are removed; a chain of which
    both happens has a row for each part. Each word of a row stands in a paragraph that comes again, or reaches on from
    one like its source. A text that repeats itself keeps the first LONG words. Rows with a null id have no result;
    equal rows have one and the same. Null, empty and short texts and an empty table give no rows. cluster_id is null
    unless `clusters`.
    """
    stash = Stash(docs.sparkSession)
    table = _texts(docs, id_col, text_col)
    chained, total = _chains(table, stash)
    shorts = _around_short(table, chained, total, stash)
    ends = _ends(table, chained, total, stash)
    reach = [ends.where(f"side = {k}").select(*_PLACE, F.col("more").alias(n)) for k, n in ((0, "before"), (1, "after"))]
    long = chained.where(F.col("last") - F.col("chain") + WORDS >= LONG).join(reach[0], [*_PLACE], "left").join(reach[1], [*_PLACE], "left")
    before = F.coalesce("before", F.lit(0))
    long = long.select("doc_id", "mark", "chain", (F.col("word") - before).alias("start"), (F.col("word") + WORDS + F.coalesce("after", F.lit(0))).alias("end"), F.struct("first.doc_id", "first.mark", (F.col("first.word") - before).alias("word")).alias("first"))
    own = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
    parts = long.unionByName(shorts).withColumn("removed", ~own | (F.col("start") != F.col("first.word")))
    parts = parts.withColumn("start", F.when(F.col("removed") & own, F.greatest("start", F.col("first.word") + LONG)).otherwise(F.col("start"))).where("start < end")
    order = Window.partitionBy("doc_id", "mark", "removed").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = parts.withColumn("run", F.sum(F.when(F.col("start") <= reached, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("doc_id", "mark", "removed", "run").agg(F.min("start").alias("word"), (F.max("end") - F.min("start")).alias("n_words"), F.min("first").alias("first"), F.min("chain").alias("chain"))
    if clusters:
        runs = runs.join(_clusters(chained, total, stash), ["doc_id", "mark", "chain"])
    else:
        runs = runs.withColumn("cluster_id", F.lit(None).cast("long"))
    return runs.select("doc_id", "mark", "word", "n_words", F.col("first.doc_id").alias("first_doc_id"), F.col("first.mark").alias("first_mark"), F.col("first.word").alias("first_word"), "removed", "cluster_id")


def removed_words(repeats: DataFrame) -> DataFrame:
    """(doc_id, mark, spans): first word and end of the words to remove."""
    span = F.struct(F.col("word").alias("start"), (F.col("word") + F.col("n_words")).alias("end"))
    return repeats.where("removed").groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def without(text: str, lines: list[int], spans: list[tuple[int, int]]) -> str:
    """The text without these lines and these words. A line goes with its last word; what stays of one keeps its bytes."""
    data = text.encode()
    start, end, _ = words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    gone = np.zeros(len(start), bool)
    for a, b in spans:
        gone[a:b] = True
    drop, out, at = set(lines), [], 0
    for k, line in enumerate(data.split(b"\n")):
        stop = at + len(line)
        lo, hi = np.searchsorted(start, (at, stop))
        here = gone[lo:hi]
        if k not in drop and not (len(here) and here.all()):
            if here.any():
                kept, begin = [], at
                for i in range(lo, hi):
                    if gone[i]:
                        kept.append(data[begin : start[i]])
                        begin = start[i + 1] if i + 1 < hi else stop
                line = b"".join([*kept, data[begin:stop]])
                line = line.rstrip(b" \t\r\x0b\x0c") if gone[hi - 1] else line
            out.append(line)
        at = stop + 1
    return b"\n".join(out).decode()
