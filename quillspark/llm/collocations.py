"""Phrase collocations of each language: runs of words counted as DataFrame rows, scored by their weakest cut in exact arithmetic.

All runs of 1 to max_n words become rows (those of a block of texts counted already) that one aggregation adds up. A
candidate is joined with the counts of both parts of each of its cuts; phrases that are mostly a part of one longer
candidate go by an anti join with its one-word shorter parts. What a longer candidate of more words holds needs no look
of its own: the one-word extension in between is at least as frequent.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.arrays import pieces
from quillspark.llm.storage import Stash
from quillspark.llm.word_runs import BLOCK, Block, Split

SPLIT = Split.at(b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d")
NO_LANG = "und"
SALTS = 16  #: parts of a language that are ranked apart before their first rows are ranked together
_EXACT = "decimal(38,0)"


def run_counts(docs: DataFrame, max_n: int, least: int, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, f) of the runs of 1 to max_n words within pieces of text that come `least` times or more, and of the empty phrase: all words.

    Language and phrase are one key while they are shuffled, and are told apart only in what is left.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", BLOCK):
                block, lang = Block(part.column("text"), SPLIT), part.column("lang").dictionary_encode()
                names, of = pc.binary_join_element_wise("\n", lang.dictionary, ""), np.asarray(lang.indices).astype(np.int64)
                words = np.bincount(of[block.row], minlength=len(names))
                yield pa.record_batch({"key": names, "f": words})
                for n, runs in enumerate(block.runs(max_n, of), 1):
                    name = names.take(pa.array(of[block.row[runs.one]]))
                    yield pa.record_batch({"key": pc.binary_join_element_wise(block.strings(runs.one, n), name, ""), "f": runs.count})

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(count, "key string, f long").groupBy("key").agg(F.sum("f").alias("f"))
    kept = counted.where((F.col("f") >= least) | F.col("key").startswith("\n"))
    end = F.instr("key", F.lit("\n"))  # a phrase holds no line end
    return kept.select(F.substring("key", end + 1, F.length("key")).alias("lang"), F.substring("key", F.lit(1), end - 1).alias("phrase"), "f")


def _words(phrase: Column) -> Column:
    return F.split(phrase, " ")


def _parts(words: Column, k: Column) -> tuple[Column, Column]:
    """The first k words, and the rest."""
    return F.array_join(F.slice(words, F.lit(1), k), " "), F.array_join(F.slice(words, k + 1, F.size(words) - k), " ")


def scored(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of several words, by their lowest cut. frequent: (lang, phrase, f) with all their parts."""
    cuts = frequent.select("lang", "phrase", F.col("f").alias("a"), _words(F.col("phrase")).alias("words")).where("size(words) > 1")
    cuts = cuts.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    first, rest = _parts(F.col("words"), F.col("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", first.alias("first"), rest.alias("rest"))
    with_first = cuts.join(frequent.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    with_both = with_first.join(frequent.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    top, below = (F.lit(1_000_000).cast("decimal(7,0)") * (exact("a") * exact("a"))).cast(_EXACT), (exact("l") * exact("r")).cast(_EXACT)
    marked = with_both.withColumn("top", top).withColumn("below", below).withColumn("score", F.expr("top div below"))
    least = marked.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x"))
    return least.select("lang", "phrase", "x.a", "x.l", "x.r", "x.score")


def parts_of_longer(frequent: DataFrame, max_n: int, num: int, den: int) -> DataFrame:
    """(lang, phrase) of the candidates that lie in a longer candidate with den * f(longer) >= num * f(phrase)."""
    longer = frequent.select("lang", F.col("f").alias("g"), _words(F.col("phrase")).alias("words")).where("size(words) > 2")
    head, tail = F.array_join(F.slice("words", F.lit(1), F.size("words") - 1), " "), F.array_join(F.slice("words", F.lit(2), F.size("words") - 1), " ")
    inside = longer.select("lang", "g", F.explode(F.array(head, tail)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("g").alias("g"))
    exact = lambda c, by: F.col(c).cast(_EXACT) * F.lit(by)
    return inside.join(frequent, ["lang", "phrase"]).where(exact("g", den) >= exact("f", num)).select("lang", "phrase")


def collocations(docs: DataFrame, max_n: int = 3, least: int = 10, within: tuple[int, int] = (50, 100), top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 to max_n words that come `least` times or more.

    A null language is `und`, like that name itself; null and empty texts have no words; repeated rows count each;
    equal scores go by frequency, then by the phrase's bytes. Other columns play no part. An empty table, or one
    without a phrase that comes often enough, gives an empty result.
    """
    stash = Stash(docs.sparkSession)
    kept = stash.put(run_counts(docs, max_n, least, lang_col, text_col))
    frequent = kept.where("phrase <> ''")
    total = kept.where("phrase = ''").select("lang", F.col("f").alias("n"))
    left = scored(frequent).join(parts_of_longer(frequent, max_n, *within), ["lang", "phrase"], "left_anti")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    named = first.join(total, "lang")
    return named.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
