"""Links from free words to entries, over synonyms and words that stand for all entries."""

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class WordLinks:
    """links: (key, target), distinct. unknown: (word, n) of words that no entry or synonym has, with how many rows have them."""

    links: DataFrame
    unknown: DataFrame


def word_links(rows: DataFrame, key: str, words: Column, targets: DataFrame, target: str = "key", name: str | None = None, synonyms: Mapping[str, str | list[str]] | None = None, every: list[str] = ("any",)) -> WordLinks:
    """Which entries the words of a row mean.

    words: an array of words of a row; a word means the entry whose name it is (by default its key), whatever the case
    and the blanks around it, or those entries that the synonym names. A word of `every` means all entries. Null, empty
    and repeated words count for nothing. Rows are joined with entries by the word, so no row meets entries that it
    doesn't name; the words for all meet the entries, of which there are as many as links are wanted.
    """
    plain = lambda c: F.lower(F.trim(c))
    asked = rows.select(F.col(key).alias("key"), F.explode(F.array_distinct(F.transform(words, plain))).alias("word")).where("word != ''").distinct()
    entries = targets.select(F.col(target).cast("string").alias("target"), plain(F.col(name or target).cast("string")).alias("named")).where("target IS NOT NULL").distinct()
    pairs = [(w.lower().strip(), t.lower().strip()) for w, ts in (synonyms or {}).items() for t in ([ts] if isinstance(ts, str) else ts)]
    spark = rows.sparkSession
    # Own names come first: a synonym of a word that is a name adds to it.
    known = entries.select(F.col("named").alias("word"), "target")
    if pairs:
        more = spark.createDataFrame(pairs, "word string, named string")
        known = known.unionByName(F.broadcast(more).join(entries, "named").select("word", "target")).distinct()  # a table that the caller wrote down
    wild = spark.createDataFrame([(w.lower().strip(),) for w in every], "word string") if every else spark.createDataFrame([], "word string")
    known = known.unionByName(wild.crossJoin(entries.select("target").distinct())).distinct()  # a few words, each meant for all entries
    met = asked.join(known, "word")
    unknown = asked.join(known.select("word").distinct(), "word", "left_anti").groupBy("word").agg(F.count("*").alias("n"))
    return WordLinks(met.select("key", "target").distinct(), unknown)
