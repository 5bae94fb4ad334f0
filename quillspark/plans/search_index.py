"""A kept search index: tables written once, of which a query reads only the parts that its words are in.

Postings hold positions and the row's length, those of a term in a block of rows as one row (search.posting_blocks), and
are partitioned by a hash of the term, so a query's scan is pruned to as many folders as it has words; TF-IDF weights and the corpus itself lie beside them. Counts of terms are in a table of
their own, partitioned alike, so no query counts the corpus again. A rebuild writes a new version and then turns to
it by one rename, so readers see one whole version (sources/versions.py; old ones go by its prune).
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import without_accents
from quillspark.plans import fulltext, search
from quillspark.sources.versions import Versions

PARTS = 256  #: folders of the terms
SPREAD = 8  #: tasks that write a folder of postings at most
#: Columns of the tables that are partitioned by term, beside the key (that of terms has none; entries of postings hold it).
BY_PART = {"postings": "term string, column string, entries array<struct<key:{key},positions:array<int>,length:int>>, fresh long, part int", "terms": "term string, df long, part int", "weights": "term string, weight double, idf double, part int"}


def part_of(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def _write(table: DataFrame, key: str, path: str) -> None:
    """By part; ranges of part, term and key spread a frequent term over many tasks."""
    ranged = table.repartitionByRange("part", "term", key).sortWithinPartitions("part", "term")
    ranged.write.partitionBy("part").parquet(path)


@dataclass
class SearchIndex:
    spark: SparkSession
    path: str

    @classmethod
    def build(cls, corpus: DataFrame, root: str, columns: list[str], key: str = "object_pk", similar: Column | None = None, parts: int = PARTS) -> "SearchIndex":
        """Writes a new version below the root and makes it the current one. corpus: one row for each key.

        columns: those that full-text search looks into. similar: the text that TF-IDF weights are made of. The corpus is
        read once for each table; a null text has no terms, an empty corpus gives an index that finds nothing.
        """
        spark = corpus.sparkSession
        versions = Versions(spark, root)
        path = versions.new_folder()
        corpus.write.parquet(f"{path}/rows")
        rows = spark.read.parquet(f"{path}/rows")
        # Blocks of a frequent term are dealt to several tasks; no range is sampled, as that would make the postings twice.
        blocks = search.posting_blocks(rows, key, columns).withColumn("part", part_of(F.col("term"), parts))
        dealt = blocks.repartition("part", F.pmod(F.xxhash64(F.col("entries")[0]["key"]), F.lit(SPREAD)))
        dealt.sortWithinPartitions("part", "term").write.option("compression", "zstd").partitionBy("part").parquet(f"{path}/postings")
        length = reduce(lambda a, b: a + b, (F.size(search.tokens(F.col(c))) for c in columns))
        rows.select(key, length.alias("length")).write.parquet(f"{path}/lengths")
        spark.read.parquet(f"{path}/lengths").agg(F.count("*").alias("n"), F.avg("length").alias("mean")).write.parquet(f"{path}/totals")
        index = cls(spark, path).opened(key, parts, similar is not None)
        counts = index.blocks().groupBy("part", "term").agg(F.sum("fresh").alias("df"))
        _write(counts, "df", f"{path}/terms")
        if similar is not None:
            weights = search.term_weights(rows, key, similar).withColumn("part", part_of(F.col("term"), parts))
            _write(weights, key, f"{path}/weights")
        facts = spark.createDataFrame([(key, parts, similar is not None)], "key string, parts int, similar boolean")
        facts.coalesce(1).write.parquet(f"{path}/facts")
        versions.publish(path)
        return index

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> "SearchIndex | None":
        """The current version; None where there is no index, so that a caller can build one."""
        path = Versions(spark, root).current()
        if not path:
            return None
        found = spark.read.parquet(f"{path}/facts").first()
        return cls(spark, path).opened(found.key, found.parts, found.similar)

    def opened(self, key: str, parts: int, similar: bool) -> "SearchIndex":
        self.key, self.parts, self.similar = key, parts, similar
        return self

    def table(self, name: str) -> DataFrame:
        if name not in BY_PART:
            return self.spark.read.parquet(f"{self.path}/{name}")
        if name == "postings":
            return search.opened(self.blocks(), self.key, "part")
        key = T.StructType([f for f in self.table("lengths").schema if f.name == self.key])  # a table by part has no file where it is empty
        return self.spark.read.schema(T.StructType([*key, *T.StructType.fromDDL(BY_PART[name])]) if name != "terms" else BY_PART[name]).parquet(f"{self.path}/{name}")

    def blocks(self) -> DataFrame:
        """The postings as they are written: (term, column, entries, fresh, part)."""
        kind = self.table("lengths").schema[self.key].dataType.simpleString()
        return self.spark.read.schema(BY_PART["postings"].format(key=kind)).parquet(f"{self.path}/postings")

    def words_of(self, words: Column) -> list[tuple[str, int, int]]:
        """(term, part, how often it comes) of a query's words, an array."""
        rows = self.spark.range(1).select(F.explode(words).alias("term")).groupBy("term").count()
        return [tuple(r) for r in rows.select("term", part_of(F.col("term"), self.parts), F.col("count").cast("int")).collect()]

    def of_terms(self, name: str, words: list[tuple[str, int, int]]) -> DataFrame:
        """The rows of a table partitioned by term: only the words' folders are read."""
        return self.table(name).where(F.col("part").isin([w[1] for w in words]) & F.col("term").isin([w[0] for w in words]))

    def bm25(self, terms: list[str], weights: dict[str, float]) -> DataFrame:
        """(key, score) of the rows that hold all terms; smaller is better. With the index's columns the scores of search.bm25."""
        words = self.words_of(F.array(*(F.lower(without_accents(F.lit(t))) for t in terms)))
        factor = F.try_element_at(F.create_map(*(F.lit(x) for c, v in weights.items() for x in (c, float(v)))), F.col("column"))
        found = self.of_terms("postings", words).groupBy(self.key, "term").agg(F.sum(F.col("n") * factor).alias("f"), F.max("length").alias("length"))
        times = F.create_map(*(F.lit(x) for w in words for x in (w[0], w[2])))
        idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        rare = self.of_terms("terms", words).crossJoin(F.broadcast(self.table("totals")))  # a row for each word, one of totals
        rare = rare.select("term", (F.when(idf <= 0, fulltext.IDF_FLOOR).otherwise(idf) * times[F.col("term")]).alias("idf"), "mean")
        scored = found.join(F.broadcast(rare), "term")
        k, b = fulltext.K1, fulltext.B
        f = F.col("f")
        part = F.col("idf") * f * (k + 1) / (f + k * (1 - b + b * F.col("length") / F.col("mean")))
        return scored.groupBy(self.key).agg(F.count("*").alias("held"), (-F.sum(part)).alias("score")).where(F.col("held") == len(words)).drop("held")

    def matches(self, node: fulltext.Node, weights: dict[str, float]) -> DataFrame:
        """(key, score) of the rows that match an expression; with the index's columns the scores of fulltext.matches.

        One aggregation of the postings of the expression's words. A prefix has no folder of its own: in every folder only
        the row groups are read whose range of terms it is in.
        """
        e = fulltext.Expression(node, weights)
        whole, prefixes = [w for w, p in e.words if not p], [w for w, p in e.words if p]
        rows = self.table("postings")
        parts = [part for _, part, _ in self.words_of(F.array(*map(F.lit, whole)))] if whole else []
        wanted = [F.col("part").isin(parts) & F.col("term").isin(whole)] if whole else []
        wanted += [F.col("term").startswith(w) for w in prefixes]
        found = rows.where(reduce(lambda a, b: a | b, wanted, F.lit(False)))
        places = lambda c, w: F.when((F.col("column") == c) & fulltext.is_word(F.col("term"), *w), F.col("positions"))
        each = [F.sort_array(F.flatten(F.collect_list(places(n, w)))).alias(e.slot(k, c)) for k, w in enumerate(e.words) for c, n in enumerate(e.names)]
        placed = found.groupBy(self.key).agg(F.max("length").alias("__length"), *each)
        return e.score(*e.judged(e.occurring(placed)), self.table("totals")).select(self.key, "score")

    def similar_to(self, query: str) -> DataFrame:
        """(key, score) by TF-IDF cosine above the threshold; nothing where the index has no weights."""
        words = self.words_of(search.weighed_words(F.lit(query)))
        if not self.similar or not words:
            return self.table("lengths").select(self.key, F.lit(0.0).alias("score")).limit(0)
        return search.tfidf_scores(self.of_terms("weights", words), self.key, query)
