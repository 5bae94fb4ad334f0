"""Ranked text search over a corpus: full-text BM25, fuzzy words of names, TF-IDF similarity, and their merge."""

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import highlighted, without_accents
from quillspark.functions.urls import search_route
from quillspark.operators.filters import predicate
from quillspark.operators.paging import PAGE_SIZE, Page
from quillspark.plans import fulltext
from quillspark.plans.fulltext import IDF_FLOOR, K1, B, tokens
from quillspark.session import kept

# Thresholds of the fuzzy and the TF-IDF search.
FUZZY_LEAST, FUZZY_WORDS, VECTOR_LEAST = 75.0, 5, 0.05
BLOCK_WORDS = 2_000_000  #: of a block of rows whose postings are made at once (one row at least)


def _occurrences(words: Column, word: Column) -> Column:
    return F.size(F.filter(words, lambda x: x == word))


def bm25(corpus: DataFrame, terms: list[str], weights: dict[str, float], all_terms: bool = True) -> DataFrame:
    """The rows that hold the terms, with `score` (smaller is better).

    One scan counts the terms of each row and one aggregation gives the corpus statistics; no posting is shuffled.
    Statistics are over the whole corpus, so filters belong after this.
    """
    words = [F.lower(without_accents(F.lit(t))) for t in terms]
    rows = corpus.withColumn("__tokens", F.array(*(tokens(F.col(c)) for c in weights)))
    rows = rows.withColumn("__length", F.aggregate("__tokens", F.lit(0), lambda a, x: a + F.size(x)))
    for k, w in enumerate(words):
        counts = [_occurrences(F.col("__tokens")[i], w) * F.lit(float(v)) for i, v in enumerate(weights.values())]
        rows = rows.withColumn(f"__f{k}", reduce(lambda a, b: a + b, counts))
    rows = rows.drop("__tokens")
    n = range(len(words))
    stats = rows.agg(F.count("*").alias("__n"), F.avg("__length").alias("__avg"), *(F.count(F.when(F.col(f"__f{k}") > 0, 1)).alias(f"__n{k}") for k in n))
    hits = [F.col(f"__f{k}") > 0 for k in n]
    held = reduce((lambda a, b: a & b) if all_terms else (lambda a, b: a | b), hits)
    joined = rows.where(held).crossJoin(F.broadcast(stats))  # one row of statistics
    parts = []
    for k in n:
        idf = F.ln((F.col("__n") - F.col(f"__n{k}") + 0.5) / (F.col(f"__n{k}") + 0.5))
        f = F.col(f"__f{k}")
        parts.append(F.when(idf <= 0, IDF_FLOOR).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("__length") / F.col("__avg"))))
    score = -reduce(lambda a, b: a + b, parts)
    return joined.withColumn("score", score).drop("__length", "__n", "__avg", *(f"__f{k}" for k in n), *(f"__n{k}" for k in n))


def posting_blocks(corpus: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(term, column, entries, fresh): postings without a shuffle, a row for each term and column of a block of rows.

    entries: (key, positions, length) of the block's rows; positions: where in the column the term stands, from 0; length:
    tokens of all columns of the row. fresh: entries of rows that have the term in no earlier column, so that its sum
    over a term is the number of rows that hold it. Keys are unique.
    """
    read = corpus.select(F.col(key).alias("key"), *(tokens(F.col(c)).alias(f"t{i}") for i, c in enumerate(columns)))
    kind = T.StructType([T.StructField("key", read.schema["key"].dataType), T.StructField("positions", T.ArrayType(T.IntegerType())), T.StructField("length", T.IntegerType())])
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("column", T.StringType()), T.StructField("entries", T.ArrayType(kind)), T.StructField("fresh", T.LongType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.asarray(pc.list_value_length(batch.column(f"t{i}")), dtype=np.int64) for i in range(len(columns))]
            length = sum(sizes)
            ends, at = np.cumsum(length), 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_WORDS, "right")))
                if ends[to - 1] > (ends[at - 1] if at else 0):
                    yield _block(batch.slice(at, to - at), [n[at:to] for n in sizes], length[at:to].astype(np.int32), columns)
                at = to

    return read.mapInArrow(find, schema)


def _block(rows: pa.RecordBatch, sizes: list[np.ndarray], length: np.ndarray, columns: list[str]) -> pa.RecordBatch:
    """The postings of some rows, of which one has a word at least. sizes: words of each row in each column."""
    many = [int(n.sum()) for n in sizes]
    coded = pa.concat_arrays([rows.column(f"t{i}").flatten() for i in range(len(columns))]).dictionary_encode()
    code, column = np.asarray(coded.indices), np.repeat(np.arange(len(columns)), many)
    row = np.concatenate([np.repeat(np.arange(len(n)), n) for n in sizes])
    place = np.concatenate([np.arange(m) - np.repeat(np.cumsum(n) - n, n) for n, m in zip(sizes, many)]).astype(np.int32)
    order = np.argsort(code.astype(np.int64) * len(columns) + column, kind="stable")  # of one term and column, rows and places are in order already
    code, column, row, place = code[order], column[order], row[order], place[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (column[1:] != column[:-1])
    entry = new.copy()
    entry[1:] |= row[1:] != row[:-1]
    group, first = np.flatnonzero(new), np.flatnonzero(entry)
    begin = np.searchsorted(first, group)
    fresh = np.zeros(len(first), np.int64)
    fresh[np.unique(code[first].astype(np.int64) * rows.num_rows + row[first], return_index=True)[1]] = 1
    positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)), pa.int32()), pa.array(place))
    entries = pa.StructArray.from_arrays([rows.column("key").take(pa.array(row[first])), positions, pa.array(length[row[first]])], ["key", "positions", "length"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(first)), pa.int32()), entries)
    names = pa.array(columns).take(pa.array(column[group]))
    return pa.record_batch({"term": coded.dictionary.take(pa.array(code[group])).cast(pa.string()), "column": names, "entries": lists, "fresh": np.add.reduceat(fresh, begin)})


def opened(blocks: DataFrame, key: str, *beside: str) -> DataFrame:
    """(key, term, column, n, positions, length, beside): a row for each posting of the blocks."""
    each = blocks.select("term", "column", F.explode("entries").alias("e"), *beside)
    return each.select(F.col("e.key").alias(key), "term", "column", F.size("e.positions").cast("long").alias("n"), "e.positions", "e.length", *beside)


def weighed_words(text: Column) -> Column:
    """Words of two word characters at least, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\b\w\w+\b)"), 1)


def term_weights(corpus: DataFrame, key: str, text: Column, of: list[str] | None = None) -> DataFrame:
    """(key, term, weight): TF-IDF with smoothed idf = ln((1 + N) / (1 + df)) + 1, rows scaled to length 1. Terms have two word characters at least.

    of: words; then only rows that hold one of them have weights, which is all that a search for these words needs. The
    counts that weights are made of are those of all rows, and each task adds up its own before they are shuffled.
    """
    read = corpus.select(key, weighed_words(text).alias("__words"))
    df = read.select(F.explode(F.array_distinct("__words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = corpus.agg(F.count("*").alias("n"))
    if of is not None:
        read = read.where(F.exists("__words", lambda w: w.isin(*of)))
    tf = read.select(key, F.explode("__words").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    raw = tf.join(df, "term").crossJoin(F.broadcast(total)).withColumn("raw", F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("raw") / norm).alias("weight"), (F.col("raw") / F.col("tf")).alias("idf"))


def query_words(spark: SparkSession, query: str) -> list[str]:
    """The distinct weighed words of a query."""
    rows = spark.createDataFrame([(query,)], "q string").select(F.explode(F.array_distinct(weighed_words(F.col("q")))).alias("term"))
    return [r.term for r in rows.collect()]


def tfidf_scores(weights: DataFrame, key: str, query: str) -> DataFrame:
    """(key, score) of cosine similarity with the query, above the threshold. The weights of the query's words are written, so that they are made once."""
    spark = weights.sparkSession
    words = spark.createDataFrame([(query,)], "q string").select(F.explode(weighed_words(F.col("q"))).alias("term")).groupBy("term").agg(F.count("*").alias("qtf"))
    held = kept(weights.join(F.broadcast(words), "term").select(key, "term", "weight", "idf", "qtf"), "query-weights")
    idf = held.groupBy("term").agg(F.first("idf").alias("idf"), F.first("qtf").alias("qtf"))
    scaled = idf.withColumn("q", F.col("qtf") * F.col("idf"))
    norm = scaled.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qnorm"))
    side = scaled.crossJoin(F.broadcast(norm)).select("term", (F.col("q") / F.col("qnorm")).alias("qweight"))
    return held.join(F.broadcast(side), "term").groupBy(key).agg(F.sum(F.col("weight") * F.col("qweight")).alias("score")).where(F.col("score") > VECTOR_LEAST)


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two short texts."""
    left, right = (F.filter(F.split(x, ""), lambda c: c != "") for x in (a, b))
    zero = F.transform(right, lambda _: F.lit(0))

    def row(previous: Column, letter: Column) -> Column:
        def step(acc: Column, j: Column) -> Column:
            over = F.get(previous, j)
            diagonal = F.coalesce(F.get(previous, j - 1), F.lit(0))
            before = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))
            new = F.when(F.get(right, j) == letter, diagonal + 1).otherwise(F.greatest(over, before))
            return F.concat(acc, F.array(new))

        return F.aggregate(F.sequence(F.lit(0), F.size(right) - 1), F.array().cast("array<int>"), step)

    found = F.aggregate(left, zero, row)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.element_at(found, -1))


def similarity(a: Column, b: Column) -> Column:
    """200 * common / (length a + length b): 100 for equal texts."""
    return 200.0 * common_length(a, b) / (F.length(a) + F.length(b))


def fuzzy_names(names: DataFrame, name: str, query: str) -> DataFrame:
    """(name, word, score) of names with a word like the query: of the best few words by similarity those above the threshold. Exact words come first, then better scores, then smaller words and names."""
    q = F.lit(query.lower())
    words = names.select(name, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit(r"(?U)(\w+)"), 1))).alias("word"))
    near = words.select("word").distinct().where(200.0 * F.least(F.length("word"), F.length(q)) >= FUZZY_LEAST * (F.length("word") + F.length(q)))
    best = near.withColumn("score", similarity(F.col("word"), q)).orderBy(F.desc("score"), "word").limit(FUZZY_WORDS).where(F.col("score") >= FUZZY_LEAST)
    found = words.join(F.broadcast(best), "word").groupBy(name).agg(F.max_by(F.struct("word", "score"), F.struct("score", "word")).alias("x"))
    return found.select(name, "x.word", "x.score")


@dataclass
class SearchRequest:
    query: str
    schema: str = "v2"
    document: str = "%"
    model: str = "%"
    vector: bool = False
    fuzzy: bool = False
    strict: bool = False


class Index(Protocol):
    """What answers searches from kept tables."""

    def matches(self, node: fulltext.Node, weights: dict[str, float]) -> DataFrame: ...
    def similar_to(self, query: str) -> DataFrame: ...


@dataclass
class Corpus:
    """Columns: object_pk (unique), object_name, object_model, document_pk, schema_version, text. With an index no search reads all texts.

    weights: those of all rows (term_weights); or weighed, the text that they are made of, for the rows that a query's words are in.
    """

    rows: DataFrame
    weights: DataFrame | None = None
    columns: dict[str, float] = field(default_factory=lambda: {"document_pk": 1, "object_pk": 1, "object_name": 10, "object_model": 1, "schema_version": 1, "text": 1})
    index: Index | None = None
    weighed: Column | None = None

    def exact(self, node: fulltext.Node) -> DataFrame:
        """Rows with `score`."""
        return self.rows.join(self.index.matches(node, self.columns), "object_pk") if self.index else fulltext.matches(self.rows, node, self.columns)

    def similar(self, query: str) -> DataFrame:
        if self.index:
            return self.index.similar_to(query)
        weights = self.weights
        if weights is None:
            weights = term_weights(self.rows, "object_pk", self.weighed, query_words(self.rows.sparkSession, query))
        return tfidf_scores(weights, "object_pk", query)


HIT = "object_pk string, object_name string, match_type string, type_rank int, score double, matched_term string"


def _merged(corpus: Corpus, request: SearchRequest) -> DataFrame:
    """Hits of all searches that the request needs, each entry once, as the first type that found it. They are written, so that nothing is searched twice."""
    empty = corpus.rows.sparkSession.createDataFrame([], HIT)
    if not request.query.strip():
        return empty
    wanted = predicate(F.col("schema_version"), "like", request.schema) & predicate(F.col("document_pk"), "like", request.document) & predicate(F.col("object_model"), "like", request.model)
    node = fulltext.parse(request.query, list(corpus.columns))
    kind = lambda df, name, rank, term: df.select("object_pk", "object_name", F.lit(name).alias("match_type"), F.lit(rank).alias("type_rank"), "score", term.cast("string").alias("matched_term"))
    exact = kept(kind(corpus.exact(node).where(wanted), "exact", 0, F.lit(request.query)), "exact-hits") if node else empty
    parts = [exact]  # entries are unique in each part
    if request.fuzzy or (not request.strict and exact.isEmpty()):
        names = fuzzy_names(corpus.rows, "object_name", request.query)
        parts.append(kind(corpus.rows.where(wanted).join(names, "object_name").withColumn("score", -F.col("score") / 100), "fuzzy", 1, F.col("word")))
    if request.vector:
        near = corpus.similar(request.query)
        parts.append(kind(corpus.rows.where(wanted).join(near, "object_pk").withColumn("score", -F.col("score")), "vector", 2, F.lit(None)))
    merged = reduce(DataFrame.unionByName, parts)
    if len(parts) == 1:
        return exact
    first = Window.partitionBy("object_pk").orderBy("type_rank", "score")
    return kept(merged.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n"), "hits")


def _shown(merged: DataFrame, request: SearchRequest) -> DataFrame:
    if request.strict and (request.fuzzy or request.vector):
        return merged.where(F.col("match_type").isin(*["fuzzy"] * request.fuzzy, *["vector"] * request.vector))
    return merged


def search(corpus: Corpus, request: SearchRequest) -> DataFrame:
    """object_pk, object_name, match_type, score, rank: exact hits by rank, then fuzzy ones, then similar ones, each entry once.

    Fuzzy matching also stands in where nothing matches exactly. strict with fuzzy or vector gives those hits only.
    A query that isn't a full-text expression (fulltext.parse) matches nothing exactly. An empty query finds nothing.
    """
    return ranked(_shown(_merged(corpus, request), request)).select("object_pk", "object_name", "match_type", F.abs("score").alias("score"), "rank")


@dataclass
class SearchPage(Page):
    """exact_matches: whether anything matches exactly, shown or not."""

    exact_matches: bool = False


def respond(corpus: Corpus, request: SearchRequest, number: int = 1, size: int = PAGE_SIZE) -> SearchPage:
    """One page of hits with their texts, marked texts, routes and extra columns (`extra`, if the corpus has it). An exact hit's match_score is 1.

    LookupError if there is no such page. Only the page's rows (`size` at most) are joined with the texts.
    """
    if number < 1 or size < 1:
        raise ValueError("pages and their sizes begin at 1")
    merged = _merged(corpus, request)
    shown = _shown(merged, request)
    facts = merged.agg(F.max(F.col("match_type") == "exact").alias("exact")).crossJoin(shown.agg(F.count("*").alias("count"))).first()  # one row each
    if number > max(1, -(-facts["count"] // size)):
        raise LookupError(f"there is no page {number}")
    begin = (number - 1) * size
    # Only the hits up to the page's end are sorted, each task's own first; only the page's are numbered.
    page = shown.orderBy(*ORDER).offset(begin).limit(size).withColumn("rank", F.row_number().over(Window.orderBy(*ORDER)) + begin - 1).drop("object_name")
    rows = corpus.rows.join(F.broadcast(page), "object_pk")  # as many rows as a page has
    node = fulltext.parse(request.query, list(corpus.columns))
    rows = fulltext.snippets(rows, node, corpus.columns, "text", name="__snippet") if node else rows.withColumn("__snippet", F.col("text"))
    marked = F.when(F.col("match_type") == "exact", F.col("__snippet")).when(F.col("match_type") == "fuzzy", _marked_by(F.col("matched_term"))).otherwise(highlighted(F.col("text"), [request.query]))
    score = F.when(F.col("match_type") == "exact", 1.0).otherwise(F.abs("score"))
    extra = [F.col("extra")] if "extra" in corpus.rows.columns else []
    rows = rows.select("document_pk", "object_pk", "object_name", "object_model", "schema_version", search_route(F.col("schema_version"), F.col("object_model")).alias("route"), "text", marked.alias("highlighted"), "match_type", "matched_term", score.alias("match_score"), *extra, "rank")
    return SearchPage(facts["count"], number, size, rows.orderBy("rank"), bool(facts.exact))


def _marked_by(word: Column) -> Column:
    """The text with each whole `word`, which is letters, digits and _, marked."""
    return F.regexp_replace(F.col("text"), F.concat(F.lit(r"(?iU)\b("), word, F.lit(r")\b")), F.lit('<span class="highlighted">$1</span>'))


ORDER = ("type_rank", "score", "object_pk")


def ranked(hits: DataFrame) -> DataFrame:
    """The hits with rank, from 0 without gaps, by ORDER, a total order.

    Tasks sort ranges of the order, ties included, and the written ranges are numbered by their sizes: no task sorts all
    hits, however many have one score.
    """
    ranges = kept(hits.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("__at", F.monotonically_increasing_id()), "ranked-hits")
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = ranges.groupBy(part.alias("__part")).agg(F.count("*").alias("__many"))  # a row for each task
    before = F.coalesce(F.sum("__many").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))
    return ranges.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn("rank", F.col("__before") + within).drop("__at", "__part", "__before").orderBy("rank")
