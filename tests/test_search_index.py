"""A kept index finds what searches over the whole corpus find, and reads only the parts of its words."""

import re

import pytest
from pyspark.sql import functions as F

from quillspark.plans import search
from quillspark.plans.search_index import SearchIndex

COLUMNS = ["document_pk", "object_pk", "object_name", "object_model", "schema_version", "text"]


@pytest.fixture(scope="module")
def rows(spark):
    texts = ["fire burns", "ice and fire", None, "élan of the fire giant", "stone", "", "ice ice ice", "the the fire fire"]
    data = [(f"k{i}", f"Name {i}" if i else "Fireball", "Spell", "srd", "v1" if i % 2 else "v2", t, '{"level":1}') for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "object_pk string, object_name string, object_model string, document_pk string, schema_version string, text string, extra string").repartition(3)


@pytest.fixture(scope="module")
def root(spark, rows, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index"))
    assert SearchIndex.load(spark, root) is None
    SearchIndex.build(rows.limit(1), root, COLUMNS, parts=4)
    SearchIndex.build(rows, root, COLUMNS, similar=F.concat_ws(" ", "object_name", "text"), parts=4)
    return root


def test_same_as_without(spark, rows, root):
    index = SearchIndex.load(spark, root)
    weights = search.term_weights(rows, "object_pk", F.concat_ws(" ", "object_name", "text"))
    plain, kept = search.Corpus(rows, weights), search.Corpus(index.table("rows"), index=index)
    for request in (*(search.SearchRequest(q, schema="%") for q in ("fire", "fire fire", "elan", "firebal", "nothing at all", "", '"fire giant"', '"the fire" OR sto*', "fire NOT ice", "NEAR(elan giant, 3)", "object_name:fireball", "^ice", "ic* ice", 'fire AND "', "-text:fireball")), search.SearchRequest("ice fire", schema="%", vector=True), search.SearchRequest("fire"), search.SearchRequest("fire", schema="v1"), search.SearchRequest("the giant", schema="%", strict=True, vector=True)):
        found = [[(r.object_pk, r.match_type, round(r.score, 9), r.rank) for r in search.search(c, request).orderBy("rank").collect()] for c in (plain, kept)]
        assert found[0] == found[1], request


def test_prunes(spark, root):
    index = SearchIndex.load(spark, root)
    plan = index.of_terms("postings", index.words_of(F.array(F.lit("fire"))))._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part", plan)


def test_empty(spark, rows, tmp_path):
    index = SearchIndex.build(rows.limit(0), str(tmp_path), COLUMNS, similar=F.col("text"), parts=2)
    corpus = search.Corpus(index.table("rows"), index=index)
    assert search.search(corpus, search.SearchRequest("fire", vector=True)).count() == 0
    assert not search.respond(corpus, search.SearchRequest("fire")).exact_matches


def test_respond(spark, root):
    index = SearchIndex.load(spark, root)
    corpus = search.Corpus(index.table("rows"), index=index)
    page = search.respond(corpus, search.SearchRequest("fire", schema="%"), 1, 2)
    found = page.rows.collect()
    assert (page.count, page.next, page.exact_matches, [r.rank for r in found]) == (4, 2, True, [0, 1])
    assert all(r.match_score == 1 and "highlighted" in r.highlighted and r.extra == '{"level":1}' and r.route.endswith("/spells/") for r in found)
    fuzzy = search.respond(corpus, search.SearchRequest("firebal", schema="%"))
    row = fuzzy.rows.first()
    assert (fuzzy.exact_matches, row.matched_term, row.match_type) == (False, "fireball", "fuzzy") and row.match_score > 0.9
    assert search.respond(corpus, search.SearchRequest("")).count == 0
    with pytest.raises(LookupError):
        search.respond(corpus, search.SearchRequest("fire"), 9)


def test_ranks_of_many_ties(spark):
    hits = spark.range(5000).selectExpr("CAST(id AS STRING) AS object_pk", "CAST(id % 2 AS INT) AS type_rank", "CAST(-1.0 AS DOUBLE) AS score").repartition(6)
    found = search.ranked(hits).collect()
    assert [r["rank"] for r in found] == list(range(5000))
    assert [(r.type_rank, r.object_pk) for r in found] == sorted((i % 2, str(i)) for i in range(5000))


def test_postings_are_made_without_a_shuffle(spark, rows):
    blocks = search.posting_blocks(rows, "object_pk", ["object_name", "text"])
    assert "Exchange" not in blocks.selectExpr("term", "entries")._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    found = {(r.term, r.column, r.object_pk): (r.n, r.positions, r.length) for r in search.opened(blocks, "object_pk").collect()}
    assert found["the", "text", "k7"] == (2, [0, 1], 6) and found["ice", "text", "k6"] == (3, [0, 1, 2], 5) and found["name", "object_name", "k2"] == (1, [0], 2)
    assert ("fireball", "object_name", "k0") in found and not any(k == "k2" and c == "text" for _, c, k in found) and len(found) == 29
    held = {}
    for term, _, key in found:
        held.setdefault(term, set()).add(key)
    assert {r.term: r.df for r in blocks.groupBy("term").agg(F.sum("fresh").alias("df")).collect()} == {t: len(k) for t, k in held.items()}


def test_frequent_terms_are_counted_in_blocks(spark, rows, tmp_path):
    """A term's postings are a row for each block, not one for each row of the corpus."""
    many = spark.range(300).select(F.col("id").alias("k"), F.lit("fire fire").alias("text")).coalesce(1)
    index = SearchIndex.build(many, str(tmp_path), ["text"], "k", parts=2)
    assert spark.read.parquet(f"{index.path}/postings").count() == 1 and index.table("postings").count() == 300
    assert index.table("terms").first().df == 300


def test_weights_of_the_rows_with_a_word(spark, rows):
    text = F.concat_ws(" ", "object_name", "text")
    plain = {(r.object_pk, r.term): (round(r.weight, 12), round(r.idf, 12)) for r in search.term_weights(rows, "object_pk", text).collect()}
    some = {(r.object_pk, r.term): (round(r.weight, 12), round(r.idf, 12)) for r in search.term_weights(rows, "object_pk", text, ["ice", "giant"]).collect()}
    keys = {k for k, t in plain if t in ("ice", "giant")}
    assert some == {k: v for k, v in plain.items() if k[0] in keys} and keys
    found = lambda c: [(r.object_pk, r.match_type, round(r.score, 9)) for r in search.search(c, search.SearchRequest("ice giant", schema="%", vector=True)).collect()]
    assert found(search.Corpus(rows, weighed=text)) == found(search.Corpus(rows, search.term_weights(rows, "object_pk", text)))
    assert search.Corpus(rows, weighed=text).similar("a").count() == 0
