"""Full-text expressions and snippets against SQLite's full-text module."""

import random
import re
import sqlite3

import pytest

from quillspark.plans import fulltext

COLUMNS = {"name": 10.0, "body": 1.0}
QUERIES = [
    "fire", '"fire ball"', "fir*", '"fire ba" *', "fire + ball", "NEAR(fire burns, 2)", "NEAR(fire burns)", "NEAR(fire ball ice, 1)", "NEAR(fire ball ice, 4)", 'NEAR("fire ball" burns ic*, 3)', "fire AND ice", "fire OR ice", "fire NOT ice",
    "name:fire", "name : fire ice", "-name:fire", "{name body}:fire", "^fire", "body: ^ fire", '""', '"" fire', 'fire AND ""', 'fire OR ""', '"" OR ice', 'fire NOT ""', "(fire ice) OR burns", "fire_ball", "fire-ball", "fire:", "nope:fire",
    "NEAR fire", "fire AND", "AND", "NOT", '"fire', "fire*ball", 'fire."x"', "ice OR fire NOT ball", "ice burns OR elan", "elan", "ÉLAN", "f* b*", "name:(fire OR ice)", "- name : (fire)", "near(fire ball)", "fire *", "fire'", "", " ", "{}:fire",
    "fire, ice", '^"fire ball"', 'NEAR("" fire)', '"..."', "fire (ice)", "(fire", "fire NOT (ice AND burns)", "(fire AND ice) OR burns", "body:(fire NOT name:ice)", "fire fire", "b* NOT ball NOT burns", "ice AND fire OR ball AND burns",
]


def texts(seed, count, longest):
    draws = random.Random(seed)
    words = ["fire", "ice", "ball", "burns", "élan", "Fire", "icy", "stone", "of", "fire_ball", "bolt", "the"]
    glue = [" "] * 9 + [". ", ": ", ", ", "\n", ".\t", "-"]
    return ["".join(draws.choice(words) + draws.choice(glue) for _ in range(draws.randint(0, longest))) for _ in range(count)]


@pytest.fixture(scope="module")
def table(spark):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(name, body)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text module")
    rows = list(zip(range(120), texts(1, 120, 4), texts(2, 120, 90)))
    con.executemany("INSERT INTO t(rowid, name, body) VALUES (?, ?, ?)", rows)
    return con, spark.createDataFrame(rows, "key int, name string, body string").repartition(3).cache()


def expected(con, sql, query):
    try:
        return dict(con.execute(sql, (query,)).fetchall())
    except sqlite3.OperationalError:
        return None


@pytest.mark.parametrize("query", QUERIES)
def test_matches(table, query):
    con, df = table
    want = expected(con, "SELECT rowid, bm25(t, 10.0, 1.0) FROM t WHERE t MATCH ?", query)
    node = fulltext.parse(query, list(COLUMNS))
    assert (node is None) == (want is None)
    if node is not None:
        got = {r.key: r.score for r in fulltext.matches(df, node, COLUMNS).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


@pytest.mark.parametrize("query", ["fire", '"fire ball"', "fire ice", "NEAR(fire burns, 3)", "elan OR bolt", "fi* stone", "name:fire", "ice NOT élan", '"of the" OR "the of"', "bolt stone burns ball"])
def test_snippets(table, query):
    con, df = table
    want = expected(con, "SELECT rowid, snippet(t, 1, '[', ']', '...', 20) FROM t WHERE t MATCH ?", query)
    node = fulltext.parse(query, list(COLUMNS))
    got = {r.key: r.snippet for r in fulltext.snippets(df, node, COLUMNS, "body", 20, marks=("[", "]")).collect()}
    wrong = {k: (want[k], got[k]) for k in want if want[k] != got[k]}
    assert len(want) > 3 and not wrong, (len(want), len(wrong), next(iter(wrong.items())))


def test_snippets_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "one"), (5, "word " * 50 + "fire")], "key int, text string")
    got = {r.key: r.snippet for r in fulltext.snippets(df, fulltext.parse("fire", ["text"]), {"text": 1.0}).collect()}
    assert [got[k] for k in (1, 2, 3, 4)] == ["", "", "...", "one"]
    assert re.fullmatch(r"\.\.\.(word ){19}<span class=\"highlighted\">fire</span>", got[5])
