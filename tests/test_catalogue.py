"""Filters, projections, pages, functions, search, linking and sources on small rows."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import derived, parsers, text
from quillspark.operators import aggregates, filters, joins, paging, projection, quality
from quillspark.plans import linking, search
from quillspark.sources import fixtures, texts


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_filters(spark):
    df = spark.createDataFrame([("a", "Fire Ball", 3, None), ("b", "fireball", 5, 1), ("c", None, 9, 2)], "key string, name string, level int, extra int")
    keys = lambda d: sorted(r.key for r in d.collect())
    f = filters.FilterSet({"name": ["iexact", "contains"], "level": ["exact", "range", "gte"], "extra": ["isnull"], "key": ["in", "not_in"]}, {"lvl": "level"})
    assert keys(f.apply(df, {"name__iexact": "FIREBALL"})) == ["b"]
    assert keys(f.apply(df, {"name__contains": "FIRE"})) == ["a", "b"]
    assert keys(f.apply(df, {"level__range": "3,5", "extra__isnull": "false"})) == ["b"]
    assert keys(f.apply(df, {"lvl": 9})) == ["c"]
    assert keys(f.apply(df, {"key__in": "a,c", "unknown": "x", "level__gte": ""})) == ["a", "c"]
    assert keys(f.apply(df, {"key__not_in": ["a"], "extra__isnull": "TRUE"})) == []
    assert keys(filters.keyword_search(df, "ball fire", ["name", "key"])) == ["a", "b"]
    with pytest.raises(ValueError):
        filters.predicate(F.col("x"), "near", 1)


def test_projection(spark):
    df = spark.createDataFrame([("k", ("n", "d"), [("x", 1)])], "key string, doc struct<name:string,desc:string>, items array<struct<a:string,b:int>>")
    out = projection.apply_params(df, {"doc__fields": "name,nothing", "items__exclude": "b", "fields": "doc,items,none"})
    assert out.columns == ["doc", "items"]
    assert out.first().asDict(True) == {"doc": {"name": "n"}, "items": [{"a": "x"}]}


def test_pages(spark):
    df = paging.ordered(spark.range(7).withColumnRenamed("id", "key"), "-nothing,-key", "key")
    found = paging.page(df, 2, 3)
    assert ([r.key for r in found.rows.collect()], found.count, found.next, found.previous) == ([3, 2, 1], 7, 3, 1)
    with pytest.raises(LookupError):
        paging.page(df, 4, 3)
    assert paging.page(df.limit(0), 1, 3).count == 0


def test_nesting(spark):
    parents = spark.createDataFrame([(1,), (2,)], "key int")
    children = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (None, 1, "x")], "parent int, n int, name string")
    out = joins.with_children(parents, children, "key", "parent", "kids", ["name"], ["n"]).orderBy("key").collect()
    assert [[k.name for k in r.kids] for r in out] == [["a", "b"], []]


def test_rekeyed(spark):
    table = spark.createDataFrame([("a", "X y")], "key string, name string")
    child = spark.createDataFrame([("1", "a"), ("2", "gone")], "key string, parent string")
    new, moved = quality.rekeyed(table, "key", F.concat_ws("_", F.lit("doc"), text.slug(F.col("name"))), {"child": (child, "parent")})
    assert new.first().key == "doc_x-y"
    assert {r.key: r.parent for r in moved["child"].collect()} == {"1": "doc_x-y", "2": "gone"}


@pytest.mark.parametrize("score, expected", [(10, 0), (9, -1), (1, -5), (30, 10), (7, -2)])
def test_modifier(spark, score, expected):
    assert value(spark, derived.modifier(F.lit(score))) == expected


def test_derived(spark):
    v = lambda c: value(spark, c)
    assert [v(derived.experience(F.lit(x))) for x in (0.125, 30.0, 31.0)] == [25, 155000, None]
    assert v(derived.experience(F.lit(1), F.lit(7))) == 7
    assert [v(derived.proficiency(F.lit(x))) for x in (0, 4, 5, 20)] == [0, 2, 3, 6]
    assert v(derived.spell_slots(F.lit(5), F.lit("FULL"))) == [0, 4, 3, 2, 0, 0, 0, 0, 0, 0]
    assert v(derived.spell_slots(F.lit(5), F.lit("HALF"))) == [0, 4, 2, 0, 0, 0]
    assert v(derived.spell_slots(F.lit(1), F.lit("HALF"))) == [0] * 6
    assert (v(derived.spell_slots(F.lit(3), F.lit("NONE"))), v(derived.spell_slots(F.lit(21), F.lit("FULL")))) == ([], None)
    assert v(derived.armor_display(F.lit(12), F.lit(True), F.lit(2))) == "12 + Dex modifier (max 2)"
    assert v(derived.usage_limits(F.lit("PER_DAY"), F.lit(0))) is None
    assert v(derived.hit_points(F.lit("D8"), F.lit("Bard")))["hit_points_at_higher_levels"] == "1D8 (or 5) + your Constitution modifier per bard level after 1st"
    assert [v(derived.level_name(F.lit(x))) for x in (0, 1, 3, 9)] == ["Cantrip", "1st-level", "3rd-level", "9th-level"]
    assert v(text.slug(F.lit("  Élan  vital! -- (x)"))) == "elan-vital-x"
    assert v(text.short_slug(F.lit("A b--C!"))) == "a-b--c"
    assert v(text.fallback_name(F.lit("  "), F.lit("n"))) == "n"
    assert v(text.highlighted(F.lit("Fire fires a.b"), ["fire", "a.b"])) == '<span class="highlighted">Fire</span> fires <span class="highlighted">a.b</span>'


def test_parsers(spark):
    v = lambda f, s: value(spark, f(F.lit(s)))
    assert [str(v(parsers.cost, s)) for s in ("1,500 GP", "5 sp", "7 CP", "—", "free")] == ["1500.00", "0.50", "0.07", "0.00", "0.00"]
    assert [str(v(parsers.weight, s)) for s in ("1/4 lb.", "2.5 lb.", "—")] == ["0.250", "2.500", "0.000"]
    assert tuple(v(parsers.distance, "**60** feet")) == (60.0, "feet")
    assert tuple(v(parsers.distance, "1 mile")) == (5280.0, "feet")
    assert tuple(v(parsers.distance, "Self (10 feet)")) == (0.0, None)
    assert [v(parsers.sortable_range, s) for s in ("Self (30-foot cone)", "Touch", "120 feet", "1 mile", "Sight", "odd")] == [0, 1, 120, 5280, 9999, None]
    assert tuple(v(parsers.spell_components, "V, S, M (a pearl worth 100 gp)")) == (True, True, True, "a pearl worth 100 gp", 100, True)
    assert tuple(v(parsers.duration, "Concentration, up to 10 minutes")) == ("10 minute", True)
    assert tuple(v(parsers.casting_time, "Reaction, when hit")) == ("reaction", "when hit")
    assert tuple(v(parsers.attack, "Melee Weapon Attack: +4 to hit, reach 5 ft., one target. Hit: 5 (1d6 - 2) piercing damage")) == ("WEAPON", 4, 5.0, None, "1d6", -2)
    assert v(parsers.senses, "- **Senses** Darkvision 60 ft.; Passive Perception 13").asDict() == {"darkvision_range": 60.0, "blindsight_range": None, "tremorsense_range": None, "truesight_range": None, "passive_perception": 13}
    assert v(parsers.movement, "- **Speed:** 40 ft., Fly 80 ft. (hover)").asDict() == {"walk": 40.0, "fly": 80.0, "swim": None, "burrow": None, "climb": None, "hover": True}
    assert tuple(v(parsers.usage, "Breath (Recharge 5-6)")) == ("RECHARGE_ON_ROLL", 5)
    assert tuple(v(parsers.damage, "takes 8d6 Fire damage and 2d4 cold damage")) == ("8d6", ["fire", "cold"])


def test_bm25_as_sqlite(spark):
    docs = [(i, f"name {i % 3}", " ".join(w for k, w in enumerate(["fire", "ice", "Élan", "stone", "naïve", "bolt"]) if (i * 7 + k * 5) % (k + 2) == 0) or "none") for i in range(40)]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(name, body)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text module")
    con.executemany("INSERT INTO t(rowid, name, body) VALUES (?, ?, ?)", docs)
    expected = dict(con.execute("SELECT rowid, bm25(t, 10.0, 1.0) FROM t WHERE t MATCH 'stone elan'").fetchall())
    df = spark.createDataFrame(docs, "key int, name string, body string")
    found = {r.key: r.score for r in search.bm25(df, ["stone", "elan"], {"name": 10.0, "body": 1.0}).collect()}
    assert found.keys() == expected.keys() and len(found) > 1
    assert all(abs(found[k] - expected[k]) < 1e-9 for k in found)


def test_fuzzy(spark):
    pairs = spark.createDataFrame([("firbal", "fireball"), ("a", ""), ("dragn", "dragon")], "a string, b string")
    assert [round(r.s, 2) for r in pairs.select(search.similarity(F.col("a"), F.col("b")).alias("s")).collect()] == [85.71, 0.0, 90.91]
    names = spark.createDataFrame([("Fireball",), ("Delayed Blast Fireball",), ("Ice Storm",)], "name string")
    assert [r.name for r in search.fuzzy_names(names, "name", "firbal").orderBy("name").collect()] == ["Delayed Blast Fireball", "Fireball"]


def test_search(spark):
    rows = [("p1", "Fireball", "Spell", "srd", "v2", "A bright streak of fire"), ("p2", "Fire Bolt", "Spell", "srd", "v2", "You hurl a mote of fire"), ("p3", "Dragon", "Creature", "tob", "v2", "It breathes fire, fire and fire"), ("p4", "Stone", "Item", "srd", "v1", "Just a stone")]
    rows += [(f"x{i}", f"Filler {i}", "Item", "srd", "v2", "nothing to see") for i in range(8)]
    df = spark.createDataFrame(rows, "object_pk string, object_name string, object_model string, document_pk string, schema_version string, text string")
    corpus = search.Corpus(df, search.term_weights(df, "object_pk", F.concat_ws(" ", "object_name", "text")))
    run = lambda **k: [(r.object_pk, r.match_type) for r in search.search(corpus, search.SearchRequest(**k)).orderBy("rank").collect()]
    assert {p for p, _ in run(query="fire")} == {"p1", "p2", "p3"}
    assert run(query="fire", model="creature") == [("p3", "exact")]
    assert run(query="firebal") == [("p1", "fuzzy")]
    assert run(query="  ") == []
    assert ("p2", "vector") in run(query="fire mote", vector=True, strict=True) or run(query="fire mote")[0] == ("p2", "exact")
    assert run(query="fire-bolt", schema="v1") == []


def test_links(spark):
    refs = spark.createDataFrame([("Spell", "s1", "Light"), ("Spell", "s2", "Fly"), ("Item", "i1", "Rope"), ("Item", "i2", "rope"), ("Item", "i3", "+1 Bow")], "type string, key string, name string")
    docs = {
        "a": "You see **Rope** here.\n# Rope\n| Rope | x |\n| y | z |", "b": "| h |\n| Rope | z |", "c": "They fly away in bright light.", "d": "Cast Fly; carry a ROPE.",
        "e": "a light weapon and Light", "i1": "The Rope itself", "f": "ropes are not it", "g": "Use the +1 Bow now", "h": "__Fly__ and Fly",
    }
    df = spark.createDataFrame([("Item" if k == "i1" else "Feature", k, v) for k, v in docs.items()], "type string, key string, desc string")
    found = {(r.source_key, r.reference_key) for r in linking.links(df, refs, ambiguous=["fly"]).collect()}
    assert found == {("b", "i1"), ("d", "s2"), ("d", "i1"), ("i1", "i2"), ("h", "s2")}


def test_fixtures(spark, tmp_path):
    (tmp_path / "a").mkdir()
    write = lambda name, rows: (tmp_path / name).write_text(json.dumps(rows))
    write("a/One.json", [{"model": "m.thing", "pk": "x", "fields": {"name": "old", "size": 3.0, "cost": "1.50", "tags": ["t"]}}, {"model": "m.other", "pk": 7, "fields": {}}])
    write("a/Two.json", [{"model": "m.thing", "pk": "x", "fields": {"name": "new", "size": "bad"}}])
    write("a/Two.json_", [{"model": "m.thing", "pk": "skipped", "fields": {}}])
    rows = fixtures.read_fixtures(spark, str(tmp_path))
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("cost", T.DecimalType(10, 2)), T.StructField("tags", T.ArrayType(T.StringType()))])
    assert [(r.key, r.name, r.size) for r in fixtures.decode(rows, "m.thing", schema).collect()] == [("x", "new", None)]
    assert sorted((r.name, r.size, str(r.cost)) for r in fixtures.decode(rows, "m.thing", schema, last_wins=False).collect()) == [("new", None, "None"), ("old", 3, "1.50")]
    assert [(r.pk, r.column, r.value) for r in fixtures.misfits(rows, "m.thing", schema).collect()] == [("x", "size", "bad")]
    assert fixtures.decode(rows, "m.other", T.StructType([T.StructField("name", T.StringType())])).first().key == "7"
    fixtures.write_csv(fixtures.decode(rows, "m.thing", schema), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["key", "name", "size", "cost", "tags"]


def test_texts(spark, tmp_path):
    df = spark.createDataFrame([("d", "intro\n## One\nbody *1*\n## Two\n**Cost:** 5 GP\nline")], "key string, text string")
    parts = texts.sections(df, "text", 2, ["key"]).orderBy("position").collect()
    assert [(p.position, p.title, p.body) for p in parts] == [(1, "One", "body *1*"), (2, "Two", "**Cost:** 5 GP\nline")]
    assert value(spark, texts.key_values(F.lit("x\n**Cost:** 5 GP\n- **Weight:** 1 lb."))) == {"Cost": "5 GP", "Weight": "1 lb."}
    (tmp_path / "keys.txt").write_text(" a \n\nb\na\n")
    assert sorted(r.key for r in texts.key_list(spark, str(tmp_path / "keys.txt")).collect()) == ["a", "b"]
    assert texts.key_list(spark, None).count() == 0
    blocks = spark.createDataFrame([("k", "***Bite.*** Hurts.\n***Claw.*** Also.")], "key string, text string")
    assert [(r.name, r.body) for r in texts.named_blocks(blocks, "text", ["key"]).orderBy("position").collect()] == [("Bite", "Hurts."), ("Claw", "Also.")]


def test_suffixes_and_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "base string, n int")
    assert sorted(r.key for r in aggregates.suffixed_keys(df, "base", ["n"]).collect()) == ["a", "a_1", "b"]
    assert [(r.base, r.n_items) for r in aggregates.by_group_size(df, "base", "n").collect()] == [("a", 2), ("b", 1)]


def test_links_join_by_the_word_that_fewest_names_have(spark):
    """A word of all names makes no pair, and neither texts nor their words are broadcast."""
    texts = spark.createDataFrame([("part", str(i), f"Made by Brand#{i % 50}, unlike hot ring") for i in range(200)], "type string, key string, desc string").coalesce(1)
    refs = spark.createDataFrame([("brand", f"b{i}", f"Brand#{i}") for i in range(50)], "type string, key string, name string")
    found = linking.links(texts, refs)
    rows = found.collect()
    assert {(r.source_key, r.reference_key, r.anchor) for r in rows} == {(str(i), f"b{i % 50}", f"Brand#{i % 50}") for i in range(200)} and len(rows) == 200
    plan = found._jdf.queryExecution()
    assert "SortMergeJoin" in plan.sparkPlan().toString() and "BuildLeft" not in plan.sparkPlan().toString()
    joins = [line for line in plan.optimizedPlan().toString().splitlines() if "Join Inner" in line and "__word" in line]
    assert joins and all("rightHint=(strategy=broadcast)" in line for line in joins[:1])
