"""Patches, change sets, cascades and versions on small rows."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import merges
from quillspark.sources.versions import Versions


@pytest.fixture
def creatures(spark):
    return spark.createDataFrame([("a", None, "old", 1.5), ("b", 3, None, 2.0), ("c", None, "x", None), ("dup", None, None, None), (None, None, "n", None)], "key string, armor_class int, armor_detail string, `a.b` double")


@pytest.fixture
def first(spark):
    return spark.createDataFrame([("a", 12, "plate"), ("b", 9, None), ("other", 7, "hide"), ("dup", 1, "p"), ("dup", 2, "q"), ("spare", 4, "z"), (None, 5, "n")], "slug string, ac int, armor string")


COLUMNS = {"armor_class": ("ac", merges.IF_NULL), "armor_detail": ("armor", merges.ALWAYS), "a.b": (None, merges.CLEAR)}


def test_patch(creatures, first):
    patch = merges.patched(creatures, first, "key", "slug", COLUMNS, {"c": "other"})
    assert sorted(map(tuple, patch.rows.collect()), key=str) == sorted([("a", 12, "plate", None), ("b", 3, None, None), ("c", 7, "hide", None), ("dup", None, None, None), (None, None, "n", None)], key=str)
    assert sorted(map(tuple, patch.report.collect()), key=str) == sorted([("a", "matched"), ("b", "matched"), ("c", "matched"), ("dup", "ambiguous"), (None, "unmatched"), ("spare", "unused")], key=str)
    assert {r.outcome: r.n for r in patch.counts().collect()} == {"matched": 3, "ambiguous": 1, "unmatched": 1, "unused": 1}
    assert patch.rows.schema == creatures.schema


def test_patch_in_part(creatures, first):
    patch = merges.patched(creatures, first, F.lower("key"), "slug", COLUMNS, only=F.col("armor_detail").isNotNull())
    assert {r.key: (r.armor_class, r["a.b"]) for r in patch.rows.collect()} == {"a": (12, None), "b": (3, 2.0), "c": (None, None), "dup": (None, None), None: (None, None)}
    assert {r.key: r.outcome for r in patch.report.collect()}["b"] == "skipped"
    assert merges.patched(creatures.limit(0), first, "key", "slug", COLUMNS).rows.count() == 0
    assert merges.patched(creatures, first.limit(0), "key", "slug", COLUMNS).report.where("outcome != 'unmatched'").isEmpty()


def test_patch_errors(creatures, first):
    with pytest.raises(merges.AmbiguousKeys, match="dup"):
        merges.patched(creatures, first, "key", "slug", COLUMNS, strict=True)
    with pytest.raises(ValueError):
        merges.patched(creatures, first, "key", "slug", {"nothing": ("ac", merges.ALWAYS)})
    with pytest.raises(ValueError):
        merges.patched(creatures, first, "key", "slug", {"armor_class": ("ac", "sometimes")})


def test_converters(spark, first):
    """Two conversions of old records: ability scores copied as they are, a weight only where there is none, by key overrides."""
    old = spark.createDataFrame([("wolf", 12, 15), ("bear", 19, 10)], "slug string, strength int, dexterity int")
    new = spark.createDataFrame([("srd_wolf", 1, 1), ("srd_bear", 1, 1), ("srd_elk", 1, 1)], "key string, ability_score_strength int, ability_score_dexterity int")
    scores = {f"ability_score_{a}": (a, merges.ALWAYS) for a in ("strength", "dexterity")}
    patch = merges.patched(new, old, F.regexp_replace("key", "^srd_", ""), "slug", scores)
    assert sorted(map(tuple, patch.rows.collect())) == [("srd_bear", 19, 10), ("srd_elk", 1, 1), ("srd_wolf", 12, 15)]
    items = spark.createDataFrame([("sword", 3.0), ("sword-1", None), ("magic-blade", None), ("shield-1", 6.5)], "key string, weight double")
    plain = merges.patched(items, items, F.regexp_replace("key", r"-\d$", ""), "key", {"weight": ("weight", merges.IF_NULL)}, {"magic-blade": "sword"}, report_key="key")
    assert {r.key: r.weight for r in plain.rows.collect()} == {"sword": 3.0, "sword-1": 3.0, "magic-blade": 3.0, "shield-1": 6.5}


def test_changes(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), ("c", 3, "z"), (None, 4, "n")], "key string, n int, t string")
    new = spark.createDataFrame([("a", 1, "x"), ("b", None, "2"), ("d", 5, None), (None, 4, "n")], "key string, n int, t string")
    found = merges.changes(old, new, ["key"])
    assert {r.key: r.change for r in found.collect()} == {"a": "same", "b": "replaced", "c": "removed", "d": "added", None: "same"}
    assert tuple(merges.change_counts(found).first()) == (1, 1, 1, 2)
    assert merges.changes(old, new, ["key"], []).where("change = 'replaced'").isEmpty()
    assert tuple(merges.change_counts(merges.changes(old.limit(0), old.limit(0), ["key"])).first()) == (0, 0, 0, 0)


def test_numbered(spark):
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(["a", "a", "a", "a_1", "a_2", "a_1", "b", None, None, "b_1_1", "b"])], "n int, base string")
    got = [r["key"] for r in merges.numbered(rows, F.col("base"), ["n"], "key").orderBy("n").collect()]
    assert len(set(got)) == len(got) and got[:5] == ["a", "a_3", "a_4", "a_1", "a_2"] and got[6:9] == ["b", "_", "__1"]


def test_cascade(spark):
    creatures = spark.createDataFrame([("1", "Red Dragon"), ("2", "Red Dragon"), ("3", "Wolf")], "key string, name string")
    actions = spark.createDataFrame([("10", "1", "Bite"), ("11", "2", "Bite"), ("12", "2", "Bite"), ("13", None, "Claw"), ("14", "gone", "Claw")], "key string, parent string, name string")
    attacks = spark.createDataFrame([("100", "12", "Bite attack"), ("101", "10", "Bite attack")], "key string, parent string, name string")
    sets = spark.createDataFrame([("s", ["3", "1", "gone"]), ("t", None), ("u", [])], "key string, creatures array<string>")
    slug = lambda c: F.regexp_replace(F.lower(c), " ", "-")
    levels = [merges.Level("creature", "key", slug("name")), merges.Level("action", "key", F.concat_ws("_", "parent", slug("name"))), merges.Level("attack", "key", F.concat_ws("_", "parent", slug("name")))]
    out = merges.cascade({"creature": creatures, "action": actions, "attack": attacks, "set": sets}, levels, [("action", "parent", "creature"), ("attack", "parent", "action"), ("set", "creatures", "creature")])
    assert {r.key: r.name for r in out.tables["creature"].collect()} == {"red-dragon": "Red Dragon", "red-dragon_1": "Red Dragon", "wolf": "Wolf"}
    assert {(r.key, r.parent) for r in out.tables["action"].collect()} == {("red-dragon_bite", "red-dragon"), ("red-dragon_1_bite", "red-dragon_1"), ("red-dragon_1_bite_1", "red-dragon_1"), ("claw", None), ("gone_claw", "gone")}
    assert {(r.key, r.parent) for r in out.tables["attack"].collect()} == {("red-dragon_1_bite_1_bite-attack", "red-dragon_1_bite_1"), ("red-dragon_bite_bite-attack", "red-dragon_bite")}
    assert {r.key: r.creatures for r in out.tables["set"].collect()} == {"s": ["wolf", "red-dragon", "gone"], "t": None, "u": []}
    assert out.maps["attack"].count() == 2


def test_versions(spark, tmp_path):
    store = Versions(spark, str(tmp_path))
    assert store.current() is None and store.read() is None
    store.write(spark.createDataFrame([("srd", "a")], "document string, key string"), "document")
    spark.range(1).write.parquet(store.new_folder())  # a run that ended before it was published
    assert [r.key for r in store.read().collect()] == ["a"]
    for k in ("b", "c"):
        store.write(spark.createDataFrame([("srd", k)], "document string, key string"), "document")
    assert [r.key for r in store.read().collect()] == ["c"] and len(store.numbers()) == 3
    assert len(store.prune(1)) == 2 and [r.key for r in store.read().collect()] == ["c"]


def test_word_links(spark):
    from quillspark.operators.synonyms import word_links

    rows = spark.createDataFrame([(1, ["Forest", " hills ", "Forest"]), (2, ["ANY"]), (3, ["lava", None, ""]), (4, None), (5, ["Woods", "lava"])], "id int, words array<string>")
    places = spark.createDataFrame([("forest",), ("hill",), ("jungle",), (None,)], "key string")
    found = word_links(rows, "id", F.col("words"), places, synonyms={"hills": "hill", "woods": ["forest", "jungle"], "Sea": "ocean"})
    assert {tuple(r) for r in found.links.collect()} == {(1, "forest"), (1, "hill"), (2, "forest"), (2, "hill"), (2, "jungle"), (5, "forest"), (5, "jungle")}
    assert {tuple(r) for r in found.unknown.collect()} == {("lava", 2)}
    assert word_links(rows.limit(0), "id", F.col("words"), places).links.count() == 0 and word_links(rows, "id", F.col("words"), places.limit(0), every=[]).links.count() == 0


def test_check_parents(spark):
    from quillspark.operators.filters import FilterSet, UnknownValues, check_parents, split_by
    from quillspark.plans.list_query import Listing

    sizes = spark.createDataFrame([("small",), ("large",)], "key string")
    kinds = spark.createDataFrame([("beast",)], "key string")
    parents = {"size": (sizes, "key"), "type": (kinds, "key")}
    check_parents({"size": "small", "type__in": "beast", "other": "x", "type": ""}, parents)
    with pytest.raises(UnknownValues) as raised:
        check_parents({"size__in": "small,huge,tiny", "type": "plant", "name": "x"}, parents)
    assert raised.value.errors == {"size__in": ["huge", "tiny"], "type": ["plant"]}
    rows = spark.createDataFrame([("a", "small"), ("b", None)], "key string, size string")
    listing = Listing(rows, "key", FilterSet({"size": ["exact"]}), parents=parents)
    assert listing.rows_of({"size": "small"}).count() == 1
    with pytest.raises(UnknownValues):
        listing.rows_of({"size": "huge"})
    some, rest = split_by(rows, F.col("size") == "small")
    assert [r.key for r in some.collect()] == ["a"] and [r.key for r in rest.collect()] == ["b"]


def test_choices_of_the_first_schema(spark):
    from quillspark.plans.first_schema import outside

    rows = spark.createDataFrame([("a", "evocation", "fire", "cone"), ("b", "Evocation", "ice", None)], "slug string, school string, damage string, area string")
    assert {(r.key, r.column) for r in outside(rows, damage_type="damage", shape="area").collect()} == {("b", "school"), ("b", "damage")}


def test_cascade_makes_each_table_once(spark):
    """A level's table isn't joined with the map of its own keys."""
    rows = spark.createDataFrame([("1", "a"), ("2", "a"), (None, "b")], "key string, name string")
    out = merges.cascade({"t": rows}, [merges.Level("t", "key", F.col("name"))], []).tables["t"]
    assert {(r.key, r.name) for r in out.collect()} == {("a", "a"), ("a_1", "a"), (None, "b")}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
