"""Conversions of older records on small rows."""

from pyspark.sql import functions as F

from quillspark.functions import conversions as c
from quillspark.operators import quality
from quillspark.plans import linking


def test_columns(spark):
    v = lambda column: spark.range(1).select(column.alias("x")).first().x
    s = F.lit
    assert tuple(v(c.keyword_context(s("It deals Fire damage to all"), "fire", 6))) == (True, "deals Fire damag")
    assert v(c.near_any(s("resist cold fire"), "fire", ["cold"])) and not v(c.near_any(s("x"), "fire", ["cold"]))
    assert [v(c.word_before(s(x), "save")) for x in ("a Dexterity save now", "save first", "none")] == ["Dexterity", None, None]
    assert v(c.damage_list(s("Fire, cold; bludgeoning and piercing from nonmagical attacks, poison"))) == ["fire", "cold", "bludgeoning", "piercing", "slashing"]
    assert v(c.damage_list(s(None).cast("string"))) == []
    assert tuple(v(c.language_list(s("Common, telepathy 60 ft."), ["common", "elvish"]))) == (["common"], 60.0)
    assert v(c.language_list(s("all, telepathy 120 ft."), ["common", "elvish"]))["keys"] == ["common", "elvish"]
    assert v(c.skills_from_json(s('{"Sleight of Hand": 4, "arcana": 2}')))["sleight_of_hand"] == 4
    assert v(c.speeds_from_json(s('{"walk": 30, "fly": 60, "hover": true}'))).asDict() == {"walk": 30.0, "fly": 60.0, "swim": None, "burrow": None, "climb": None, "hover": True}
    assert v(c.scores_from_table(s("| STR | 10 | +0 |\n| Dex | 14 | +2 |")))["dexterity"] == 14
    assert [v(c.tier_dice(s("1d10"), s(n))) for n in (1, 5, 11, 20)] == ["1d10", "2d10", "3d10", "4d10"]
    assert v(c.slot_dice(s("8d6"), s(1), s(3), s(5))) == "10d6"
    assert v(c.target_count(s(1), s(1), s(5), s(2))) == 3
    assert v(c.first_keyword(s("A Very Rare ring"), {"very rare": "vr", "rare": "r"})) == "vr"
    assert v(c.attack_types(s("Melee or Ranged Weapon Attack"))) == ["melee", "ranged"]
    assert v(c.level_of_hit_points(s(27), s(8), s(14))) == 4
    assert v(c.nth_level(s("At 3rd level you"))) == 3


def test_rows(spark):
    spells = spark.createDataFrame([("a", 0, False), ("b", 8, True), ("c", 9, False)], "key string, level int, ritual boolean")
    assert sorted((r.parent, r.type) for r in c.casting_options(spells).collect()) == [("a", "default"), ("a", "player_level_11"), ("a", "player_level_17"), ("a", "player_level_5"), ("b", "default"), ("b", "ritual"), ("b", "slot_level_9"), ("c", "default")]
    options = spark.createDataFrame([("a",)], "parent string")
    assert sorted(r.key for r in quality.without_children(spells, options, "key", "parent").collect()) == ["b", "c"]


def test_edges(spark):
    edges = spark.createDataFrame([("e1", "d1", "Spell", "s1", "r1"), ("e2", "d2", "Feat", "s2", "r2"), ("e3", "d2", "Spell", "s3", "r1")], "key string, document string, source_type string, source_key string, reference_key string")
    keys = spark.createDataFrame([("r2",)], "key string")
    assert [r.key for r in linking.deleted(edges, documents=["d1"], keys=keys).collect()] == ["e3"]
    new = spark.createDataFrame([("e3", "d2", "Spell", "s3", "r9"), ("e4", "d2", "Spell", "s4", "r1")], edges.schema)
    assert sorted((r.key, r.reference_key) for r in linking.applied(edges, new, ["d1"]).collect()) == [("e2", "r2"), ("e3", "r9"), ("e4", "r1")]
