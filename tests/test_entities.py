"""The catalogue from fixture files: nesting, derived columns, listings, checks."""

import json

import pytest

from quillspark.plans.catalogue import ENTITIES, Catalogue


def record(model, pk, **fields):
    return {"model": f"api_v2.{model}", "pk": pk, "fields": fields}


@pytest.fixture(scope="module")
def catalogue(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("fixtures")
    scores = {f"ability_score_{a}": n for a, n in zip(("strength", "dexterity", "constitution", "intelligence", "wisdom", "charisma"), (8, 15, 10, 3, 12, 7))}
    rows = [
        record("document", "srd", name="Rules", display_name=" ", publisher="pub", gamesystem="5e", licenses=["l"], distance_unit="feet"), record("publisher", "pub", name="P"), record("gamesystem", "5e", name="5e"),
        record("size", "small", name="Small", document="srd", rank=1, space_diameter=5.0), record("creaturetype", "beast", name="Beast", document="srd"),
        record("creature", "srd_goblin", name="Goblin", document="srd", type="beast", size="small", walk=30.0, climb=None, challenge_rating="0.250", armor_class=15, hit_points=7, saving_throw_dexterity=5, skill_bonus_stealth=6, languages=["common"], weight="40.000", **scores),
        record("creature", "srd_rat", name="Rat", document="gone", type="beast", size="small", walk=20, fly=10.0, challenge_rating="99", armor_class=200, hit_points=1, **scores),
        record("creatureaction", "a2", name="Second", desc="Bites hard", parent="srd_goblin", order_in_statblock=2, uses_type="PER_DAY", uses_param=0), record("creatureaction", "a1", name="First", desc="d", parent="srd_goblin", order_in_statblock=1, uses_type="PER_DAY", uses_param=3),
        record("creatureactionattack", "t", name="Hit", parent="a1", attack_type="WEAPON", to_hit_mod=4, reach=5.0),
        record("weapon", "club", name="Club", document="srd", is_simple=True, damage_dice="1d4", damage_type="x", range=0, long_range=0.0), record("weaponproperty", "light", name="Light", document="srd", desc=""), record("weaponpropertyassignment", "as", document="srd", weapon="club", property="light", detail="d"),
        record("characterclass", "bard", name="Bard", document="srd", hit_dice="D8", desc="Sings", saving_throws=[]), record("characterclass", "lore", name="Lore", document="srd", subclass_of="bard", desc="x"),
        record("classfeature", "f", name="Song", document="srd", parent="bard", desc="Heals"), record("classfeatureitem", "i1", parent="f", level=3, column_value="1d6"), record("classfeatureitem", "i2", parent="f", level=2),
        record("condition", "blind", name="Blinded", document="srd"), record("conditiondescription", "cd", desc="Can't see", document="srd", describes="blind"),
    ]
    (root / "deep").mkdir()
    (root / "deep" / "All.json").write_text(json.dumps(rows))
    return Catalogue.load(spark, str(root), store=str(tmp_path_factory.mktemp("store")))


def test_tables(catalogue):
    assert set(catalogue.tables) == set(ENTITIES) and catalogue.creature.count() == 2 and catalogue.feat.count() == 0
    assert str(catalogue.creature.where("key = 'srd_goblin'").first().weight) == "40.000"


def test_creatures(catalogue):
    goblin = catalogue.listings()["creatures"].rows_of({"key": "srd_goblin"}).first()
    assert [a.name for a in goblin.actions] == ["First", "Second"] and goblin.actions[0].attacks[0].to_hit_mod == 4
    assert goblin.actions[0].usage_limits.param == 3 and goblin.actions[1].usage_limits is None
    assert (goblin.modifiers.strength, goblin.modifiers.intelligence, goblin.saving_throws_all.dexterity, goblin.saving_throws_all.wisdom) == (-1, -4, 5, 1)
    assert (goblin.skill_bonuses_all.stealth, goblin.skill_bonuses_all.acrobatics) == (6, 2)
    assert (goblin.speed_all.climb, goblin.speed_all.fly, goblin.experience_points, goblin.initiative, goblin.distance_unit) == (15.0, 0.0, 50, 2, "feet")
    assert goblin.document.name == "Rules"


def test_requests(catalogue):
    creatures = catalogue.listings()["creatures"]
    found = creatures.request({"hit_points__lte": 7, "ordering": "-hit_points", "fields": "key,document", "document__fields": "key", "limit": 1})
    assert (found.count, found.next, [r.asDict(True) for r in found.rows.collect()]) == (2, 2, [{"key": "srd_goblin", "document": {"key": "srd"}}])
    assert [r.key for r in creatures.rows_of({"document__key__in": "srd,x"}).collect()] == ["srd_goblin"]
    assert [r.key for r in catalogue.listings()["classes"].rows_of({"is_subclass": True}).collect()] == ["lore"]


def test_classes_weapons_and_descriptions(catalogue):
    bard = catalogue.classes().where("key = 'bard'").first()
    assert [x.level for x in bard.features[0].data_for_class_table] == [3] and [x.level for x in bard.features[0].gained_at] == [2]
    assert bard.hit_points.hit_dice_name == "1D8 per Bard level" and not bard.is_subclass
    assert catalogue.weapons().first().properties[0].property_name == "Light"
    assert catalogue.descriptions("condition").first().descriptions[0].gamesystem == "5e"


def test_checks(catalogue):
    lost = {(r.table, r.key, r.column, r.value) for r in catalogue.violations().collect()}
    assert lost == {("creature", "srd_rat", "document", "gone"), ("creature", "srd_goblin", "languages", "common"), ("weapon", "club", "damage_type", "x")}
    assert {(r.key, r.column) for r in catalogue.out_of_bounds().collect()} == {("srd_rat", "challenge_rating"), ("srd_rat", "armor_class")}
    assert {(r.document, r.model): r.actual_count for r in catalogue.stats().collect()}["srd", "characterclass"] == 2


def test_corpus(catalogue):
    rows = {r.object_pk: r.text for r in catalogue.corpus().collect()}
    assert "Bites hard" in rows["srd_goblin"] and "Heals" in rows["bard"]


def test_enumerations(spark, catalogue):
    from quillspark.plans import enums

    assert {(r.key, r.column, r.value) for r in enums.outside(catalogue.tables).collect()} == set()
    assert enums.catalogue_of(spark).where("entity = 'spell' AND column = 'casting_time'").count() == 16


def test_urls(spark):
    from pyspark.sql import functions as F

    from quillspark.functions import urls

    v = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert v(urls.object_url(F.lit("CharacterClass"), F.lit("bard"))) == "/v2/classes/bard/"
    assert v(urls.object_url(F.lit("ConditionDescription"), F.lit("d"), F.lit("Condition"), F.lit("blind"))) == "/v2/conditions/blind/"
    assert v(urls.search_route(F.lit("v1"), F.lit("Monster"))) == "v1/monsters/"
    routes = {"WeaponProperty": "weaponproperties", "SpeciesTrait": "species", "FeatBenefit": "feats", "CreatureAction": "creatures", "SpellCastingOption": "spells", "AbilityDescription": "abilities", "ClassFeatureItem": "classes", "Item": "items", "ItemRarity": "itemrarities"}
    assert {k: v(urls.route(F.lit(k))) for k in routes} == routes
    assert v(urls.newer_path(F.lit("creatures"), F.lit("doc"), F.lit("Big Rat"), F.lit(True))) == "/v2/creatures/doc_big-rat/"


def test_export(spark, catalogue, tmp_path):
    from quillspark.sources import exports

    items = exports.scoped(catalogue.classfeatureitem, [(catalogue.classfeature, "parent"), (catalogue.characterclass, "parent")])
    assert {r.document for r in items.collect()} == {"srd"}
    exports.export({"weapon": catalogue.weapon, "condition": catalogue.condition, "feat": catalogue.feat}, catalogue.document, str(tmp_path / "out"))
    again = spark.read.json(str(tmp_path / "out"))
    assert {(r.publisher, r.document, r.model, r.pk) for r in again.collect()} == {("pub", "srd", "weapon", "club"), ("pub", "srd", "condition", "blind")}


def test_ranks_have_no_gaps(spark):
    from quillspark.plans.search import ranked

    rows = [(f"k{i:03d}", i % 3, -((i * 7) % 11) / 4.0) for i in range(300)]
    df = spark.createDataFrame(rows, "object_pk string, type_rank int, score double").repartition(7)
    found = ranked(df).collect()
    expected = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    assert [(r.object_pk, r.rank) for r in sorted(found, key=lambda r: r.rank)] == [(r[0], i) for i, r in enumerate(expected)]
    assert ranked(df.limit(0)).count() == 0
