"""Scope, dry runs and kept edges of link runs on a catalogue of two documents."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.plans import references
from quillspark.plans.catalogue import Catalogue
from quillspark.sources.versions import Versions


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("fixtures")
    record = lambda model, pk, **fields: {"model": f"api_v2.{model}", "pk": pk, "fields": fields}
    rows = [
        record("document", "one", name="One", publisher="p"), record("document", "two", name="Two", publisher="p"), record("publisher", "p", name="P"),
        record("spell", "one_fireball", name=" Fireball ", document="one", desc="Like Fire Bolt, but larger. Fireball burns."), record("spell", "one_bolt", name="Fire Bolt", document="one", desc="A bolt."), record("spell", "two_fireball", name="Fireball", document="two", desc="See Fire Bolt."),
        record("condition", "blinded", name="Blinded", document="one"), record("conditiondescription", "cd", desc="A Blinded creature can't see Fireball.", document="one", describes="blinded"),
        record("creature", "one_wolf", name="Wolf", document="one", desc=""), record("creatureaction", "wolf_bite", name="Bite", desc="The target is Blinded.", parent="one_wolf"), record("creatureactionattack", "wolf_bite_a", name="Blinded", parent="wolf_bite"),
        record("creature", "two_wolf", name="Wolf", document="two"), record("creatureaction", "wolf2_bite", name="Bite", desc="The target is Blinded.", parent="two_wolf"),
        record("characterclass", "bard", name="Bard", document="one", desc="A Bard casts Fireball on the 3rd day."), record("characterclass", "lore", name="Lore", document="one", subclass_of="bard", desc="A Bard who knows Fire Bolt."), record("classfeature", "song", name="Song", document="one", parent="bard", desc="The Bard is Blinded."),
        record("rule", "r", name="3rd", document="one", desc="  "), record("feat", "f", name=" ", document="one", desc="Nothing"),
    ]
    (root / "All.json").write_text(json.dumps(rows))
    return references.ReferenceRuns(Catalogue.load(spark, str(root), store=str(tmp_path_factory.mktemp("store"))))


def test_paths():
    assert references.path_to_document("spell") == ["spell"] and references.path_to_document("creatureactionattack") == ["creatureactionattack", "creatureaction", "creature"]
    assert references.path_to_document("gamesystem") is None and references.TYPES["weaponproperty"] == "WeaponProperty" and references.TYPES["spell"] == "Spell"


def test_scope(runs):
    names = {(r.type, r.key, r.name) for r in runs.candidates("one").collect()}
    assert names == {("Spell", "one_fireball", "Fireball"), ("Spell", "one_bolt", "Fire Bolt"), ("Condition", "blinded", "Blinded"), ("CharacterClass", "bard", "Bard"), ("CharacterClass", "lore", "Lore"), ("ClassFeature", "song", "Song"), ("Rule", "r", "3rd")}
    keys = {r.key for r in runs.sources("one").collect()}
    assert {"one_fireball", "cd", "wolf_bite", "bard", "song"} <= keys and not keys & {"two_fireball", "wolf2_bite", "wolf_bite_a", "one"}
    assert {r.key for r in runs.sources("two").collect()} == {"two_fireball", "wolf2_bite", "two_wolf"}
    assert {r.key for r in runs.sources("one", "CreatureAction").collect()} == {"wolf_bite"}
    with pytest.raises(LookupError):
        runs.found("three")


def edges_of(df):
    return {(r.source_key, r.reference_key) for r in df.collect()}


ONE = {("one_fireball", "one_bolt"), ("cd", "blinded"), ("cd", "one_fireball"), ("wolf_bite", "blinded"), ("bard", "one_fireball"), ("lore", "one_bolt"), ("song", "blinded")}


def test_found(runs):
    assert edges_of(runs.found("one")) == ONE and edges_of(runs.found("two")) == set()


def test_runs_count_before_they_write(spark, runs, tmp_path):
    store = Versions(spark, str(tmp_path))
    none = runs.found("two")
    first = runs.applied(none, "one")
    assert first.counts() == {"added": 7, "replaced": 0, "removed": 0, "same": 0} and store.current() is None
    references.publish(first, store)
    stale = spark.createDataFrame([("Spell", "one_bolt", "Feat", "gone", "Gone", "stale", "one"), ("Spell", "two_fireball", "Feat", "x", "X", "other", "two")], store.read().schema)
    edges = store.read().unionByName(stale)
    assert runs.applied(edges, "one").counts() == {"added": 0, "replaced": 0, "removed": 0, "same": 9}
    again = runs.applied(edges, "one", replace=True)
    assert again.counts() == {"added": 0, "replaced": 0, "removed": 1, "same": 8}
    references.publish(again, store)
    assert edges_of(store.read()) == ONE | {("two_fireball", "x")}
    assert runs.deleted(store.read(), "one", "ConditionDescription").counts() == {"added": 0, "replaced": 0, "removed": 2, "same": 6}
    assert runs.deleted(store.read(), keys=spark.createDataFrame([("blinded",)], "key string")).counts()["removed"] == 3
    with pytest.raises(ValueError):
        runs.deleted(store.read())


def test_exclusions(spark, runs):
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    fewer = references.ReferenceRuns(runs.catalogue, keys("cd", "bard"), keys("one_bolt"))
    assert edges_of(fewer.found("one")) == {("wolf_bite", "blinded"), ("song", "blinded")}


def test_records(runs):
    edges = runs.found("one")
    records = references.as_records(edges)
    row = records.where("source_object_key = 'song'").first()
    assert row.source_content_type == ["api_v2", "classfeature"] and set(records.columns) <= set(runs.catalogue.crossreference.columns)
    assert {tuple(r) for r in references.from_records(records).collect()} == {tuple(r) for r in edges.collect()}


def test_corpus_has_extras_and_environments(runs):
    rows = {r.object_pk: r for r in runs.catalogue.corpus().collect()}
    assert json.loads(rows["lore"].extra) == {"subclass_of": {"name": "Bard", "key": "bard"}} and json.loads(rows["bard"].extra) == {"subclass_of": None}
    assert rows["one_wolf"].document_name == "One" and json.loads(rows["one_wolf"].extra) == {"cr": None, "type": None, "size": None}


def test_attacks_in_full(runs):
    wolf = runs.catalogue.creatures().where(F.col("key") == "one_wolf").first()
    assert {"damage_type", "extra_damage_type", "long_range", "distance_unit", "target_creature_only", "extra_damage_die_count"} <= set(wolf.actions[0].attacks[0].asDict())
