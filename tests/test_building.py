"""Fixture files that are exported, read and exported again, and builds that read only what changed."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.plans import exporting
from quillspark.plans.building import CatalogueStore, UnreadableFixture
from quillspark.plans.catalogue import Catalogue
from quillspark.sources import exports


def record(model, pk, **fields):
    return {"model": f"api_v2.{model}", "pk": pk, "fields": fields}


ROWS = {
    "v2/License.json": [record("license", "ogl", name="OGL", desc="Text\nof \"it\"")],
    "v2/pub/Publisher.json": [record("publisher", "pub", name="Pub")],
    "v2/pub/srd/Document.json": [record("document", "srd", name="Rules", publisher="pub", licenses=["ogl"], publication_date="2023-01-31T00:00:00")],
    "v2/pub/srd/Spell.json": [record("spell", "b", name="B", document="srd", level=1, range=30.0, classes=[], material_cost=None), record("spell", "a", name="Ä, [x]", document="srd", level=0)],
    "v2/pub/srd/Creature.json": [record("creature", "wolf", name="Wolf", document="srd", challenge_rating="0.250", weight="40.000", hover=False)],
    "v2/pub/srd/CreatureAction.json": [record("creatureaction", "bite", name="Bite", parent="wolf", order_in_statblock=1)],
    "v2/pub/srd/CreatureActionAttack.json": [record("creatureactionattack", "hit", name="Hit", parent="bite", to_hit_mod=4)],
    "v2/pub/srd/CrossReference.json": [record("crossreference", "e", anchor="B", document="srd", source_content_type=["api_v2", "spell"], source_object_key="a", reference_content_type=["api_v2", "spell"], reference_object_key="b")],
    "v2/pub/other/Document.json": [record("document", "other", name="Other", publisher="pub")],
}


@pytest.fixture
def fixtures(tmp_path):
    root = tmp_path / "in"
    for place, rows in ROWS.items():
        (root / place).parent.mkdir(parents=True, exist_ok=True)
        (root / place).write_text(json.dumps(rows))
    return root


def contents(root: Path) -> dict[str, bytes]:
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*.json")}


def test_export_reads_back(spark, fixtures, tmp_path):
    first, second = tmp_path / "first", tmp_path / "second"
    places = exporting.export_catalogue(Catalogue.load(spark, str(fixtures), store=str(tmp_path / "s1")), str(first))
    assert set(places) == set(ROWS) | {"v2/pub/other/CrossReference.json"} == set(contents(first))
    assert contents(first)["v2/pub/other/CrossReference.json"] == b"[]\n"
    spells = json.loads(contents(first)["v2/pub/srd/Spell.json"])
    assert [s["pk"] for s in spells] == ["a", "b"] and spells[1]["fields"]["range"] == 30.0 and spells[1]["fields"]["material_cost"] is None
    assert json.loads(contents(first)["v2/pub/srd/Creature.json"])[0]["fields"]["challenge_rating"] == "0.250"
    exporting.export_catalogue(Catalogue.load(spark, str(first), store=str(tmp_path / "s2")), str(second))
    assert contents(first) == contents(second)
    assert not [p for p in first.iterdir() if p.name.startswith(".draft")]


def test_export_replaces_and_keeps(spark, tmp_path):
    rows = spark.createDataFrame([("m/A.json", f"{i:04d}", f'{{"pk":"{i:04d}"}}') for i in range(500)] + [("B.json", "x", "{}")], "place string, pk string, text string").repartition(7)
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "A.json").write_text("old")
    (tmp_path / "Other.json").write_text("[]")
    assert exports.write_arrays(rows, str(tmp_path), ["B.json", "E.json"]) == ["B.json", "E.json", "m/A.json"]
    assert [r["pk"] for r in json.loads((tmp_path / "m" / "A.json").read_text())] == [f"{i:04d}" for i in range(500)]
    assert (tmp_path / "Other.json").exists() and json.loads((tmp_path / "E.json").read_text()) == []
    with pytest.raises(Exception, match="no place"):
        exports.write_arrays(rows.withColumn("place", F.lit(None).cast("string")), str(tmp_path))
    assert exports.write_arrays(rows.limit(0), str(tmp_path)) == []


def test_append(spark, tmp_path):
    one = spark.createDataFrame([("a", '{"fields":{"n":1},"model":"m","pk":"a"}'), ("b", '{"fields":{"n":2.50},"model":"m","pk":"b"}')], "pk string, text string")
    exports.appended(spark, str(tmp_path), "x/M.json", one)
    exports.appended(spark, str(tmp_path), "x/M.json", spark.createDataFrame([("a", '{"fields":{"n":9},"model":"m","pk":"a"}'), ("c", '{"fields":{},"model":"m","pk":"c"}')], "pk string, text string"))
    assert [(r["pk"], r["fields"]) for r in json.loads((tmp_path / "x" / "M.json").read_text())] == [("a", {"n": 9}), ("b", {"n": 2.5}), ("c", {})]


def test_build_reads_what_changed(spark, fixtures, tmp_path):
    store = CatalogueStore(spark, str(fixtures), str(tmp_path / "store"))
    assert store.load() is None
    first = store.build()
    assert len(first.read) == len(ROWS) and first.records == 10 and store.load().spell.count() == 2
    again = store.build()
    assert again.read == [] and again.rebuilt == [] and again.version == first.version
    (fixtures / "v2/pub/srd/Spell.json").write_text(json.dumps(ROWS["v2/pub/srd/Spell.json"] + [record("spell", "c", name="C", document="srd")]))
    (fixtures / "v2/pub/srd/CreatureActionAttack.json").unlink()
    third = store.build()
    assert [p.rsplit("/", 1)[-1] for p in third.read] == ["Spell.json"] and set(third.rebuilt) == {"spell", "creatureactionattack"}
    now = store.load()
    assert now.spell.count() == 3 and now.creatureactionattack.count() == 0 and now.creature.count() == 1
    assert {(r.path.rsplit("/", 1)[-1], r.rows) for r in store.outcomes().where("model = 'api_v2.spell'").collect()} == {("Spell.json", 3)}


def test_build_stops_at_what_it_cant_read(spark, fixtures, tmp_path):
    store = CatalogueStore(spark, str(fixtures), str(tmp_path / "store"))
    (fixtures / "v2/pub/srd/Feat.json").write_text('{"model": ')
    (fixtures / "v2/pub/srd/Able.json").write_text("[1, 2]")
    with pytest.raises(UnreadableFixture, match="Able.json"):
        store.build()
    assert store.load() is None
    build = store.build(strict=False)
    assert build.unreadable >= 2 and store.load().spell.count() == 2
