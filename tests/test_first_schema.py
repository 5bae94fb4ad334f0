"""The first schema from fixture files: listings, filters, JSON parts, corpus."""

import json

import pytest

from quillspark.plans.first_schema import ENTITIES, FirstCatalogue, outside


def record(model, pk, **fields):
    return {"model": f"api.{model}", "pk": pk, "fields": fields}


@pytest.fixture(scope="module")
def first(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("first")
    rows = [
        record("document", 32, slug="srd", title="Rules", license_url="l", url="u"), record("document", 33, slug="more", title="More", license_url="l", url="u"),
        record("spell", "aid", name="Aid", desc="Helps", document=32, spell_level=2, dnd_class="Cleric, Paladin", school="abjuration", requires_verbal_components=True, requires_somatic_components=True, requires_material_components=False, can_be_cast_as_ritual=False, requires_concentration=True),
        record("spell", "bane", name="Bane", desc="Harms", document=33, spell_level=0, dnd_class="Bard", school="Odd", requires_verbal_components=False, requires_material_components=True, can_be_cast_as_ritual=True, requires_concentration=False),
        record("spelllist", "cleric", name="cleric", desc="", document=32, spells=["aid", "gone"]),
        record("monster", "rat", name="Rat", desc="Gnaws", document=32, cr=0.125, hit_points=1, speed_json='{"walk": 20, "hover": true}', environments_json='["Sewer", "City"]', skills_json='{"stealth": 4}', actions_json='[{"name": "Bite", "attack_bonus": 1}]', bonus_actions_json=None, reactions_json="", img_main="a.png", strength=3),
        record("monster", "ox", name="Ox", desc="", document=99, cr=1, hit_points=9), record("monsterspell", 1, spell="aid", monster="rat"),
        record("race", "elf", name="Elf", desc="d", document=32, asi_json='[{"attributes": ["Dexterity"], "value": 2}]', speed_json='{"walk": 30}'), record("subrace", "high", name="High", desc="d", document=32, parent_race="elf", asi_json="[]"),
        record("charclass", "bard", name="Bard", desc="d", document=32, hit_dice="1d8"), record("archetype", "lore", name="Lore", desc="d", document=32, char_class="bard"),
        record("armor", "plate", name="Plate", desc="", document=32, base_ac=14, plus_dex_mod=True, plus_flat_mod=0, plus_max=3), record("armor", "shield", name="Shield", desc="", document=32, base_ac=0, plus_flat_mod=2, plus_max=0),
        record("feat", "grappler", name="Grappler", desc="", document=32, effects_desc_json='["a", "b"]'), record("weapon", "axe", name="Axe", desc="", document=32, properties_json=""),
        record("section", "s", name="S", desc="x", document=32, parent="Rules"),
    ]
    (root / "All.json").write_text(json.dumps(rows))
    return FirstCatalogue.load(spark, str(root), store=str(tmp_path_factory.mktemp("first-store")))


def keys(listing, **params):
    return [r.slug for r in listing.rows_of(params).collect()]


def test_spells(first):
    spells = first.listings()["spells"]
    aid = spells.rows_of({"slug": "aid"}).first()
    assert (aid.level, aid.level_int, aid.components, aid.ritual, aid.concentration, aid.spell_lists, aid.document__title) == ("2nd-level", 2, "V, S", "no", "yes", ["cleric"], "Rules")
    assert keys(spells) == ["aid", "bane"] and keys(spells, ordering="-name") == ["bane", "aid"]
    assert keys(spells, spell_lists="cleric") == ["aid"] and keys(spells, spell_lists_not="cleric") == ["bane"]
    assert keys(spells, document__slug__not_in="srd,x") == ["bane"] and keys(spells, dnd_class__icontains="paladin") == ["aid"]
    assert keys(spells, level_int=0) == ["bane"] and keys(spells, spell_level__gte=1) == ["aid"] and keys(spells, concentration="no") == ["bane"]
    assert keys(spells, search="bard harms") == ["bane"] and keys(spells, components="M") == ["bane"]
    assert spells.rows_of({"fields": "slug,level"}).columns == ["slug", "level"]


def test_monsters(first):
    monsters = first.listings("http://host/")["monsters"]
    rat = monsters.rows_of({"environments": "sewer"}).first()
    assert (rat.speed["walk"], rat.environments, rat.skills, rat.actions[0]["name"], rat.bonus_actions, rat.reactions) == ("20", ["Sewer", "City"], {"stealth": 4}, "Bite", [], [])
    assert (rat.spell_list, rat.img_main, rat.cr) == (["aid"], "http://host/a.png", 0.125)
    assert keys(monsters) == ["rat"] and keys(monsters, cr__range="0,0.125") == ["rat"]


def test_nested(first):
    elf = first.races().first()
    assert (elf.asi[0].attributes, elf.asi[0].value, [s.slug for s in elf.subraces], elf.subraces[0].asi) == (["Dexterity"], 2, ["high"], [])
    assert [a.slug for a in first.classes().first().archetypes] == ["lore"]
    assert {r.slug: r.ac_string for r in first.armors().collect()} == {"plate": "14 + Dex modifier (max 2)", "shield": "0 +2"}
    assert first.listings()["feats"].rows.first().effects_desc == ["a", "b"] and first.listings()["weapons"].rows.first().properties is None
    assert [r.title for r in first.listings()["documents"].rows_of({"slug": "more"}).collect()] == ["More"]


def test_checks_and_corpus(first):
    assert set(first.tables) == set(ENTITIES) and [(r.key, r.value) for r in outside(first.tables["spell"]).collect()] == [("bane", "Odd")]
    assert sorted((r.table, r.key, r.value) for r in first.violations().collect()) == [("monster", "ox", "99"), ("spelllist", "cleric", "gone")]
    rows = {r.object_pk: r for r in first.corpus().collect()}
    assert rows["aid"].text == "Aid\nHelps" and (rows["aid"].schema_version, rows["aid"].object_model, rows["aid"].document_pk) == ("v1", "Spell", "srd")
    assert json.loads(rows["s"].extra) == {"parent": "Rules"} and "lore" not in rows and "ox" not in rows and rows["plate"].extra is None
