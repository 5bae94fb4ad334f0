"""Addresses of entries."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import slug

# Routes that aren't the type in lower case with an s.
ROUTES = {
    "CharacterClass": "classes",
    "CharClass": "classes",
    "Species": "species",
    "Armor": "armor",
    "Ability": "abilities",
    "ItemCategory": "itemcategories",
    "ItemRarity": "itemrarities",
    "WeaponProperty": "weaponproperties",
}
# Routes of search hits that aren't the type in lower case with an s.
SEARCH_ROUTES = {"CharacterClass": "classes", "CharClass": "classes", "Species": "species"}
# Types without a route of their own, and the type whose route they have. Descriptions have that of what they describe.
OWNERS = {
    "SpeciesTrait": "Species",
    "FeatBenefit": "Feat",
    "BackgroundBenefit": "Background",
    "CreatureTrait": "Creature",
    "CreatureAction": "Creature",
    "SpellCastingOption": "Spell",
    "ClassFeature": "CharacterClass",
    "ClassFeatureItem": "CharacterClass",
}
#: Types that are addressed through what they describe or belong to.
NESTED = ["ClassFeature"]


def _of(table: dict[str, str], kind: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), kind)


def route(kind: Column) -> Column:
    owner = F.coalesce(_of(OWNERS, kind), F.regexp_replace(kind, "Description$", ""))
    return F.coalesce(_of(ROUTES, owner), F.concat(F.lower(owner), F.lit("s")))


def search_route(schema: Column, kind: Column) -> Column:
    """v2/spells/: the type in lower case with an s, but for a few; not always the address that objects have."""
    return F.concat_ws("/", schema, F.coalesce(_of(SEARCH_ROUTES, kind), F.concat(F.lower(kind), F.lit("s"))), F.lit(""))


def object_url(kind: Column, key: Column, parent_kind: Column | None = None, parent: Column | None = None) -> Column:
    """/v2/route/key/; a description or another nested type has its parent's address, if there is one."""
    if parent is not None:
        nested = (kind.contains("Description") | kind.isin(*NESTED)) & parent.isNotNull()
        kind, key = F.when(nested, parent_kind).otherwise(kind), F.when(nested, parent).otherwise(key)
    return F.concat(F.lit("/v2/"), route(kind), F.lit("/"), key, F.lit("/"))


def static_url(root: str, path: Column) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), path)


def newer_path(resource: Column, document: Column, name: Column, keyed_by_document: Column) -> Column:
    """Where an entry of the first schema would be in the second: resource/document_slug/, without the document for some types."""
    key = F.when(keyed_by_document, F.concat_ws("_", document, slug(name))).otherwise(slug(name))
    return F.concat(F.lit("/v2/"), resource, F.lit("/"), key, F.lit("/"))
