"""The catalogue's first schema: flat entities that name their document, with parts kept as JSON text."""

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import derived
from quillspark.operators import joins, quality
from quillspark.operators.filters import FilterSet
from quillspark.plans.list_query import Listing
from quillspark.sources.fixtures import decode, read_fixtures

CONTENT = "name string, desc string, document string, page_no int"
ABILITIES = derived.ABILITIES
MONSTER_JSON = ["speed", "environments", "skills", "actions", "bonus_actions", "special_abilities", "reactions", "legendary_actions"]

#: Columns of each entity besides its key, as Spark reads them.
ENTITIES: dict[str, str] = {
    "document": "slug string, title string, desc string, license string, author string, organization string, version string, url string, copyright string, license_url string, v2_related_key string",
    "spell": f"{CONTENT}, page string, spell_level int, dnd_class string, school string, casting_time string, range string, target_range_sort int, requires_verbal_components boolean, requires_somatic_components boolean, requires_material_components boolean, material string, higher_level string, can_be_cast_as_ritual boolean, duration string, requires_concentration boolean, archetype string, circles string",
    "spelllist": f"{CONTENT}, spells array<string>",
    "monster": f"{CONTENT}, size string, type string, subtype string, group string, alignment string, armor_class int, armor_desc string, hit_points int, hit_dice string, {', '.join(f'{a} int, {a}_save int' for a in ABILITIES)}, perception int, damage_vulnerabilities string, damage_resistances string, damage_immunities string, condition_immunities string, senses string, languages string, challenge_rating string, cr double, legendary_desc string, img_main string, {', '.join(f'{c}_json string' for c in MONSTER_JSON)}",
    "monsterspell": "spell string, monster string",
    "background": f"{CONTENT}, skill_proficiencies string, tool_proficiencies string, languages string, equipment string, feature string, feature_desc string, suggested_characteristics string",
    "plane": f"{CONTENT}, parent string", "section": f"{CONTENT}, parent string", "feat": f"{CONTENT}, prerequisite string, effects_desc_json string", "condition": CONTENT,
    "race": f"{CONTENT}, asi_desc string, asi_json string, age string, alignment string, size string, size_raw string, speed_json string, speed_desc string, languages string, vision string, traits string",
    "subrace": f"{CONTENT}, asi_desc string, asi_json string, traits string, parent_race string",
    "charclass": f"{CONTENT}, hit_dice string, hp_at_1st_level string, hp_at_higher_levels string, prof_armor string, prof_weapons string, prof_tools string, prof_saving_throws string, prof_skills string, equipment string, table string, spellcasting_ability string, subtypes_name string",
    "archetype": f"{CONTENT}, char_class string", "magicitem": f"{CONTENT}, type string, rarity string, requires_attunement string",
    "weapon": f"{CONTENT}, category string, cost string, damage_dice string, damage_type string, weight string, properties_json string",
    "armor": f"{CONTENT}, category string, cost string, weight string, stealth_disadvantage boolean, base_ac int, plus_dex_mod boolean, plus_con_mod boolean, plus_wis_mod boolean, plus_flat_mod int, plus_max int, strength_requirement int",
}

#: (entity, column, entity that the column's key belongs to)
REFERENCES = [
    *((e, "document", "document") for e, ddl in ENTITIES.items() if "document string" in ddl),
    ("subrace", "parent_race", "race"), ("archetype", "char_class", "charclass"), ("monsterspell", "spell", "spell"), ("monsterspell", "monster", "monster"), ("spelllist", "spells", "spell"),
]

# Choices of texts, in lower case; types of entries that the search corpus holds, by entity.
SCHOOLS = ["abjuration", "conjuration", "divination", "enchantment", "evocation", "illusion", "necromancy", "transmutation"]
DAMAGE_TYPES = ["acid", "cold", "fire", "force", "lightning", "necrotic", "poison", "psychic", "radiant", "thunder"]
SHAPES = ["cone", "cube", "cylinder", "line", "sphere"]
SEARCHED = {"magicitem": "MagicItem", "spell": "Spell", "monster": "Monster", "charclass": "CharClass", "race": "Race", "subrace": "Subrace", "plane": "Plane", "section": "Section", "feat": "Feat", "condition": "Condition", "background": "Background", "weapon": "Weapon", "armor": "Armor"}
#: Columns that a search hit shows besides the common ones.
EXTRA = {"monster": ["armor_class", "hit_points", "hit_dice", *ABILITIES, "challenge_rating", "cr"], "spell": ["school", "dnd_class"], "section": ["parent"], "magicitem": ["type", "rarity", "requires_attunement"]}

ACTIONS = "array<map<string, string>>"
SCORE_INCREASES = "array<struct<attributes: array<string>, value: int>>"
TEXTS = "array<string>"
NUMBER = ["exact", "range", "gt", "gte", "lt", "lte"]
TEXT, CHOICE, ANY = ["exact", "iexact", "icontains"], ["exact", "iexact", "in"], ["exact", "iexact", "in", "icontains"]
OF_DOCUMENT = ["document__slug", "document__title", "document__license_url", "document__url"]


def parsed(column: str, ddl: str, blank: str | None = "[]") -> Column:
    """JSON text as typed values; a null or empty text counts as `blank`."""
    text = F.nullif(F.col(column), F.lit(""))
    return F.from_json(F.coalesce(text, F.lit(blank)) if blank else text, ddl)


def armor_text(base: Column, dex: Column, con: Column, wis: Column, flat: Column, most: Column) -> Column:
    """14 + Dex modifier (max 2): whatever the cap is, the text says 2."""
    given = lambda flag, text: F.when(flag, F.lit(text)).otherwise("")
    more = F.when(F.coalesce(flat, F.lit(0)) != 0, F.concat(F.lit(" +"), flat.cast("string"))).otherwise("")
    return F.concat(base.cast("string"), given(dex, " + Dex modifier"), given(con, " + Con modifier"), given(wis, " + Wis modifier"), more, given(F.coalesce(most, F.lit(0)) != 0, " (max 2)"))


def outside(rows: DataFrame, school: str | None = "school", damage_type: str | None = None, shape: str | None = None, key: str = "slug") -> DataFrame:
    """(key, column, value) of texts that aren't among the choices of schools, damage types and shapes, in lower case. Name the columns that hold them; null passes."""
    domains = {c: v for c, v in ((school, SCHOOLS), (damage_type, DAMAGE_TYPES), (shape, SHAPES)) if c}
    return quality.outside_domain(rows, key, domains)


@dataclass
class FirstCatalogue:
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def load(cls, spark: SparkSession, root: str, prefix: str = "api", store: str | None = None) -> "FirstCatalogue":
        """Tables of all entities below the root, keyed by `slug` (documents and bridges by `key`); with `store`, written there as Parquet first."""
        rows = read_fixtures(spark, root)
        tables = {}
        for name, ddl in ENTITIES.items():
            table = decode(rows, f"{prefix}.{name}", T.StructType.fromDDL(ddl), "key" if name in ("document", "monsterspell") else "slug")
            if store:
                table.write.mode("overwrite").parquet(f"{store}/{name}")
                table = spark.read.parquet(f"{store}/{name}")
            tables[name] = table
        return cls(tables)

    def violations(self) -> DataFrame:
        """(table, key, column, value) of references to keys that don't exist."""
        found = []
        for entity, column, target in REFERENCES:
            df, side = self.tables[entity], self.tables[target]
            df = df.withColumnRenamed("key" if entity == "monsterspell" else "slug", "__of")
            if isinstance(df.schema[column].dataType, T.ArrayType):
                df = df.select("__of", F.explode(column).alias(column))
            found.append(quality.missing_parents(df, column, side, "key" if target == "document" else "slug", entity, "__of"))
        return reduce(DataFrame.unionByName, found)

    def of_documents(self, entity: str) -> DataFrame:
        """The entity with its document's columns beside its own; rows without a document are left out."""
        d = self.tables["document"].select(F.col("key").alias("__key"), *(F.col(c.removeprefix("document__")).alias(c) for c in OF_DOCUMENT))
        rows = self.tables[entity]
        return rows.join(d, rows["document"] == F.col("__key")).drop("__key", "document")

    def spells(self) -> DataFrame:
        """Spells with texts of their flags and the keys of the lists that hold them."""
        held = joins.bridge(self.tables["spelllist"], "slug", "spells", "__spell").groupBy("__spell").agg(F.sort_array(F.collect_set("slug")).alias("__lists"))
        rows = self.of_documents("spell")
        rows = rows.join(held, rows["slug"] == F.col("__spell"), "left").withColumn("spell_lists", F.coalesce("__lists", F.array().cast(TEXTS))).drop("__spell", "__lists")
        c = F.col
        return rows.select(
            "*", c("spell_level").alias("level_int"), derived.level_name(c("spell_level")).alias("level"), derived.yes_no(c("can_be_cast_as_ritual")).alias("ritual"), derived.yes_no(c("requires_concentration")).alias("concentration"),
            derived.components(c("requires_verbal_components"), c("requires_somatic_components"), c("requires_material_components")).alias("components"),
        )

    def monsters(self, images: str = "") -> DataFrame:
        """Monsters with their JSON parts typed, and the keys of their spells. images: address that image paths follow."""
        cast = joins.bridge(self.tables["monsterspell"].withColumn("spell", F.array("spell")), "monster", "spell", "__spell").groupBy(F.col("monster").alias("__monster")).agg(F.sort_array(F.collect_set("__spell")).alias("__spells"))
        rows = self.of_documents("monster")
        rows = rows.join(cast, rows["slug"] == F.col("__monster"), "left").withColumn("spell_list", F.coalesce("__spells", F.array().cast(TEXTS))).drop("__monster", "__spells")
        types = dict.fromkeys(MONSTER_JSON, (ACTIONS, "[]")) | {"speed": ("map<string, string>", "{}"), "skills": ("map<string, int>", "{}"), "environments": (TEXTS, "[]")}
        return rows.select("*", *(parsed(f"{n}_json", ddl, blank).alias(n) for n, (ddl, blank) in types.items())).withColumn("img_main", F.concat(F.lit(images), "img_main"))

    def races(self) -> DataFrame:
        """Races with their subraces."""
        subraces = self.of_documents("subrace").withColumn("asi", parsed("asi_json", SCORE_INCREASES))
        shown = ["name", "slug", "desc", "asi", "traits", "asi_desc", "document__slug", "document__title", "document__url"]
        rows = self.of_documents("race").withColumn("asi", parsed("asi_json", SCORE_INCREASES)).withColumn("speed", parsed("speed_json", "map<string, string>", "{}"))
        return joins.with_children(rows, subraces, "slug", "parent_race", "subraces", shown, ["slug"])

    def classes(self) -> DataFrame:
        """Classes with their archetypes."""
        return joins.with_children(self.of_documents("charclass"), self.of_documents("archetype"), "slug", "char_class", "archetypes", ["name", "slug", "desc", *OF_DOCUMENT], ["slug"])

    def armors(self) -> DataFrame:
        text = armor_text(*(F.col(c) for c in ("base_ac", "plus_dex_mod", "plus_con_mod", "plus_wis_mod", "plus_flat_mod", "plus_max")))
        return self.of_documents("armor").withColumn("ac_string", text)

    def listings(self, images: str = "") -> dict[str, Listing]:
        """What requests can ask for, by route. Conditions on computed texts (components, concentration, level_int) are on what a response shows."""
        common = {"slug": CHOICE, "name": TEXT, "document__slug": [*CHOICE, "not_in"]}
        texts = lambda *names: dict.fromkeys(names, TEXT)
        spell = FilterSet(
            common | dict.fromkeys(["spell_level", "target_range_sort"], NUMBER) | dict.fromkeys(["school", "duration", "casting_time"], CHOICE) | {"dnd_class": ANY, "level_int": ["exact"], "concentration": ["exact"], "components": ["exact"]}
            | {f"requires_{c}": ["exact"] for c in ("concentration", "verbal_components", "somatic_components", "material_components")},
            named={"spell_lists": ("spell_lists", "has"), "spell_lists_not": ("spell_lists", "has_not")},
        )
        monster = FilterSet(common | dict.fromkeys(["cr", "hit_points", "armor_class", "page_no"], NUMBER) | dict.fromkeys(["desc", "type", "size", "environments_json"], ANY), named={"environments": ("environments_json", "icontains")})
        described = FilterSet(common | {"desc": ANY})
        background = FilterSet(common | {"desc": ANY} | texts("skill_proficiencies", "tool_proficiencies", "languages", "feature", "feature_desc"))
        race = FilterSet(common | {"desc": ANY} | texts("asi_desc", "age", "alignment", "size", "speed_desc", "languages", "vision", "traits"))
        of_class = FilterSet(common | {"desc": ANY, "hit_dice": CHOICE} | texts("hp_at_1st_level", "hp_at_higher_levels", "prof_armor", "prof_weapons", "prof_tools", "prof_skills", "equipment", "spellcasting_ability", "subtypes_name"))
        item = FilterSet(common | {"desc": ANY, "requires_attunement": ["exact", "iexact"]} | texts("type", "rarity"))
        weapon = FilterSet(common | {"desc": ANY} | texts("cost", "damage_dice", "damage_type", "weight"))
        armor = FilterSet(common | {"desc": ANY} | texts("cost", "weight"))
        feats = self.of_documents("feat").withColumn("effects_desc", parsed("effects_desc_json", TEXTS, None))
        weapons = self.of_documents("weapon").withColumn("properties", parsed("properties_json", TEXTS, None))
        found = ["name", "desc"]
        return {
            "spells": Listing(self.spells(), "slug", spell, ["dnd_class", *found], "name"), "spelllist": Listing(self.of_documents("spelllist"), "slug", described, found),
            "monsters": Listing(self.monsters(images), "slug", monster, found),
            "documents": Listing(self.tables["document"], "key", FilterSet(dict.fromkeys(["slug", "title", "organization", "license"], ["exact"])), ["title", "desc"]),
            "backgrounds": Listing(self.of_documents("background"), "slug", background, found, "name"), "planes": Listing(self.of_documents("plane"), "slug", described, found),
            "sections": Listing(self.of_documents("section"), "slug", FilterSet(common | {"desc": ANY, "parent": ANY}), found, "name"), "feats": Listing(feats, "slug", described, found),
            "conditions": Listing(self.of_documents("condition"), "slug", described, found), "races": Listing(self.races(), "slug", race, found), "classes": Listing(self.classes(), "slug", of_class, found),
            "magicitems": Listing(self.of_documents("magicitem"), "slug", item, found), "weapons": Listing(weapons, "slug", weapon, found), "armor": Listing(self.armors(), "slug", armor, found),
        }

    def corpus(self, models: Mapping[str, str] | None = None) -> DataFrame:
        """Rows of the search corpus: the text is the name and, on the next line, the description; `extra` has further columns of some types as JSON."""
        parts = []
        for entity, model in (models or SEARCHED).items():
            extra = F.to_json(F.struct(*EXTRA[entity])) if entity in EXTRA else F.lit(None).cast("string")
            columns = {"document_pk": F.col("document__slug"), "object_pk": F.col("slug"), "object_name": F.col("name"), "object_model": F.lit(model), "schema_version": F.lit("v1"), "text": F.concat_ws("\n", "name", "desc"), "extra": extra}
            parts.append(self.of_documents(entity).select(*(v.alias(k) for k, v in columns.items())))
        return reduce(DataFrame.unionByName, parts)
