"""The catalogue: entities with their columns, loaded from fixture files, and the listings that requests see."""

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import derived, text
from quillspark.operators import aggregates, joins, quality
from quillspark.operators.filters import FilterSet
from quillspark.plans.list_query import Listing
from quillspark.sources.fixtures import decode, read_fixtures

NAMED, FROM = "name string, document string", "document string"
DESCRIBED = f"{NAMED}, desc string"
SCORES = ", ".join(f"ability_score_{a} int, saving_throw_{a} int" for a in derived.ABILITIES) + ", " + ", ".join(f"skill_bonus_{s} int" for s in derived.SKILLS)
SENSES = "normal_sight_range double, darkvision_range double, blindsight_range double, tremorsense_range double, truesight_range double, telepathy_range double"
SPEEDS = "walk double, unit string, hover boolean, fly double, burrow double, climb double, swim double"
RESISTANCES = ", ".join(f"{k} array<string>, {k}_display string" for k in ("damage_immunities", "damage_resistances", "damage_vulnerabilities", "condition_immunities"))
OF_PARENT = "name string, desc string, parent string, type string"
OF_DESCRIBED = "desc string, document string, describes string"

#: Columns of each entity besides its key, as Spark reads them.
ENTITIES: dict[str, str] = {
    "ability": f"{NAMED}, short_desc string", "abilitydescription": OF_DESCRIBED, "alignment": NAMED, "alignmentdescription": OF_DESCRIBED,
    "armor": f"{NAMED}, ac_base int, ac_add_dexmod boolean, ac_cap_dexmod int, grants_stealth_disadvantage boolean, strength_score_required int",
    "background": DESCRIBED, "backgroundbenefit": OF_PARENT,
    "characterclass": f"{DESCRIBED}, hit_dice string, caster_type string, subclass_of string, saving_throws array<string>, primary_abilities array<string>",
    "classfeature": f"{DESCRIBED}, parent string", "classfeatureitem": "parent string, level int, detail string, column_value string",
    "condition": f"{NAMED}, icon string", "conditiondescription": OF_DESCRIBED,
    "creature": f"{DESCRIBED}, type string, category string, subcategory string, alignment string, size string, weight decimal(10,3), armor_class int, armor_detail string, hit_points int, hit_dice string, challenge_rating decimal(10,3), experience_points_integer int, proficiency_bonus int, initiative_bonus int, passive_perception int, languages array<string>, languages_desc string, environments array<string>, nonmagical_attack_immunity boolean, nonmagical_attack_resistance boolean, illustration string, {SCORES}, {SENSES}, {SPEEDS}, {RESISTANCES}",
    "creatureaction": "name string, desc string, parent string, action_type string, order_in_statblock int, uses_type string, uses_param int, legendary_action_cost int, limited_to_form string",
    "creatureactionattack": "name string, parent string, attack_type string, to_hit_mod int, reach double, range double, long_range double, distance_unit string, target_creature_only boolean, damage_die_count int, damage_die_type string, damage_bonus int, damage_type string, extra_damage_die_count int, extra_damage_die_type string, extra_damage_bonus int, extra_damage_type string",
    "creatureset": f"{NAMED}, creatures array<string>", "creaturetrait": OF_PARENT, "creaturetype": NAMED, "creaturetypedescription": OF_DESCRIBED,
    "crossreference": "anchor string, document string, source_content_type array<string>, source_object_key string, reference_content_type array<string>, reference_object_key string",
    "damagetype": NAMED, "damagetypedescription": OF_DESCRIBED,
    "document": "name string, display_name string, desc string, type string, author string, publisher string, gamesystem string, licenses array<string>, permalink string, publication_date timestamp_ntz, distance_unit string, weight_unit string",
    "environment": f"{DESCRIBED}, aquatic boolean, planar boolean, interior boolean", "feat": f"{DESCRIBED}, prerequisite string, type string", "featbenefit": f"{OF_PARENT}, order int",
    "gamesystem": "name string, desc string, content_prefix string", "image": f"{NAMED}, file_path string, alt_text string, attribution string, type string",
    "item": f"{DESCRIBED}, category string, cost decimal(10,2), weight decimal(10,3), weapon string, armor string, size string, armor_class int, hit_points int",
    "itemcategory": NAMED, "itemrarity": f"{NAMED}, rank int", "itemset": f"{DESCRIBED}, items array<string>", "language": f"{DESCRIBED}, is_exotic boolean, is_secret boolean, script_language string",
    "license": "name string, desc string", "publisher": "name string", "rule": f"{DESCRIBED}, index int, ruleset string", "ruleset": DESCRIBED,
    "service": f"{DESCRIBED}, cost decimal(10,2), detail string", "size": f"{NAMED}, rank int, space_diameter double, distance_unit string, suggested_hit_dice string",
    "skill": f"{NAMED}, ability string", "skilldescription": OF_DESCRIBED, "species": f"{DESCRIBED}, subspecies_of string", "speciestrait": f"{OF_PARENT}, order int",
    "spell": f"{DESCRIBED}, level int, school string, higher_level string, classes array<string>, casting_time string, reaction_condition string, ritual boolean, range_text string, range double, range_unit string, target_type string, target_count int, verbal boolean, somatic boolean, material boolean, material_specified string, material_cost double, material_consumed boolean, saving_throw_ability string, attack_roll boolean, damage_roll string, damage_types array<string>, duration string, shape_type string, shape_size double, shape_size_unit string, concentration boolean",
    "spellcastingoption": "parent string, type string, damage_roll string, target_count int, duration string, range string, concentration boolean, shape_size double, desc string",
    "spellschool": DESCRIBED, "weapon": f"{NAMED}, damage_type string, damage_dice string, range double, long_range double, distance_unit string, is_simple boolean, is_improvised boolean",
    "weaponproperty": f"{DESCRIBED}, type string", "weaponpropertyassignment": "document string, weapon string, property string, detail string",
}

#: (entity, column, entity that the column's key belongs to); arrays are checked element by element.
REFERENCES = [
    *((e, "document", "document") for e, ddl in ENTITIES.items() if "document string" in ddl),
    *((e, "describes", e.removesuffix("description")) for e in ENTITIES if e.endswith("description")),
    ("backgroundbenefit", "parent", "background"), ("featbenefit", "parent", "feat"), ("speciestrait", "parent", "species"), ("creaturetrait", "parent", "creature"),
    ("classfeature", "parent", "characterclass"), ("classfeatureitem", "parent", "classfeature"), ("creatureaction", "parent", "creature"), ("creatureactionattack", "parent", "creatureaction"),
    ("spellcastingoption", "parent", "spell"), ("characterclass", "subclass_of", "characterclass"), ("species", "subspecies_of", "species"), ("language", "script_language", "language"),
    ("creature", "type", "creaturetype"), ("creature", "size", "size"), ("creature", "languages", "language"), ("creature", "environments", "environment"),
    ("spell", "school", "spellschool"), ("spell", "classes", "characterclass"), ("weapon", "damage_type", "damagetype"), ("weaponpropertyassignment", "weapon", "weapon"),
    ("weaponpropertyassignment", "property", "weaponproperty"), ("skill", "ability", "ability"), ("document", "publisher", "publisher"), ("document", "gamesystem", "gamesystem"),
    ("item", "category", "itemcategory"), ("item", "weapon", "weapon"), ("item", "armor", "armor"), ("rule", "ruleset", "ruleset"),
]

#: What an attack shows within its action; a damage type is shown with its name, a unit is the document's where it isn't set.
ATTACK_FIELDS = ["name", "attack_type", "to_hit_mod", "reach", "range", "long_range", "distance_unit", "target_creature_only", "damage_die_count", "damage_die_type", "damage_bonus", "damage_type", "extra_damage_die_count", "extra_damage_die_type", "extra_damage_bonus", "extra_damage_type"]

#: Bounds of numbers by entity.
BOUNDS = {
    "creature": {f"ability_score_{a}": (0, 50) for a in derived.ABILITIES} | {f"saving_throw_{a}": (-5, 20) for a in derived.ABILITIES} | {f"skill_bonus_{s}": (-5, 20) for s in derived.SKILLS} | {"passive_perception": (0, 40), "challenge_rating": (0, 30), "armor_class": (0, 100), "hit_points": (0, 10000)},
    "spell": {"level": (0, 9)},
    "classfeatureitem": {"level": (0, 20)},
}


def _json(**columns: Column) -> Column:
    """A JSON object of all columns, nulls too; decimals are texts."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in columns.items())), {"ignoreNullFields": "false"})


@dataclass
class Catalogue:
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name in ENTITIES:
            return self.tables[name]
        raise AttributeError(name)

    @classmethod
    def load(cls, spark: SparkSession, root: str, prefix: str = "api_v2", store: str | None = None) -> "Catalogue":
        """Tables of all entities below the root; with `store`, written there as Parquet first, so that requests don't parse JSON."""
        rows = read_fixtures(spark, root)
        tables = {}
        for name, ddl in ENTITIES.items():
            table = decode(rows, f"{prefix}.{name}", T.StructType.fromDDL(ddl))
            if store:
                table.write.mode("overwrite").parquet(f"{store}/{name}")
                table = spark.read.parquet(f"{store}/{name}")
            tables[name] = table
        return cls(tables)

    def violations(self) -> DataFrame:
        """(table, key, column, value) of references to keys that don't exist."""
        found = []
        for entity, column, target in REFERENCES:
            df, key = self.tables[entity].withColumnRenamed("key", "__of"), self.tables[target]
            if isinstance(df.schema[column].dataType, T.ArrayType):
                df = df.select("__of", F.explode(column).alias(column))
            found.append(quality.missing_parents(df, column, key, "key", entity, "__of"))
        return reduce(DataFrame.unionByName, found)

    def out_of_bounds(self) -> DataFrame:
        return reduce(DataFrame.unionByName, (quality.outside_bounds(self.tables[e], "key", b) for e, b in BOUNDS.items()))

    def stats(self) -> DataFrame:
        """(document, model, actual_count) of all entities that belong to a document."""
        return aggregates.counts_by({n: t for n, t in self.tables.items() if "document" in t.columns}, "document")

    def with_document(self, df: DataFrame) -> DataFrame:
        """document becomes a struct with its display name, publisher and game system."""
        d = self.document.select("key", text.fallback_name(F.col("display_name"), F.col("name")).alias("name"), "publisher", "gamesystem", "distance_unit", "weight_unit")
        return joins.with_parent(df.withColumnRenamed("document", "__document"), d, "__document", "key", "document", ["key", "name", "publisher", "gamesystem", "distance_unit", "weight_unit"]).drop("__document")

    def descriptions(self, entity: str) -> DataFrame:
        """The entity with its descriptions of all documents and their game systems."""
        rows = joins.with_parent(self.tables[f"{entity}description"], self.document, "document", "key", "__d", ["gamesystem"]).withColumn("gamesystem", F.col("__d.gamesystem"))
        return joins.with_children(self.tables[entity], rows, "key", "describes", "descriptions", ["desc", "document", "gamesystem"], ["document", "key"])

    def creatures(self) -> DataFrame:
        """Creatures with actions (with attacks), traits, modifiers, all saves, all skills, all speeds and experience."""
        attacks = self.creatureactionattack.withColumnsRenamed({"damage_type": "__damage", "extra_damage_type": "__extra"})
        for column, name in (("__damage", "damage_type"), ("__extra", "extra_damage_type")):
            attacks = joins.with_parent(attacks, self.damagetype, column, "key", name, ["key", "name"])
        attacks = joins.with_parent(attacks, joins.with_parent(self.creatureaction, self.creature, "parent", "key", "__c", ["unit", "document"]).select("key", "__c.unit", "__c.document"), "parent", "key", "__a", ["unit", "document"])
        units = self.document.select(F.col("key").alias("__d"), F.col("distance_unit").alias("__du"))
        attacks = attacks.join(units, F.col("__a.document") == F.col("__d"), "left").withColumn("distance_unit", F.coalesce("distance_unit", "__du"))
        actions = joins.with_children(self.creatureaction, attacks, "key", "parent", "attacks", ATTACK_FIELDS, ["key"])
        actions = actions.withColumn("usage_limits", derived.usage_limits(F.col("uses_type"), F.col("uses_param")))
        df = joins.with_children(self.creature, actions, "key", "parent", "actions", ["name", "desc", "action_type", "order_in_statblock", "legendary_action_cost", "limited_to_form", "usage_limits", "attacks"], ["order_in_statblock", "key"])
        df = joins.with_children(df, self.creaturetrait, "key", "parent", "traits", ["name", "desc"], ["key"])
        df = self.with_document(df)
        score = {a: F.col(f"ability_score_{a}") for a in derived.ABILITIES}
        return df.select(
            "*", F.struct(*(derived.modifier(score[a]).alias(a) for a in derived.ABILITIES)).alias("modifiers"),
            F.struct(*(derived.saving_throw(F.col(f"saving_throw_{a}"), score[a]).alias(a) for a in derived.ABILITIES)).alias("saving_throws_all"),
            F.struct(*(derived.skill_bonus(s, F.col(f"skill_bonus_{s}"), score).alias(s) for s in derived.SKILLS)).alias("skill_bonuses_all"),
            derived.speeds(*(F.col(c) for c in ("walk", "fly", "burrow", "climb", "swim"))).alias("speed_all"),
            F.coalesce("unit", "document.distance_unit").alias("distance_unit"),
            derived.experience(F.col("challenge_rating"), F.col("experience_points_integer")).alias("experience_points"),
            F.coalesce("initiative_bonus", derived.modifier(score["dexterity"])).alias("initiative"),
        )

    def spells(self) -> DataFrame:
        df = joins.with_children(self.spell, self.spellcastingoption, "key", "parent", "casting_options", ["type", "damage_roll", "target_count", "duration", "range"], ["type", "key"])
        df = joins.with_parent(df.withColumnRenamed("school", "__school"), self.spellschool, "__school", "key", "school", ["key", "name"]).drop("__school")
        return self.with_document(df).withColumn("range_unit", F.coalesce("range_unit", "document.distance_unit"))

    def weapons(self) -> DataFrame:
        property_ = joins.with_parent(self.weaponpropertyassignment, self.weaponproperty, "property", "key", "p", ["key", "name", "type"]).withColumn("property_name", F.col("p.name"))
        df = joins.with_children(self.weapon, property_, "key", "weapon", "properties", ["property_name", "detail"], ["key"])
        df = joins.with_parent(df.withColumnRenamed("damage_type", "__type"), self.damagetype, "__type", "key", "damage_type", ["key", "name"]).drop("__type")
        return self.with_document(df).withColumn("is_martial", ~F.col("is_simple")).withColumn("distance_unit", F.coalesce("distance_unit", "document.distance_unit"))

    def armors(self) -> DataFrame:
        c = F.col
        return self.with_document(self.armor).withColumn("category", derived.armor_category(c("ac_add_dexmod"), c("ac_cap_dexmod"))).withColumn("ac_display", derived.armor_display(c("ac_base"), c("ac_add_dexmod"), c("ac_cap_dexmod")))

    def classes(self) -> DataFrame:
        """Classes with features; a feature's items with a column value are table cells, the others the levels at which it is gained."""
        items = self.classfeatureitem
        features = joins.with_children(self.classfeature, items, "key", "parent", "cells", ["level", "detail", "column_value"], ["level", "key"])
        pick = lambda cells: F.filter("cells", lambda x: x["column_value"].isNotNull() if cells else x["column_value"].isNull())
        features = features.withColumn("data_for_class_table", pick(True)).withColumn("gained_at", pick(False)).drop("cells")
        df = joins.with_children(self.characterclass, features, "key", "parent", "features", ["key", "name", "desc", "data_for_class_table", "gained_at"], ["key"])
        df = joins.with_parent(df.withColumnRenamed("subclass_of", "__of"), self.characterclass, "__of", "key", "subclass_of", ["key", "name"]).drop("__of")
        return self.with_document(df).withColumn("is_subclass", F.col("subclass_of").isNotNull()).withColumn("hit_points", derived.hit_points(F.col("hit_dice"), F.col("name")))

    def with_benefits(self, entity: str, child: str, name: str, order: list[str]) -> DataFrame:
        return self.with_document(joins.with_children(self.tables[entity], self.tables[child], "key", "parent", name, ["name", "desc", "type"], order))

    def listings(self) -> dict[str, Listing]:
        """What requests can ask for, by route."""
        keyed = {"key": ["exact", "in", "iexact"], "name": ["exact", "iexact", "icontains", "contains"], "document__key": ["exact", "in", "iexact"], "document__gamesystem": ["exact", "in"]}
        number = ["exact", "range", "gt", "gte", "lt", "lte"]
        filters = lambda **more: FilterSet(keyed | more)
        routes = {
            "creatures": Listing(self.creatures(), "key", filters(size=["exact"], type=["exact"], challenge_rating=number, armor_class=number, hit_points=number, passive_perception=number, **{f"ability_score_{a}": number for a in derived.ABILITIES}, **{f"saving_throw_{a}": ["isnull"] for a in derived.ABILITIES}), parents={"size": (self.size, "key"), "type": (self.creaturetype, "key")}),
            "spells": Listing(self.spells(), "key", filters(level=number, range=number, school__key=["exact"], school__name=["exact", "in"], duration=["exact", "in"], casting_time=["exact", "in"], **{c: ["exact"] for c in ("concentration", "verbal", "somatic", "material", "material_consumed")})),
            "weapons": Listing(self.weapons(), "key", filters(damage_dice=["exact", "in"], is_simple=["exact"])),
            "armor": Listing(self.armors(), "key", filters(ac_base=number, ac_add_dexmod=["exact"], grants_stealth_disadvantage=["exact"], strength_score_required=number)),
            "classes": Listing(self.classes(), "key", filters(is_subclass=["exact"], caster_type=["exact", "in"])),
            "backgrounds": Listing(self.with_benefits("background", "backgroundbenefit", "benefits", ["key"]), "key", filters()),
            "feats": Listing(self.with_benefits("feat", "featbenefit", "benefits", ["order", "key"]), "key", filters(prerequisite=["icontains"])),
            "species": Listing(self.with_benefits("species", "speciestrait", "traits", ["order", "key"]), "key", filters(subspecies_of=["exact", "isnull"]), parents={"subspecies_of": (self.species, "key")}),
        }
        simple = {"languages": ("language", {"is_exotic": ["exact"], "is_secret": ["exact"]}), "services": ("service", {}), "environments": ("environment", {}), "sizes": ("size", {"rank": number}), "images": ("image", {}), "rulesets": ("ruleset", {}), "itemcategories": ("itemcategory", {}), "itemrarities": ("itemrarity", {}), "items": ("item", {"cost": number, "weight": number, "category": ["exact"], "weapon": ["isnull"], "armor": ["isnull"]}), "creaturesets": ("creatureset", {}), "itemsets": ("itemset", {})}
        routes |= {r: Listing(self.with_document(self.tables[e]), "key", filters(**more), parents={"category": (self.itemcategory, "key")} if e == "item" else {}) for r, (e, more) in simple.items()}
        routes |= {r: Listing(self.descriptions(e), "key", FilterSet({"key": ["exact", "in"], "name": ["exact", "icontains"], "document": ["exact", "in"]})) for r, e in {"abilities": "ability", "alignments": "alignment", "conditions": "condition", "damagetypes": "damagetype", "skills": "skill", "creaturetypes": "creaturetype"}.items()}
        routes |= {r: Listing(self.tables[e], "key", FilterSet.of_schema(self.tables[e])) for r, e in {"documents": "document", "publishers": "publisher", "gamesystems": "gamesystem", "licenses": "license", "rules": "rule"}.items()}
        return routes

    def corpus(self, models: Mapping[str, str] | None = None) -> DataFrame:
        """The search corpus: a creature's text includes its actions, a class's its features; `extra` has further columns of some types as JSON.

        The types are those that the index to rebuild really holds: conditions are asked for there, but give no rows.
        """
        one = lambda df, table, column, name: joins.with_parent(df, table.select(F.col("key").alias("__k"), "name"), column, "__k", name, ["name"])
        chosen = models or {"creature": "Creature", "spell": "Spell", "feat": "Feat", "background": "Background", "characterclass": "CharacterClass", "species": "Species", "item": "Item", "environment": "Environment", "rule": "Rule"}
        parts = []
        for entity, model in chosen.items():
            df = {"creature": self.creatures, "characterclass": self.classes}.get(entity, lambda e=entity: self.with_document(self.tables[e]))()
            extra = F.lit(None).cast("string")
            if entity == "creature":
                df = one(one(df, self.creaturetype, "type", "__type"), self.size, "size", "__size")
                extra = _json(cr=F.col("challenge_rating"), type=F.col("__type.name"), size=F.col("__size.name"))
            elif entity == "spell":
                df = one(df, self.spellschool, "school", "__school")
                extra = _json(school=F.col("__school.name"), level=F.col("level"))
            elif entity == "characterclass":
                extra = _json(subclass_of=F.when(F.col("subclass_of").isNotNull(), F.struct("subclass_of.name", "subclass_of.key")))
            elif entity == "species":
                df = one(df, self.species, "subspecies_of", "__of")
                extra = _json(subspecies_of=F.when(F.col("__of").isNotNull(), F.struct("__of.name", F.col("subspecies_of").alias("key"))))
            body = [F.col("name"), F.coalesce("desc", F.lit(""))]
            nested = {"creature": "actions", "characterclass": "features"}.get(entity)
            if nested:
                body.append(F.array_join(F.transform(nested, lambda x: F.concat_ws("\n", x["name"], x["desc"])), "\n"))
            parts.append(df.select(F.col("document.key").alias("document_pk"), F.col("key").alias("object_pk"), F.col("name").alias("object_name"), F.lit(model).alias("object_model"), F.lit("v2").alias("schema_version"), F.concat_ws("\n\n", *body).alias("text"), F.col("document.name").alias("document_name"), extra.alias("extra")))
        return reduce(DataFrame.unionByName, parts)
