"""Runs that link a document's texts to the entries of the same document: what takes part, what would change, and the kept edges.

Which tables take part follows from the catalogue's own graph: a table belongs to a document by its own column or over
its parents', however many there are between. A run is counted as a change set before anything is written, and a new
version of the edges is written by document and turned to at once.
"""

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import merges
from quillspark.plans import linking
from quillspark.plans.catalogue import ENTITIES, REFERENCES, Catalogue
from quillspark.sources.versions import Versions

# Types that texts may name, names and keys that take no part, and names that are common words as well.
NAMED_TYPES = ["Spell", "Item", "Condition", "Feat", "Rule", "RuleSet", "WeaponProperty", "Language", "Environment", "Background", "Species", "CharacterClass", "ClassFeature", "DamageType", "Alignment", "CreatureType", "Ability", "Skill"]
EXCLUDED_NAMES = ["1st", "2nd", "3rd", "4th", "5th", "6th", "7th", "8th", "9th"]
EXCLUDED_KEY_PARTS = ["spellcasting-levels"]
AMBIGUOUS = ["fly", "sleep", "light", "resistance", "magic weapon", "armor"]
PARENT_COLUMNS = ["parent", "subclass_of"]

#: Names of types whose entity is more than one word; others are the entity with a capital.
_WORDS = ["AbilityDescription", "AlignmentDescription", "BackgroundBenefit", "CharacterClass", "ClassFeature", "ClassFeatureItem", "ConditionDescription", "CreatureAction", "CreatureActionAttack", "CreatureSet", "CreatureTrait", "CreatureType", "CreatureTypeDescription", "CrossReference", "DamageType", "DamageTypeDescription", "FeatBenefit", "GameSystem", "ItemCategory", "ItemRarity", "ItemSet", "RuleSet", "SkillDescription", "SpeciesTrait", "SpellCastingOption", "SpellSchool", "WeaponProperty", "WeaponPropertyAssignment"]
TYPES = {e: e.capitalize() for e in ENTITIES} | {t.lower(): t for t in _WORDS}

COLUMNS = {e: [part.split()[0] for part in ddl.split(", ")] for e, ddl in ENTITIES.items()}

EDGE = ["source_type", "source_key", "reference_type", "reference_key", "anchor", "key"]


def path_to_document(entity: str) -> list[str] | None:
    """The tables from an entity to the one with a column `document`: [spell], or [creatureactionattack, creatureaction, creature]; None where none has one."""
    if "document" in COLUMNS[entity]:
        return [entity]
    parents = [target for e, column, target in REFERENCES if e == entity and column == "parent"]
    rest = path_to_document(parents[0]) if parents else None
    return [entity, *rest] if rest else None


@dataclass
class Outcome:
    """edges: all edges after the run. counts: by kind of change. Nothing is written yet."""

    edges: DataFrame
    changes: DataFrame

    def counts(self) -> dict[str, int]:
        return merges.change_counts(self.changes).first().asDict()


@dataclass
class ReferenceRuns:
    """Runs over a catalogue. source_exclusions, reference_exclusions: keys that take no part on either side."""

    catalogue: Catalogue
    source_exclusions: DataFrame | None = None
    reference_exclusions: DataFrame | None = None
    ambiguous: list[str] = field(default_factory=lambda: list(AMBIGUOUS))

    def document(self, key: str) -> str:
        """The key itself; LookupError if there is no such document."""
        if self.catalogue.document.where(F.col("key") == key).isEmpty():
            raise LookupError(f"there is no document {key}")
        return key

    def in_document(self, entity: str, document: str) -> DataFrame:
        """The entity's rows that belong to a document: a filter on its column, or semi joins with the parents that do."""
        path = path_to_document(entity)
        rows = self.catalogue.tables[path[-1]].where(F.col("document") == document)
        for below in reversed(path[:-1]):
            own = rows.select(F.col("key").alias("__parent"))
            below_rows = self.catalogue.tables[below]
            rows = below_rows.join(own, below_rows["parent"] == F.col("__parent"), "left_semi")
        return rows

    def candidates(self, document: str) -> DataFrame:
        """(type, key, name) of the entries that texts may name, names trimmed, blank ones left out."""
        parts = []
        for kind in NAMED_TYPES:
            rows = self.catalogue.tables[kind.lower()].where(F.col("document") == document)
            parts.append(rows.select(F.lit(kind).alias("type"), "key", F.trim("name").alias("name")).where("name != ''"))
        return _without(reduce(DataFrame.unionByName, parts), "key", self.reference_exclusions)

    def source_entities(self, kind: str | None = None) -> list[str]:
        """Entities with descriptions that belong to a document, of one type if named."""
        found = [e for e in ENTITIES if "desc" in COLUMNS[e] and path_to_document(e)]
        return [e for e in found if kind is None or TYPES[e] == kind]

    def sources(self, document: str, kind: str | None = None) -> DataFrame:
        """(type, key, desc, parents) of a document's texts; parents: (type, key) of what a text isn't linked to."""
        parts = []
        for entity in self.source_entities(kind):
            targets = {column: target for e, column, target in REFERENCES if e == entity and column in PARENT_COLUMNS}
            pairs = [F.struct(F.lit(TYPES[t]).alias("type"), F.col(c).alias("key")) for c, t in targets.items()]
            parents = F.array(*pairs) if pairs else F.array().cast("array<struct<type:string,key:string>>")
            parts.append(self.in_document(entity, document).select(F.lit(TYPES[entity]).alias("type"), "key", "desc", parents.alias("parents")))
        if not parts:
            raise LookupError(f"no texts of type {kind}")
        return _without(reduce(DataFrame.unionByName, parts), "key", self.source_exclusions)

    def found(self, document: str) -> DataFrame:
        """The edges (EDGE, document) that the document's texts give; of edges with one key the first by type and reference stays."""
        key = self.document(document)
        edges = linking.links(self.sources(key), self.candidates(key), self.ambiguous, EXCLUDED_NAMES, EXCLUDED_KEY_PARTS)
        return linking.keep_first(edges, ["key"], [F.asc("source_type"), F.asc("reference_type"), F.asc("reference_key")]).select(*EDGE, F.lit(document).alias("document"))

    def of_sources(self, edges: DataFrame, document: str, kind: str | None = None) -> DataFrame:
        """The kept edges whose source is one of the document's texts (of one type, if named), without excluded keys."""
        own = self.sources(self.document(document), kind).select(F.col("type").alias("source_type"), F.col("key").alias("source_key"))
        return _without(edges.join(own, ["source_type", "source_key"], "left_semi"), "reference_key", self.reference_exclusions)

    def applied(self, edges: DataFrame, document: str, replace: bool = False) -> Outcome:
        """What a run for a document leaves: new edges beside the kept ones, or instead of those of the document's texts. A new edge replaces one of its key."""
        new = self.found(document)
        gone = self.of_sources(edges, document).select("key") if replace else edges.select("key").limit(0)
        kept = edges.join(gone.unionByName(new.select("key")).distinct(), "key", "left_anti")
        after = kept.select(*EDGE, "document").unionByName(new)
        return Outcome(after, merges.changes(edges, after, ["key"]))

    def deleted(self, edges: DataFrame, document: str | None = None, kind: str | None = None, keys: DataFrame | None = None) -> Outcome:
        """What is left without the edges of a document's texts (of one type, if named), or of the listed source or reference keys."""
        gone = [self.of_sources(edges, document, kind).select("key")] if document else []
        if keys is not None:
            gone += [edges.join(keys.select(F.col("key").alias(side)), side, "left_semi").select("key") for side in ("source_key", "reference_key")]
        if not gone:
            raise ValueError("name a document or keys")
        after = edges.join(reduce(DataFrame.unionByName, gone).distinct(), "key", "left_anti").select(*EDGE, "document")
        return Outcome(after, merges.changes(edges, after, ["key"]))


def publish(outcome: Outcome, store: Versions) -> int:
    """Writes the edges by document and makes them the current version. Until then, and after a crash, readers see the one before."""
    return store.write(outcome.edges, "document")


def natural_type(kind: Column, app: str = "api_v2") -> Column:
    """How fixtures name a type: [app, type in lower case]."""
    return F.array(F.lit(app), F.lower(kind))


def as_records(edges: DataFrame) -> DataFrame:
    """Edges as rows of the catalogue's table of cross references."""
    return edges.select("key", "anchor", "document", natural_type(F.col("source_type")).alias("source_content_type"), F.col("source_key").alias("source_object_key"), natural_type(F.col("reference_type")).alias("reference_content_type"), F.col("reference_key").alias("reference_object_key"))


def from_records(records: DataFrame) -> DataFrame:
    """The catalogue's cross references as edges."""
    names = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    of = lambda c: F.try_element_at(names, F.element_at(c, -1))
    return records.select(of("source_content_type").alias("source_type"), F.col("source_object_key").alias("source_key"), of("reference_content_type").alias("reference_type"), F.col("reference_object_key").alias("reference_key"), "anchor", "key", "document")


def _without(rows: DataFrame, column: str, keys: DataFrame | None) -> DataFrame:
    return rows if keys is None else rows.join(keys.select(F.col("key").alias("__excluded")), F.col(column) == F.col("__excluded"), "left_anti")
