"""Records of the second schema from those of the first: feats, subclasses, their features, traits of species.

Keys of the new rows are document_slug. Rows that the older conversions number by a counter get their parent's key and
their place under it instead, so that keys don't depend on what else is converted.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.conversions import nth_level
from quillspark.functions.text import slug
from quillspark.sources.texts import sections


def _key(document: str, *parts: Column) -> Column:
    return F.concat_ws("_", F.lit(document), *parts)


def feats(rows: DataFrame, document: str) -> tuple[DataFrame, DataFrame]:
    """Feats, and a benefit for each text of the JSON list effects_desc_json; what isn't such a list gives none. rows: slug, name, desc, prerequisite, effects_desc_json."""
    key = _key(document, F.col("slug"))
    found = rows.select(key.alias("key"), "name", "desc", "prerequisite", F.lit(document).alias("document"))
    parts = rows.select(key.alias("parent"), F.posexplode(F.from_json("effects_desc_json", "array<string>")).alias("place", "desc"))
    benefits = parts.select(F.concat_ws("_", "parent", "place").alias("key"), F.lit("").alias("name"), "desc", F.lit(None).cast("string").alias("type"), "parent")
    return found, benefits


def subclasses(rows: DataFrame, document: str, base: str = "srd") -> DataFrame:
    """Archetypes (slug, name, char_class) as classes below their class of the document `base`."""
    return rows.select(
        _key(document, F.col("slug")).alias("key"),
        "name",
        F.lit(document).alias("document"),
        _key(base, slug(F.col("char_class"))).alias("subclass_of"),
        F.lit(None).cast("string").alias("hit_dice"),
        F.lit(None).cast("string").alias("caster_type"),
        F.array().cast("array<string>").alias("saving_throws"),
    )


def features(rows: DataFrame, document: str) -> tuple[DataFrame, DataFrame]:
    """Features from the headings of level 5 in archetypes' descriptions (slug, desc), and the level at which a feature's text says it is gained."""
    parts = sections(rows, "desc", 5, ["slug"]).where("title <> '' OR body <> ''")
    parent = _key(document, F.col("slug"))
    found = parts.select(F.concat_ws("_", parent, slug(F.col("title"))).alias("key"), F.col("title").alias("name"), F.col("body").alias("desc"), F.lit(document).alias("document"), parent.alias("parent"))
    levels = found.select(F.col("key").alias("parent"), nth_level(F.col("desc")).alias("level")).where("level > 0")
    items = levels.select(F.concat_ws("_", "parent", "level").alias("key"), "parent", "level", F.lit(None).cast("string").alias("column_value"))
    return found, items


def species_traits(rows: DataFrame) -> DataFrame:
    """Traits of species (parent, asi_desc, traits): the rise of scores first, then each paragraph, named by its bold beginning or else by its first sentence."""
    bold = r"(?s)^\*\*[_*]?([^.*]+)[.*_]*\*\*\s*(.*)$"
    plain = r"(?s)^([^.]*)\.?(.*)$"
    paragraphs = F.filter(F.transform(F.split(F.coalesce("traits", F.lit("")), r"\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")

    def named(p: Column) -> Column:
        name, desc = (F.when(p.rlike(bold), F.regexp_extract(p, bold, g)).otherwise(F.regexp_extract(p, plain, g)) for g in (1, 2))
        return F.struct(F.trim(name).alias("name"), F.trim(desc).alias("desc"))

    raised = F.struct(F.lit("Ability Score Increase").alias("name"), F.col("asi_desc").alias("desc"))
    none = F.array().cast("array<struct<name: string, desc: string>>")
    all_traits = F.concat(F.when(F.coalesce("asi_desc", F.lit("")) != "", F.array(raised)).otherwise(none), F.transform(paragraphs, named))
    placed = rows.select("parent", F.posexplode(all_traits).alias("place", "t"))
    return placed.select(F.concat_ws("_", "parent", "place").alias("key"), "t.name", "t.desc", F.lit(None).cast("string").alias("type"), "parent")
