"""Links from texts to the entries that they name."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import edge_key
from quillspark.operators.aggregates import keep_first

# Names and phrases that decide whether a word means an entry.
CONTEXT = 120
FEW_NAMES = 50_000  #: that are broadcast; more are joined by a shuffle
LIGHTING = ["bright light", "dim light"]
SPELL = ["cast", "spell", "cantrip", "concentration", "prepared", "slot", "evocation"]
WEAPON_PROPERTY = ["light weapon", "weapon property", "weapon has", "weapons with", "property.", "properties", "melee weapon", "ranged weapon", "has the light", "light property"]
ARMOR = ["light and medium", " and medium armor", "armor training", "light armor", "medium armor", "heavy armor"]
SHIELD_ITEM = ["wield a shield", "wielding a shield", "don shield", "donning a shield", "armor and shield", "shield's ac", "shield ac", "shield (armor)", "carry a shield", "holding a shield", "equip a shield", "shield and armor", "shields and", "or shield", "and shields", "proficiency with shields"]
CROSSBOW = ["light crossbow", "heavy crossbow", "hand crossbow"]
ACID_DAMAGE = ["acid damage", "resistance to acid", "immunity to acid", "vulnerability to acid", "acid resistance", "acid immunity"]
CHAIN_LIGHTNING = ["chain lightning"]
#: (type of the entry, its name or None for all, phrases around a match that mean something else)
MISMATCHES = [
    ("Spell", None, WEAPON_PROPERTY + ARMOR),
    ("Spell", "shield", SHIELD_ITEM),
    ("Spell", "light", CROSSBOW),
    ("WeaponProperty", "light", CROSSBOW),
    ("WeaponProperty", "heavy", CROSSBOW),
    ("WeaponProperty", None, SPELL),
    ("Item", "shield", SPELL),
    ("Item", "acid", ACID_DAMAGE),
    ("Item", "chain", CHAIN_LIGHTNING),
]


def masked(text: Column) -> Column:
    """The text with blanks for what takes no links: bold parts, heading lines, the first line of each table. Positions stay."""
    lines = F.split(text, "\n")
    plain = F.transform(lines, lambda x, i: F.when(x.rlike(r"^\s*#") | (x.contains("|") & ~F.coalesce(F.get(lines, i - 1).contains("|"), F.lit(False))), F.repeat(F.lit(" "), F.length(x))).otherwise(x))
    return _without_marked(_without_marked(F.array_join(plain, "\n"), r"\*\*"), "__")


def _without_marked(text: Column, mark: str) -> Column:
    """Blanks for what stands between two of the marks (two characters each)."""
    parts = F.split(text, mark, -1)
    last = F.size(parts) - 1
    return F.array_join(F.transform(parts, lambda x, i: F.when((i % 2 == 1) & (i < last), F.regexp_replace(x, "[^\n]", " ")).otherwise(x)), "  ")


def positions(text: Column, name: Column) -> Column:
    """Where (from 0) the name stands as whole words, whatever the case."""
    parts = F.split(F.lower(text), F.concat(F.lit(r"(?U)\b\Q"), F.lower(name), F.lit(r"\E\b")), -1)
    ends = F.aggregate(parts, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)) + F.length(name), F.lit(0)) + F.length(x))))
    return F.slice(ends, 1, F.greatest(F.lit(0), F.size(parts) - 1))


def allowed(text: Column, at: Column, kind: Column, name: Column, ambiguous: list[str]) -> Column:
    """Whether the match at a position means the entry."""
    low, size = F.lower(name), F.length(name)
    here = F.substr(text, at + 1, size)
    around = F.lower(F.substr(text, F.greatest(F.lit(1), at + 1 - CONTEXT), F.least(at, F.lit(CONTEXT)) + size + CONTEXT))
    before = F.lower(F.substr(text, F.greatest(F.lit(1), at - 6), F.least(at, F.lit(7)) + size))
    any_of = lambda where, phrases: reduce(lambda a, b: a | b, (where.contains(p) for p in phrases))
    common = low.isin(*ambiguous) & (name != low) & (here == F.lower(here)) if ambiguous else F.lit(False)
    wrong = [(kind == k) & (F.lit(True) if n is None else low == n) & any_of(around, phrases) for k, n, phrases in MISMATCHES]
    return ~(common | ((low == "light") & any_of(before, LIGHTING)) | reduce(lambda a, b: a | b, wrong))


def links(sources: DataFrame, references: DataFrame, ambiguous: list[str] = (), excluded_names: list[str] = (), excluded_key_parts: list[str] = ()) -> DataFrame:
    """source_type, source_key, reference_type, reference_key, anchor, key.

    sources: (type, key, desc[, parent][, parents]); references: (type, key, name). A text links to an entry that it
    names as whole words at a place that takes links; it links neither to itself nor to its parent (a key of any type) or
    one of its parents (an array of type and key), and once to each name.
    Candidates come from an equi join of the texts' words with one word of each name, that which fewest names have (of
    these the longest), so that a word which all names share makes no pairs; only those that hold the name at all are
    searched by regular expression.
    """
    refs = references.where((F.length(F.trim("name")) >= 2) & ~F.col("name").isin(*excluded_names, ""))
    texts = sources.where(F.coalesce(F.col("desc"), F.lit("")) != "")
    for part in excluded_key_parts:
        refs, texts = refs.where(~F.col("key").contains(part)), texts.where(~F.col("key").contains(part))
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), 1)
    refs = refs.select(F.col("type").alias("reference_type"), F.col("key").alias("reference_key"), F.col("name").alias("anchor"))
    names = refs.select("anchor", F.lower("anchor").alias("__low")).distinct().select("anchor", F.explode(F.array_distinct(words("__low"))).alias("__word"))
    shared = names.groupBy("__word").agg(F.count("*").alias("__many"))
    rarest = names.join(shared, "__word").groupBy("anchor").agg(F.min(F.struct("__many", (-F.length("__word")).alias("n"), "__word")).alias("__rare"))
    refs = refs.join(rarest.select("anchor", F.col("__rare.__word").alias("__word")), "anchor")
    parent = F.col("parent") if "parent" in sources.columns else F.lit(None).cast("string")
    parents = F.col("parents") if "parents" in sources.columns else F.array().cast("array<struct<type:string,key:string>>")
    texts = texts.select(F.col("type").alias("source_type"), F.col("key").alias("source_key"), "desc", parent.alias("__parent"), parents.alias("__parents"))
    pairs = texts.select("source_type", "source_key", "__parent", "__parents", F.explode(F.array_distinct(words("desc"))).alias("__word"))
    # Words of all texts, and the texts, are far larger than their files let expect: neither is broadcast. Few names are.
    pairs = (pairs.join(F.broadcast(refs), "__word") if refs.limit(FEW_NAMES + 1).count() <= FEW_NAMES else pairs.hint("merge").join(refs, "__word")).drop("__word")
    pairs = pairs.where((F.col("reference_key") != F.col("source_key")) | (F.col("reference_type") != F.col("source_type")))
    above = F.exists("__parents", lambda p: F.coalesce((p["type"] == F.col("reference_type")) & (p["key"] == F.col("reference_key")), F.lit(False)))
    pairs = pairs.where(~F.coalesce(F.col("reference_key") == F.col("__parent"), F.lit(False)) & ~above).drop("__parent", "__parents")
    named = pairs.join(texts.drop("__parent", "__parents").hint("merge"), ["source_type", "source_key"]).where(F.lower("desc").contains(F.lower("anchor")))
    at = positions(masked(F.col("desc")), F.col("anchor"))
    good = named.where(F.exists(at, lambda p: allowed(F.col("desc"), p, F.col("reference_type"), F.col("anchor"), list(ambiguous))))
    named = good.withColumn("__name", F.lower("anchor")).select("source_type", "source_key", "reference_type", "reference_key", "anchor", "__name")
    once = keep_first(named, ["source_type", "source_key", "__name"], [F.asc("reference_type"), F.asc("reference_key"), F.asc("anchor")]).drop("__name")
    return once.withColumn("key", edge_key(F.col("source_key"), F.col("anchor"), F.col("reference_key")))


def report(edges: DataFrame, by: str, other: str) -> DataFrame:
    """(by, others, anchors, n): what each side of the links is linked with, most links first."""
    groups = edges.groupBy(by).agg(F.sort_array(F.collect_set(other)).alias("others"), F.sort_array(F.collect_set("anchor")).alias("anchors"))
    return groups.withColumn("n", F.size("others")).orderBy(F.desc("n"), by)


def write_reports(edges: DataFrame, folder: str) -> None:
    """Two JSON tables below the folder: what each source names (by_source), and what names each entry (by_reference), most first."""
    for name, by, other in (("by_source", "source_key", "reference_key"), ("by_reference", "reference_key", "source_key")):
        report(edges, by, other).write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}")


def applied(existing: DataFrame, new: DataFrame, documents: list[str] | None = None) -> DataFrame:
    """The edges after a run: new ones replace those of the same key (and all of the given documents)."""
    kept = existing.where(~F.col("document").isin(*documents)) if documents else existing
    return kept.join(new.select("key"), "key", "left_anti").unionByName(keep_first(new, ["key"], [F.asc("reference_key")]), allowMissingColumns=True)


def deleted(edges: DataFrame, documents: list[str] = (), source_types: list[str] = (), keys: DataFrame | None = None) -> DataFrame:
    """The edges without those of the given documents, of the given source types and of the listed source or reference keys."""
    left = edges
    if documents:
        left = left.where(~F.col("document").isin(*documents))
    if source_types:
        left = left.where(~F.col("source_type").isin(*source_types))
    if keys is not None:
        for column in ("source_key", "reference_key"):
            left = left.join(keys.select(F.col("key").alias("__key")), F.col(column) == F.col("__key"), "left_anti")
    return left
