"""Conversions of older records: lists in text, JSON in text, dice by level, keyword cascades."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.derived import ABILITIES, SKILLS
from quillspark.functions.parsers import DAMAGE_TYPES, found

# Damage that nonmagical weapons do; character levels at which a cantrip's dice grow.
WEAPON_DAMAGE = ["bludgeoning", "piercing", "slashing"]
TIERS = [5, 11, 17]


def keyword_context(text: Column, word: str, around: int = 40) -> Column:
    """(found, context): whether the text holds the word, in either case, and what stands around it."""
    at = F.locate(word.lower(), F.lower(text))
    context = F.substr(text, F.greatest(F.lit(1), at - around), F.least(at - 1, F.lit(around)) + len(word) + around)
    return F.struct((at > 0).alias("found"), F.when(at > 0, context).otherwise("").alias("context"))


def near_any(text: Column, word: str, others: list[str], around: int = 40) -> Column:
    """Whether one of the other words stands near the word."""
    context = F.lower(keyword_context(text, word, around)["context"])
    return F.exists(F.array(*(F.lit(x.lower()) for x in others)), lambda x: F.contains(context, x))


def word_before(text: Column, word: str) -> Column:
    """The word before the first occurrence; null without one."""
    words = F.split(text, " ")
    at = F.array_position(words, word)
    return F.when(at > 1, F.element_at(words, F.greatest(at - 1, F.lit(1)).cast("int")))


def damage_list(text: Column) -> Column:
    """Damage types in the order named; what says nonmagical stands for the damage of weapons, and nothing after it counts."""
    low = F.lower(F.coalesce(text, F.lit("")))
    cut = F.locate("nonmagical", low)
    head = F.when(cut > 0, F.substr(low, F.lit(1), F.greatest(cut - 1, F.lit(0)))).otherwise(low)
    named = F.array_distinct(F.regexp_extract_all(head, F.lit(rf"({'|'.join(DAMAGE_TYPES)})"), 1))
    return F.when(cut > 0, F.array_union(F.array_except(named, F.array(*map(F.lit, WEAPON_DAMAGE))), F.array(*map(F.lit, WEAPON_DAMAGE)))).otherwise(named)


def language_list(text: Column, known: list[str]) -> Column:
    """(keys, telepathy_range): the known languages that are named; all of them where the text says all."""
    low = F.lower(F.coalesce(text, F.lit("")))
    every = F.array(*map(F.lit, known))
    named = F.filter(every, lambda k: F.contains(low, k))
    return F.struct(F.when(low.rlike(r"^\s*all\b"), every).otherwise(named).alias("keys"), found(low, r"telepathy (\d+)").try_cast("double").alias("telepathy_range"))


def skills_from_json(text: Column) -> Column:
    """A struct of all skills from JSON like {"Sleight of Hand": 4}."""
    table = F.from_json(F.lower(text), "map<string,int>")
    return F.struct(*(F.coalesce(F.try_element_at(table, F.lit(s)), F.try_element_at(table, F.lit(s.replace("_", " ")))).alias(s) for s in SKILLS))


def speeds_from_json(text: Column) -> Column:
    """A struct of speeds from JSON like {"walk": 30, "hover": true}."""
    return F.struct(*(F.get_json_object(text, f"$.{k}").try_cast("double").alias(k) for k in ("walk", "fly", "swim", "burrow", "climb")), F.coalesce(F.get_json_object(text, "$.hover").try_cast("boolean"), F.lit(False)).alias("hover"))


def scores_from_table(text: Column) -> Column:
    """Six ability scores from the rows of a pipe table, like "| STR | 10 | +0 |"."""
    return F.struct(*(found(text, rf"(?i)\|\s*{a[:3]}[a-z]*\s*\|\s*(\d+)").try_cast("int").alias(a) for a in ABILITIES))


def tier_dice(dice: Column, level: Column) -> Column:
    """A cantrip's dice at a character level: as many times the dice as tiers are reached, and once."""
    times = sum((F.when(level >= t, 1).otherwise(0) for t in TIERS), F.lit(1))
    count, size = found(dice, r"^(\d+)d").try_cast("int"), found(dice, r"d(\d+)$")
    return F.concat((count * times).cast("string"), F.lit("d"), size)


def slot_dice(dice: Column, more: Column, level: Column, slot: Column) -> Column:
    """Dice with `more` of the same size for each slot level above the spell's own."""
    count, size = found(dice, r"^(\d+)d").try_cast("int"), found(dice, r"d(\d+)$")
    return F.concat((count + more * F.greatest(F.lit(0), slot - level)).cast("string"), F.lit("d"), size)


def target_count(base: Column, level: Column, slot: Column, slope: Column) -> Column:
    """One more target for each `slope` slot levels above the spell's own."""
    return base + F.floor((slot - level) / slope).cast("int")


def casting_options(spells: DataFrame, key: str = "key", level: str = "level", ritual: str = "ritual") -> DataFrame:
    """(parent, type) of each way to cast: default, ritual, every slot above the level, or every tier of a cantrip."""
    slots = F.when(F.col(level).between(1, 8), F.transform(F.sequence(F.col(level) + 1, F.lit(9)), lambda n: F.concat(F.lit("slot_level_"), n.cast("string")))).otherwise(F.array().cast("array<string>"))
    tiers = F.when(F.col(level) == 0, F.array(*(F.lit(f"player_level_{t}") for t in TIERS))).otherwise(F.array().cast("array<string>"))
    ways = F.concat(F.array(F.lit("default")), F.when(F.col(ritual), F.array(F.lit("ritual"))).otherwise(F.array().cast("array<string>")), tiers, slots)
    return spells.select(F.col(key).alias("parent"), F.explode(ways).alias("type"))


def first_keyword(text: Column, values: dict[str, str], default: str | None = None) -> Column:
    """The value of the first keyword (in the given order) that the text holds, in either case."""
    low = F.lower(text)
    return F.coalesce(*(F.when(low.contains(k.lower()), F.lit(v)) for k, v in values.items()), F.lit(default))


def attack_types(text: Column) -> Column:
    """melee, ranged or both, from how an attack begins."""
    low = F.lower(text)
    return F.filter(F.array(F.when(low.rlike(r"^\s*melee"), "melee"), F.when(low.rlike(r"^\s*(melee or )?ranged"), "ranged")), lambda x: x.isNotNull())


def level_of_hit_points(points: Column, sides: Column, constitution: Column) -> Column:
    """The level at which dice of so many sides give these hit points on average, 1 at least."""
    each = (sides + 1) / 2 + F.floor((constitution - 10) / 2)
    return F.greatest(F.lit(1), F.round(points / F.greatest(each, F.lit(1.0)))).cast("int")


def nth_level(text: Column) -> Column:
    """3 from "at 3rd level"."""
    return found(text, r"(?i)(\d+)(?:st|nd|rd|th)[ -]level").try_cast("int")
