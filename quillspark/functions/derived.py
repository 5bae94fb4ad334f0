"""Derived columns of catalogue entries: modifiers, fallbacks, lookups and display texts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

ABILITIES = ["strength", "dexterity", "constitution", "intelligence", "wisdom", "charisma"]

# The ability behind each skill.
SKILLS = {
    "acrobatics": "dexterity", "animal_handling": "wisdom", "arcana": "intelligence", "athletics": "strength", "deception": "charisma", "history": "intelligence",
    "insight": "wisdom", "intimidation": "charisma", "investigation": "intelligence", "medicine": "wisdom", "nature": "intelligence", "perception": "wisdom",
    "performance": "charisma", "persuasion": "charisma", "religion": "intelligence", "sleight_of_hand": "dexterity", "stealth": "dexterity", "survival": "wisdom",
}

# Experience points by challenge rating.
EXPERIENCE = {
    0: 0, 0.125: 25, 0.25: 50, 0.5: 100, 1: 200, 2: 450, 3: 700, 4: 1100, 5: 1800, 6: 2300, 7: 2900, 8: 3900, 9: 5000, 10: 5900, 11: 7200, 12: 8400, 13: 10000,
    14: 11500, 15: 13000, 16: 15000, 17: 18000, 18: 20000, 19: 22000, 20: 25000, 21: 33000, 22: 41000, 23: 50000, 24: 62000, 25: 75000, 26: 90000, 27: 105000,
    28: 120000, 29: 135000, 30: 155000,
}

# Spell slots of levels 1 to 9 that a full caster has at character levels 1 to 20.
FULL_SLOTS = [
    [2, 0, 0, 0, 0, 0, 0, 0, 0],
    [3, 0, 0, 0, 0, 0, 0, 0, 0],
    [4, 2, 0, 0, 0, 0, 0, 0, 0],
    [4, 3, 0, 0, 0, 0, 0, 0, 0],
    [4, 3, 2, 0, 0, 0, 0, 0, 0],
    [4, 3, 3, 0, 0, 0, 0, 0, 0],
    [4, 3, 3, 1, 0, 0, 0, 0, 0],
    [4, 3, 3, 2, 0, 0, 0, 0, 0],
    [4, 3, 3, 3, 1, 0, 0, 0, 0],
    [4, 3, 3, 3, 2, 0, 0, 0, 0],
    [4, 3, 3, 3, 2, 1, 0, 0, 0],
    [4, 3, 3, 3, 2, 1, 0, 0, 0],
    [4, 3, 3, 3, 2, 1, 1, 0, 0],
    [4, 3, 3, 3, 2, 1, 1, 0, 0],
    [4, 3, 3, 3, 2, 1, 1, 1, 0],
    [4, 3, 3, 3, 2, 1, 1, 1, 0],
    [4, 3, 3, 3, 2, 1, 1, 1, 1],
    [4, 3, 3, 3, 3, 1, 1, 1, 1],
    [4, 3, 3, 3, 3, 2, 1, 1, 1],
    [4, 3, 3, 3, 3, 2, 2, 1, 1],
]


def modifier(score: Column) -> Column:
    """floor((score - 10) / 2)."""
    return F.floor((score - 10) / 2).cast("int")


def skill_bonus(skill: str, explicit: Column, scores: dict[str, Column]) -> Column:
    """The explicit bonus, else the modifier of the skill's ability."""
    return F.coalesce(explicit, modifier(scores[SKILLS[skill]]))


def saving_throw(explicit: Column, score: Column) -> Column:
    return F.coalesce(explicit, modifier(score))


def experience(rating: Column, override: Column | None = None) -> Column:
    """The override, else by rating; null for a rating without an entry."""
    table = F.create_map(*(F.lit(x) for k, v in EXPERIENCE.items() for x in (float(k), v)))
    found = F.try_element_at(table, rating.cast("double"))
    return found if override is None else F.coalesce(override, found)


def proficiency(level: Column) -> Column:
    """0 at level 0, then 2 and one more every four levels up to 20."""
    return F.when(level == 0, 0).when(level.between(1, 20), (F.floor((level - 1) / 4) + 2).cast("int"))


def spell_slots(level: Column, caster: Column) -> Column:
    """Slots by spell level from 0 (none). Half casters have those of a full caster of half their level, rounded up, from level 2 on; others have none; null outside 0 to 20."""
    full = F.array(*(F.array(F.lit(0), *(F.lit(n) for n in x)) for x in FULL_SLOTS))
    own = F.element_at(full, F.greatest(F.lit(1), level.cast("int")))
    half = F.slice(F.element_at(full, F.greatest(F.lit(1), F.ceil(level / 2).cast("int"))), 1, 6)
    none = F.array().cast("array<int>")
    slots = F.when(level == 0, none).when(caster == "FULL", own).when(caster == "HALF", F.when(level == 1, F.array_repeat(F.lit(0), 6)).otherwise(half)).otherwise(none)
    return F.when(level.between(0, 20), slots)


def speeds(walk: Column, fly: Column, burrow: Column, climb: Column, swim: Column) -> Column:
    """All speeds: none to fly or burrow unless given, half the walk to climb, swim and crawl."""
    half = F.floor(walk / 2)
    zero = F.lit(0.0)
    return F.struct(walk.alias("walk"), F.coalesce(fly, zero).alias("fly"), F.coalesce(burrow, zero).alias("burrow"), F.coalesce(climb, half.cast("double")).alias("climb"), F.coalesce(swim, half.cast("double")).alias("swim"), half.cast("double").alias("crawl"))


def armor_category(add_dex: Column, cap: Column) -> Column:
    """medium with a cap other than 0, else light if dexterity is added, else heavy."""
    return F.when(cap.isNotNull() & (cap != 0), "medium").when(add_dex, "light").otherwise("heavy")


def armor_display(base: Column, add_dex: Column, cap: Column) -> Column:
    return F.concat(base.cast("string"), F.when(add_dex, " + Dex modifier").otherwise(""), F.when(cap.isNotNull(), F.concat(F.lit(" (max "), cap.cast("string"), F.lit(")"))).otherwise(""))


def usage_limits(kind: Column, param: Column) -> Column:
    """Null unless there is a kind and a number other than 0."""
    return F.when((F.coalesce(kind, F.lit("")) != "") & (F.coalesce(param, F.lit(0)) != 0), F.struct(kind.alias("type"), param.alias("param")))


def hit_points(dice: Column, name: Column) -> Column:
    """Texts about hit points; null where the dice are."""
    sides = F.element_at(F.split(F.lower(dice), "d"), 2)
    more = (F.floor(sides.try_cast("int") / 2) + 1).cast("string")
    first = F.concat(sides, F.lit(" + your Constitution modifier"))
    later = F.concat(F.lit("1"), dice, F.lit(" (or "), more, F.lit(") + your Constitution modifier per "), F.lower(name), F.lit(" level after 1st"))
    return F.when(dice.isNotNull(), F.struct(dice.alias("hit_dice"), F.concat(F.lit("1"), dice, F.lit(" per "), name, F.lit(" level")).alias("hit_dice_name"), first.alias("hit_points_at_1st_level"), later.alias("hit_points_at_higher_levels")))


def level_name(level: Column) -> Column:
    """Cantrip, 1st-level, 2nd-level, 3rd-level, 4th-level, ..."""
    suffix = F.when(level == 1, "st").when(level == 2, "nd").when(level == 3, "rd").otherwise("th")
    return F.when(level == 0, "Cantrip").otherwise(F.concat(level.cast("string"), suffix, F.lit("-level")))


def components(verbal: Column, somatic: Column, material: Column) -> Column:
    return F.concat_ws(", ", F.when(verbal, "V"), F.when(somatic, "S"), F.when(material, "M"))


def yes_no(flag: Column) -> Column:
    return F.when(flag, "yes").otherwise("no")
