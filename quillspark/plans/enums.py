"""Choices of enumerated columns."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from quillspark.operators import quality

# The codes that each enumerated column takes.
DICE = [f"{d}{n}" for d in "Dd" for n in (3, 4, 6, 8, 10, 12, 20)]
DISTANCE_UNITS = ["feet", "ft", "miles", "any"]
CASTERS = ["FULL", "HALF", "PACT", "NONE"]
ACTIONS = ["ACTION", "REACTION", "BONUS_ACTION", "LEGENDARY_ACTION", "LAIR_ACTION"]
USES = ["PER_DAY", "RECHARGE", "RECHARGE_ON_ROLL", "RECHARGE_AFTER_REST"]
ATTACKS = ["SPELL", "WEAPON"]
TARGETS = ["creature", "object", "point", "area"]
SHAPES = ["cone", "cube", "cylinder", "line", "sphere"]
CASTING_TIMES = ["reaction", "bonus-action", "action", "turn", "round", "1minute", "5minutes", "10minutes", "1hour", "4hours", "7hours", "8hours", "9hours", "12hours", "24hours", "1week"]
CASTING_OPTIONS = ["default", "ritual", *(f"player_level_{n}" for n in range(1, 21)), *(f"slot_level_{n}" for n in range(1, 10))]
MODIFICATIONS = ["ability_score", "skill_proficiency", "tool_proficiency", "language", "equipment", "feature", "feat", "suggested_characteristics", "adventures_and_advancement", "connection_and_memento"]
IMAGES = ["icon", "illustration"]

#: (entity, column) -> choices.
DOMAINS: dict[tuple[str, str], list[str]] = {
    ("characterclass", "hit_dice"): DICE, ("characterclass", "caster_type"): CASTERS, ("size", "suggested_hit_dice"): DICE, ("creatureaction", "action_type"): ACTIONS,
    ("creatureaction", "uses_type"): USES, ("creatureactionattack", "attack_type"): ATTACKS, ("creatureactionattack", "damage_die_type"): DICE, ("creatureactionattack", "distance_unit"): DISTANCE_UNITS,
    ("spell", "target_type"): TARGETS, ("spell", "shape_type"): SHAPES, ("spell", "casting_time"): CASTING_TIMES, ("spell", "range_unit"): DISTANCE_UNITS,
    ("spellcastingoption", "type"): CASTING_OPTIONS, ("backgroundbenefit", "type"): MODIFICATIONS, ("featbenefit", "type"): MODIFICATIONS, ("image", "type"): IMAGES,
    ("weapon", "distance_unit"): DISTANCE_UNITS, ("document", "distance_unit"): DISTANCE_UNITS,
}


def catalogue_of(spark: SparkSession) -> DataFrame:
    """(entity, column, position, value) of all choices."""
    rows = [(e, c, k, v) for (e, c), values in DOMAINS.items() for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "entity string, column string, position int, value string")


def outside(tables: dict[str, DataFrame]) -> DataFrame:
    """(key, column, value) of values that aren't among the choices; null passes."""
    return reduce(DataFrame.unionByName, (quality.outside_domain(tables[e], "key", {c: v}) for (e, c), v in DOMAINS.items() if e in tables))
