"""Parsers of rule texts as column expressions: prices, weights, ranges, components, durations, dice, senses, speeds."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import without_markup

NUMBER = r"(\d+(?:\.\d+)?)"

# Names that texts are searched for.
DAMAGE_TYPES = ["acid", "bludgeoning", "cold", "fire", "force", "lightning", "necrotic", "piercing", "poison", "psychic", "radiant", "slashing", "thunder"]
ABILITY_WORDS = ["Strength", "Dexterity", "Constitution", "Intelligence", "Wisdom", "Charisma"]
SCHOOLS = ["abjuration", "conjuration", "divination", "enchantment", "evocation", "illusion", "necromancy", "transmutation"]
SHAPES = ["cone", "cube", "cylinder", "line", "sphere", "emanation", "square"]
RARITIES = ["common", "uncommon", "rare", "very rare", "legendary", "artifact"]
FEET_IN_A_MILE = 5280


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    text = F.regexp_extract(c, pattern, group)
    return F.when(text != "", text)


def number(c: Column, pattern: str) -> Column:
    return found(c, pattern).try_cast("double")


def cost(c: Column) -> Column:
    """Price in gold pieces with two decimals; silver counts a tenth, copper a hundredth, anything else 0."""
    text = F.replace(F.upper(c), F.lit(","), F.lit(""))
    amount = number(text, NUMBER)
    rate = F.when(text.contains("GP"), 1.0).when(text.contains("SP"), 0.1).when(text.contains("CP"), 0.01)
    return F.coalesce(F.round(amount * rate, 2), F.lit(0.0)).cast("decimal(10,2)")


def weight(c: Column) -> Column:
    """Number or fraction with three decimals, else 0. A fraction is read as one ("1/4" is 0.25)."""
    over, under = number(c, r"(\d+)/\d+"), number(c, r"\d+/(\d+)")
    return F.coalesce(F.round(F.when(under != 0, over / under), 3), F.round(number(c, NUMBER), 3), F.lit(0.0)).cast("decimal(10,3)")


def distance(c: Column) -> Column:
    """(range in feet, unit): 0 without unit for Self, Touch and what holds no distance."""
    text = without_markup(c)
    feet = F.coalesce(number(text, r"(\d+)\s*feet"), number(text, r"(\d+)\s*mile") * FEET_IN_A_MILE)
    near = text.contains("Self") | text.contains("Touch")
    return F.struct(F.when(near | feet.isNull(), 0.0).otherwise(feet).alias("range"), F.when(~near & feet.isNotNull(), "feet").alias("unit"))


def sortable_range(c: Column) -> Column:
    """Feet to sort by. Self 0, touch 1, sight 9999, special 99990, unlimited 99999."""
    text = F.lower(F.element_at(F.split(c, r" \("), 1))
    amount = F.element_at(F.split(text, " "), 1).try_cast("int")
    words = F.when(text.contains("self"), 0).when(text == "touch", 1).when(text == "sight", 9999).when(text == "unlimited", 99999).when(text == "special", 99990)
    return F.when(text.rlike(r"(feet|ft\.)$"), amount).when(text.rlike(r"miles?$"), amount * FEET_IN_A_MILE).otherwise(words)


def spell_components(c: Column) -> Column:
    """(verbal, somatic, material, material_specified, material_cost, material_consumed)."""
    text = without_markup(c)
    material = text.contains("M")
    what = F.when(material, F.coalesce(found(text, r"M\s*\((.*?)\)"), F.lit(""))).otherwise("")
    gone = F.lower(what).contains("consume") | F.lower(what).contains("worth")
    return F.struct(text.contains("V").alias("verbal"), text.contains("S").alias("somatic"), material.alias("material"), what.alias("material_specified"), found(what, r"(\d+)\s*gp").try_cast("int").alias("material_cost"), gone.alias("material_consumed"))


def duration(c: Column) -> Column:
    """(duration, concentration): instantaneous, permanent, "10 minute" or the text in lower case."""
    text = without_markup(c)
    time = F.when(text.rlike(r"\d+\s*(round|minute|hour|day)"), F.concat_ws(" ", found(text, r"(\d+)\s*(round|minute|hour|day)"), found(text, r"\d+\s*(round|minute|hour|day)")))
    plain = F.when(text.contains("Instantaneous"), "instantaneous").when(text.contains("Permanent"), "permanent").otherwise(F.coalesce(time, F.lower(text)))
    return F.struct(plain.alias("duration"), text.contains("Concentration").alias("concentration"))


def casting_time(c: Column) -> Column:
    """(casting_time, reaction_condition)."""
    text = without_markup(c)
    low = F.lower(text)
    reaction = text.contains("Reaction")
    kind = F.when(reaction, "reaction").when(text.contains("Bonus Action"), "bonus_action").when(text.contains("Ritual"), F.when(text.contains("1 minute"), "minute").otherwise("action"))
    kind = F.coalesce(kind, F.when(low.contains("minute"), "minute").when(low.contains("hour"), "hour").otherwise("action"))
    return F.struct(kind.alias("casting_time"), F.when(reaction, F.coalesce(found(text, r"Reaction\s*\((.*?)\)"), F.regexp_extract(text, r"Reaction,?\s*(.*)", 1))).alias("reaction_condition"))


def spell_level(c: Column) -> Column:
    """0 for a cantrip, else the number after Level; null without one."""
    return F.when(F.lower(c).contains("cantrip"), 0).otherwise(found(c, r"(?i)level (\d+)").try_cast("int"))


def first_of(c: Column, names: list[str], default: str | None = None) -> Column:
    """The first name of the list that the text holds, in either case."""
    low = F.lower(c)
    return F.coalesce(*(F.when(low.contains(n.lower()), n) for n in names), F.lit(default))


def all_of(c: Column, names: list[str]) -> Column:
    """The names that the text holds, in the list's order."""
    low = F.lower(c)
    return F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(low, F.lower(n)))


def saving_throw(c: Column) -> Column:
    """The ability of the first saving throw, in lower case."""
    return F.lower(found(c, rf"({'|'.join(ABILITY_WORDS)}) saving throw"))


def damage(c: Column) -> Column:
    """(first dice, distinct types that follow dice)."""
    dice = rf"(?i)(\d+d\d+(?:\s*\+\s*\d+)?)\s+({'|'.join(DAMAGE_TYPES)}) damage"
    return F.struct(found(c, dice).alias("dice"), F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(dice), 2), F.lower)).alias("types"))


def attack(c: Column) -> Column:
    """(kind, to_hit, reach, range, dice, dice_bonus): from "Melee Weapon Attack: +4 to hit, reach 5 ft., ... 5 (1d6 + 2)"."""
    bonus = found(c, r"\(\d+d\d+\s*([+-]\s*\d+)\)")
    fields = {"kind": F.upper(found(c, r"(?i)(weapon|spell) attack")), "to_hit": found(c, r"([+-]\d+) to hit").try_cast("int"), "reach": number(c, r"reach (\d+)"), "range": number(c, r"range (\d+)"), "dice": found(c, r"\((\d+d\d+)"), "dice_bonus": F.replace(bonus, F.lit(" "), F.lit("")).try_cast("int")}
    return F.struct(*(x.alias(n) for n, x in fields.items()))


def usage(name: Column) -> Column:
    """(type, param) from names like "Fire Breath (Recharge 5-6)" and "Teleport (3/Day)"."""
    low = F.lower(name)
    day, from_, rest = found(low, r"(\d+)/day"), found(low, r"recharge (\d)"), low.contains("recharges after a")
    kind = F.when(day.isNotNull(), "PER_DAY").when(from_.isNotNull(), "RECHARGE_ON_ROLL").when(rest, "RECHARGE_AFTER_REST")
    return F.struct(kind.alias("type"), F.coalesce(day, from_).try_cast("int").alias("param"))


def senses(c: Column) -> Column:
    """Ranges of four senses, and passive perception (10 unless said)."""
    kinds = ("darkvision", "blindsight", "tremorsense", "truesight")
    line = F.coalesce(found(c, r"(?i)- \*\*Senses\*\*:?\s*([^\n]+)"), F.lit(""))
    passive = F.coalesce(found(line, r"(?i)passive\s+perception\s+(\d+)").try_cast("int"), F.lit(10))
    return F.struct(*(number(line, rf"(?i){k}\s+(\d+)\s*ft").alias(f"{k}_range") for k in kinds), passive.alias("passive_perception"))


def movement(c: Column) -> Column:
    """Walk (30 unless said) and four other speeds; whether it hovers."""
    line = F.coalesce(found(c, r"(?i)- \*\*Speed:\*\*\s*([^\n]+)"), F.lit(""))
    kinds = {k: number(line, rf"(?i){k}\s+(\d+)\s*ft") for k in ("fly", "swim", "burrow", "climb")}
    walk = F.coalesce(number(F.trim(line), r"^(\d+)\s*ft"), F.lit(30.0))
    return F.struct(walk.alias("walk"), *(x.alias(k) for k, x in kinds.items()), (kinds["fly"].isNotNull() & F.lower(line).contains("hover")).alias("hover"))


def passive_perception(senses_text: Column, wisdom: Column) -> Column:
    """As said, else 10 and the modifier of wisdom."""
    return F.coalesce(found(F.lower(senses_text), r"passive perception (\d+)").try_cast("int"), (10 + F.floor((wisdom - 10) / 2)).cast("int"))
