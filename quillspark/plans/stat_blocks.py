"""Creatures, their traits, actions and attacks from stat blocks in Markdown, and the lines that no rule takes.

A block begins with a heading of level 2 and holds labelled lines, a table of scores and sections of named entries. All
of it is read by expressions over the block's own row, so nothing is shuffled. Where the behaviour to rebuild loses
what a block says, the block counts: its challenge rating (fractions as such; 0.125 only without one), the sign of a
damage bonus, and the damage type, which is the attack's own. Skills are read with a plus only, and vulnerabilities
not at all: such a line is among the unplaced.
"""

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import conversions, parsers
from quillspark.functions.derived import ABILITIES, SKILLS
from quillspark.functions.parsers import all_of, first_of, found
from quillspark.functions.text import without_markup
from quillspark.sources.texts import sections

# Names that blocks are searched for, sections and their kinds of entries, and what holds without a line.
SIZES = ["tiny", "small", "medium", "large", "huge", "gargantuan"]
TYPES = ["aberration", "beast", "celestial", "construct", "dragon", "elemental", "fey", "fiend", "giant", "humanoid", "monstrosity", "ooze", "plant", "undead"]
ALIGNMENTS = ["lawful evil", "chaotic evil", "neutral evil", "lawful good", "chaotic good", "neutral good", "lawful neutral", "chaotic neutral", "unaligned"]
LANGUAGES = ["common", "draconic", "deep speech", "giant", "goblin", "orc", "elvish", "dwarvish", "halfling", "gnomish", "abyssal", "celestial", "infernal", "primordial", "sylvan", "undercommon"]
CONDITIONS = ["blinded", "charmed", "deafened", "exhaustion", "frightened", "grappled", "incapacitated", "invisible", "paralyzed", "petrified", "poisoned", "prone", "restrained", "stunned", "unconscious"]
ENERGIES = [t for t in parsers.DAMAGE_TYPES if t not in ("bludgeoning", "piercing", "slashing")]
SECTIONS = {"Traits": "TRAIT", "Actions": "ACTION", "Bonus Actions": "BONUS_ACTION", "Reactions": "REACTION", "Legendary Actions": "LEGENDARY_ACTION"}
NORMAL_SIGHT = 10560.0  #: feet

ENTRY = r"(?s)\*\*\*([^*]+)\.\*\*\*\s*+(?!\*\*\*|\z)(.*?)(?=\*\*\*|\z)"  #: with a description
_REACH = r"(?:reach (\d+) ?ft\.?)? ?(?:(?:or )?range (\d+)(?:/(\d+))? ?ft\.?)?"
_ROLLS = (
    rf"(?i)(?:melee|ranged)(?: or ranged)? attack roll: ?([+-]?\d+), ?{_REACH} ?\d+ ?\(([^)]+)\) ?(\w+) damage",
    rf"(?i)(?:melee|ranged) (?:weapon|spell) attack: ?([+-]?\d+) to hit, ?{_REACH}.*?hit: ?\d+ ?\(([^)]+)\) ?(\w+) damage",
)
_LABELS = (
    r"\*\*Armor Class:\*\* *\d+",
    r"\*\*Hit Points:\*\* *\d+ *\([^)]+\)",
    r"\*\*Speed:\*\* *\d+ *ft",
    r"\*\*Initiative\*\*:? *[+-]?\d+",
    r"\*\*Skills\*\*:? *\S",
    r"\*\*Senses\*\*:? *\S",
    r"\*\*Languages\*\*:? *\S",
    r"\*\*CR\*\* *\d+",
    r"\*\*Resistances?\*\*:? *\S",
    r"\*\*Immunit(?:y|ies)\*\*:? *\S",
    r"\*\*Condition Immunit(?:y|ies)\*\*:? *\S",
)
_PLACED = rf"(?i)^\s*(?:- (?:{'|'.join(_LABELS)})|\*[^*].*\*\s*$|\| *STAT *\||\|[ |:-]+$|\| *(?:STR|DEX|CON|INT|WIS|CHA) *\| *\d+ *\|)"


def _line(text: Column, label: str) -> Column:
    """What follows "- **label**" on its line."""
    return found(text, rf"(?i)- \*\*{label}\*\*:?[ \t]*([^\n]+)")


def _rating(text: Column) -> Column:
    whole, under = (parsers.number(text, rf"- \*\*CR\*\*\s*{p}") for p in (r"(\d+(?:\.\d+)?)", r"\d+/(\d+)"))
    return F.coalesce(whole / F.when(under != 0, under).otherwise(1.0), F.lit(0.125)).cast("decimal(10,3)")


def entry_key(parent: Column, name: Column) -> Column:
    """parent_name in lower case: spaces and slashes become hyphens, parentheses go."""
    return F.concat_ws("_", parent, F.translate(F.lower(name), " /()", "--"))


def attack_roll(desc: Column) -> Column:
    """(to_hit_mod, reach, range, long_range, damage_die_count, damage_die_type, damage_bonus, damage_type), null without an attack.

    Reads "Melee Attack Roll: +9, reach 15 ft. 12 (2d6 + 5) Bludgeoning damage" and "Melee Weapon Attack: +9 to hit,
    reach 10 ft., one target. Hit: 12 (2d6 + 5) bludgeoning damage"; of a text that holds both the first form.
    """

    def part(group: int) -> Column:
        return F.coalesce(*(F.when(desc.rlike(p), F.regexp_extract(desc, p, group)) for p in _ROLLS))

    dice = part(5)
    bonus = F.replace(found(dice, r"\d+d\d+\s*([+-]\s*\d+)"), F.lit(" "), F.lit(""))
    sides = found(dice, r"\d+d(\d+)")
    fields = {
        "to_hit_mod": part(1).try_cast("int"),
        "reach": part(2).try_cast("double"),
        "range": part(3).try_cast("double"),
        "long_range": part(4).try_cast("double"),
        "damage_die_count": found(dice, r"(\d+)d\d+").try_cast("int"),
        "damage_die_type": F.concat(F.lit("D"), sides),
        "damage_bonus": bonus.try_cast("int"),
        "damage_type": F.lower(part(6)),
    }
    return F.when(part(1).isNotNull(), F.struct(*(c.alias(n) for n, c in fields.items())))


class StatBlocks:
    """The blocks of `text` in each row of df, of one document and category. Null and empty texts hold none; a block's key is document_name."""

    def __init__(self, df: DataFrame, text: str, document: str, category: str = "Monsters"):
        self.document, self.category = document, category
        name = without_markup(F.col("title"))
        slugged = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\w\s-]", ""), r"[-\s]+", "-")
        parts = F.split(F.col("body"), r"(?:^|\n)### ", -1)
        found_blocks = sections(df, text, 2, []).where(name != "")
        self.blocks = found_blocks.select(F.concat_ws("_", F.lit(document), slugged).alias("key"), name.alias("name"), "body", parts[0].alias("head"), F.slice(parts, 2, F.size(parts)).alias("parts"))

    @cached_property
    def creatures(self) -> DataFrame:
        text = F.col("body")
        scores, senses, speeds = conversions.scores_from_table(text), parsers.senses(text), parsers.movement(text)
        header = F.coalesce(found(F.col("head"), r"(?m)^\s*\*([^*].*)\*\s*$"), F.lit(""))
        skills, languages = _line(text, "Skills"), _line(text, "Languages")
        resisted, immune, conditions = (F.coalesce(_line(text, x), F.lit("")) for x in ("Resistances?", "Immunit(?:y|ies)", "Condition Immunit(?:y|ies)"))
        stated = F.split(immune, ";")
        lists = {
            "languages": F.transform(all_of(F.coalesce(languages, F.lit("")), LANGUAGES), lambda x: F.replace(x, F.lit(" "), F.lit("-"))),
            "damage_vulnerabilities": F.array().cast("array<string>"),
            "damage_immunities": all_of(stated[0], ENERGIES),
            "damage_resistances": all_of(resisted, ENERGIES),
            "condition_immunities": F.concat(all_of(F.coalesce(F.try_element_at(stated, F.lit(2)), F.lit("")), CONDITIONS), all_of(conditions, CONDITIONS)),
        }
        columns = {
            "ability_score_" + a: F.coalesce(scores[a], F.lit(10)) for a in ABILITIES
        } | {
            "saving_throw_" + a: found(text, rf"(?i)\|\s*{a[:3]}\s*\|\s*\d+\s*\|[^|\n]*\|\s*([+-]?\d+)\s*\|").try_cast("int") for a in ABILITIES
        } | {
            "skill_bonus_" + s: found(skills, rf"(?i){s.replace('_', ' ')}\s*\+(\d+)").try_cast("int") for s in SKILLS
        } | {
            "normal_sight_range": F.lit(NORMAL_SIGHT),
            "document": F.lit(self.document),
            "category": F.lit(self.category),
            "size": first_of(header, SIZES, "medium"),
            "type": first_of(header, TYPES, "humanoid"),
            "alignment": first_of(header, ALIGNMENTS, "neutral"),
            "armor_class": F.coalesce(found(text, r"- \*\*Armor Class:\*\*\s*(\d+)").try_cast("int"), F.lit(10)),
            "armor_detail": F.lit("natural armor"),
            "hit_points": F.coalesce(found(text, r"- \*\*Hit Points:\*\*\s*(\d+)\s*\([^)]+\)").try_cast("int"), F.lit(1)),
            "hit_dice": F.coalesce(found(text, r"- \*\*Hit Points:\*\*\s*\d+\s*\(([^)]+)\)"), F.lit("1d8")),
            "initiative_bonus": found(text, r"- \*\*Initiative\*\*:?\s*([+-]?\d+)").try_cast("int"),
            "challenge_rating": _rating(text),
            "languages_desc": F.coalesce(without_markup(languages), F.lit("")),
            "telepathy_range": parsers.number(languages, r"(?i)telepathy\s+(\d+)\s*ft"),
        } | lists
        shown = {f"{n}_display": F.array_join(lists[n], ", ") for n in lists if n != "languages"}
        return self.blocks.select("key", "name", senses.alias("_senses"), speeds.alias("_speeds"), *(c.alias(n) for n, c in (columns | shown).items())).select("*", "_senses.*", "_speeds.*").drop("_senses", "_speeds")

    @cached_property
    def _sections(self) -> DataFrame:
        """(key, name, place, title, content, kind): of equal titles only the first has a kind."""
        titles = F.transform("parts", lambda p: F.trim(F.regexp_extract(p, r"^([^\n]*)", 1)))
        rows = self.blocks.select("key", "name", titles.alias("titles"), F.posexplode("parts").alias("place", "part"))
        title = F.col("titles")[F.col("place")]
        kind = F.coalesce(*(F.when(title == t, k) for t, k in SECTIONS.items()))
        first = F.array_position("titles", title) == F.col("place") + 1
        return rows.select("key", "name", "place", title.alias("title"), F.regexp_replace("part", r"^[^\n]*\n?", "").alias("content"), F.when(first, kind).alias("kind"))

    @cached_property
    def _entries(self) -> DataFrame:
        """(parent, kind, order from 0, name, desc) of named entries with a description."""
        names, descs = (F.regexp_extract_all("content", F.lit(ENTRY), g) for g in (1, 2))
        entries = F.zip_with(names, descs, lambda n, d: F.struct(without_markup(n).alias("name"), without_markup(d).alias("desc")))
        kept = F.filter(entries, lambda e: (e["name"] != "") & (e["desc"] != ""))
        return self._sections.where("kind IS NOT NULL").select(F.col("key").alias("parent"), "kind", F.posexplode(kept).alias("order", "e")).select("parent", "kind", "order", "e.*")

    @cached_property
    def traits(self) -> DataFrame:
        return self._entries.where("kind = 'TRAIT'").select(entry_key(F.col("parent"), F.col("name")).alias("key"), "parent", "name", "desc", F.lit(None).cast("string").alias("type"))

    @cached_property
    def actions(self) -> DataFrame:
        """Actions of all kinds with their uses; an action of a legend costs what its description says, others 1."""
        low, legend = F.lower("name"), F.col("kind") == "LEGENDARY_ACTION"
        recharge, daily = low.contains("recharge") & ~legend, low.contains("/day") & ~legend
        says = F.lower("desc")
        cost = F.when(legend & says.contains("costs 2"), 2).when(legend & says.contains("costs 3"), 3).otherwise(1)
        uses = F.when(recharge, "RECHARGE").when(daily, "PER_DAY")
        param = F.when(recharge, found(low, r"recharge\s+(\d+)")).when(daily, found(low, r"(\d+)/day")).try_cast("int")
        key = entry_key(F.col("parent"), F.col("name"))
        return self._entries.where("kind <> 'TRAIT'").select(key.alias("key"), "parent", "name", "desc", F.col("kind").alias("action_type"), uses.alias("uses_type"), param.alias("uses_param"), cost.alias("legendary_cost"), "order")

    @cached_property
    def attacks(self) -> DataFrame:
        rolled = self.actions.select("key", "name", attack_roll(F.col("desc")).alias("roll")).where("roll IS NOT NULL")
        key = F.concat(entry_key(F.col("key"), F.col("name")), F.lit("-attack"))
        return rolled.select(key.alias("key"), F.col("key").alias("parent"), F.concat("name", F.lit(" attack")).alias("name"), F.lit("WEAPON").alias("attack_type"), "roll.*")

    @cached_property
    def unplaced(self) -> DataFrame:
        """(key, section, line) of lines that aren't blank and that no rule took; section is null above the first one. Lines of an unknown or repeated section are all among them."""
        head = self.blocks.select("key", F.lit(None).cast("string").alias("section"), F.explode(F.filter(F.split("head", "\n"), lambda x: ~x.rlike(_PLACED))).alias("line"))
        named = F.regexp_replace("content", ENTRY, "")
        rest = self._sections.select("key", F.col("title").alias("section"), F.explode(F.split(F.when(F.col("kind").isNull(), F.col("content")).otherwise(named), "\n")).alias("line"))
        return head.union(rest).select("key", "section", F.trim("line").alias("line")).where("line <> ''")

    @cached_property
    def line_counts(self) -> DataFrame:
        """(key, lines, unplaced) of each block: its lines that aren't blank, headings of blocks and sections left out."""
        written = F.filter(F.split("body", "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("### "))
        lost = self.unplaced.groupBy("key").agg(F.count("*").alias("unplaced"))
        return self.blocks.groupBy("key").agg(F.sum(F.size(written)).alias("lines")).join(lost, "key", "left").select("key", "lines", F.coalesce("unplaced", F.lit(0)).alias("unplaced"))
