"""Stat blocks as tables, every line accounted for; records of the first schema as those of the second."""

from decimal import Decimal

from quillspark.plans import upgrades
from quillspark.plans.stat_blocks import StatBlocks

WORM = """# Beasts

Some words on them.

## Bog Worm (Elder)

*Large Monstrosity, Chaotic Evil*

- **Armor Class:** 14
- **Hit Points:** 90 (12d10 + 24)
- **Speed:** 20 ft., Burrow 30 ft., Fly 10 ft. (hover)
- **Initiative**: -1 (9)

|STAT|SCORE|MOD|SAVE|
| --- | --- | --- | ---- |
| STR | 18 | +4 | +4 |
| DEX | 8 | -1 | -1 |
| CON | 15 | +2 | +6 |
| INT | 3 | -4 | -4 |
| WIS | 11 | +0 | +3 |
| CHA | 5 | -3 | -3 |

- **Resistances**: Acid, Cold
- **Immunities**: Fire, Poison; Charmed, Prone
- **Vulnerabilities**: Thunder
- **Skills**: Perception +3, Sleight of Hand +2, Stealth -1
- **Senses**: blindsight 60 ft.; Passive Perception 13
- **Languages**: Deep Speech, Undercommon; telepathy 30 ft.
- **CR** 1/4 (XP 50)

### Traits

***Slick.*** It can *squeeze* anywhere.
It leaves a trail.

***Empty.***

### Actions

Its deeds are these.

***Bite.*** *Melee Attack Roll:* +6, reach 10 ft. 13 (2d8 + 4) Piercing damage.

***Spit (Recharge 5-6).*** *Melee or Ranged Attack Roll:* +4, reach 5 ft. or range 20/60 ft. 3 (1d6 - 1) Acid damage.

***Burrow (2/Day).*** It digs.

### Legendary Actions

***Roll (Costs Much).*** It rolls; costs 2 actions.

### Habitat

Bogs, mostly.

## Reed Hen

- **CR** 3

### Reactions

***Peck/Claw.*** Ranged Spell Attack: -2 to hit, range 30 ft., one target. Hit: 4 (1d4+2) radiant damage.

### Reactions

***Again.*** A section that stands twice.
"""


def test_stat_blocks(spark):
    df = spark.createDataFrame([(1, WORM), (2, None), (3, ""), (4, "## \n- **CR** 2\n## Bare")], "id int, text string")
    blocks = StatBlocks(df, "text", "book")
    creatures = {r.key: r for r in blocks.creatures.collect()}
    assert set(creatures) == {"book_bog-worm-elder", "book_reed-hen", "book_bare"}
    worm, hen = creatures["book_bog-worm-elder"], creatures["book_reed-hen"]
    assert (worm.name, worm.size, worm.type, worm.alignment, worm.category, worm.document) == ("Bog Worm (Elder)", "large", "monstrosity", "chaotic evil", "Monsters", "book")
    assert (worm.armor_class, worm.hit_points, worm.hit_dice, worm.initiative_bonus, worm.challenge_rating) == (14, 90, "12d10 + 24", -1, Decimal("0.250"))
    assert (worm.ability_score_strength, worm.saving_throw_constitution, worm.saving_throw_dexterity) == (18, 6, -1)
    assert (worm.skill_bonus_perception, worm.skill_bonus_sleight_of_hand, worm.skill_bonus_stealth) == (3, 2, None)
    assert (worm.walk, worm.burrow, worm.fly, worm.hover, worm.swim) == (20.0, 30.0, 10.0, True, None)
    assert (worm.blindsight_range, worm.passive_perception, worm.telepathy_range) == (60.0, 13, 30.0)
    assert worm.languages == ["common", "deep-speech", "undercommon"] and worm.languages_desc == "Deep Speech, Undercommon; telepathy 30 ft."
    assert (worm.damage_resistances, worm.damage_immunities, worm.condition_immunities, worm.damage_vulnerabilities) == (["acid", "cold"], ["fire", "poison"], ["charmed", "prone"], [])
    assert worm.damage_immunities_display == "fire, poison"
    assert (hen.size, hen.type, hen.alignment, hen.armor_class, hen.hit_points, hen.hit_dice, hen.challenge_rating, hen.ability_score_wisdom) == ("medium", "humanoid", "neutral", 10, 1, "1d8", 3, 10)
    assert creatures["book_bare"].challenge_rating == Decimal("0.125")

    assert [(r.key, r.desc) for r in blocks.traits.collect()] == [("book_bog-worm-elder_slick", "It can squeeze anywhere. It leaves a trail.")]
    actions = {r.key: (r.action_type, r.uses_type, r.uses_param, r.legendary_cost, r.order) for r in blocks.actions.collect()}
    assert actions == {
        "book_bog-worm-elder_bite": ("ACTION", None, None, 1, 0),
        "book_bog-worm-elder_spit-recharge-5-6": ("ACTION", "RECHARGE", 5, 1, 1),
        "book_bog-worm-elder_burrow-2-day": ("ACTION", "PER_DAY", 2, 1, 2),
        "book_bog-worm-elder_roll-costs-much": ("LEGENDARY_ACTION", None, None, 2, 0),
        "book_reed-hen_peck-claw": ("REACTION", None, None, 1, 0),
    }
    attacks = {r.parent: tuple(r)[2:] for r in blocks.attacks.collect()}
    assert attacks == {
        "book_bog-worm-elder_bite": ("Bite attack", "WEAPON", 6, 10.0, None, None, 2, "D8", 4, "piercing"),
        "book_bog-worm-elder_spit-recharge-5-6": ("Spit (Recharge 5-6) attack", "WEAPON", 4, 5.0, 20.0, 60.0, 1, "D6", -1, "acid"),
        "book_reed-hen_peck-claw": ("Peck/Claw attack", "WEAPON", -2, None, 30.0, None, 1, "D4", 2, "radiant"),
    }
    assert sorted(map(tuple, blocks.unplaced.collect()), key=str) == sorted(
        [
            ("book_bog-worm-elder", None, "- **Vulnerabilities**: Thunder"),
            ("book_bog-worm-elder", "Traits", "***Empty.***"),
            ("book_bog-worm-elder", "Actions", "Its deeds are these."),
            ("book_bog-worm-elder", "Habitat", "Bogs, mostly."),
            ("book_reed-hen", "Reactions", "***Again.*** A section that stands twice."),
        ],
        key=str,
    )
    assert {tuple(r) for r in blocks.line_counts.collect()} == {("book_bog-worm-elder", 29, 4), ("book_reed-hen", 3, 1), ("book_bare", 0, 0)}
    none = StatBlocks(df.limit(0), "text", "book")
    assert not any(t.count() for t in (none.creatures, none.traits, none.actions, none.attacks, none.unplaced, none.line_counts))


def test_upgrades(spark):
    rows = spark.createDataFrame([("alert", "Alert", "d", None, '["one", "two"]'), ("bad", "Bad", "d", "x", "{oops"), ("none", "None", "d", "x", None)], "slug string, name string, desc string, prerequisite string, effects_desc_json string")
    feats, benefits = upgrades.feats(rows, "tome")
    assert {(r.key, r.prerequisite, r.document) for r in feats.collect()} == {("tome_alert", None, "tome"), ("tome_bad", "x", "tome"), ("tome_none", "x", "tome")}
    assert sorted((r.key, r.name, r.desc, r.parent) for r in benefits.collect()) == [("tome_alert_0", "", "one", "tome_alert"), ("tome_alert_1", "", "two", "tome_alert")]
    classes = spark.createDataFrame([("moon-path", "Moon Path", "Tree Warden", "Intro\n##### Moon Step\nFrom 3rd level you step.\n##### Owl's Eye\nNo rank.")], "slug string, name string, char_class string, desc string")
    found = upgrades.subclasses(classes, "tome").first()
    assert (found.key, found.subclass_of, found.saving_throws) == ("tome_moon-path", "srd_tree-warden", [])
    features, items = upgrades.features(classes, "tome")
    assert {(r.key, r.name, r.desc, r.parent) for r in features.collect()} == {("tome_moon-path_moon-step", "Moon Step", "From 3rd level you step.", "tome_moon-path"), ("tome_moon-path_owls-eye", "Owl's Eye", "No rank.", "tome_moon-path")}
    assert [tuple(r) for r in items.collect()] == [("tome_moon-path_moon-step_3", "tome_moon-path_moon-step", 3, None)]
    species = spark.createDataFrame([("tome_elf", "Your grace rises by 2.", "**_Keen._** You see.\n\n\n\nFast. You run. Far.\n\n**Bold** text"), ("tome_orc", None, None)], "parent string, asi_desc string, traits string")
    assert [tuple(r)[:3] for r in upgrades.species_traits(species).collect()] == [
        ("tome_elf_0", "Ability Score Increase", "Your grace rises by 2."),
        ("tome_elf_1", "Keen", "You see."),
        ("tome_elf_2", "Fast", "You run. Far."),
        ("tome_elf_3", "Bold", "text"),
    ]
