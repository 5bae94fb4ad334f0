"""Slugs, initials and other text expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and the plain letters that stand for them in keys and searches.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def without_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def slug(c: Column) -> Column:
    """Plain letters in lower case, digits, _ and single hyphens; other characters than spaces and hyphens go."""
    plain = F.regexp_replace(F.lower(without_accents(c)), r"[^a-z0-9_\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.trim(plain), r"[-\s]+", "-"), r"^[-_]+|[-_]+$", "")


def short_slug(c: Column) -> Column:
    """Spaces become hyphens, other characters than a-z, 0-9 and - go; nothing collapses."""
    return F.regexp_replace(F.replace(F.lower(c), F.lit(" "), F.lit("-")), r"[^a-z0-9-]", "")


def edge_key(source: Column, anchor: Column, reference: Column) -> Column:
    """source_anchor_reference, with at most 80 characters of the anchor's slug."""
    return F.concat_ws("_", source, F.substring(slug(anchor), 1, 80), reference)


def initials(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, " "), lambda w: F.upper(F.substring(w, 1, 1))), "")


def first_word(name: Column) -> Column:
    return F.element_at(F.split(name, " "), 1)


def last_word(name: Column) -> Column:
    return F.element_at(F.split(name, " "), -1)


def fallback_name(display: Column, name: Column) -> Column:
    """The display name, unless it is null or blank."""
    return F.when(F.trim(F.coalesce(display, F.lit(""))) != "", display).otherwise(name)


def without_markup(c: Column) -> Column:
    """Markdown's bold, italics and code marks go, white space collapses."""
    for mark in (r"\*\*(.*?)\*\*", r"\*(.*?)\*", r"`(.*?)`"):
        c = F.regexp_replace(c, mark, "$1")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def highlighted(text: Column, terms: list[str], before: str = '<span class="highlighted">', after: str = "</span>") -> Column:
    """Whole words in either case, marked. A term is taken literally."""
    words = "|".join("".join(f"\\{x}" if not x.isalnum() else x for x in t) for t in terms if t)
    return F.regexp_replace(text, rf"(?iU)\b({words})\b", f"{before}$1{after}") if words else text
