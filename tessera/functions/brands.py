"""Brand names, comma lists of them, and tags as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import alnum, let, present

#: Endings of configuration keys, display names that differ from the rule.
KEY_SUFFIX = "(?i)(_stores|_retailers|_dealers|_watches)$"
OVERRIDES = {
    "ALANGE SOEHNE": "A. LANGE & SÖHNE",
    "BAUME ET MERCIER": "BAUME & MERCIER",
    "BELL ROSS": "BELL & ROSS",
    "FREDERIQUE CONSTANT": "FRÉDÉRIQUE CONSTANT",
    "FREDERIQUE-CONSTANT": "FRÉDÉRIQUE CONSTANT",
    "GLASHUTTE": "GLASHÜTTE",
    "GLASHUTTE ORIGINAL": "GLASHÜTTE ORIGINAL",
    "MUHLE GLASHUTTE": "MUHLE GLASHÜTTE",
    "NOMOS GLASHUTTE": "NOMOS GLASHÜTTE",
    "UNION GLASHUTTE": "UNION GLASHÜTTE",
    "TOMMY HILFINGER": "TOMMY HILFIGER",
    "UBOAT": "U-BOAT",
    "GRAHAM OF LONDON": "GRAHAM",
}
#: Words that make a name after a house number a street line.
STREET_WORDS = ("RUE", "RUA", "VIA", "VIALE", "CORSO", "PIAZZA", "C/", "STREET", "ST.", "AVENUE", "ROAD", "BLVD", "BOULEVARD", "LANE", "DRIVE", "WAY", "COURT", "CARRER")


def street_line(words: tuple[str, ...] = STREET_WORDS) -> str:
    """Up to five digits, white space, and further on one of the words, whole."""
    return r"^\d{1,5}\s.*\b(?:" + "|".join(re.escape(w) for w in words) + r")\b"


def display_name(token: Column) -> Column:
    """Capitals without key ending, tags and underscores; empty for what has no letter or digit or looks like a street."""
    name = F.regexp_replace(F.trim(F.regexp_replace(token, "<[^>]+>", "")), KEY_SUFFIX, "")
    name = F.upper(F.trim(F.regexp_replace(F.replace(name, F.lit("_"), F.lit(" ")), r"\s+", " ")))

    def shown(name: Column) -> Column:
        out = name
        for key, value in OVERRIDES.items():
            out = F.when(name == key, F.lit(value)).otherwise(out)
        return F.when(~name.rlike("[A-Z0-9]") | name.rlike(street_line()), F.lit("")).otherwise(out)

    return let(name, shown)


def tokens(text: Column) -> Column:
    """The parts of a comma list that aren't blank, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")


def display_names(text: Column) -> Column:
    """Distinct display names of a comma list, in order."""
    return F.array_distinct(F.filter(F.transform(tokens(text), display_name), lambda t: t != ""))


def _listed(names: Column) -> Column:
    return let(names, lambda n: F.when(F.size(n) > 0, F.array_join(n, ", ")))


def normalized_brands(text: Column) -> Column:
    return _listed(display_names(text))


def merged_lists(a: Column, b: Column) -> Column:
    """Ordered union of two comma lists; case doesn't count, the first casing wins."""
    both = F.concat(tokens(a), tokens(b))
    start = F.array().cast("array<string>")
    fresh = lambda acc, t: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(t)), acc).otherwise(F.array_append(acc, t))
    return _listed(F.aggregate(both, start, fresh))


def normalized_tags(text: Column) -> Column:
    """Only tokens that look like configuration keys are rewritten; repeats stay."""
    return _listed(F.transform(tokens(text), lambda t: F.when(t.rlike(KEY_SUFFIX), display_name(t)).otherwise(t)))


def custom_names(html: Column) -> Column:
    """Texts of anchors, else the parts of a comma list."""
    anchors = F.filter(F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), 1), lambda t: F.trim(t)), lambda t: t != "")
    return F.when(F.size(anchors) > 0, anchors).otherwise(tokens(html))


def unified_brands(old: Column, new: Column, old_custom: Column, new_custom: Column) -> Column:
    """Old, new, old custom, new custom brands: distinct display names in that order."""
    names = F.concat(tokens(old), tokens(new), custom_names(old_custom), custom_names(new_custom))
    return _listed(F.array_distinct(F.filter(F.transform(names, display_name), lambda t: t != "")))


def custom_without(custom: Column, brands: Column) -> Column:
    """Parts of the custom list that name a brand which isn't in the brands column."""
    known = display_names(brands)
    kept = F.filter(tokens(custom), lambda part: ~F.forall(custom_names(part), lambda n: F.array_contains(known, display_name(n))))
    return _listed(kept)


def title_name(brand_id: Column) -> Column:
    """Title case of a configuration key, without its ending."""
    return F.initcap(F.replace(F.regexp_replace(brand_id, KEY_SUFFIX, ""), F.lit("_"), F.lit(" ")))


def similarity(a: Column, b: Column) -> Column:
    """1 for equal letters and digits, 0.85 if one holds the other, else one minus the share of edits."""
    x, y = alnum(a), alnum(b)
    longest = F.greatest(F.length(x), F.length(y))
    inside = (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))
    return F.when(x == y, F.lit(1.0)).when(inside, F.lit(0.85)).otherwise(1 - F.levenshtein(x, y) / F.greatest(F.lit(1), longest))


def effective_brands(linked: Column, legacy: Column) -> Column:
    """Linked names, distinct and sorted, else the old column."""
    return F.coalesce(_listed(F.sort_array(F.array_distinct(F.coalesce(linked, F.array().cast("array<string>"))))), present(legacy))
