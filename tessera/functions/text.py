"""Names, addresses and general text as column expressions. A missing text counts as empty where texts are compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what they fold to (a composed letter loses its mark).
ACCENTED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
FOLDED = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"
#: Organisation suffixes; street abbreviations at the end of a line; separators of units and floors.
ORG_SUFFIX = "(inc|llc|ltd|limited|corporation|corp|company|gmbh|srl|nv|plc)+$"
STREETS = {"st": "street", "ave": "avenue", "rd": "road", "blvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court", "pl": "place", "pkwy": "parkway", "cir": "circle"}
FLOOR = r"\b\d{1,2}f\b|\bf-?\d{1,2}\b"
UNIT_CODE = r"\s*#?\s*[a-z0-9]+(?:-[a-z0-9]+)*\b"
UNITS = rf"\b(?:suite|ste)\.?{UNIT_CODE}|\bunit{UNIT_CODE}|\bbldg\.?\s*[a-z0-9]+\b|\bbuilding\s*[a-z0-9]+\b"
DIRECTIONS = r"\b(?:west|east)\b(?!\s+river\b)|\b(?:north|south|northeast|northwest|southeast|southwest|n\.?|s\.?|e\.?|w\.?)\b\.?"
MIN_CONTAINED = 8


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once and stands once in the plan, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def present(text: Column) -> Column:
    """The trimmed text, null if blank."""
    return F.nullif(F.trim(text), F.lit(""))


def alnum(text: Column) -> Column:
    """Lower case, only a-z and 0-9 (names, plain address and postal keys)."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def fold_accents(text: Column) -> Column:
    """Without accents: composed Latin letters by a table, and combining marks dropped."""
    return F.regexp_replace(F.translate(text, ACCENTED, FOLDED), r"\p{M}", "")


def address_key(line: Column) -> Column:
    """Fingerprint of a street line: accents, hyphened numbers, floors, units, directions and abbreviations level out.

    The steps stand within :func:`let`. Generated code for all of them, with the columns beside them, is one method that the
    JVM doesn't compile, being too long, and every row would cost several times as much.
    """

    def plain(line: Column) -> Column:
        t = fold_accents(F.lower(F.trim(F.coalesce(line, F.lit("")))))
        t = F.regexp_replace(t, r"(\d)-(?=\d)", "$1")
        t = F.regexp_replace(F.regexp_replace(t, FLOOR, " "), UNITS, " ")
        t = F.regexp_replace(t, DIRECTIONS, " ")
        t = F.regexp_replace(F.regexp_replace(t, r"\bave\.?\b(?!n)", "avenue "), r"\bav\.?\b(?!e)", "avenue ")
        return F.trim(F.regexp_replace(t, r"[\s,]+$", ""))

    def spelled_out(t: Column) -> Column:
        full_names = t
        for short, full in STREETS.items():
            full_names = F.regexp_replace(full_names, rf"(\s){short}\.?$", f"$1{full}")
        return F.when(t.rlike(rf"\s(?:{'|'.join(STREETS)})\.?$"), full_names).otherwise(t)

    return let(line, lambda line: F.regexp_replace(let(plain(line), spelled_out), "[^a-z0-9]+", ""))


def key_contains(a: Column, b: Column) -> Column:
    """One fingerprint extends the other (both of 8 characters or more), and not just by digits after digits."""
    longer, shorter = F.when(F.length(a) >= F.length(b), a).otherwise(b), F.when(F.length(a) >= F.length(b), b).otherwise(a)
    tail = F.substring(longer, F.length(shorter) + 1, F.length(longer))
    number_goes_on = longer.startswith(shorter) & shorter.rlike(r"\d$") & tail.rlike(r"^\d")
    return F.coalesce((F.length(a) >= MIN_CONTAINED) & (F.length(b) >= MIN_CONTAINED) & F.contains(longer, shorter) & ~number_goes_on, F.lit(False))


def names_similar(a: Column, b: Column) -> Column:
    """Equal keys, equal without organisation suffixes, or a long common beginning. Keys and stems are made once for a pair."""

    def stems_similar(s: Column) -> Column:
        p, q = s["p"], s["q"]
        short = F.least(F.length(p), F.length(q))
        same = lambda n: (F.left(p, n) == F.left(q, n)) & (short >= n)
        part = F.greatest(F.lit(10), F.ceil(0.55 * short).cast("int"))
        begins = (short >= 8) & (same(short) | same(F.lit(14)) | same(part) | (p.rlike(r"^\d") & q.rlike(r"^\d") & same(F.lit(9))))
        return (p == q) | begins

    def keys_similar(n: Column) -> Column:
        x, y = n["x"], n["y"]
        stem = lambda key: F.regexp_replace(key, ORG_SUFFIX, "")
        return (x != "") & (y != "") & ((x == y) | let(F.struct(stem(x).alias("p"), stem(y).alias("q")), stems_similar))

    return let(F.struct(alnum(a).alias("x"), alnum(b).alias("y")), keys_similar)


def name_keys(key: Column, asking: bool) -> Column:
    """Keys of which two similar names (:func:`names_similar`) share one, if one of them asks and the other doesn't.

    Without organisation suffixes, similar names are equal, or agree in ten letters, or in nine after a digit, or the shorter
    one has eight or nine letters and begins the other; for these, the shorter one's key is the whole of it.
    """

    def keys_of(stem: Column) -> Column:
        n = F.length(stem)
        keys = [F.when(n > 0, F.concat(F.lit("="), stem)), F.when(n >= 10, F.concat(F.lit("10"), F.left(stem, F.lit(10)))), F.when((n >= 9) & stem.rlike(r"^\d"), F.concat(F.lit("d"), F.left(stem, F.lit(9))))]
        for size in (8, 9):
            begins = F.left(stem, F.lit(size))
            for side, whole in (("a", asking), ("b", not asking)):
                keys.append(F.when((n == size) if whole else (n > size), F.concat(F.lit(f"{side}{size}"), begins)))
        return F.filter(F.array(*keys), lambda k: k.isNotNull())

    return let(F.regexp_replace(key, ORG_SUFFIX, ""), keys_of)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a text's words, each word framed by two blanks before and one after."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    of_word = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def street_numbers(line: Column) -> Column:
    """Numbers of two digits or more."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(line, F.lit("")), F.lit(r"(\d{2,})"), 1))


def primary_number(line: Column) -> Column:
    """The first of four digits or more, else the longest."""
    numbers = street_numbers(line)
    long = F.filter(numbers, lambda n: F.length(n) >= 4)
    longest = F.array_sort(numbers, lambda a, b: F.length(b) - F.length(a))
    return F.coalesce(F.get(long, 0), F.get(longest, 0))


def share_number(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(street_numbers(a), street_numbers(b)), F.lit(False))


def keys_align(line_a: Column, line_b: Column, plain_a: Column, plain_b: Column, key_a: Column, key_b: Column) -> Column:
    """Two street lines are the same or one extends the other; ``plain`` is :func:`alnum`, ``key`` is :func:`address_key`."""
    equal = (F.lower(F.trim(line_a)) == F.lower(F.trim(line_b))) & ~blank(line_a)
    same = ((key_a == key_b) & (F.length(key_a) >= 6)) | ((plain_a == plain_b) & (plain_a != ""))
    return F.coalesce(equal | same | key_contains(key_a, key_b) | key_contains(plain_a, plain_b), F.lit(False))


def addresses_align(a: Column, b: Column) -> Column:
    return keys_align(a, b, alnum(a), alnum(b), address_key(a), address_key(b))


def word_key(text: Column) -> Column:
    """Letters and digits of any script, single blanks, lower case."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def stable_handle(line1: Column, line2: Column, city: Column, country: Column, lat: Column, lon: Column) -> Column:
    """``loc_`` and 24 hexadecimal digits of what identifies a place; null if a part is missing."""
    line = F.coalesce(present(line1), present(line2))
    key = F.concat_ws("|", word_key(line), word_key(city), word_key(country), F.format_string("%.5f", lat), F.format_string("%.5f", lon))
    return F.when(line.isNotNull() & lat.isNotNull() & lon.isNotNull(), F.concat(F.lit("loc_"), F.substring(F.sha2(key, 256), 1, 24)))


def joined_key(*parts: Column) -> Column:
    """Lower-case trimmed parts with ``|`` between; missing ones are empty."""
    return F.concat_ws("|", *[F.coalesce(F.lower(F.trim(p.cast("string"))), F.lit("")) for p in parts])


def joined_present(sep: str, *parts: Column) -> Column:
    """The parts that aren't blank."""
    return F.concat_ws(sep, *[present(p) for p in parts])


def clean_html(text: Column) -> Column:
    """Tags out, the common entities resolved, direction marks dropped, white space collapsed."""
    t = F.regexp_replace(text, r"(?i)<br\s*/?>|</p>", " ")
    t = F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), "[\\u200e\\u200f\\u202a-\\u202e]", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def clean_address(text: Column) -> Column:
    """Escaped slashes, backslashes, words run together with numbers, and stray commas put right."""
    t = F.replace(text, F.lit("\\/"), F.lit("/"))
    t = F.regexp_replace(t, r"\\+", ", ")
    t = F.regexp_replace(t, r"([A-Za-z]{2,})(\d)", "$1 $2")
    t = F.regexp_replace(t, r"(\d)(?!(?:st|nd|rd|th)\b)([A-Za-z]{3,})", "$1 $2")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"\s*,(?:\s*,)*\s*", ", ")
    return F.trim(F.regexp_replace(t, r"^[,\s]+|[,\s]+$", ""))


def drop_trailing(text: Column, *parts: Column) -> Column:
    """A street line without the country, state and city that it ends with, in that order."""
    t = text
    for part in parts:
        ends = ~blank(part) & F.lower(t).endswith(F.lower(F.trim(part))) & (F.length(F.trim(t)) > F.length(F.trim(part)))
        t = F.when(F.coalesce(ends, F.lit(False)), F.regexp_replace(F.substring(t, F.lit(1), F.length(t) - F.length(F.trim(part))), r"[\s,]+$", "")).otherwise(t)
    return t


def fix_cell(text: Column, address: bool = False) -> Column:
    """Control characters dropped (kept in address lines), backslashes resolved, white space collapsed."""
    t = F.replace(text, F.lit("\\/"), F.lit("/"))
    t = F.regexp_replace(t, r"\\+\s*$", "")
    t = F.regexp_replace(t, r"\\+", ", " if address else " ")
    if not address:
        t = F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def slug(text: Column) -> Column:
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(t, r"[-\s]+", "-"), "^-+|-+$", "")


def non_latin(text: Column) -> Column:
    """Has a character outside ASCII and the letters of Latin-1."""
    return F.coalesce(text.rlike(r"[^\x00-\x7F\xC0-\xFF]"), F.lit(False))


def spacing_issue(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[a-zA-Z]\d|\d[a-zA-Z]"), F.lit(False))


def text_flags(text: Column) -> Column:
    """Names of what looks wrong in a text: entity, tag, spaces, commas, escape, controls."""
    tests = {"entity": r"&(?:[a-z]+|#\d+);", "tag": r"<[a-zA-Z/][^>]*>", "spaces": r"\s{2,}", "commas": r",\s*,\s*,", "escape": r"\\[nrtu/]", "control": r"[\x00-\x08\x0e-\x1f]"}
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in tests.items()]))


def display_address(line1: Column, line1_en: Column, city: Column, city_en: Column, state: Column, country: Column) -> Column:
    """English parts where there are some; the state left out if it equals the city."""
    town = F.coalesce(present(city_en), present(city))
    region = F.when(F.lower(F.trim(state)) != F.lower(F.coalesce(town, F.lit(""))), present(state))
    return F.concat_ws(", ", F.coalesce(present(line1_en), present(line1)), town, region, present(country))


def state_unless_city(state: Column, city: Column) -> Column:
    """Null where the state is blank or equals the city."""
    return F.when(~blank(state) & (F.lower(F.trim(state)) != F.coalesce(F.lower(F.trim(city)), F.lit(""))), F.trim(state))


def completeness_flag(name: Column, lat: Column, lon: Column, line1: Column, line2: Column) -> Column:
    """A name, numeric coordinates and one of the address lines."""
    return ~blank(name) & lat.isNotNull() & lon.isNotNull() & ~(blank(line1) & blank(line2))


def active(text: Column) -> Column:
    """``active``, ``true`` (any case) or blank mean true; anything else false, 1 and yes included."""
    return F.coalesce(F.lower(F.trim(text)), F.lit("")).isin("active", "true", "")


def boolean_word(text: Column, default: bool = False) -> Column:
    """TRUE or FALSE for common words, else the default."""
    word = F.lower(F.trim(text.cast("string")))
    yes, no = word.isin("true", "1", "yes", "y", "on", "active", "t"), word.isin("false", "0", "no", "n", "off", "inactive", "f")
    return F.when(yes, F.lit("TRUE")).when(no, F.lit("FALSE")).otherwise(F.lit(str(default).upper()))


def decode_escapes(text: Column) -> Column:
    """Characters for ``\\uXXXX`` and ``/uXXXX`` (the JSON reader of the engine decodes them; other backslashes stay)."""
    t = F.regexp_replace(text, r"[\\/]u([0-9a-fA-F]{4})", "\uE000u$1")
    quoted = F.replace(F.to_json(F.struct(t.alias("t"))), F.lit("\uE000"), F.lit("\\"))
    return F.when(text.rlike(r"[\\/]u[0-9a-fA-F]{4}"), F.coalesce(F.get_json_object(quoted, "$.t"), text)).otherwise(text)


def by_rules(text: Column, rules: dict[str, str]) -> Column:
    """The value of the first pattern (in order) that the lower-case text matches."""
    out = F.lit(None).cast("string")
    for pattern, value in reversed(rules.items()):
        out = F.when(F.lower(text).rlike(pattern), F.lit(value)).otherwise(out)
    return out


def cell_text(value: Column) -> Column:
    """A JSON value as text: the first three filled items of a list, a usual key of an object, else as it is."""
    listed = F.array_join(F.slice(F.filter(F.from_json(value, "array<string>"), lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), 1, 3), ", ")
    keyed = F.coalesce(*[F.get_json_object(value, f"$.{k}") for k in ("display", "value", "number", "raw", "formatted")])
    return F.coalesce(F.when(value.startswith("["), listed).when(value.startswith("{"), keyed).otherwise(F.trim(value)), F.lit(""))
