"""E-mail addresses, phone numbers and URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank

EMAIL = r"^[a-z0-9._%+-]+@[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}$"
#: Calling code, national prefix and shortest and longest national number of some countries.
PHONE_RULES = {
    "United States": ("1", "1", 10, 10), "Canada": ("1", "1", 10, 10), "United Kingdom": ("44", "0", 9, 10), "France": ("33", "0", 9, 9), "Germany": ("49", "0", 6, 11),
    "Italy": ("39", "", 6, 11), "Spain": ("34", "", 9, 9), "Switzerland": ("41", "0", 9, 9), "Austria": ("43", "0", 6, 12), "Netherlands": ("31", "0", 9, 9),
    "Belgium": ("32", "0", 8, 9), "Japan": ("81", "0", 9, 10), "China": ("86", "0", 9, 11), "Australia": ("61", "0", 9, 9), "India": ("91", "0", 10, 10),
    "Brazil": ("55", "0", 10, 11), "Mexico": ("52", "", 10, 10), "Singapore": ("65", "", 8, 8), "Hong Kong": ("852", "", 8, 8), "United Arab Emirates": ("971", "0", 8, 9),
}


def email(text: Column) -> Column:
    """Trimmed lower case if well formed, else empty."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(t.rlike(EMAIL), t).otherwise(F.lit(""))


def e164(text: Column, country: Column) -> Column:
    """``+`` and digits where the number fits its own prefix or the country's rule; else the trimmed text; null if blank."""
    t = F.regexp_replace(F.trim(text), r"^00", "+")
    digits = F.regexp_replace(F.regexp_replace(t, r"(?i)\s*(?:ext\.?|x)\s*\d+$", ""), r"\(0\)|\D", "")
    out = F.trim(text)
    for name, (code, trunk, least, most) in PHONE_RULES.items():
        national = F.regexp_replace(digits, f"^{trunk}", "") if trunk else digits
        fits = (country == name) & F.length(national).between(least, most) & ~t.startswith("+")
        out = F.when(fits, F.concat(F.lit("+" + code), national)).otherwise(out)
    whole = t.startswith("+") & F.length(digits).between(8, 15)
    return F.when(blank(text), None).when(whole, F.concat(F.lit("+"), digits)).otherwise(out)


def phone_like(text: Column) -> Column:
    digits = F.length(F.regexp_replace(text, r"\D", ""))
    return F.coalesce(text.rlike(r"^[+()\d][\d\s().+/-]*$") & digits.between(7, 15), F.lit(False))


def email_like(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).rlike(EMAIL), F.lit(False))


def repaired_scheme(url: Column) -> Column:
    """``http:/x``, ``HTTP//x`` and the like become ``http://x``; the scheme in lower case."""
    t = F.regexp_replace(F.trim(url), r"^(?i)(https?)\s*:?\s*/{1,}", "$1://")
    return F.when(t.rlike("^(?i)https?://"), F.concat(F.lower(F.regexp_extract(t, "^(?i)(https?://)", 1)), F.regexp_replace(t, "^(?i)https?://", ""))).otherwise(t)


def normalized_url(url: Column, base: str | None = None) -> Column:
    """Backslashes turned, relative paths joined to the base, https added; null without a host."""
    t = repaired_scheme(F.replace(F.trim(url), F.lit("\\"), F.lit("/")))
    if base:
        t = F.when(t.rlike("^/[^/]"), F.concat(F.lit(base.rstrip("/")), t)).otherwise(t)
    t = F.when(t.startswith("//"), F.concat(F.lit("https:"), t)).when(t.rlike("^https?://"), t).otherwise(F.concat(F.lit("https://"), t))
    host = F.regexp_extract(t, r"^https?://([^/?#]+)", 1)
    return F.when(~blank(url) & host.rlike(r"^[A-Za-z0-9.-]+\.[A-Za-z]{2,}(:\d+)?$"), t)


def resolved_partial(url: Column, base: Column) -> Column:
    """The page of a store from a relative ``store/storedetails/<id>`` and the brand's base; other URLs stay as they are."""
    store = F.regexp_extract(url, r"(?i)(?:^|/)store[/\\]storedetails[/\\]([^\s/]+)", 1)
    return F.when((store != "") & ~blank(base), F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/store/storedetails/"), store)).otherwise(url)


def is_image(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[^?#]*", 0)).rlike(r"\.(jpe?g|png|gif|webp|svg|bmp)$"), F.lit(False))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def without_parameters(url: Column, names: tuple[str, ...]) -> Column:
    """The URL without query parameters of these names; the rest in order."""
    kept = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*names))
    stem = F.regexp_extract(url, "^[^?#]*", 0)
    return F.when(F.size(kept) > 0, F.concat(stem, F.lit("?"), F.array_join(kept, "&"))).otherwise(stem)


LOCATION_PARAMETERS = ("lat", "lng", "lon", "latitude", "longitude", "radius", "distance", "page", "offset", "limit", "zip", "city", "country")


def url_variations(url: Column) -> Column:
    """The URL, without location parameters, without its query: distinct, in this order."""
    return F.array_distinct(F.array(url, without_parameters(url, LOCATION_PARAMETERS), F.regexp_extract(url, "^[^?#]*", 0)))


def detail_page(url: Column) -> Column:
    return F.coalesce(path(url).rlike(r"(?i)/(store|stores|storedetails|boutique|dealer|retailer|location)s?/[^/]+/?$"), F.lit(False))


def image_name(url: Column) -> Column:
    """File name of a managed picture (a UUID and an extension); null for anything else."""
    name = F.regexp_extract(url, r"(?i)/([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\.(?:png|jpe?g|webp))(?:[?#].*)?$", 1)
    return F.nullif(name, F.lit(""))
