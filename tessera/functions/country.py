"""Country names: aliases, codes and inference from addresses.

Tables are parameters; the defaults hold the reference's aliases and project codes, and all of ISO 3166-1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, let

#: Lower-case aliases.
ALIASES = {
    "usa": "United States", "u.s.": "United States", "u.s.a.": "United States", "united states of america": "United States",
    "uk": "United Kingdom", "u.k.": "United Kingdom", "great britain": "United Kingdom", "britain": "United Kingdom", "england": "United Kingdom",
    "scotland": "United Kingdom", "wales": "United Kingdom", "northern ireland": "United Kingdom", "uae": "United Arab Emirates", "u.a.e.": "United Arab Emirates",
    "korea": "South Korea", "republic of korea": "South Korea", "czechia": "Czech Republic", "hk": "Hong Kong", "hong kong sar": "Hong Kong",
    "hong kong sar, china": "Hong Kong", "hong kong, china": "Hong Kong", "macao": "Macau", "macau sar": "Macau", "macao sar": "Macau", "prc": "China",
    "people's republic of china": "China", "mainland china": "China", "chinese taipei": "Taiwan", "taiwan, province of china": "Taiwan",
    "russian federation": "Russia", "iran, islamic republic of": "Iran", "syrian arab republic": "Syria", "viet nam": "Vietnam", "rsa": "South Africa",
    "brasil": "Brazil", "belgique": "Belgium", "brunei darussalam": "Brunei", "kingdom of saudi arabia": "Saudi Arabia", "macedonia": "North Macedonia",
    "suisse": "Switzerland", "bahamas, the": "Bahamas", "curacao": "Curaçao", "burma": "Myanmar", "deutschland": "Germany", "espana": "Spain", "italia": "Italy",
    "hong kong sar. china": "Hong Kong", "hong kong sar china": "Hong Kong", "macau sar, china": "Macau", "macau sar. china": "Macau", "macao sar, china": "Macau",
    "macao sar. china": "Macau", "macau, china": "Macau", "peoples republic of china": "China", "the people's republic of china": "China", "taiwan province of china": "Taiwan",
    "taiwan, china": "Taiwan", "taiwan region": "Taiwan", "taiwan region. china": "Taiwan", "taiwan region, china": "Taiwan", "united states virgin islands": "Virgin Islands, U.S.",
    "u.s. virgin islands": "Virgin Islands, U.S.", "saint-barthelemy": "Saint Barthélemy", "saint martin": "Saint Martin (French part)",
    "caribbean netherlands": "Bonaire, Sint Eustatius and Saba", "bahamas (the)": "Bahamas", "dominican republic": "Dominican Republic", "myanmar (burma)": "Myanmar",
    "saudia arabia": "Saudi Arabia", "untied states": "United States", "turkiye": "Turkey", "türkiye": "Turkey", "the netherlands": "Netherlands",
}
#: Two-letter codes of the project's own list, whose names come first.
CODES = {
    "AE": "United Arab Emirates", "AR": "Argentina", "AT": "Austria", "AU": "Australia", "BD": "Bangladesh", "BE": "Belgium", "BG": "Bulgaria",
    "BH": "Bahrain", "BN": "Brunei", "BR": "Brazil", "BY": "Belarus", "CA": "Canada", "CH": "Switzerland", "CL": "Chile", "CN": "China", "CO": "Colombia",
    "CR": "Costa Rica", "CY": "Cyprus", "CZ": "Czech Republic", "DE": "Germany", "DK": "Denmark", "EC": "Ecuador", "EE": "Estonia", "EG": "Egypt",
    "ES": "Spain", "FI": "Finland", "FR": "France", "GB": "United Kingdom", "GH": "Ghana", "GR": "Greece", "GT": "Guatemala", "HK": "Hong Kong",
    "HR": "Croatia", "HU": "Hungary", "ID": "Indonesia", "IE": "Ireland", "IL": "Israel", "IN": "India", "IS": "Iceland", "IT": "Italy", "JO": "Jordan",
    "JP": "Japan", "KE": "Kenya", "KH": "Cambodia", "KR": "South Korea", "KW": "Kuwait", "KZ": "Kazakhstan", "LA": "Laos", "LB": "Lebanon", "LK": "Sri Lanka",
    "LT": "Lithuania", "LU": "Luxembourg", "LV": "Latvia", "MA": "Morocco", "MM": "Myanmar", "MT": "Malta", "MX": "Mexico", "MY": "Malaysia", "NG": "Nigeria",
    "NL": "Netherlands", "NO": "Norway", "NZ": "New Zealand", "OM": "Oman", "PA": "Panama", "PE": "Peru", "PH": "Philippines", "PK": "Pakistan",
    "PL": "Poland", "PT": "Portugal", "PY": "Paraguay", "QA": "Qatar", "RO": "Romania", "RU": "Russia", "SA": "Saudi Arabia", "SE": "Sweden",
    "SG": "Singapore", "SI": "Slovenia", "SK": "Slovakia", "TH": "Thailand", "TN": "Tunisia", "TR": "Turkey", "TW": "Taiwan", "UA": "Ukraine",
    "US": "United States", "UY": "Uruguay", "VE": "Venezuela", "VN": "Vietnam", "ZA": "South Africa",
}
#: The other codes of ISO 3166-1 (and Kosovo's), with the usual short names.
ISO = {
    "AD": "Andorra", "AF": "Afghanistan", "AG": "Antigua and Barbuda", "AI": "Anguilla", "AL": "Albania", "AM": "Armenia", "AO": "Angola", "AQ": "Antarctica",
    "AS": "American Samoa", "AW": "Aruba", "AX": "Åland Islands", "AZ": "Azerbaijan", "BA": "Bosnia and Herzegovina", "BB": "Barbados", "BF": "Burkina Faso",
    "BI": "Burundi", "BJ": "Benin", "BL": "Saint Barthélemy", "BM": "Bermuda", "BO": "Bolivia", "BQ": "Bonaire, Sint Eustatius and Saba", "BS": "Bahamas",
    "BT": "Bhutan", "BV": "Bouvet Island", "BW": "Botswana", "BZ": "Belize", "CC": "Cocos (Keeling) Islands", "CD": "Congo, The Democratic Republic of the",
    "CF": "Central African Republic", "CG": "Congo", "CI": "Côte d'Ivoire", "CK": "Cook Islands", "CM": "Cameroon", "CU": "Cuba", "CV": "Cabo Verde",
    "CW": "Curaçao", "CX": "Christmas Island", "DJ": "Djibouti", "DM": "Dominica", "DO": "Dominican Republic", "DZ": "Algeria", "EH": "Western Sahara",
    "ER": "Eritrea", "ET": "Ethiopia", "FJ": "Fiji", "FK": "Falkland Islands (Malvinas)", "FM": "Micronesia, Federated States of", "FO": "Faroe Islands",
    "GA": "Gabon", "GD": "Grenada", "GE": "Georgia", "GF": "French Guiana", "GG": "Guernsey", "GI": "Gibraltar", "GL": "Greenland", "GM": "Gambia",
    "GN": "Guinea", "GP": "Guadeloupe", "GQ": "Equatorial Guinea", "GS": "South Georgia and the South Sandwich Islands", "GU": "Guam", "GW": "Guinea-Bissau",
    "GY": "Guyana", "HM": "Heard Island and McDonald Islands", "HN": "Honduras", "HT": "Haiti", "IM": "Isle of Man", "IO": "British Indian Ocean Territory",
    "IQ": "Iraq", "IR": "Iran", "JE": "Jersey", "JM": "Jamaica", "KG": "Kyrgyzstan", "KI": "Kiribati", "KM": "Comoros", "KN": "Saint Kitts and Nevis",
    "KP": "North Korea", "KY": "Cayman Islands", "LC": "Saint Lucia", "LI": "Liechtenstein", "LR": "Liberia", "LS": "Lesotho", "LY": "Libya", "MC": "Monaco",
    "MD": "Moldova", "ME": "Montenegro", "MF": "Saint Martin (French part)", "MG": "Madagascar", "MH": "Marshall Islands", "MK": "North Macedonia",
    "ML": "Mali", "MN": "Mongolia", "MO": "Macau", "MP": "Northern Mariana Islands", "MQ": "Martinique", "MR": "Mauritania", "MS": "Montserrat",
    "MU": "Mauritius", "MV": "Maldives", "MW": "Malawi", "MZ": "Mozambique", "NA": "Namibia", "NC": "New Caledonia", "NE": "Niger", "NF": "Norfolk Island",
    "NI": "Nicaragua", "NP": "Nepal", "NR": "Nauru", "NU": "Niue", "PF": "French Polynesia", "PG": "Papua New Guinea", "PM": "Saint Pierre and Miquelon",
    "PN": "Pitcairn", "PR": "Puerto Rico", "PS": "Palestine, State of", "PW": "Palau", "RE": "Réunion", "RS": "Serbia", "RW": "Rwanda",
    "SB": "Solomon Islands", "SC": "Seychelles", "SD": "Sudan", "SH": "Saint Helena, Ascension and Tristan da Cunha", "SJ": "Svalbard and Jan Mayen",
    "SL": "Sierra Leone", "SM": "San Marino", "SN": "Senegal", "SO": "Somalia", "SR": "Suriname", "SS": "South Sudan", "ST": "Sao Tome and Principe",
    "SV": "El Salvador", "SX": "Sint Maarten (Dutch part)", "SY": "Syria", "SZ": "Eswatini", "TC": "Turks and Caicos Islands", "TD": "Chad",
    "TF": "French Southern Territories", "TG": "Togo", "TJ": "Tajikistan", "TK": "Tokelau", "TL": "Timor-Leste", "TM": "Turkmenistan", "TO": "Tonga",
    "TT": "Trinidad and Tobago", "TV": "Tuvalu", "TZ": "Tanzania", "UG": "Uganda", "UM": "United States Minor Outlying Islands", "UZ": "Uzbekistan",
    "VA": "Holy See (Vatican City State)", "VC": "Saint Vincent and the Grenadines", "VG": "Virgin Islands, British", "VI": "Virgin Islands, U.S.",
    "VU": "Vanuatu", "WF": "Wallis and Futuna", "WS": "Samoa", "XK": "Kosovo", "YE": "Yemen", "YT": "Mayotte", "ZM": "Zambia", "ZW": "Zimbabwe",
}
#: Other English names of countries, recognized but left as they are.
OTHER_NAMES = (
    "Bolivia, Plurinational State of", "Cape Verde", "Congo, Democratic Republic of the", "Congo, The Democratic Republic of the", "Cote d'Ivoire", "Democratic Republic of the Congo",
    "Falkland Islands", "Gambia, The", "Holy See", "Ivory Coast", "Korea, Democratic People's Republic of", "Korea, Republic of", "Lao People's Democratic Republic", "Micronesia",
    "Moldova, Republic of", "Palestine", "Pitcairn Islands", "Republic of the Congo", "Reunion", "Saint Helena", "Swaziland", "Tanzania, United Republic of", "The Gambia", "Timor Leste",
    "United Republic of Tanzania", "Vatican City", "Venezuela, Bolivarian Republic of", "Aland Islands", "Saint Barthelemy", "Sint Maarten",
)
#: Names that are looked for in addresses besides the project's, and aliases that stand in addresses for something else.
ALSO_IN_ADDRESSES, NOT_IN_ADDRESSES = ("Algeria", "Ethiopia", "Iran", "Iraq", "Macau", "Monaco", "Mozambique", "Serbia"), ("wales", "saint martin")
#: Abbreviations of regions that name a country.
AU_STATES = ("NSW", "VIC", "QLD", "SA", "WA", "TAS", "ACT", "NT")
US_STATES = tuple("AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WV WI WY DC".split())
CA_PROVINCES = tuple("AB BC MB NB NL NS ON PE QC SK YT NU".split())


def _lookup(table: dict[str, str], key: Column) -> Column:
    """The table as one constant (not a node of the plan for each of its entries)."""
    text = "\x01".join(f"{k}\x02{v}" for k, v in table.items())
    return F.try_element_at(F.str_to_map(F.lit(text), F.lit("\x01"), F.lit("\x02")), key)


def normalized_country(text: Column, aliases: dict[str, str] = ALIASES, codes: dict[str, str] = CODES, iso: dict[str, str] = ISO) -> Column:
    """Alias, two-letter code (``codes`` before ``iso``), or a known name in its usual casing; else the trimmed text."""
    name = F.trim(text)
    by_code = F.when(name.rlike("^[A-Za-z]{2}$"), F.coalesce(_lookup(codes, F.upper(name)), _lookup(iso, F.upper(name))))
    by_name = _lookup({v.lower(): v for v in [*iso.values(), *codes.values(), *aliases.values()]}, F.lower(name))
    return F.coalesce(_lookup(aliases, F.lower(name)), by_code, by_name, name)


def country_key(text: Column) -> Column:
    """The usual name in lower case; rows without a country agree with one another, not with others."""
    return F.coalesce(F.lower(normalized_country(text)), F.lit(""))


def recognized(text: Column) -> Column:
    names = {n.lower() for n in (*CODES.values(), *ISO.values(), *ALIASES.values(), *OTHER_NAMES)}
    return F.coalesce(F.lower(normalized_country(text)).isin(*sorted(names)), F.lit(False))


def inferred_country(country: Column, address: Column, city: Column, state: Column, cities: dict[str, str] | None = None) -> Column:
    """The given country, else the longest country name within the address, else by state or province, else by city."""
    text = F.lower(F.concat_ws(" ", address, city, state))
    names = sorted({*CODES.values(), *ALSO_IN_ADDRESSES, *[a for a in ALIASES if len(a) > 3 and a not in NOT_IN_ADDRESSES]}, key=lambda n: (-len(n), n))
    found = F.get(F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(text, F.lower(n))), 0)
    region = F.upper(F.trim(state))
    by_region = F.when(region.isin(*AU_STATES), "Australia").when(region.isin(*US_STATES), "United States").when(region.isin(*CA_PROVINCES), "Canada")
    by_city = _lookup(cities, F.lower(F.trim(city))) if cities else F.lit(None).cast("string")
    return F.coalesce(F.when(~blank(country), normalized_country(country)), normalized_country(found), by_region, by_city)


#: Ordered patterns of a postal code before or after a town's name.
POSTAL = (r"\d{5}-\d{4}", r"[A-Z]\d[A-Z]\s?\d[A-Z]\d", r"[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}", r"\d{4}\s?[A-Z]{2}", r"\d{3}-\d{4}", r"\d{2}-\d{3}", r"\d{4,6}")


def postal_before(text: Column) -> Column:
    """Struct (postal, rest) of a text that begins with a code; null otherwise."""
    return _postal(text, r"^({0})(?:[\s,]+|$)(.*)$", 1, 2)


def postal_after(text: Column) -> Column:
    """Struct (postal, rest) of a text that ends with a code; null otherwise."""
    return _postal(text, r"^(.*?)[\s,]+({0})$", 2, 1)


def _postal(text: Column, form: str, code: int, rest: int) -> Column:
    t, out = F.trim(F.coalesce(text, F.lit(""))), F.lit(None)
    for pattern in reversed(POSTAL):
        whole = form.replace("{0}", pattern)
        out = F.when(t.rlike(whole), F.struct(F.regexp_extract(t, whole, code).alias("postal"), F.regexp_extract(t, whole, rest).alias("rest"))).otherwise(out)
    return out


def split_postal(text: Column) -> Column:
    """Struct (postal, rest): a code at the beginning, else at the end; of several kinds the first in order."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.coalesce(postal_before(t), postal_after(t), F.struct(F.lit(None).cast("string").alias("postal"), t.alias("rest")))


#: Parts of the world that may follow a country.
CONTINENTS = ("Asia", "Europe", "Americas", "Africa", "Oceania", r"Middle\s+East", "APAC")


def last_paragraph(text: Column) -> Column:
    """Struct (city, state, postal, country) of an address's last paragraph.

    ``left - country`` comes first (left: a region and its code, a code and a town, or a town), then a code and what
    follows (a town, a country, or both with a comma), then ``town, country`` or a country alone.
    """
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i),?\s*(?:" + "|".join(CONTINENTS) + r")\s*$", ""))
    dash, region, none = r"^(.+?)\s*[–-]\s*(.+)$", r"^([A-Z]{1,3})\s+(\d{3,6})$", F.lit(None).cast("string")
    part = lambda city=none, state=none, postal=none, country=none: F.struct(city.alias("city"), state.alias("state"), postal.alias("postal"), country.alias("country"))
    left, land = F.trim(F.regexp_extract(t, dash, 1)), F.regexp_extract(t, dash, 2)
    comma = r"^(.*),([^,]*)$"

    def dashed(coded: Column) -> Column:
        parts = F.when(left.rlike(region), part(state=F.regexp_extract(left, region, 1), postal=F.regexp_extract(left, region, 2), country=land))
        return parts.when(coded.isNotNull(), part(coded["rest"], postal=coded["postal"], country=land)).otherwise(part(left, country=land))

    def coded(head: Column) -> Column:
        rest = head["rest"]
        parts = F.when(F.contains(rest, F.lit(",")), part(F.trim(F.regexp_extract(rest, comma, 1)), postal=head["postal"], country=F.trim(F.regexp_extract(rest, comma, 2))))
        return parts.when(recognized(rest), part(postal=head["postal"], country=rest)).otherwise(part(rest, postal=head["postal"]))

    listed = F.when(F.contains(t, F.lit(",")), part(F.trim(F.regexp_extract(t, comma, 1)), country=F.trim(F.regexp_extract(t, comma, 2)))).otherwise(part(country=t))
    found = F.when(t.rlike(dash), let(postal_before(left), dashed)).otherwise(let(postal_before(t), lambda head: F.when(head.isNotNull(), coded(head)).otherwise(listed)))
    return let(found, lambda p: F.struct(p["city"].alias("city"), p["state"].alias("state"), p["postal"].alias("postal"), normalized_country(p["country"]).alias("country")))


def paragraph_address(paragraphs: Column) -> Column:
    """Struct (city, state, postal, country) of an address in paragraphs: the last one, and the one before for a town
    and code that it lacks (a code at its end, at its beginning, or after its last comma)."""
    before = F.when(F.size(paragraphs) > 1, F.element_at(paragraphs, -2))
    piece = F.trim(F.regexp_extract(before, "^(.*),([^,]*)$", 2))
    found = F.struct(last_paragraph(F.element_at(paragraphs, -1)).alias("last"), postal_after(before).alias("tail"), postal_before(before).alias("head"), postal_before(piece).alias("inner"))

    def filled(x: Column) -> Column:
        return (x["rest"] != "") & x["postal"].isNotNull()

    def whole(f: Column) -> Column:
        last, tail, head, inner = f["last"], f["tail"], f["head"], f["inner"]
        needs_city = last["city"].isNull() | (last["city"] == "")
        city = F.when(filled(tail), tail["rest"]).when(filled(head), head["rest"]).when(filled(inner), inner["rest"]).when(F.contains(before, F.lit(",")), piece)
        postal = F.when(filled(tail), tail["postal"]).when(needs_city & filled(head), head["postal"]).when(needs_city & filled(inner), inner["postal"])
        return F.struct(F.when(needs_city, city).otherwise(last["city"]).alias("city"), last["state"].alias("state"), F.coalesce(last["postal"], postal).alias("postal"), last["country"].alias("country"))

    return let(found, whole)


def town_line(text: Column) -> Column:
    """Struct (city, state, postal) of lines such as ``Austin, TX 78701``, ``Toronto, ON M5V 2T6`` and ``1012 AB Amsterdam``."""
    us, ca, nl = r"^(.+?),?\s+([A-Z]{2})\s+(\d{5}(?:-\d{4})?)$", r"^(.+?),?\s+([A-Z]{2})\s+([A-Z]\d[A-Z]\s?\d[A-Z]\d)$", r"^(\d{4}\s?[A-Z]{2})\s+(.+)$"
    t = F.trim(text)
    part = lambda pattern, *g: F.struct(*[(F.regexp_extract(t, pattern, k) if k else F.lit(None).cast("string")).alias(n) for k, n in zip(g, ("city", "state", "postal"))])
    return F.when(t.rlike(us), part(us, 1, 2, 3)).when(t.rlike(ca), part(ca, 1, 2, 3)).when(t.rlike(nl), part(nl, 2, 0, 1))


def combined_address(text: Column) -> Column:
    """Struct (street, city, postal, country) of ``Street, City[, Postal][, COUNTRY]``."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda t: F.trim(t)), lambda p: p != "")
    last, before = F.get(parts, F.size(parts) - 1), F.get(parts, F.size(parts) - 2)
    is_country = (F.size(parts) > 2) & (last.rlike(r"^[A-Z][A-Z .'-]{2,}$") | (last.rlike("^[A-Z]{2}$") & before.rlike(r"\d")))
    rest = F.slice(parts, 1, F.size(parts) - F.when(is_country, 1).otherwise(0))
    tail = F.get(rest, F.size(rest) - 1)
    is_postal = (F.size(rest) > 2) & tail.rlike(r"\d") & (F.length(tail) <= 10)
    core = F.slice(rest, 1, F.size(rest) - F.when(is_postal, 1).otherwise(0))
    street = F.array_join(F.slice(core, 1, F.greatest(F.lit(1), F.size(core) - 1)), ", ")
    city = F.when(F.size(core) > 1, F.get(core, F.size(core) - 1))
    return F.struct(street.alias("street"), city.alias("city"), F.when(is_postal, tail).alias("postal"), F.when(is_country, last).alias("country"))
