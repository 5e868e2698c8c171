"""Queries that apply one function each to texts derived from every customer, with what it has to give.

A case is an input and the value wanted for it, texts in which ``{k}`` and ``{g}`` stand for numbers of the row. Row k has
case k modulo their number; the SQL states the values wanted.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import brands as B
from ..functions import contact as C
from ..functions import country as N
from ..functions import geo, records
from ..functions import text as X
from ..operators import inference, ranking
from .places import customers


class Either(str):
    """A wanted text that only rows have for which ``test`` holds, an SQL condition on k and g; others have ``other``."""

    def __new__(cls, test: str, text: str, other: str) -> Either:
        out = super().__new__(cls, text)
        out.test, out.other = test, other
        return out


#: name: (function of the inputs, cases (inputs..., value wanted)).
CASES: dict[str, tuple[Callable[..., Column], list[tuple]]] = {}


def quoted(text: str, spark: bool) -> str:
    return "'" + (text.replace("\\", "\\\\").replace("'", "\\'") if spark else text.replace("'", "''")) + "'"


def expression(text: str | None, spark: bool) -> str:
    """A text in which {k} and {g} are put in, in either dialect."""
    kind = "string" if spark else "varchar"
    if text is None:
        return f"cast(NULL as {kind})"
    if isinstance(text, Either):
        return f"CASE WHEN {text.test} THEN {expression(str(text), spark)} ELSE {expression(text.other, spark)} END"
    parts = [f"cast({p[1]} as {kind})" if p in ("{k}", "{g}") else quoted(p, spark) for p in re.split(r"(\{[kg]\})", text) if p]
    return "concat(" + ", ".join(parts) + ")" if len(parts) > 1 else parts[0] if parts else "''"


def case(name: str, f: Callable[..., Column], *rows: tuple) -> None:
    """Register cases: each row is the inputs and, last, the value wanted; texts, or None for null."""
    CASES[name] = (f, list(rows))


def listed(c: Column) -> Column:
    return F.array_join(c, "|", "-")


def fields(c: Column, *names: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(c[n].cast("string"), F.lit("-")) for n in names])


def choose(texts: list[str | None], spark: bool) -> str:
    return f"CASE k % {len(texts)} " + " ".join(f"WHEN {n} THEN {expression(t, spark)}" for n, t in enumerate(texts)) + " END"


def run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        f, rows = CASES[name]
        keyed = customers(spark, sf_dir).select(F.col("c_custkey").alias("k"), F.expr("c_custkey div 3").alias("g"))
        names = [f"in{n}" for n in range(len(rows[0]) - 1)]
        inputs = keyed.select("k", *[F.expr(choose([r[n] for r in rows], True)).alias(c) for n, c in enumerate(names)])
        return inputs.select("k", f(*map(F.col, names)).cast("string").alias("value"))

    query.__name__ = name
    return query


def sql(name: str) -> str:
    return f"SELECT k, {choose([r[-1] for r in CASES[name][1]], False)} AS value FROM (SELECT c_custkey AS k, c_custkey // 3 AS g FROM customer)"


# Countries and addresses

case("country_inferred", lambda c, a, t, s: N.inferred_country(c, a, t, s), ("de", "x {k}", "", "", "Germany"), ("", "{k} Rue de Rivoli, Paris, France", "", "", "France"), ("", "{k} Main Street", "Austin", "TX", "United States"), ("", "{k} King St", "Toronto", "ON", "Canada"), ("", "{k} George St", "Sydney", "NSW", "Australia"), ("", "{k} Somewhere", "Nowhere", "", None))
case("country_recognized", lambda c: N.recognized(c), ("France", "true"), ("usa", "true"), ("Atlantis {k}", "false"), ("", "false"), (None, "false"), ("KZ", "true"))
case("country_key", N.country_key, (" usa ", "united states"), ("UNITED KINGDOM", "united kingdom"), (None, ""), ("Atlantis {g}", "atlantis {g}"))
case("state_unless_city", lambda s, c: X.state_unless_city(s, c), ("Dubai", " dubai ", None), ("TX", "Austin {k}", "TX"), ("", "Paris", None), (" CA ", None, "CA"))
case("postal_split", lambda t: fields(N.split_postal(t), "postal", "rest"), ("75001 Paris {k}", "75001|Paris {k}"), ("Town {k}, 78701-1234", "78701-1234|Town {k}"), ("SW1A 1AA London", "SW1A 1AA|London"), ("1012 AB Amsterdam {g}", "1012 AB|Amsterdam {g}"), ("Tokyo 100-0001", "100-0001|Tokyo"), ("Village", "-|Village"), ("00-950 Warszawa", "00-950|Warszawa"))
case("town_line", lambda t: fields(N.town_line(t), "city", "state", "postal"), ("Austin, TX 78701", "Austin|TX|78701"), ("Town{k}, ON M5V 2T6", "Town{k}|ON|M5V 2T6"), ("1012 AB Amsterdam", "Amsterdam|-|1012 AB"), ("City{g}, NY 10001-1234", "City{g}|NY|10001-1234"))
case("combined_address", lambda t: fields(N.combined_address(t), "street", "city", "postal", "country"), ("{k} Main St, Town {g}, 75001, FRANCE", "{k} Main St|Town {g}|75001|FRANCE"), ("{k} Main St, Town", "{k} Main St|Town|-|-"), ("{k} High Road, Floor 2, Leeds, LS1", "{k} High Road, Floor 2|Leeds|LS1|-"))
case("paragraph_address", lambda p: fields(N.paragraph_address(F.split(p, "/")), "city", "state", "postal", "country"), ("Rue {k} Haute/75001 Paris", "Paris|-|75001|-"), ("Rue {k} Haute/1204 Geneva, Switzerland", "Geneva|-|1204|Switzerland"), ("X{k}/Tokyo 141-0021/Japan", "Tokyo|-|141-0021|Japan"), ("X{k}/Songpa-gu, Seoul/South Korea", "Seoul|-|-|South Korea"), ("X{k}/1017 RZ Amsterdam - Netherlands", "Amsterdam|-|1017 RZ|Netherlands"), ("X{k}/10310 Thailand", "-|-|10310|Thailand"), ("X{k}/WA 6017 – Australia", "-|WA|6017|Australia"), ("X{k}/Malaysia, Asia", "-|-|-|Malaysia"), ("X{k}/KL Gateway, 59200 Kuala Lumpur/Malaysia", "Kuala Lumpur|-|59200|Malaysia"))
case("street_shared", lambda a, b: X.share_number(a, b), ("{k} A 100 St", "B 100", "true"), ("12 X", "13 X", "false"), ("5 X", "5 X", "false"), (None, "12", "false"))
case("street_primary", X.primary_number, ("12 Rue 1234 X {g}x", "1234"), ("77 Road", "77"), ("Road", None), ("123 or 45", "123"))
case("address_aligned", lambda a, b: X.addresses_align(a, b), ("{k} Main St", "{k} main street", "true"), ("{k} Main St, Suite 5", "{k} Main Street", "true"), ("12 Main Plaza", "99 Other Road", "false"), ("", "", "false"))
case("address_verify_key", lambda a, b, c: X.joined_key(a, b, c), (" {k} Main ", "Paris", None, "{k} main|paris|"), ("A", "", "FR", "a||fr"))
case("address_query", lambda a, b, c: X.joined_present(", ", a, b, c), ("{k} Main", " ", "France", "{k} Main, France"), (None, "Paris {g}", "France ", "Paris {g}, France"))
case("address_cleaned", X.clean_address, ("{k} Main St\\\\Paris", "{k} Main St, Paris"), ("Street12 A", "Street 12 A"), ("1st Avenue ,, Paris ,", "1st Avenue, Paris"), ("a\\/b  c", "a/b c"))
case("address_trailing", lambda t, c, s, y: X.drop_trailing(t, c, s, y), ("{k} Main, Paris, France", "France", None, "Paris", "{k} Main"), ("{k} Main", "France", "X", "Paris", "{k} Main"), ("Paris", "France", None, "Paris", "Paris"))
case("address_display", lambda a, e, c, d, s, n: X.display_address(a, e, c, d, s, n), ("{k} Straße", "{k} Street", "Köln", "Cologne", "NRW", "Germany", "{k} Street, Cologne, NRW, Germany"), ("{k} Road", None, "Dubai", None, "dubai", "UAE", "{k} Road, Dubai, UAE"))
case("stable_coordinates", lambda a, b: F.concat_ws("|", geo.format_coordinate(geo.strict_coordinate(a, 90.0)), geo.format_coordinate(geo.strict_coordinate(b, 180.0))), ("12.5", "-170.25", "12.5000000|-170.2500000"), ("91", "10", "10.0000000"), ("x", "181", ""), ("NaN", " 7 ", "7.0000000"))

# Brands and tags

case("brand_display", B.display_name, ("hublot_stores", "HUBLOT"), ("88 Rue du Rhone", ""), ("88 Wayne Watches {k}", "88 WAYNE WATCHES {k}"), ("frederique constant", "FRÉDÉRIQUE CONSTANT"), ("<b>Brand</b> {k}", "BRAND {k}"), (" - ", ""), ("uboat_retailers", "U-BOAT"), ("12 Parkway Time", "12 PARKWAY TIME"), ("9 The Way", ""))
case("brand_merge", B.merged_lists, ("A, b{k}", "B{k}, c", "A, b{k}, c"), (None, "x", "x"), ("", None, None))
case("brand_tags", B.normalized_tags, ("vip, hublot_stores, vip", "vip, HUBLOT, vip"), ("x{k}", "x{k}"), (None, None))
case("brand_custom", lambda h: listed(B.custom_names(h)), ('<a href="#">One {k}</a> and <a>Two</a>', "One {k}|Two"), ("One, {k}", "One|{k}"), (None, ""))
case("brand_unified", B.unified_brands, ("a_stores", "B", '<a href="#">c {k}</a>', "a", "A, B, C {k}"), (None, None, None, None, None))
case("brand_custom_rest", B.custom_without, ("Alpha, Beta {k}", "alpha_stores", "Beta {k}"), ("Alpha", "ALPHA", None))
case("brand_effective", lambda linked, old: B.effective_brands(F.split(linked, ";"), old), ("B{k};A;B{k}", "old", "A, B{k}"), (None, " old {g} ", "old {g}"), (None, "", None))
case("brand_title", B.title_name, ("grand_seiko_stores", "Grand Seiko"), ("tag_heuer_{k}_dealers", "Tag Heuer {k}"))
case("brand_similarity", lambda a, b: F.round(B.similarity(a, b), 2), ("Hublot {k}", "HUBLOT-{k}", "1.0"), ("Grand Seiko", "Seiko", "0.85"), ("abcd", "abxx", "0.5"))
case("name_similar", lambda a, b: X.names_similar(a, b), ("Shop {k} Inc", "shop {k} LLC", "true"), ("Maison du Temps {k}", "Maison du Temps Paris", "true"), ("Alpha", "Beta", "false"), ("", "", "false"))
case("key_contained", lambda a, b: X.key_contains(a, b), ("12longavenue", "12longavenuemall", "true"), ("longroad12", "longroad123", "false"), ("short", "shorter", "false"))
case("trigram_similarity", lambda a, b: F.round(X.jaccard(X.trigrams(a), X.trigrams(b)), 3), ("word", "words", "0.571"), ("abc", "abc", "1.0"), ("one two", "two one", "1.0"), ("abc", "xyz", "0.0"))
case("field_similarity", lambda a, b: F.round(inference.name_similarity(a, b), 3), ("storeName", "store_name", "1.0"), ("Address Line 1", "address.line1", "1.0"), ("Phone 2", "phone3", "0.9"), ("a1b", "a2c", "0.333"), ("name", "storename", "0.7"), ("latitude", "phone", "0.0"))

# Text

case("boolean_word", lambda t: X.boolean_word(t), ("Yes", "TRUE"), (" off ", "FALSE"), ("maybe {k}", "FALSE"), (None, "FALSE"), ("1", "TRUE"))
case("escapes_decoded", X.decode_escapes, ("caf\\u00e9 {k}", "café {k}"), ("a/u0026b", "a&b"), ("plain \\n {g}", "plain \\n {g}"))
case("cell_value", X.cell_text, ('["a{k}","","b","c","d"]', "a{k}, b, c"), ('{"value":"v{g}"}', "v{g}"), (" x {k} ", "x {k}"), (None, ""))
case("cell_fixed", lambda t: X.fix_cell(t), ("a\\/b {k}", "a/b {k}"), ("tail\\", "tail"), ("x\\\\y  z", "x y z"))
case("cell_fixed_address", lambda t: X.fix_cell(t, True), ("{k} Main\\\\Paris", "{k} Main, Paris"), ("a\\/b", "a/b"))
case("text_flags", lambda t: listed(X.text_flags(t)), ("a &amp; b {k}", "entity"), ("<b>x</b>  y", "tag|spaces"), ("a,,,b", "commas"), ("plain {k}", ""), ("x\\n", "escape"))
case("text_non_latin", X.non_latin, ("Zürich {k}", "false"), ("Москва", "true"), ("東京 {k}", "true"), (None, "false"), ("ž", "true"))
case("text_spacing", X.spacing_issue, ("Street12 {k}", "true"), ("12 Street", "false"), ("a{k}", "true"), (None, "false"))
case("postal_key", X.alnum, ("SW1A 1AA", "sw1a1aa"), ("M5V-2T6 ", "m5v2t6"), (None, ""), ("{k} ", "{k}"))
case("slug_of_name", X.slug, (" Maison du Temps {k} ", "maison-du-temps-{k}"), ("A & B -- C", "a-b-c"), (None, ""), ("-x-", "x"))

# Contacts and URLs

#: A number has 15 digits at most; a longer one stays as it is written, which rows from k = 100 000 on have.
_FITS = Either("length(cast(k as varchar)) <= 5", "+4122{k}000000", "+41 22 {k}000000 ext. 5")
#: What is left of ``call {k}`` has the nine digits of a French number from k = 100 000 000 on.
_CALLED = Either("length(cast(k as varchar)) <> 9", "call {k}", "+33{k}")
case("phone_international", lambda p, c: C.e164(p, c), ("+41 22 {k}000000 ext. 5", "Switzerland", _FITS), ("(212) 555-0199", "United States", "+12125550199"), ("0044 20 7946 0958", "France", "+442079460958"), ("01 42 68 53 00", "France", "+33142685300"), ("call {k}", "France", _CALLED), ("", "France", None))
case("phone_like", C.phone_like, ("+41 22 1234567", "true"), ("12", "false"), ("abc {k}", "false"), ("(212) 555-0199", "true"))
case("email_like", C.email_like, ("Info{k}@Shop.example.com", "true"), ("a@b", "false"), ("{k}", "false"), (None, "false"))
case("url_scheme", C.repaired_scheme, ("http:/x{k}.com", "http://x{k}.com"), ("HTTPS//x.com/A", "https://x.com/A"), ("x.com", "x.com"), ("Http://Y.com", "http://Y.com"))
case("url_based", lambda u: C.normalized_url(u, "https://base.example.com/"), ("/stores/{k}", "https://base.example.com/stores/{k}"), ("//cdn.example.com/{k}", "https://cdn.example.com/{k}"), ("localhost", None), ("", None), ("shop{k}.example.com", "https://shop{k}.example.com"))
case("url_partial", C.resolved_partial, ("store/storedetails/{k}", "https://base.example.com", "https://base.example.com/store/storedetails/{k}"), ("https://x.com/{k}", "https://base.example.com", "https://x.com/{k}"), ("x/store/storedetails/{g}/", "https://base.example.com/", "https://base.example.com/store/storedetails/{g}"), ("store/storedetails/{k}", "", "store/storedetails/{k}"))
case("url_variations", lambda u: listed(C.url_variations(u)), ("https://x.com/s?lat=1&q={k}&lng=2", "https://x.com/s?lat=1&q={k}&lng=2|https://x.com/s?q={k}|https://x.com/s"), ("https://x.com/{k}", "https://x.com/{k}"))
case("url_detail", C.detail_page, ("https://x.com/stores/paris-{k}", "true"), ("https://x.com/stores/", "false"), ("https://x.com/en/boutique/a/", "true"), ("https://x.com/about", "false"))
case("url_image", lambda u: C.is_image(u), ("https://x.com/{k}.PNG?x=1", "true"), ("https://x.com/{k}.html", "false"), (None, "false"))
case("url_image_name", C.image_name, ("https://x.com/i/0123abcd-0123-0123-0123-0123456789ab.png?w={k}", "0123abcd-0123-0123-0123-0123456789ab.png"), ("https://x.com/i/{k}.png", None), ("https://x.com/../x.png", None))
case("url_relevant", lambda u: ranking.relevant(u), ("https://x.com/api/stores?{k}", "true"), ("https://x.com/app.js", "false"), ("https://www.google-analytics.com/stores", "false"), ("https://x.com/about/{k}", "false"))
case("url_kind", ranking.locator_kind, ("https://x.com/s?north=1&south={k}", "viewport"), ("https://x.com/s?radius={k}", "radius"), ("https://x.com/s?country=FR", "country"), ("https://x.com/s?page={k}", "paginated"), ("https://x.com/{k}.json", "single"))
case("url_score", ranking.endpoint_score, ("https://x.com/api/stores.json", "50"), ("https://x.com/a.css", "0"), ("https://x.com/{k}", "0"), ("https://x.com/store-locator/search", "70"))

# Numbers and coordinates

case("number_prefix", geo.parse_number, ("12.5abc", "12.5"), (" -7", "-7.0"), ("x{k}", None), ("1e3", "1000.0"), (".5 ", "0.5"))
case("integer_prefix", geo.parse_integer, ("12.9", "12"), ("{k}px", "{k}"), ("abc", None), ("-3 x", "-3"))
case("coordinate_code", lambda t: geo.coordinate_error(t, 90.0), ("", "empty"), ("x{k}", "not_a_number"), ("NaN", "invalid_number"), ("95", "out_of_range"), ("-45.5", None), ("Infinity", "invalid_number"))
case("coordinate_decimals", geo.decimals, ("1.2300", "2"), ("12", "0"), ("1.12345678", "8"), ("-7.10", "1"))
case("coordinate_decision", lambda a, b, c, d: geo.correction(*[x.try_cast("double") for x in (a, b, c, d)]), ("10", "20", "10", "20.001", "keep"), ("10", "20", "11", "20", "replace"), ("10", "20", None, None, "no_geocode"), ("0", "0", "10", "20", "replace"))
case("great_circle", lambda a, b, c, d: F.round(geo.great_circle(*[x.try_cast("double") for x in (a, b, c, d)]) / 1000, 0).cast("int"), ("0", "0", "0", "1", "111"), ("10", "20", "10", "20", "0"), ("0", "0", "0", "180", "20015"))

# Records

case("record_listed", lambda d: records.value(d, "a.1.b"), ('{"a":[{"b":"x"},{"b":"y{k}"}]}', "y{k}"), ('{"a":[]}', None), (None, None))
case("record_caseless", lambda d: records.caseless(d, "Store.name"), ('{"STORE":{"Name":"n{k}"}}', "n{k}"), ('{"Store":{"name":"exact","NAME":"other"}}', "exact"), ('{"x":1}', None))

case("record_found", lambda d: listed(records.record_array(d)), ('{"data":{"stores":[{"id":"{k}"}]}}', '{"id":"{k}"}'), ('[{"id":"1"},{"id":"{k}"}]', '{"id":"1"}|{"id":"{k}"}'), ('{"stores":[]}', ""), ("x", None))
case("record_jsonp", records.jsonp_body, ('cb({"a":"({k})"});', '{"a":"({k})"}'), ('{"a":{k}}', '{"a":{k}}'), ("window.cb([1,{k}])", "[1,{k}]"), ('cb({"a":"){k}\\""}); other({"b":2});', '{"a":"){k}\\""}'), ('/**/cb({"a":{k}}); // note (x)', '{"a":{k}}'), ("<p>(see {k})</p>", "<p>(see {k})</p>"))
case("record_joined", lambda d: records.field(d, {"join": ["a", "b", "c"], "separator": ", ", "skip_tokens": ["n/a"]}), ('{"a":"x{k}","b":"N/A","c":"y"}', "x{k}, y"), ('{"a":"","b":"q"}', "q"), ("{}", None))
case("record_structure", inference.structure, ('[{"a":{k}}]', "flat_array"), ('{"type":"FeatureCollection","features":[]}', "geojson"), ('{"stores":[{"a":{k}}]}', "nested_array"), ('{"x":{"items":[{"a":{k}}]}}', "nested_array"), ('{"a":{k}}', "unknown"), ("x", "unknown"))
case("record_coordinates", inference.coordinate_format, ('{"latitude":1.5,"longitude":{k}}', "latitude_longitude"), ('[{"lat":1,"lng":{k}}]', "lat_lng"), ('{"coordinates":[2,1]}', "coordinates_array"), ('{"location":{"x":"{k}"}}', "nested_location"), ('{"geoLat":1,"geoLng":2}', "geo_lat_lng"), ('{"location":"{k}"}', "unknown"), ("x", "unknown"))
case("record_hours", inference.hours_format, ('{"Monday":"9","Tuesday":"9","Wednesday":"9","Thursday":"9","Friday":"{k}"}', "day_keys"), ('{"openingHours":["Mo 9-5"]}', "hours_array"), ('{"hours":"Mon {k}"}', "hours_string"), ('{"monday":"9-5"}', "unknown"), ("x", "unknown"))
case("strategy", lambda c, k, r, m: ranking.strategy(c, k, r == "y", m == "y"), ('{"post_per_country":{"a":{k}}}', "paginated", "n", "n", "post_per_country"), ('{"stores_by_api_countries":{"countries_url":"https://x/all","stores_url_template":"https://x/{country_id}"}}', "single", "n", "n", "stores_by_api_countries"), ('{"stores_by_api_countries":{"countries_url":" ","stores_url_template":"https://x/{country_id}"}}', "single", "n", "n", "single_call"), ('{"stores_by_api_countries":{"stores_url_template":"https://x/{country_id}"}}', "viewport", "n", "n", "viewport_expansion"), ('{"pagination_fetch_urls":["https://x/{k}"]}', "single", "n", "n", "pagination_fetch_urls"), ('{"pagination_fetch_urls":[]}', "viewport", "n", "n", "viewport_expansion"), ('{"force_radius_multi_point":true,"radius_centers":[1]}', "paginated", "y", "n", "radius_expansion"), (None, "paginated", "y", "y", "radius_expansion"), (None, "paginated", "y", "n", "paginated"), ("{}", "country", "n", "n", "country_expansion"), ("{}", "radius", "n", "n", "radius_expansion"), ('{"force_single_call":true}', "radius", "y", "y", "single_call"), ('{"geohash_prefix_expansion":true}', "single", "n", "n", "geohash_prefixes"), (None, "single", "n", "n", "single_call"))
case("trust_group", lambda u, v, n: ranking.trust_group(u, v == "y", n.try_cast("int")), ("https://x.com/stores/{k}", "y", "3", "2"), ("https://x.com/{k}", "n", "9", "1"), ("https://pixel.x.com/{k}", "y", "2", "0"), ("https://pixel.x.com/{k}", "y", "5", "2"), ("https://x.com", "y", None, "1"))
