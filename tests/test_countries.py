"""Countries beyond the common ones: the project's codes, all of ISO 3166-1, and suppliers' spellings."""

from pyspark.sql import functions as F

from tessera.functions import country
from tessera.operators import audits, dedupe

PROJECT = {"BD": "Bangladesh", "BN": "Brunei", "BY": "Belarus", "CR": "Costa Rica", "EC": "Ecuador", "EE": "Estonia", "GH": "Ghana", "GT": "Guatemala", "KH": "Cambodia", "KZ": "Kazakhstan", "LA": "Laos", "LK": "Sri Lanka", "LT": "Lithuania", "LV": "Latvia", "MM": "Myanmar", "MT": "Malta", "NG": "Nigeria", "PK": "Pakistan", "PY": "Paraguay", "UY": "Uruguay", "VE": "Venezuela"}
SPELLINGS = {"The Netherlands": "Netherlands", "turkiye": "Turkey", "Türkiye": "Turkey", "Taiwan, China": "Taiwan", "dominican republic": "Dominican Republic", "Hong Kong SAR China": "Hong Kong", "U.S. Virgin Islands": "Virgin Islands, U.S.", "Saint Martin": "Saint Martin (French part)"}
OTHERS = {"AD": "Andorra", "li": "Liechtenstein", "MC": "Monaco", "DO": "Dominican Republic", "PR": "Puerto Rico", "MO": "Macau", "XX": "XX", " Narnia ": "Narnia"}


def test_codes_and_spellings(spark):
    cases = PROJECT | SPELLINGS | OTHERS
    df = spark.createDataFrame([(k,) for k in cases], "a string")
    assert {r.a: r.c for r in df.select("a", country.normalized_country(F.col("a")).alias("c")).collect()} == cases
    assert len({**country.ISO, **country.CODES}) == 250 and not set(country.ISO) & set(country.CODES)


def test_recognized(spark):
    cases = {"NG": True, "Nigeria": True, "andorra": True, "Ivory Coast": True, "The Netherlands": True, "VI": True, "Paris": False, "London": False, "New York": False, "XX": False, "": False}
    df = spark.createDataFrame([(k,) for k in cases], "a string")
    assert {r.a: r.c for r in df.select("a", country.recognized(F.col("a")).alias("c")).collect()} == cases
    audit = {r.verdict: r.n_rows for r in audits.country_audit(df.withColumnRenamed("a", "country")).collect()}
    assert audit == {"blank": 1, "canonical": 2, "needs_normalizing": 4, "unrecognized": 4}


def test_code_and_name_link(spark):
    """Rows of one place are linked whether they give a code, a name or another spelling."""
    rows = [(f"h{n}", f"Shop {n}", "12 Long Street", "Lagos", c, 6.45 + n / 10, 3.39, False, "", None) for n, c in enumerate(["NG", "Nigeria", "nigeria "])]
    rows += [(f"k{n}", f"Shop {n}", "12 Long Street", "Delft", c, 52.0 + n / 10, 4.3, False, "", None) for n, c in enumerate(["NL", "The Netherlands"])]
    places = spark.createDataFrame(rows, "handle string, name string, line1 string, city string, country string, lat double, lon double, is_premium boolean, brands string, updated_at date")
    assert {r.handle: r.cluster for r in dedupe.clusters(places).collect()} == {"h0": "h0", "h1": "h0", "h2": "h0", "k0": "k0", "k1": "k0"}


def test_streets_named_like_countries(spark):
    """Names of countries that are common in addresses elsewhere aren't taken from an address."""
    df = spark.createDataFrame([("12 Rue Saint Martin", "Paris", ""), ("5 Peachtree St, Georgia", "Atlanta", "GA"), ("5 Broad St", "Newark, New Jersey", "NJ"), ("1 Allen Ave, Nigeria", "Lagos", "")], "a string, c string, s string")
    assert [r.x for r in df.select(country.inferred_country(F.lit(""), F.col("a"), F.col("c"), F.col("s")).alias("x")).collect()] == [None, "United States", "United States", "Nigeria"]
